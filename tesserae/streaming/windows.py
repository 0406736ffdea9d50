"""Streaming forms of the incremental jobs: tumbling windows with a lateness bound, and keyed de-duplication."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.plans.scale import shared_dir


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet files of a folder or single file."""
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    one = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]" if one else path)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return what it wrote."""
    spark = stream.sparkSession
    work = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    else:
        write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{work}/out")  # noqa: E731  (complete mode: the whole result each time)
        q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{work}/out")


def tumbling(stream: DataFrame, time: str, value: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, by, n, total) of event-time windows; rows later than ``late`` behind the newest are dropped."""
    rows = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return rows.groupBy(F.window("_t", width).alias("_w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("_w.start").alias("start"), by, "n", "total")


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str = "2 hours") -> DataFrame:
    """Each key once, by state that is dropped after ``late``."""
    return stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys).drop("_t")


def carried_filter(stream: DataFrame, entity: str, order: str, value: str, q: float = 0.01, r: float = 1.0) -> DataFrame:
    """(entity, order, value, filtered): a random-walk filter whose state (level, variance) is carried from batch to batch
    of the stream, an entity a state. Within a batch an entity's rows are taken in ``order``."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    out = f"{entity} string, {order} {stream.schema[order].dataType.simpleString()}, {value} double, filtered double"

    def step(key: tuple, batches, state: GroupState):
        rows = pd.concat(list(batches)).sort_values(order)
        level, p = state.get if state.exists else (float("nan"), 1.0)
        found = []
        for x in rows[value].astype(float):
            level = x if level != level else level
            p += q
            g = p / (p + r)
            level += g * (x - level)
            p *= 1 - g
            found.append(level)
        state.update((level, p))
        yield pd.DataFrame({entity: [key[0]] * len(rows), order: rows[order].to_numpy(), value: rows[value].astype(float).to_numpy(), "filtered": found})

    rows = stream.where(F.col(value).isNotNull() & F.col(entity).isNotNull()).withColumn(entity, F.col(entity).cast("string")).select(entity, order, value)
    return rows.groupBy(entity).applyInPandasWithState(step, out, "level double, p double", "append", GroupStateTimeout.NoTimeout)

"""Helpers that keep plans safe at scale.

* :func:`cut` ends a lineage in the folder all executors share.
* :func:`lookup_join` joins a large side to a small one: broadcast behind a row check,
  otherwise a shuffle join whose hot keys are salted.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A lookup side up to this many rows is broadcast (counted, never guessed).
BROADCAST_ROWS = 50_000
#: A key is hot when it holds more than this share of an average task's rows.
HOT_TASKS = 4
SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors: ``spark.checkpoint.dir``. Where that is unset, a session on one machine gets a
    temporary folder; on a cluster that is an error, as no folder of one machine would do."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            place = jvm_dir.get()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tesserae-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(place)
    return place


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once with a reliable checkpoint, so that iterations don't recompute it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it needs."""
    return df.limit(rows + 1).count() <= rows


def _same(left: Column, right: Column, null_safe: bool) -> Column:
    return left.eqNullSafe(right) if null_safe else left == right


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``big`` with ``small`` (unique per key) on ``keys``.

    ``small`` must already be materialised (see :func:`cut`): it is counted first. Up to ``max_rows`` rows it is
    broadcast. Beyond that both sides are shuffled on the keys, and the keys that hold more than their share of ``big``
    are spread over ``salts`` tasks, the matching rows of ``small`` being repeated once a salt. Null keys match nothing.
    """
    if at_most(small, max_rows):
        return big.join(F.broadcast(small), keys, how)
    counts = big.groupBy(*keys).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(1, HOT_TASKS * total // max(1, parts))
    hot = cut(counts.where(F.col("count") > least).drop("count").withColumn("_hot", F.lit(True)))  # at most parts / HOT_TASKS keys
    salted = big.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    )
    copies = small.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    )
    return salted.drop("_hot").join(copies.drop("_hot"), [*keys, "_salt"], how).drop("_salt")


def running_total(df: DataFrame, order: str, value: str, descending: bool = False) -> DataFrame:
    """``df`` (one row a distinct ``order`` value) with ``_upto``, the running sum of ``value``, and ``_all``, its total.

    Range-sorted: partitions are summed on their own and shifted by the totals of those before, so no task ever holds
    more than a range partition; the totals are one row a partition."""
    key = F.desc(order) if descending else F.asc(order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_t")).orderBy("_part").collect()  # one row a partition
    before, at = {}, 0
    for r in totals:
        before[r["_part"]], at = at, at + (r["_t"] or 0)
    shift = F.lit(0)
    for p, b in before.items():
        shift = F.when(F.col("_part") == p, F.lit(b)).otherwise(shift)
    w = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("_upto", F.sum(value).over(w) + shift).withColumn("_all", F.lit(at)).drop("_part")


def grouped_running(counts: DataFrame, groups: list[str], order: str, value: str) -> DataFrame:
    """``counts`` (one row a (groups, order)) with ``_upto``, the running sum of ``value`` in its group by ``order``, and
    ``_all``, the group's total. As :func:`running_total`, a group is spread over as many range partitions as it fills;
    the offsets of partitions are one row a (group, partition) that meet."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)])
    ranged = cut(counts.repartitionByRange(parts, *groups, order).withColumn("_p", F.spark_partition_id())).withColumn("_key", key)
    w = Window.partitionBy("_key")
    sums = ranged.groupBy("_key", "_p").agg(F.sum(value).alias("_t"))
    offsets = sums.select("_key", "_p", F.coalesce(F.sum("_t").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_t").over(w).alias("_all"))
    running = F.sum(value).over(Window.partitionBy("_key", "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_run", running).join(offsets, ["_key", "_p"]).select(*counts.columns, (F.col("_run") + F.col("_before")).alias("_upto"), "_all")


def quantiles(df: DataFrame, groups: list[str], x: str, probabilities: dict[str, float]) -> DataFrame:
    """(groups, names of ``probabilities``): linear quantiles of the known values of each group, from value counts that
    are range-sorted, so neither a group nor a value is ever held by one task. Without groups there is one row."""
    keys = groups or ["_one"]
    known = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).withColumns({} if groups else {"_one": F.lit(1)})
    counts = known.groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    at = grouped_running(counts, keys, "_x", "_n")
    picks = []
    for name, p in probabilities.items():
        place = F.round((F.col("_all") - 1) * F.lit(float(p)), 9)
        low = F.floor(place)
        picks += [F.min(F.when(F.col("_upto") >= low + 1, F.col("_x"))).alias(f"_a_{name}"), F.min(F.when(F.col("_upto") >= F.least(low + 2, F.col("_all")), F.col("_x"))).alias(f"_b_{name}"), F.max(place - low).alias(f"_w_{name}")]
    found = at.groupBy(*keys).agg(*picks)
    between = lambda n: (F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_w_{n}")).alias(n)
    return found.select(*groups, *[between(n) for n in probabilities])

"""Percentiles of very large numeric columns (problem 6): cumulative frequencies in SQL terms.

1. :func:`value_counts` reduces a column to (group, value, n). This is the summary that can be kept: summaries of parts or
   days are put together by :func:`merge`, which adds counts.
2. :func:`cumulative` range-sorts the counts, sums them inside each range partition with a running window, and adds the
   totals of all earlier partitions of the group (offsets), so a group of any size is spread over as many partitions as
   it fills.
3. :func:`percentiles` picks the first value whose cumulative count reaches each target rank ceil(p * n).

The result is exact (``error`` 0) with ``relative_error=0``. With a positive one, values are first rounded to a geometric
grid, which bounds the distinct values of a group (and so the summary) at any data size; the returned value then differs
from the exact percentile by at most that share of it. Summaries to be merged must use the same grid.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.plans.scale import cut


def on_grid(x: Column, relative_error: float) -> Column:
    """``x`` rounded so that it changes by at most ``relative_error`` of itself; 0 and infinities stay."""
    x = x.cast("double") + 0.0
    if not relative_error:
        return x
    step = math.log1p(relative_error)
    a = F.abs(x)
    rounded = F.signum(x) * F.exp(F.round(F.ln(a) / (2 * step)) * (2 * step))
    return F.when((a > 0) & (a < float("inf")), rounded).otherwise(x)


def value_counts(df: DataFrame, group: list[str], value: str, relative_error: float = 0.0) -> DataFrame:
    """(group..., value, n) of the values that are neither null nor NaN; combined map-side, so a hot group or value is
    one row a task before the shuffle. Null groups are a group."""
    x = F.col(value).cast("double")
    kept = df.where(x.isNotNull() & ~F.isnan(x)).select(*group, on_grid(x, relative_error).alias("value"))
    return kept.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))


def merge(*summaries: DataFrame) -> DataFrame:
    """The summary of all parts together."""
    whole = reduce(DataFrame.unionByName, summaries)
    keys = [c for c in whole.columns if c != "n"]
    return whole.groupBy(*keys).agg(F.sum("n").alias("n"))


def cumulative(counts: DataFrame, group: list[str], partitions: int | None = None) -> DataFrame:
    """``counts`` with ``upto``, the number of the group's values up to and including this one, and ``total``."""
    size = partitions or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(counts.repartitionByRange(size, *group, "value").withColumn("_p", F.spark_partition_id()))
    key = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)]) if group else F.struct(F.lit(0).alias("g0"))
    ranged = ranged.withColumn("_g", key)
    # one row a (partition, group) that meet: no more than groups plus partitions
    parts = cut(ranged.groupBy("_g", "_p").agg(F.sum("n").alias("_t")))
    w = Window.partitionBy("_g")
    offsets = parts.select("_g", "_p", F.coalesce(F.sum("_t").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_t").over(w).alias("total"))
    running = F.sum("n").over(Window.partitionBy("_g", "_p").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    # both sides have one row a (_g, _p) at most on the right and are clustered by it on the left
    return ranged.withColumn("_run", running).join(offsets, ["_g", "_p"]).select(*counts.columns, (F.col("_run") + F.col("_before")).alias("upto"), "total")


def percentiles(counts: DataFrame, group: list[str], probabilities: list[float], relative_error: float = 0.0) -> DataFrame:
    """(group..., n, p<percent>..., error) of a summary: for each probability p the first value whose cumulative count
    reaches rank max(1, ceil(p * n)). Groups without a value have no row."""
    ranked = cumulative(counts, group)
    aggs = []
    for p in probabilities:
        rank = F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(p) - 1e-9))
        name = f"p{p * 100:g}".replace(".", "_")
        aggs.append(F.min(F.when(F.col("upto") >= rank, F.col("value"))).alias(name))
    return ranked.groupBy(*group).agg(F.first("total").alias("n"), *aggs).withColumn("error", F.lit(float(relative_error)))

"""Joins over panels: as-of, point-in-time snapshots, calendar expansion, upserts, keyed de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, time: str, by: list[str] | None = None, values: list[str] | None = None, allow_equal: bool = True) -> DataFrame:
    """Each left row with the ``values`` of the last right row of its key at or before its time (null where there is
    none). One union and one window: no range join, and both sides are shuffled once on the key.

    ``right`` must have one row a (key, time); without ``by`` it is a dimension series, and the left side is first
    reduced to its distinct times, so that the only ordered partition is as long as the calendar."""
    values = values or [c for c in right.columns if c not in (time, *(by or []))]
    if not by:
        times = left.select(time).distinct()
        found = _carry(times, right, time, [], values, allow_equal).withColumnsRenamed({time: "_time"} | {v: f"_v_{v}" for v in values})
        return left.join(found, F.col(time).eqNullSafe(F.col("_time")), "left").select(*left.columns, *[F.col(f"_v_{v}").alias(v) for v in values])
    return _carry(left, right, time, by, values, allow_equal)


def _carry(left: DataFrame, right: DataFrame, time: str, by: list[str], values: list[str], allow_equal: bool) -> DataFrame:
    a = left.withColumns({f"_r_{v}": F.lit(None).cast(right.schema[v].dataType) for v in values}).withColumn("_side", F.lit(1 if allow_equal else 0))
    pads = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (time, *by)]
    b = right.where(F.col(time).isNotNull()).select(time, *by, *pads, *[F.col(v).alias(f"_r_{v}") for v in values], F.lit(0 if allow_equal else 1).alias("_side"), F.lit(True).alias("_right"))
    both = a.withColumn("_right", F.lit(False)).unionByName(b)
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({f"_r_{v}": F.last(F.when(F.col("_right"), F.struct(f"_r_{v}")), True).over(w)[f"_r_{v}"] for v in values})
    return out.where(~F.col("_right")).select(*left.columns, *[F.col(f"_r_{v}").alias(v) for v in values])


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order`` (which must be total for a stable result)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def merge_landings(old: DataFrame, new: DataFrame, keys: list[str], keep: str = "last") -> DataFrame:
    """Append ``new`` to ``old`` and keep, of equal keys, the ``last`` landed (or the ``first``)."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return keep_one(both, keys, [F.desc("_batch") if keep == "last" else F.asc("_batch")]).drop("_batch")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with values replaced by non-null ones of ``new``, and the rows that only ``new`` has."""
    a, b = old.alias("a"), new.alias("b")
    cond = None
    for k in keys:
        c = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        cond = c if cond is None else cond & c
    cols = [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in new.columns else F.col(f"a.{c}").alias(c) for c in old.columns]
    return a.join(b, cond, "full").select(*cols)


def expand_days(df: DataFrame, entity: str, time: str) -> DataFrame:
    """Every calendar day from an entity's first to its last row, values carried forward."""
    w = Window.partitionBy(entity).orderBy(time)
    until = F.coalesce(F.date_sub(F.lead(time).over(w), 1), F.col(time))
    return df.withColumn("_until", until).withColumn("_day", F.explode(F.sequence(time, "_until"))).withColumn(time, F.col("_day")).drop("_until", "_day")


def snapshot_at(df: DataFrame, keys: list[str], version: str, at: Column) -> DataFrame:
    """Of each key the row of the latest version at or before ``at``, otherwise of the earliest one."""
    before = F.col(version) <= at
    return keep_one(df, keys, [F.desc(before), F.when(before, F.col(version)).desc_nulls_last(), F.asc(version)])

"""Joins and set operations over whole tables, beside the time-aware ones of :mod:`tesserae.operators.joins`.

Every join against a table of distinct keys goes through :func:`tesserae.plans.scale.lookup_join`, so the small side is
broadcast behind a count, and otherwise hot keys are salted. Null keys match nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.plans.scale import cut, lookup_join


def _keys(other: DataFrame, keys: list[str]) -> DataFrame:
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return cut(other.where(known).select(*keys).distinct().withColumn("_there", F.lit(True)))


def semi(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df`` whose key is in ``other``; each once, however often it is there."""
    return lookup_join(df, _keys(other, keys), keys, "inner").select(*df.columns)


def anti(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df`` whose key is not in ``other``; rows with a null key are such."""
    return lookup_join(df, _keys(other, keys), keys, "left").where(F.col("_there").isNull()).select(*df.columns)


def attach(df: DataFrame, values: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` of ``values`` (unique per key); null where there is no match. Columns of these names in ``df``
    are replaced."""
    return lookup_join(df.drop(*columns), cut(values.select(*keys, *columns)), keys, "left")


def overlay(df: DataFrame, values: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` taken from ``values`` (unique per key) where they are known there, otherwise as they were."""
    new = cut(values.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns]))
    out = lookup_join(df, new, keys, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def outer(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of either side, with both sides' columns; names that both have get ``_right`` on the second."""
    renamed = b.withColumnsRenamed({c: f"{c}_right" for c in b.columns if c in a.columns and c not in keys})
    return a.join(renamed, keys, "full")


def mapped(x: Column, table: dict, default) -> Column:
    """A dictionary lookup with a default, as an expression: no join."""
    if not table:
        return F.lit(default)
    return F.coalesce(F.create_map(*[F.lit(v) for pair in table.items() for v in pair])[x], F.lit(default))


def aligned(a: DataFrame, b: DataFrame, time: str, x: str, y: str) -> DataFrame:
    """(time, x, y) of the times at which both series have a value; ``b`` has one row a time."""
    right = cut(b.where(F.col(y).isNotNull()).select(time, F.col(y).alias("_y")))
    out = lookup_join(a.where(F.col(x).isNotNull()), right, [time], "inner")
    return out.select(*[c for c in a.columns if c != y], F.col("_y").alias(y))


def stacked(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, by column name; a column that a table lacks is null, and numbers widen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def common(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of ``columns`` that both tables have (null counts as a value)."""
    return a.select(*columns).intersect(b.select(*columns))


def remaining(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of ``columns`` that only the first table has."""
    return a.select(*columns).subtract(b.select(*columns))


def value_counts(df: DataFrame, by: list[str], distinct: str) -> DataFrame:
    """(by, n, distinct values of another column, its ``mode``: the smallest of the most frequent)."""
    each = df.groupBy(*by, distinct).agg(F.count(F.lit(1)).alias("_n"))
    known = F.col(distinct).isNotNull()
    best = F.min(F.when(known, F.struct((-F.col("_n")).alias("a"), F.col(distinct).alias("b"))))["b"].alias("mode")
    return each.groupBy(*by).agg(F.sum("_n").alias("n"), F.count(distinct).alias("distinct_values"), best)


def supply(df: DataFrame, time: str, passes: Column) -> DataFrame:
    """(time, n_pass, n_universe, share in percent)."""
    hit = F.when(passes, 1).otherwise(0)
    return df.groupBy(time).agg(F.sum(hit).alias("n_pass"), F.count(F.lit(1)).alias("n_universe")).withColumn("pass_pct", F.col("n_pass") / F.col("n_universe") * 100)


def refresh_span(last: Column, today: Column) -> Column:
    """How much history an incremental load asks for, by the days since the last stored row."""
    gap = F.datediff(today, last)
    return F.when(last.isNull(), "2 Y").when(gap <= 0, "none").when(gap <= 30, "60 D").when(gap <= 90, "120 D").otherwise("6 M")


def missing_range(last: Column, full_start: Column, today: Column, overlap: int = 3) -> Column:
    """(start, end) that is missing: from ``overlap`` days before the last stored row, but not before ``full_start``; from
    ``full_start`` where nothing is stored; null where nothing is missing."""
    start = F.coalesce(F.greatest(full_start, F.date_sub(last, overlap)), full_start)
    return F.when(last.isNull() | (last < today), F.struct(start.alias("start"), today.alias("end")))


def firing(df: DataFrame, entity: str, flag: Column) -> DataFrame:
    """All rows of the entities that have at least one row with ``flag``."""
    return semi(df, df.where(flag), [entity])

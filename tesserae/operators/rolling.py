"""Rolling totals over trailing periods of calendar days (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions.missing import finite


def daily(df: DataFrame, fields: tuple[str, ...], entity: str, time: str, order: str) -> DataFrame:
    """One row an (entity, day): ``_bars`` landings, and of each field the usable reading that landed last (highest
    ``order``). Combined map-side, so what is shuffled is bounded by entities times days, however many landings."""
    day = F.col(time).cast("date").alias("day")
    aggs = [F.max_by(finite(F.col(f)), F.when(finite(F.col(f)).isNotNull(), F.col(order))).alias(f) for f in fields]
    return df.where(F.col(time).isNotNull()).groupBy(F.col(entity), day).agg(F.count(F.lit(1)).alias("_bars"), *aggs)


def trailing(
    df: DataFrame,
    fields: tuple[str, ...] = ("close", "volume"),
    entity: str = "ticker",
    time: str = "date",
    order: str = "bar_id",
    periods: tuple[int, ...] = (7, 30),
) -> DataFrame:
    """For each entity and calendar day from its first to its last row: ``bars_<n>`` landings and, of each field,
    ``<field>_sum_<n>`` and ``<field>_avg_<n>`` (over days with a usable reading) for the last n calendar days.

    The calendar is not joined: each day's row is expanded to the days up to the entity's next one, so densifying needs
    no second shuffle, and the row windows (fixed numbers of preceding rows) reuse the partitioning. After the daily
    pre-aggregation an entity has at most a row a calendar day, so no entity's partition grows with its row count.

    Days or entities that are null: rows with null day are left out, the null entity is an entity. Sums over periods
    without a usable reading are 0 and averages null. Repeated landings count once in sums, the last usable one.
    """
    days = daily(df, fields, entity, time, order)
    w = Window.partitionBy(entity).orderBy("day")
    until = F.coalesce(F.date_sub(F.lead("day").over(w), 1), F.col("day"))
    dense = days.withColumn("_until", until).select(entity, "day", "_bars", *fields, F.posexplode(F.sequence("day", "_until")).alias("_k", "_day"))
    first = F.col("_k") == 0
    dense = dense.select(entity, F.col("_day").alias("day"), F.when(first, F.col("_bars")).otherwise(F.lit(0)).alias("_bars"), *[F.when(first, F.col(f)).alias(f) for f in fields])
    out = {}
    for n in periods:
        back = w.rowsBetween(1 - n, 0)
        out[f"bars_{n}"] = F.sum("_bars").over(back)
        for f in fields:
            out[f"{f}_sum_{n}"] = F.coalesce(F.sum(f).over(back), F.lit(0.0))
            out[f"{f}_avg_{n}"] = F.avg(f).over(back)
    return dense.withColumns(out).drop("_bars", *fields)

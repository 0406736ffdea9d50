"""Row and column hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions.missing import finite


def interpolate(df: DataFrame, columns: list[str], entity: str, time: str, limit: int = 50, mark: bool = False, by_time: bool = False) -> DataFrame:
    """Linear by row position (or, ``by_time``, by days) between known values, at most ``limit`` rows after the last one; further gaps, and those
    without a later value, carry the last value for up to ``limit`` rows. ``mark`` adds ``<column>_interpolated``."""
    w = Window.partitionBy(entity).orderBy(time)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_row", F.row_number().over(w)).withColumn("_at", F.unix_date(F.col(time).cast("date")) if by_time else F.col("_row"))
    out = {}
    for c in columns:
        x = finite(F.col(c))
        here = F.when(x.isNotNull(), F.struct(F.col("_row").alias("r"), F.col("_at").alias("t"), x.alias("v")))
        a, b = F.last(here, True).over(back), F.first(here, True).over(ahead)
        since = F.col("_row") - a["r"]
        line = a["v"] + (b["v"] - a["v"]) * F.try_divide(F.col("_at") - a["t"], b["t"] - a["t"])
        filled = F.when(since <= limit, F.when(b["r"].isNotNull(), line).otherwise(a["v"]))
        out[c] = F.coalesce(x, filled)
        if mark:
            out[f"{c}_interpolated"] = x.isNull() & filled.isNotNull()
    return df.withColumns(out).drop("_row", "_at")


def forward_filled(df: DataFrame, columns: list[str], entity: str, time: str) -> DataFrame:
    """``columns`` as floats, unknown values carried forward from the entity's last known one; leading ones stay unknown."""
    w = Window.partitionBy(entity).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(finite(F.col(c)), True).over(w).cast("float") for c in columns})


def big_moves(df: DataFrame, entity: str, price: str, time: str, size: float = 1.0, most: int = 10) -> DataFrame:
    """(entity, moves, warns): how many changes from one known price to the next are larger than ``size``, and whether they
    are more than ``most``."""
    w = Window.partitionBy(entity).orderBy(time)
    known = df.where(finite(F.col(price)).isNotNull() & (F.col(price) != 0)).withColumn("_b", F.lag(price).over(w))
    each = known.groupBy(entity).agg(F.sum(F.when(F.abs(F.col(price) / F.col("_b") - 1) > size, 1).otherwise(0)).alias("moves"))
    return each.withColumn("warns", F.col("moves") > most)


def winsorise(df: DataFrame, column: str, entity: str, time: str, rows: int = 282, sigmas: float = 3.0) -> DataFrame:
    """``column`` clipped to the rolling mean of its non-zero values plus or minus ``sigmas`` standard deviations."""
    w = Window.partitionBy(entity).orderBy(time).rowsBetween(1 - rows, 0)
    x = F.when(F.col(column) != 0, F.col(column))
    m, s = F.avg(x).over(w), F.stddev_samp(x).over(w)
    return df.withColumn(column, F.when(s.isNull(), F.col(column)).otherwise(F.least(F.greatest(F.col(column), m - sigmas * s), m + sigmas * s)))


def quality(df: DataFrame, entity: str, price: str, time: str, min_rows: int = 201, min_std: float = 0.01, max_missing: float = 0.2) -> DataFrame:
    """One row an entity: rows, spread and missing share of its price, and whether it passes."""
    each = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.stddev_samp(finite(F.col(price))), F.lit(0.0)).alias("price_std"),
        (1 - F.count(finite(F.col(price))) / F.count(F.lit(1))).alias("missing_share"),
        F.datediff(F.max(time), F.min(time)).alias("span_days"),
    )
    return each.withColumn("passes", (F.col("n_rows") >= min_rows) & (F.col("price_std") >= min_std) & (F.col("missing_share") <= max_missing))


def drop_warmup(df: DataFrame, entity: str, time: str, rows: int = 200, digits: int = 8) -> DataFrame:
    """Without each entity's first ``rows`` rows, doubles rounded."""
    w = Window.partitionBy(entity).orderBy(time)
    kept = df.withColumn("_row", F.row_number().over(w)).where(F.col("_row") > rows).drop("_row")
    return kept.withColumns({f.name: F.round(f.name, digits) for f in kept.schema if f.dataType.typeName() == "double"})


def standard_order(df: DataFrame, first: list[str]) -> DataFrame:
    """``first`` in that order, then the other columns by name."""
    return df.select(*[c for c in first if c in df.columns], *sorted(c for c in df.columns if c not in first))


def downcast(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("float") for f in df.schema if f.dataType.typeName() == "double"})

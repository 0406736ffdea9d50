"""The panel the feature queries run over, in both engines, and rounding that both agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_GOOD = " AND ".join(f"{c} > 0 AND {c} < 500000" for c in ("open", "high", "low", "close")) + " AND volume >= 0 AND volume < 1e15"

#: Some stored NaNs have bits that DuckDB's comparisons and isnan don't know; isfinite does.
_FINITE = " AND ".join(f"isfinite({c})" for c in ("open", "high", "low", "close", "volume"))
#: One bar a ticker and date: the last landing whose readings are all usable.
_LATEST = """SELECT ticker, date, open, high, low, close, volume FROM (
SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY bar_id DESC) AS _k FROM {} WHERE {}) AS landed WHERE _k = 1"""
BARS = _LATEST.format("pricedata", f"{_FINITE} AND {_GOOD}")

BAR_COLUMNS = {"ticker", "date", "open", "high", "low", "close", "volume"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bars(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_LATEST.format("{pricedata}", _GOOD), pricedata=table(spark, d, "pricedata"))


def rounded(x: str) -> str:
    """Six decimals for small values, fewer for large ones; a small shift keeps exact halves on one side."""
    return f"(CASE WHEN abs({x}) >= 1e6 THEN round({x} + 0.0313, 0) WHEN abs({x}) >= 1e3 THEN round({x} + 3.13e-5, 3) ELSE round({x} + 3.13e-8, 6) END)"

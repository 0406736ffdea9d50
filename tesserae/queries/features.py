"""Feature queries: every block over the bars, with the same blocks in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import features as _features  # noqa: F401  (fills the registry)
from tesserae.functions.dialect import DuckDialect, SparkDialect
from tesserae.plans import blocks as B
from tesserae.operators.joins import asof
from tesserae.queries.panel import BAR_COLUMNS, BARS, bars, rounded, table

#: The tables hold 160 days, so that windows of a year and of a season are passed shorter.
SHORT = {"year": 60, "season": 30}
#: Blocks a query adds before its own, so that what it needs is there.
NEEDS = {
    "ratio_log_scaled": ("price_ratio",), "ratio_rates": ("price_ratio",), "ratio_signals": ("price_ratio", "ratio_rates"), "ratio_efficiency": ("price_ratio",),
    "keltner": ("moving_average", "close_volatility"), "composite_scores": ("liquidity", "vix_regime", "atr_regime", "coefficient_of_variation", "price_momentum", "volume_momentum"), "panel_formulas": ("panel_inputs",), "dynamic_rsi": ("vix_family",),
}
#: Blocks over bars that have the index joined as of each bar.
WITH_VIX = ("vix_family", "dynamic_rsi", "vix_regime", "composite_scores", "index_beta")
_VIX_SQL = "vix AS (SELECT date, max(vix_close) AS vix FROM rfpredictions WHERE date IS NOT NULL AND vix_close > 0 GROUP BY date)"


def _with_vix(spark: SparkSession, d: str) -> DataFrame:
    vix = table(spark, d, "rfpredictions").where("date is not null and vix_close > 0").groupBy("date").agg(F.max("vix_close").alias("vix"))
    return asof(bars(spark, d), vix, "date").withColumn("index_close", F.col("vix"))



def _columns(names: tuple[str, ...]) -> list[str]:
    return ["ticker", "CAST(date AS VARCHAR(10)) AS day", *[f"{rounded(f'CAST({c} AS DOUBLE)')} AS {c}" for c in names]]


def _query(name: str):
    chain = [B.REGISTRY[n] for n in (*NEEDS.get(name, ()), name)]
    out = B.REGISTRY[name].produces

    def run(spark: SparkSession, d: str) -> DataFrame:
        return B.apply((_with_vix if name in WITH_VIX else bars)(spark, d), *chain, dialect=SparkDialect(**SHORT)).selectExpr(*[c.replace("VARCHAR(10)", "STRING") for c in _columns(out)])

    run.__name__ = f"feature_{name}"
    if name in WITH_VIX:
        head, source, have = f"WITH bars AS ({BARS}), {_VIX_SQL}, joined AS (SELECT b.*, v.vix, v.vix AS index_close FROM bars b ASOF LEFT JOIN vix v ON b.date >= v.date) ", "joined", BAR_COLUMNS | {"vix", "index_close"}
    else:
        head, source, have = f"WITH bars AS ({BARS}) ", "bars", BAR_COLUMNS
    return run, head + B.as_sql(source, *chain, columns=_columns(out), have=have, dialect=DuckDialect(**SHORT))


_ALL = {f"feature_{name}": _query(name) for name in B.REGISTRY}
QUERIES = {k: v[0] for k, v in _ALL.items()}
ORACLE = {k: v[1] for k, v in _ALL.items()}

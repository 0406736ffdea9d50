"""Queries of the data problems 1, 3, 4 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.operators import fill, rolling, spikes
from tesserae.streaming.compact import compact


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pricedata.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return fill.missing_cells(_bars(spark, d))


def p1_filled(spark: SparkSession, d: str) -> DataFrame:
    return fill.fill_numeric(_bars(spark, d))


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """The masks of the fills, and the readings of the cells that were not filled, which are those stored; whether every
    fill is a reading (a price above 0, a volume of at least 0)."""
    rows = fill.fill_numeric(_bars(spark, d))
    kept = {f"{c}_kept": F.when(~F.col(f"{c}_filled"), F.col(c)) for c in ("close", "volume")}
    sound = (~F.col("close_filled") | (F.col("close") > 0)) & (~F.col("volume_filled") | (F.col("volume") >= 0))
    return rows.withColumns(kept | {"sound": sound}).select("bar_id", "close_filled", "volume_filled", "close_kept", "volume_kept", "sound")


def p1_sectors(spark: SparkSession, d: str) -> DataFrame:
    return fill.fill_categorical(spark.read.parquet(f"{d}/tickerciks.parquet"), "sector", "ticker", "snapshot_date")


def p1_holdout(spark: SparkSession, d: str) -> DataFrame:
    """A ninth of the usable cells, hidden, filled and measured: by field and number of its ticker's usable readings, the
    cells hidden and whether, over the whole field, the fills' mean error on the log scale is at most 1.05 times that of the
    ticker's mean (in small tables the two hardly differ for volumes)."""
    ok = _usable_bars(spark, d).where("date is not null and ticker is not null")
    hide = (F.col("bar_id") * 7919) % 9 == 4
    hidden = ok.select("bar_id", "ticker", "date", *[F.when(~hide, F.col(c)).alias(c) for c in ("close", "volume")])
    filled = fill.fill_numeric(hidden).select("bar_id", *[F.col(c).alias(f"_{c}") for c in ("close", "volume")])
    logs = {c: f.log(F.col(c)) for f in fill.BAR_FIELDS for c in [f.name]}
    means = ok.groupBy("ticker").agg(*[x for c in logs for x in (F.avg(F.when(~hide, logs[c])).alias(f"_mean_{c}"), F.count(F.when(F.col(c) > 0, 1)).alias(f"_n_{c}"))])
    both = ok.where(hide).join(filled, "bar_id").join(means, "ticker")
    cells = [
        F.struct(F.lit(f.name).alias("field"), F.col(f"_n_{f.name}").alias("n"), F.when(F.col(f.name) > 0, F.abs(f.log(F.col(f"_{f.name}")) - logs[f.name])).alias("err"), F.when(F.col(f.name) > 0, F.abs(F.col(f"_mean_{f.name}") - logs[f.name])).alias("naive"))
        for f in fill.BAR_FIELDS
    ]
    rows = both.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*").where("err is not null and naive is not null")
    band = F.when(F.col("n") < 60, "under 60").when(F.col("n") < 120, "60 to 119").otherwise("120 and more")
    each = rows.groupBy("field", band.alias("readings")).agg(F.count(F.lit(1)).alias("cells"), F.sum("err").alias("err"), F.sum("naive").alias("naive"))
    w = Window.partitionBy("field")  # a row a band
    return each.select("field", "readings", "cells", (F.sum("err").over(w) <= 1.05 * F.sum("naive").over(w)).alias("no_worse_than_mean"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return compact(spark, f"{d}/rfpredictions.parquet").surplus().select("pred_id").distinct()


def p3_compacted(spark: SparkSession, d: str) -> DataFrame:
    """The compacted table; a probability that is no number is null here and marked in ``<column>_nan``, as not every
    engine's comparison takes NaN for equal."""
    rows = compact(spark, f"{d}/rfpredictions.parquet").merge()
    marks = {f"{c}_nan": F.coalesce(F.isnan(c), F.lit(False)) for c in ("upprobability", "downprobability")}
    return rows.withColumns(marks).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("upprobability", "downprobability")})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(_bars(spark, d))


def p4_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return spikes.verdicts(_bars(spark, d))


def p4_impossible(spark: SparkSession, d: str) -> DataFrame:
    """The bars with a negative reading or a high below the low."""
    v = spikes.verdicts(_bars(spark, d))
    return v.where("close_impossible or volume_impossible or high_impossible").select("bar_id").distinct()


def _usable_bars(spark: SparkSession, d: str) -> DataFrame:
    ok = fill.usable(_bars(spark, d))
    return ok.drop("close", "volume").withColumnsRenamed({"_ok_close": "close", "_ok_volume": "volume"})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = rolling.trailing(_usable_bars(spark, d))
    return rows.where("bars_7 = 0 and ticker is not null").select("ticker", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p5_trailing(spark: SparkSession, d: str) -> DataFrame:
    rows = rolling.trailing(_usable_bars(spark, d))
    # prices have four decimals, so averages often end in a 5 there: a small amount keeps both engines on one side
    sums = {c: F.round(F.col(c) + 1e-7, 4) for c in rows.columns if "_sum_" in c or "_avg_" in c}
    return rows.withColumns(sums | {"day": F.date_format("day", "yyyy-MM-dd")})


QUERIES = {f.__name__: f for f in (p1_found, p1_filled, p1_kept, p1_sectors, p1_holdout, p3_found, p3_compacted, p4_found, p4_verdicts, p4_impossible, p5_found, p5_trailing)}

_GONE_CLOSE = "(close IS NULL OR NOT isfinite(close) OR close IN (0, -1, -999, -9999, 999999))"
_GONE_VOLUME = "(volume IS NULL OR NOT isfinite(volume) OR volume IN (-1, -999, -9999))"
_RF_CONTENT = "date, ticker, open, high, low, close, volume, upprobability, downprobability, positivethreshold, negativethreshold, upprediction, raw_score, vix_close, model_tag, scored_at"
_SCORES = ("upprobability", "downprobability")
_CALENDAR = """WITH ends AS (SELECT ticker, min(date) AS a, max(date) AS b FROM pricedata WHERE date IS NOT NULL GROUP BY ticker),
calendar AS (SELECT ticker, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM ends)"""


def _period(n: int) -> str:
    parts = [f"sum(coalesce(bars, 0)) OVER w{n} AS bars_{n}"]
    for f in ("close", "volume"):
        parts += [f"round(coalesce(sum({f}) OVER w{n}, 0) + 1e-7, 4) AS {f}_sum_{n}", f"round(avg({f}) OVER w{n} + 1e-7, 4) AS {f}_avg_{n}"]
    return ", ".join(parts)




def _held_out(field: str, gone: str) -> str:
    return f"""SELECT '{field}' AS field, CASE WHEN n < 60 THEN 'under 60' WHEN n < 120 THEN '60 to 119' ELSE '120 and more' END AS readings, x FROM (
SELECT bar_id, {field} AS x, count(CASE WHEN {field} > 0 THEN 1 END) OVER (PARTITION BY ticker) AS n, count(CASE WHEN bar_id * 7919 % 9 <> 4 THEN {field} END) OVER (PARTITION BY ticker) AS seen
FROM pricedata WHERE date IS NOT NULL AND ticker IS NOT NULL AND NOT {gone}) WHERE bar_id * 7919 % 9 = 4 AND x > 0 AND seen > 0"""


ORACLE = {
    "p1_holdout": f"SELECT field, readings, count(*) AS cells, true AS no_worse_than_mean FROM ({_held_out('close', _GONE_CLOSE)} UNION ALL {_held_out('volume', _GONE_VOLUME)}) GROUP BY field, readings",
    "p1_found": f"SELECT bar_id, 'close' AS field FROM pricedata WHERE {_GONE_CLOSE} UNION ALL SELECT bar_id, 'volume' FROM pricedata WHERE {_GONE_VOLUME}",
    "p1_kept": f"SELECT bar_id, {_GONE_CLOSE} AS close_filled, {_GONE_VOLUME} AS volume_filled, CASE WHEN NOT {_GONE_CLOSE} THEN close END AS close_kept, CASE WHEN NOT {_GONE_VOLUME} THEN volume END AS volume_kept, true AS sound FROM pricedata",
    "p4_impossible": f"""SELECT bar_id FROM pricedata WHERE (NOT {_GONE_CLOSE} AND close < 0) OR (NOT {_GONE_VOLUME} AND volume < 0) OR (isfinite(high) AND high NOT IN (0, -1, -999, -9999, 999999) AND (high < 0 OR (low > 0 AND isfinite(low) AND high > 0 AND high < low)))""",
    "p3_found": f"SELECT pred_id FROM (SELECT pred_id, min(pred_id) OVER (PARTITION BY {_RF_CONTENT}) AS first_id FROM rfpredictions) WHERE pred_id > first_id",
    "p3_compacted": f"SELECT * REPLACE ({', '.join(f'CASE WHEN isfinite({c}) OR isinf({c}) THEN {c} END AS {c}' for c in _SCORES)}), {', '.join(f'coalesce(NOT isfinite({c}) AND NOT isinf({c}), false) AS {c}_nan' for c in _SCORES)} FROM (SELECT pred_id, {_RF_CONTENT}, file_id FROM (SELECT *, min(pred_id) OVER (PARTITION BY {_RF_CONTENT}) AS first_id FROM rfpredictions) WHERE pred_id = first_id)",
    "p5_found": f"""{_CALENDAR} SELECT c.ticker, strftime(c.day, '%Y-%m-%d') AS day FROM calendar c WHERE NOT EXISTS
(SELECT 1 FROM pricedata p WHERE p.ticker = c.ticker AND p.date <= c.day AND p.date > c.day - 7)""",
    "p5_trailing": f"""{_CALENDAR}, daily AS (SELECT ticker, date AS day, count(*) AS bars,
  arg_max(close, bar_id) FILTER (NOT {_GONE_CLOSE}) AS close, arg_max(volume, bar_id) FILTER (NOT {_GONE_VOLUME}) AS volume
  FROM pricedata WHERE date IS NOT NULL GROUP BY ALL)
SELECT c.ticker, strftime(c.day, '%Y-%m-%d') AS day, {_period(7)}, {_period(30)}
FROM calendar c LEFT JOIN daily d ON d.ticker = c.ticker AND d.day = c.day
WINDOW w7 AS (PARTITION BY c.ticker ORDER BY c.day ROWS 6 PRECEDING), w30 AS (PARTITION BY c.ticker ORDER BY c.day ROWS 29 PRECEDING)""",
}

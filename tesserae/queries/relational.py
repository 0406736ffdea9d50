"""Queries of the joins, hygiene, cross-section, metric, relation and text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.dialect import DuckDialect
from tesserae.operators import cross, hygiene, joins, merge, metrics, relate, text
from tesserae.queries.panel import BARS, bars, rounded, table
from tesserae.sources import io

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
Q = DuckDialect()


def query(sql: str | None = None):
    def made(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return made


def R(expr: str, name: str) -> str:
    return f"{rounded(f'CAST({expr} AS DOUBLE)')} AS {name}"


def pick(df: DataFrame, *plain: str, **numbers: str) -> DataFrame:
    return df.selectExpr(*plain, *[R(e, n) for n, e in numbers.items()])


DAY = "CAST(date AS STRING) AS day"
SDAY = "CAST(date AS VARCHAR) AS day"
#: Bars with next-day return and a score: the momentum of five days.
PANEL = f"""bars AS ({BARS}), scored AS (SELECT *, {Q.lead('close')} / close - 1 AS ret, {Q.lag('close')} / {Q.lag('close', 6)} - 1 AS score, close / {Q.lag('close')} - 1 AS back FROM bars),
panel AS (SELECT *, CASE WHEN ret > 0 THEN 1 ELSE 0 END AS up FROM scored)"""
FULL = "full_panel AS (SELECT * FROM panel WHERE ret IS NOT NULL AND score IS NOT NULL)"
RANKED = f"ranked AS (SELECT *, {Q.pct_rank('score')} AS rank FROM full_panel)"


def panel(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("ticker").orderBy("date")
    b = bars(spark, d)
    c = F.col("close")
    return b.withColumns({"ret": F.lead("close").over(w) / c - 1, "score": F.lag("close").over(w) / F.lag("close", 6).over(w) - 1, "back": c / F.lag("close").over(w) - 1}).withColumn("up", F.when(F.col("ret") > 0, 1).otherwise(0))


def full(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).where("ret is not null and score is not null")


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return full(spark, d).withColumn("rank", cross.pct_rank("score", ["date"]))


# joins -------------------------------------------------------------------------------------------------------------
_VIX = "vix AS (SELECT date, max(vix_close) AS vix FROM rfpredictions WHERE date IS NOT NULL AND vix_close > 0 GROUP BY date)"


@query(f"WITH bars AS ({BARS}), {_VIX} SELECT b.ticker, CAST(b.date AS VARCHAR) AS day, v.vix FROM bars b ASOF LEFT JOIN vix v ON b.date >= v.date")
def join_asof_index(spark, d):
    vix = table(spark, d, "rfpredictions").where("date is not null and vix_close > 0").groupBy("date").agg(F.max("vix_close").alias("vix"))
    return joins.asof(bars(spark, d), vix, "date").select("ticker", F.col("date").cast("string").alias("day"), "vix")


@query(f"""WITH bars AS ({BARS}), p AS (SELECT ticker, coalesce(model_tag, '') AS model_tag, date, max(raw_score) AS raw_score FROM rfpredictions WHERE date IS NOT NULL AND isfinite(raw_score) GROUP BY ALL),
wanted AS (SELECT b.ticker, b.date, t.model_tag FROM bars b JOIN (SELECT DISTINCT ticker, model_tag FROM p) t ON b.ticker = t.ticker)
SELECT w.ticker, CAST(w.date AS VARCHAR) AS day, w.model_tag, p.raw_score FROM wanted w ASOF LEFT JOIN p ON w.ticker = p.ticker AND w.model_tag = p.model_tag AND w.date >= p.date""")
def join_asof_by_ticker(spark, d):
    """For every model that scored a ticker; a missing tag is ''."""
    known = table(spark, d, "rfpredictions").where("date is not null and not isnan(raw_score) and abs(raw_score) < double('infinity')").withColumn("model_tag", F.coalesce("model_tag", F.lit("")))
    p = known.groupBy("ticker", "model_tag", "date").agg(F.max("raw_score").alias("raw_score"))
    wanted = bars(spark, d).select("ticker", "date").join(p.select("ticker", "model_tag").distinct(), "ticker")
    return joins.asof(wanted, p, "date", ["ticker", "model_tag"]).select("ticker", F.col("date").cast("string").alias("day"), "model_tag", "raw_score")


@query("""SELECT ticker, cik, name, sector, CAST(snapshot_date AS VARCHAR) AS snapshot_date FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY snapshot_date <= DATE '2025-05-01' DESC,
CASE WHEN snapshot_date <= DATE '2025-05-01' THEN snapshot_date END DESC NULLS LAST, snapshot_date) AS k FROM tickerciks) WHERE k = 1""")
def join_snapshot_at(spark, d):
    rows = joins.snapshot_at(table(spark, d, "tickerciks"), ["ticker"], "snapshot_date", F.lit("2025-05-01").cast("date"))
    return rows.select("ticker", "cik", "name", "sector", F.col("snapshot_date").cast("string").alias("snapshot_date"))


@query(f"""WITH bars AS ({BARS}), ends AS (SELECT ticker, date, close, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS nxt FROM bars)
SELECT ticker, CAST(CAST(unnest(generate_series(CAST(date AS TIMESTAMP), CAST(coalesce(nxt - 1, date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS day, close FROM ends""")
def join_calendar_expansion(spark, d):
    return joins.expand_days(bars(spark, d).select("ticker", "date", "close"), "ticker", "date").select("ticker", F.col("date").cast("string").alias("day"), "close")


_OLD = "SELECT bar_id, ticker, date, close FROM pricedata WHERE bar_id % 5 <> 0"
_NEW = "SELECT bar_id, ticker, date, close FROM pricedata WHERE bar_id % 5 = 0"
for _keep, _side in (("last", "DESC"), ("first", "ASC")):
    ORACLE[f"merge_keep_{_keep}"] = f"""SELECT ticker, CAST(date AS VARCHAR) AS day, close FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY b {_side}, bar_id {_side}) AS k FROM
(SELECT *, 0 AS b FROM ({_OLD}) UNION ALL SELECT *, 1 AS b FROM ({_NEW}))) WHERE k = 1"""


def _merge(keep: str):
    def run(spark, d):
        p = table(spark, d, "pricedata").select("bar_id", "ticker", "date", "close")
        side = F.desc if keep == "last" else F.asc
        old = joins.keep_one(p.where("bar_id % 5 <> 0"), ["ticker", "date"], [side("bar_id")])
        new = joins.keep_one(p.where("bar_id % 5 = 0"), ["ticker", "date"], [side("bar_id")])
        return joins.merge_landings(old, new, ["ticker", "date"], keep).select("ticker", F.col("date").cast("string").alias("day"), "close")

    return run


QUERIES["merge_keep_last"], QUERIES["merge_keep_first"] = _merge("last"), _merge("first")


@query("""WITH a AS (SELECT ticker, max(exchange) AS exchange, max(sector) AS sector FROM tickerciks WHERE snapshot_date < DATE '2025-06-30' GROUP BY ticker),
b AS (SELECT ticker, max(exchange) AS exchange, max(sector) AS sector FROM tickerciks WHERE snapshot_date >= DATE '2025-06-30' GROUP BY ticker)
SELECT coalesce(b.ticker, a.ticker) AS ticker, coalesce(b.exchange, a.exchange) AS exchange, coalesce(b.sector, a.sector) AS sector FROM a FULL JOIN b ON a.ticker = b.ticker""")
def join_upsert(spark, d):
    t = table(spark, d, "tickerciks")
    g = lambda x: x.groupBy("ticker").agg(F.max("exchange").alias("exchange"), F.max("sector").alias("sector"))
    return joins.upsert(g(t.where("snapshot_date < '2025-06-30'")), g(t.where("snapshot_date >= '2025-06-30'")), ["ticker"])


@query("""SELECT bar_id FROM pricedata p WHERE EXISTS (SELECT 1 FROM rfpredictions r WHERE r.ticker = p.ticker AND r.upprediction = 1)""")
def join_semi_firing(spark, d):
    r = table(spark, d, "rfpredictions")
    return merge.semi(table(spark, d, "pricedata"), r.where("upprediction = 1"), ["ticker"]).select("bar_id")


@query("""SELECT bar_id FROM pricedata p WHERE NOT EXISTS (SELECT 1 FROM rfpredictions r WHERE r.ticker = p.ticker AND r.date = p.date)""")
def join_anti_unscored(spark, d):
    return merge.anti(table(spark, d, "pricedata"), table(spark, d, "rfpredictions"), ["ticker", "date"]).select("bar_id")


@query("""SELECT p.bar_id, u.sector FROM pricedata p LEFT JOIN (SELECT ticker, max(sector) AS sector FROM tickerciks GROUP BY ticker) u ON p.ticker = u.ticker""")
def join_left_universe(spark, d):
    sectors = table(spark, d, "tickerciks").groupBy("ticker").agg(F.max("sector").alias("sector"))
    return merge.attach(table(spark, d, "pricedata").select("bar_id", "ticker"), sectors, ["ticker"], ["sector"]).select("bar_id", "sector")


@query("""SELECT coalesce(a.ticker, b.ticker) AS ticker, a.n AS bars, b.n AS predictions FROM (SELECT ticker, count(*) AS n FROM pricedata GROUP BY ticker) a FULL OUTER JOIN (SELECT ticker, count(*) AS n FROM rfpredictions GROUP BY ticker) b ON a.ticker = b.ticker""")
def join_full_counts(spark, d):
    n = lambda t, c: table(spark, d, t).groupBy("ticker").agg(F.count(F.lit(1)).alias(c))
    return merge.outer(n("pricedata", "bars"), n("rfpredictions", "predictions"), ["ticker"])


@query("""SELECT t.ticker, coalesce(m.zone, 'other') AS zone FROM tickerciks t LEFT JOIN (SELECT 'NYSE' AS exchange, 'east' AS zone UNION ALL SELECT 'Nasdaq', 'east') m ON t.exchange = m.exchange""")
def join_lookup_default(spark, d):
    return table(spark, d, "tickerciks").select("ticker", merge.mapped(F.col("exchange"), {"NYSE": "east", "Nasdaq": "east"}, "other").alias("zone"))


@query("""SELECT ticker, CAST(date AS VARCHAR) AS day, round(avg(upprobability) + 1e-9, 6) AS mean_up, count(DISTINCT model_tag) AS models FROM rfpredictions WHERE upprobability IS NOT NULL AND (isfinite(upprobability) OR isinf(upprobability)) GROUP BY ticker, date HAVING count(DISTINCT model_tag) >= 2""")
def ensemble_mean(spark, d):
    ok = table(spark, d, "rfpredictions").where("upprobability is not null and not isnan(upprobability)")
    each = ok.groupBy("ticker", "date").agg(F.avg("upprobability").alias("m"), F.count_distinct("model_tag").alias("models")).where("models >= 2")
    return each.selectExpr("ticker", DAY, "round(m + 1e-9, 6) AS mean_up", "models")


@query("""SELECT ticker FROM pricedata UNION ALL SELECT ticker FROM tickerciks""")
def set_union_all(spark, d):
    return merge.stacked(table(spark, d, "pricedata").select("ticker"), table(spark, d, "tickerciks").select("ticker"))


@query("""SELECT CAST(date AS VARCHAR) AS day FROM pricedata WHERE date IS NOT NULL INTERSECT SELECT CAST(date AS VARCHAR) AS day FROM rfpredictions WHERE date IS NOT NULL""")
def set_intersect_dates(spark, d):
    days = lambda t: table(spark, d, t).where("date is not null").selectExpr(DAY)
    return merge.common(days("pricedata"), days("rfpredictions"), ["day"])


@query("""SELECT ticker FROM tickerciks EXCEPT SELECT ticker FROM rfpredictions WHERE upprediction = 1""")
def set_except_tickers(spark, d):
    return merge.remaining(table(spark, d, "tickerciks"), table(spark, d, "rfpredictions").where("upprediction = 1"), ["ticker"])


@query("""SELECT a.exchange, a.n, a.sectors, b.top_sector FROM (SELECT exchange, count(*) AS n, count(DISTINCT sector) AS sectors FROM tickerciks GROUP BY exchange) a JOIN (SELECT exchange, sector AS top_sector FROM (SELECT exchange, sector, row_number() OVER (PARTITION BY exchange ORDER BY sector IS NULL, c DESC, sector) AS k FROM (SELECT exchange, sector, count(*) AS c FROM tickerciks GROUP BY ALL)) WHERE k = 1) b ON a.exchange IS NOT DISTINCT FROM b.exchange""")
def value_counts(spark, d):
    return merge.value_counts(table(spark, d, "tickerciks"), ["exchange"], "sector").selectExpr("exchange", "n", "distinct_values AS sectors", "mode AS top_sector")


@query("""SELECT ticker, CASE WHEN gap <= 0 THEN 'none' WHEN gap <= 30 THEN '60 D' WHEN gap <= 90 THEN '120 D' ELSE '6 M' END AS duration
FROM (SELECT ticker, datediff('day', max(date), DATE '2025-07-01') AS gap FROM pricedata WHERE date IS NOT NULL GROUP BY ticker) g""")
def download_range(spark, d):
    last = table(spark, d, "pricedata").where("date is not null").groupBy("ticker").agg(F.max("date").alias("last"))
    return last.select("ticker", merge.refresh_span(F.col("last"), F.lit("2025-07-01").cast("date")).alias("duration"))


@query(f"""SELECT CAST(date AS VARCHAR) AS day, sum(CASE WHEN upprediction = 1 THEN 1 ELSE 0 END) AS n_pass, count(*) AS n_universe, {R("sum(CASE WHEN upprediction = 1 THEN 1 ELSE 0 END) / count(*) * 100", "pass_pct")} FROM rfpredictions GROUP BY date""")
def monthly_supply(spark, d):
    return merge.supply(table(spark, d, "rfpredictions"), "date", F.col("upprediction") == 1).selectExpr(DAY, "n_pass", "n_universe", R("pass_pct", "pass_pct"))


@query("""SELECT CAST(written_at AS DATE) AS day, count(*) AS files, sum(coalesce(n_bytes, 0)) AS bytes, sum(coalesce(n_rows, 0)) AS n_rows FROM prediction_files GROUP BY CAST(written_at AS DATE)""")
def file_inventory(spark, d):
    f = table(spark, d, "prediction_files")
    return io.inventory_by(f.select(F.to_date("written_at").alias("day"), "n_bytes", "n_rows"), "day", "n_bytes", "n_rows")


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value) + 1e-7, 4) AS total FROM events GROUP BY date_trunc('hour', ts), event_type""")
def events_by_hour(spark, d):
    e = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("t"))
    return e.selectExpr("CAST(hour AS TIMESTAMP_NTZ) AS hour", "event_type", "n", "round(t + 1e-7, 4) AS total")


@query("""SELECT p.bar_id FROM pricedata p WHERE p.ticker IN (SELECT ticker FROM pricedata WHERE close > 300 AND isfinite(close) AND close < 999)""")
def join_firing_rows(spark, d):
    """All rows of the tickers that have a reading of a certain kind."""
    p = table(spark, d, "pricedata")
    return merge.firing(p, "ticker", (F.col("close") > 300) & (F.col("close") < 999)).select("bar_id")


@query("""SELECT ticker, CAST(CASE WHEN a IS NOT NULL THEN greatest(DATE '2025-01-01', b - 3) END AS VARCHAR) AS start, CASE WHEN b < DATE '2025-06-30' THEN '2025-06-30' END AS until FROM (SELECT ticker, min(date) AS a, max(date) AS b FROM pricedata WHERE date IS NOT NULL GROUP BY ticker) WHERE b < DATE '2025-06-30'""")
def missing_tail(spark, d):
    last = table(spark, d, "pricedata").where("date is not null").groupBy("ticker").agg(F.max("date").alias("last"))
    day = lambda x: F.lit(x).cast("date")
    gap = last.withColumn("g", merge.missing_range(F.col("last"), day("2025-01-01"), day("2025-06-30"))).where("g is not null")
    return gap.selectExpr("ticker", "CAST(g.start AS STRING) AS start", "CAST(g.end AS STRING) AS until")


@query("""WITH n AS (SELECT ticker, max(sector) AS sector, max(exchange) AS exchange FROM tickerciks WHERE snapshot_date >= DATE '2025-06-30' GROUP BY ticker)
SELECT o.cik, o.ticker, coalesce(n.sector, o.sector) AS sector, coalesce(n.exchange, o.exchange) AS exchange FROM tickerciks o LEFT JOIN n ON o.ticker = n.ticker""")
def merge_overlay(spark, d):
    t = table(spark, d, "tickerciks")
    new = t.where("snapshot_date >= '2025-06-30'").groupBy("ticker").agg(F.max("sector").alias("sector"), F.max("exchange").alias("exchange"))
    return merge.overlay(t.select("cik", "ticker", "sector", "exchange"), new, ["ticker"], ["sector", "exchange"])


@query(f"""WITH {PANEL}, {_VIX} SELECT p.ticker, CAST(p.date AS VARCHAR) AS day, {R('back', 'back')}, {R('vix', 'vix')} FROM panel p JOIN vix v USING (date) WHERE back IS NOT NULL""")
def join_aligned_series(spark, d):
    vix = table(spark, d, "rfpredictions").where("date is not null and vix_close > 0").groupBy("date").agg(F.max("vix_close").alias("vix"))
    return merge.aligned(panel(spark, d), vix, "date", "back", "vix").selectExpr("ticker", DAY, R("back", "back"), R("vix", "vix"))


# hygiene -----------------------------------------------------------------------------------------------------------
_USABLE = "{} AND close > 0 AND close < 500000"


@query(f"""WITH gappy AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS r FROM (SELECT ticker, date, arg_max(close, bar_id) FILTER ({_USABLE.format('isfinite(close)')}) AS x FROM pricedata WHERE date IS NOT NULL GROUP BY ticker, date)),
ends AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN r END IGNORE NULLS) OVER p AS ra, last_value(x IGNORE NULLS) OVER p AS va,
first_value(CASE WHEN x IS NOT NULL THEN r END IGNORE NULLS) OVER f AS rb, first_value(x IGNORE NULLS) OVER f AS vb FROM gappy
WINDOW p AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT ticker, CAST(date AS VARCHAR) AS day, {R("coalesce(x, CASE WHEN r - ra <= 3 THEN CASE WHEN rb IS NOT NULL THEN va + (vb - va) * (r - ra) / (rb - ra) ELSE va END END)", "x")}, coalesce(x IS NULL AND r - ra <= 3, false) AS filled FROM ends""")
def hygiene_interpolate(spark, d):
    """Over the days as they are stored: a close is missing where no landing of the day has a usable one."""
    ok = F.expr(_USABLE.format("NOT isnan(close)"))
    days = table(spark, d, "pricedata").where("date is not null").groupBy("ticker", "date").agg(F.max_by(F.when(ok, F.col("close")), F.when(ok, F.col("bar_id"))).alias("x"))
    return hygiene.interpolate(days, ["x"], "ticker", "date", 3, True).selectExpr("ticker", DAY, R("x", "x"), "x_interpolated AS filled")


@query(f"""WITH gappy AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS r FROM (SELECT ticker, date, arg_max(close, bar_id) FILTER ({_USABLE.format('isfinite(close)')}) AS x FROM pricedata WHERE date IS NOT NULL GROUP BY ticker, date)),
ends AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN r END IGNORE NULLS) OVER p AS ra, last_value(CASE WHEN x IS NOT NULL THEN date END IGNORE NULLS) OVER p AS ta, last_value(x IGNORE NULLS) OVER p AS va, first_value(CASE WHEN x IS NOT NULL THEN date END IGNORE NULLS) OVER f AS tb, first_value(x IGNORE NULLS) OVER f AS vb FROM gappy
WINDOW p AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT ticker, CAST(date AS VARCHAR) AS day, {R("coalesce(x, CASE WHEN r - ra <= 50 THEN CASE WHEN tb IS NOT NULL THEN va + (vb - va) * date_diff('day', ta, date) / date_diff('day', ta, tb) ELSE va END END)", "x")} FROM ends""")
def hygiene_interpolate_by_time(spark, d):
    ok = F.expr(_USABLE.format("NOT isnan(close)"))
    days = table(spark, d, "pricedata").where("date is not null").groupBy("ticker", "date").agg(F.max_by(F.when(ok, F.col("close")), F.when(ok, F.col("bar_id"))).alias("x"))
    return hygiene.interpolate(days, ["x"], "ticker", "date", by_time=True).selectExpr("ticker", DAY, R("x", "x"))


@query(f"""SELECT bar_id, {R('CAST(last_value(CASE WHEN isfinite(close) THEN close END IGNORE NULLS) OVER w AS FLOAT)', 'close')}, {R('CAST(last_value(CASE WHEN isfinite(volume) THEN volume END IGNORE NULLS) OVER w AS FLOAT)', 'volume')} FROM pricedata WINDOW w AS (PARTITION BY ticker ORDER BY bar_id ROWS UNBOUNDED PRECEDING)""")
def hygiene_forward_fill(spark, d):
    return hygiene.forward_filled(table(spark, d, "pricedata"), ["close", "volume"], "ticker", "bar_id").selectExpr("bar_id", R("close", "close"), R("volume", "volume"))


@query("""WITH k AS (SELECT ticker, close, lag(close) OVER (PARTITION BY ticker ORDER BY bar_id) AS b FROM pricedata WHERE isfinite(close) AND close <> 0) SELECT ticker, CAST(sum(CASE WHEN abs(close / b - 1) > 1 THEN 1 ELSE 0 END) AS BIGINT) AS moves, sum(CASE WHEN abs(close / b - 1) > 1 THEN 1 ELSE 0 END) > 10 AS warns FROM k GROUP BY ticker""")
def hygiene_big_moves(spark, d):
    return hygiene.big_moves(table(spark, d, "pricedata"), "ticker", "close", "bar_id")


@query(f"""WITH bars AS ({BARS}), m AS (SELECT *, avg(back) OVER w AS mu, stddev_samp(back) OVER w AS sd FROM (SELECT *, close / {Q.lag('close')} - 1 AS back0, CASE WHEN close / {Q.lag('close')} - 1 <> 0 THEN close / {Q.lag('close')} - 1 END AS back FROM bars)
WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 281 PRECEDING)) SELECT ticker, CAST(date AS VARCHAR) AS day, {R('CASE WHEN sd IS NULL THEN back0 WHEN back0 IS NULL THEN least(mu + 3 * sd, greatest(NULL, mu - 3 * sd)) ELSE least(greatest(back0, mu - 3 * sd), mu + 3 * sd) END', 'x')} FROM m""")
def hygiene_winsorise(spark, d):
    rows = panel(spark, d).select("ticker", "date", F.col("back").alias("x"))
    return hygiene.winsorise(rows, "x", "ticker", "date").selectExpr("ticker", DAY, R("x", "x"))


@query(f"""WITH q AS (SELECT ticker, count(*) AS n_rows, coalesce(stddev_samp(CASE WHEN isfinite(close) THEN close END), 0) AS price_std, 1 - count(CASE WHEN isfinite(close) THEN close END) / count(*) AS missing_share,
datediff('day', min(date), max(date)) AS span_days FROM pricedata GROUP BY ticker) SELECT ticker, n_rows, {R('price_std', 'price_std')}, {R('missing_share', 'missing_share')}, span_days, n_rows >= 150 AND price_std >= 0.01 AND missing_share <= 0.2 AS passes FROM q""")
def hygiene_quality(spark, d):
    q = hygiene.quality(table(spark, d, "pricedata"), "ticker", "close", "date", min_rows=150)
    return q.selectExpr("ticker", "n_rows", R("price_std", "price_std"), R("missing_share", "missing_share"), "span_days", "passes")


@query(f"WITH bars AS ({BARS}) SELECT close, CAST(date AS VARCHAR) AS day, high, low, open, ticker, volume FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS r FROM bars) WHERE r > 20")
def hygiene_warmup(spark, d):
    return hygiene.drop_warmup(bars(spark, d), "ticker", "date", 20).withColumn("day", F.col("date").cast("string")).drop("date")


# cross-section, labels, splits -------------------------------------------------------------------------------------
@query(f"WITH {PANEL}, {FULL} SELECT ticker, {SDAY}, {R(Q.pct_rank('score'), 'r_score')}, {R(Q.pct_rank('volume'), 'r_volume')}, {R(Q.pct_rank('back'), 'r_back')} FROM full_panel")
def rank_cross_section(spark, d):
    long = cross.ranks_long(full(spark, d), ["score", "volume", "back"], "date", ["ticker", "date"])
    wide = long.groupBy("ticker", "date").pivot("feature", ["score", "volume", "back"]).agg(F.first("rank"))
    return wide.selectExpr("ticker", DAY, R("score", "r_score"), R("volume", "r_volume"), R("back", "r_back"))


@query(f"""WITH {PANEL}, c AS (SELECT *, {Q.rank('score')} AS ar, count(score) OVER (PARTITION BY date) AS n, avg(score) OVER (PARTITION BY date) AS mu, stddev_pop(score) OVER (PARTITION BY date) AS sd FROM panel)
SELECT ticker, {SDAY}, {R('CASE WHEN n >= 2 AND score IS NOT NULL THEN ar / (n + 1) * 2 - 1 ELSE 0 END', 'centred')}, {R('(score - mu) / (sd + 1e-10)', 'z')} FROM c""")
def rank_centred_and_z(spark, d):
    return panel(spark, d).withColumns({"c": cross.centred_rank("score", ["date"]), "zz": cross.zscore("score", ["date"])}).selectExpr("ticker", DAY, R("c", "centred"), R("zz", "z"))


@query(f"""WITH {PANEL}, {FULL}, t AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS k FROM full_panel)
SELECT {SDAY}, {R('avg(up)', 'precision_k')}, {R('avg(ret)', 'mean_ret')}, count(*) AS k FROM t WHERE n >= 20 AND k <= greatest(floor(n * 0.1), 1) GROUP BY date""")
def top_k_per_day(spark, d):
    top = cross.top_k(full(spark, d), "score", "date", 0.1, 20, [F.asc("ticker")])
    return top.groupBy("date").agg(F.avg("up").alias("p"), F.avg("ret").alias("m"), F.count(F.lit(1)).alias("k")).selectExpr(DAY, R("p", "precision_k"), R("m", "mean_ret"), "k")


_BAND = " ".join(f"WHEN rank >= {lo} AND rank < {hi} THEN '{n}'" for n, lo, hi in cross.BANDS)


@query(f"""WITH {PANEL}, {FULL}, {RANKED}, b AS (SELECT *, CASE {_BAND} END AS band FROM ranked), dd AS (SELECT band, date, avg(ret) AS m FROM b GROUP BY ALL), e AS (SELECT band, avg(m) AS pm, stddev_samp(m) AS ps FROM dd GROUP BY band)
SELECT b.band, count(*) AS n, {R('count(*) / (SELECT count(DISTINCT date) FROM ranked)', 'picks_per_day')}, {R('avg(ret) * 100', 'pooled_ret')}, {R('any_value(pm) * 100', 'perday_ret')},
{R('any_value(CASE WHEN ps > 0 THEN pm / ps * sqrt(252) END)', 'perday_sharpe')}, {R('avg(up)', 'precision_band')}, {R('avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END)', 'hit')} FROM b JOIN e ON b.band = e.band GROUP BY b.band""")
def band_report(spark, d):
    t = cross.band_table(ranked(spark, d), "rank", "ret", "up", "date")
    return t.selectExpr("band", "n", R("picks_per_day", "picks_per_day"), R("pooled_ret", "pooled_ret"), R("perday_ret", "perday_ret"), R("perday_sharpe", "perday_sharpe"), R("precision", "precision_band"), R("hit", "hit"))


@query(f"""WITH {PANEL}, {FULL}, {RANKED}, n AS (SELECT date, avg(CASE WHEN rank >= 0.9 THEN ret END) - avg(CASE WHEN rank < 0.5 THEN ret END) AS net FROM ranked GROUP BY date) SELECT {R('avg(net) * 100', 'net')}, count(net) AS days FROM n""")
def band_net_of_baseline(spark, d):
    daily = ranked(spark, d).groupBy("date").agg((F.avg(F.when(F.col("rank") >= 0.9, F.col("ret"))) - F.avg(F.when(F.col("rank") < 0.5, F.col("ret")))).alias("net"))
    return daily.agg((F.avg("net") * 100).alias("net"), F.count("net").alias("days")).selectExpr(R("net", "net"), "days")


@query(f"""WITH {PANEL}, {FULL}, r AS (SELECT date, {Q.rank('score')} AS a, {Q.rank('ret')} AS b FROM full_panel) SELECT {SDAY}, count(*) AS n, {R('covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0)', 'ic')} FROM r GROUP BY date HAVING count(*) >= 5""")
def daily_rank_ic(spark, d):
    return cross.rank_correlations(full(spark, d), "score", "ret", "date").selectExpr(DAY, "n", R("ic", "ic"))


@query(f"""WITH {PANEL}, {FULL}, e AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS q FROM full_panel), b AS (SELECT ret, 1 + len(list_filter(list_distinct(q), lambda x: x < score)) AS bin FROM full_panel, e)
SELECT bin, count(*) AS n, {R('avg(ret) * 100', 'mean_ret')}, {R('median(ret) * 100', 'median_ret')}, {R('avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END)', 'win')}, {R('stddev_samp(ret) * 100', 'sd')} FROM b GROUP BY bin""")
def quantile_bin_report(spark, d):
    b = cross.quantile_bins(full(spark, d), "score", 5)
    a = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("m"), F.expr("percentile(ret, 0.5)").alias("md"), F.avg(F.when(F.col("ret") > 0, F.lit(1.0).cast("double")).otherwise(0.0)).alias("w"), F.stddev_samp("ret").alias("s"))
    return a.selectExpr("bin", "n", R("m * 100", "mean_ret"), R("md * 100", "median_ret"), R("w", "win"), R("s * 100", "sd"))


@query(f"""WITH {PANEL}, {FULL}, r AS (SELECT up, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM full_panel)
SELECT {R('(sum(CASE WHEN up = 1 THEN k ELSE 0 END) - sum(up) * (sum(up) + 1) / 2.0) / (sum(up) * (count(*) - sum(up)))', 'auc')}, CAST(sum(up) AS BIGINT) AS positives, CAST(count(*) - sum(up) AS BIGINT) AS negatives FROM r""")
def auc_by_ranks(spark, d):
    return cross.auc(full(spark, d), "score", "up").selectExpr(R("auc", "auc"), "positives", "negatives")


@query(f"""WITH {PANEL}, {FULL}, c AS (SELECT score, sum(up) AS p, count(*) AS n FROM full_panel GROUP BY score), a AS (SELECT score AS threshold, sum(p) OVER w / sum(n) OVER w AS prec, sum(n) OVER w / sum(n) OVER () AS coverage FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT {R('max(threshold)', 'threshold')}, {R('max(prec)', 'prec')}, {R('max(coverage)', 'coverage')} FROM (SELECT * FROM a WHERE coverage BETWEEN 0.001 AND 0.3 AND prec >= 0.5 ORDER BY threshold LIMIT 1)""")
def precision_cutoff(spark, d):
    return cross.precision_threshold(full(spark, d), "score", "up", 0.5, 0.001, 0.3).selectExpr(R("threshold", "threshold"), R("precision", "prec"), R("coverage", "coverage"))


@query(f"""WITH {PANEL}, {FULL}, {RANKED} SELECT ticker, {SDAY}, {R('CASE WHEN rank >= 0.9 THEN 0.45 + 0.25 * (rank - 0.9) / 0.1 ELSE 0.30 + 0.14 * rank / 0.9 END', 'up_probability')}, CASE WHEN ret >= quantile_cont(ret, 0.9) OVER (PARTITION BY date) THEN 1 ELSE 0 END AS label FROM ranked""")
def rescale_and_top_label(spark, d):
    r = cross.top_label(ranked(spark, d).withColumn("u", cross.rescaled(F.col("rank"), 0.1)), "ret", ["date"], 0.1)
    return r.selectExpr("ticker", DAY, R("u", "up_probability"), "label")


@query(f"""WITH {PANEL}, {FULL}, c AS (SELECT date, count(*) AS n FROM full_panel GROUP BY date), u AS (SELECT *, sum(n) OVER (ORDER BY date) AS upto, sum(n) OVER () AS total FROM c),
e AS (SELECT min(date) AS e FROM u WHERE upto >= greatest(floor(total * 0.6), 1)), p AS (SELECT date, sum(n) OVER (ORDER BY date) AS upto, sum(n) OVER () AS pool, total FROM u, e WHERE date >= e + 10), k AS (SELECT min(date) AS k FROM p WHERE upto >= least(floor(total * 0.15), pool))
SELECT CASE WHEN date <= e THEN 'train' WHEN date < e + 10 THEN 'embargo' WHEN date <= k THEN 'calib' ELSE 'oos' END AS split, count(*) AS n, count(DISTINCT date) AS days FROM full_panel, e, k GROUP BY 1""")
def split_with_embargo(spark, d):
    return cross.time_split(full(spark, d), "date", 60, 15, 10).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("days"))


@query(f"""WITH {PANEL}, {FULL}, w AS (SELECT ticker, date, pow(0.5, datediff('day', date, (SELECT max(date) FROM full_panel)) / 90.0) AS w FROM full_panel) SELECT ticker, {SDAY}, {R('w / (SELECT avg(w) FROM w)', 'weight')} FROM w""")
def weight_recency(spark, d):
    return cross.with_recency_weight(full(spark, d), "date", 90).selectExpr("ticker", DAY, R("weight", "weight"))


# metrics -----------------------------------------------------------------------------------------------------------
_ERF = "(1 - (t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))) * exp(-x * x))"


@query(f"""WITH {PANEL}, r AS (SELECT ticker, date, back AS ret FROM panel WHERE back IS NOT NULL), eq AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY date)) AS equity FROM r), dd AS (SELECT *, (1 - equity / max(equity) OVER (PARTITION BY ticker ORDER BY date)) * 100 AS drawdown FROM eq)
SELECT ticker, count(*) AS n, {R('stddev_pop(ret) * 100', 'daily_volatility')}, {R('CASE WHEN stddev_samp(ret) > 1e-12 THEN (avg(ret) - (pow(1.05, 1.0 / 252) - 1)) / stddev_samp(ret) * sqrt(252) END', 'sharpe_ratio')},
{R('sum(CASE WHEN ret > 0 THEN ret ELSE 0 END) / nullif(-sum(CASE WHEN ret < 0 THEN ret ELSE 0 END), 0)', 'gain_to_pain_ratio')}, {R('sqrt(avg(drawdown * drawdown))', 'ulcer_index')}, {R('max(drawdown)', 'max_drawdown')},
{R('quantile_cont(ret, 0.05) * 100', 'var_95')}, {R('CASE WHEN quantile_cont(ret, 0.05) < 0 THEN quantile_cont(ret, 0.95) / -quantile_cont(ret, 0.05) END', 'tail_ratio')},
{R('sum(greatest(ret - 0.05 / 252, 0)) / nullif(sum(greatest(0.05 / 252 - ret, 0)), 0)', 'omega_ratio_rf')}, {R('avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) * 100', 'positive_days_pct')} FROM dd GROUP BY ticker""")
def metrics_by_ticker(spark, d):
    rows = panel(spark, d).where("back is not null").select("ticker", "date", F.col("back").alias("ret"))
    m = metrics.summary(rows, "ticker", "date", "ret")
    return m.selectExpr("ticker", "n", *[R(c, c) for c in ("daily_volatility", "sharpe_ratio", "gain_to_pain_ratio", "ulcer_index", "max_drawdown", "var_95", "tail_ratio", "omega_ratio_rf", "positive_days_pct")])


@query(f"""WITH {PANEL}, r AS (SELECT ticker, date, back > 0 AS pos FROM panel WHERE back IS NOT NULL), t AS (SELECT *, CASE WHEN pos = lag(pos) OVER (PARTITION BY ticker ORDER BY date) THEN 0 ELSE 1 END AS turn FROM r),
g AS (SELECT *, sum(turn) OVER (PARTITION BY ticker ORDER BY date) AS run FROM t), k AS (SELECT ticker, run, any_value(pos) AS pos, count(*) AS n FROM g GROUP BY ticker, run)
SELECT ticker, coalesce(max(CASE WHEN pos THEN n END), 0) AS max_pos_streak, coalesce(max(CASE WHEN NOT pos THEN n END), 0) AS max_neg_streak FROM k GROUP BY ticker""")
def metrics_streaks(spark, d):
    rows = panel(spark, d).where("back is not null").select("ticker", "date", F.col("back").alias("ret"))
    return metrics.summary(rows, "ticker", "date", "ret").selectExpr("ticker", "CAST(max_pos_streak AS BIGINT) AS max_pos_streak", "CAST(max_neg_streak AS BIGINT) AS max_neg_streak")


@query(f"WITH {PANEL} SELECT ticker, CAST(CAST(date_trunc('month', date) AS DATE) AS VARCHAR) AS month, {R('(exp(sum(ln(1 + back))) - 1) * 100', 'return_pct')}, count(*) AS days FROM panel WHERE back IS NOT NULL GROUP BY ticker, date_trunc('month', date)")
def returns_by_month(spark, d):
    return metrics.period_returns(panel(spark, d), "ticker", "date", "back").selectExpr("ticker", "CAST(period AS STRING) AS month", R("return_pct", "return_pct"), "days")


@query(f"""WITH {PANEL}, m AS (SELECT ticker, date_trunc('month', date) AS month, exp(sum(ln(1 + back))) - 1 AS r FROM panel WHERE back IS NOT NULL GROUP BY ALL), b AS (SELECT month, avg(r) AS b FROM m GROUP BY month)
SELECT ticker, {R('(exp(avg(CASE WHEN b > 0 THEN ln(1 + r) END)) - 1) / nullif(exp(avg(CASE WHEN b > 0 THEN ln(1 + b) END)) - 1, 0) * 100', 'up_capture')}, {R('(exp(avg(CASE WHEN b < 0 THEN ln(1 + r) END)) - 1) / nullif(exp(avg(CASE WHEN b < 0 THEN ln(1 + b) END)) - 1, 0) * 100', 'down_capture')} FROM m JOIN b USING (month) GROUP BY ticker""")
def capture_ratios(spark, d):
    m = metrics.period_returns(panel(spark, d), "ticker", "date", "back").withColumn("r", F.col("return_pct") / 100)
    b = m.groupBy("period").agg(F.avg("r").alias("b"))
    j = m.join(b, "period")
    gm = lambda x, c: F.exp(F.avg(F.when(c, F.ln(1 + F.col(x))))) - 1
    up, dn = F.col("b") > 0, F.col("b") < 0
    a = j.groupBy("ticker").agg((gm("r", up) / F.nullif(gm("b", up), F.lit(0.0)) * 100).alias("u"), (gm("r", dn) / F.nullif(gm("b", dn), F.lit(0.0)) * 100).alias("v"))
    return a.selectExpr("ticker", R("u", "up_capture"), R("v", "down_capture"))


# relations ---------------------------------------------------------------------------------------------------------
@query(f"""WITH {PANEL}, i AS (SELECT date, avg(back) AS y FROM panel WHERE back IS NOT NULL GROUP BY date), p AS (SELECT ticker, back AS x, y FROM panel JOIN i USING (date) WHERE back IS NOT NULL)
SELECT ticker, count(*) AS n, {R('covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0)', 'corr')}, {R('covar_samp(x, y) / var_samp(y)', 'beta')}, {R('avg(x) - covar_samp(x, y) / var_samp(y) * avg(y)', 'alpha')} FROM p GROUP BY ticker""")
def beta_to_index(spark, d):
    p = panel(spark, d)
    i = p.where("back is not null").groupBy("date").agg(F.avg("back").alias("y"))
    return relate.correlations_with(p, i, "ticker", "date", "back", "y").selectExpr("ticker", "n", R("corr", "corr"), R("beta", "beta"), R("alpha", "alpha"))


_GROUPS = "groups AS (SELECT ticker, max(coalesce(nullif(trim(sector), ''), '-')) AS g FROM tickerciks GROUP BY ticker)"


def _groups(spark, d):
    return table(spark, d, "tickerciks").groupBy("ticker").agg(F.max(F.expr("coalesce(nullif(trim(sector), ''), '-')")).alias("g"))


@query(f"""WITH {PANEL}, {_GROUPS}, z AS (SELECT ticker, date, (back - avg(back) OVER (PARTITION BY ticker)) / nullif(stddev_samp(back) OVER (PARTITION BY ticker), 0) AS z FROM panel WHERE back IS NOT NULL), m AS (SELECT g, date, avg(z) AS gz FROM z JOIN groups USING (ticker) GROUP BY ALL)
SELECT ticker, g, {R('covar_samp(z, gz)', 'mean_corr')} FROM z JOIN m USING (date) GROUP BY ticker, g""")
def correlation_with_groups(spark, d):
    return relate.group_correlations(panel(spark, d), _groups(spark, d), "ticker", "date", "back", "g").selectExpr("ticker", "g", R("mean_corr", "mean_corr"))


@query(f"""WITH {PANEL}, {_GROUPS}, r AS (SELECT p.ticker, date, back, g FROM panel p JOIN groups USING (ticker) WHERE back IS NOT NULL), a AS (SELECT g, avg(p) * 252 AS ar, stddev_samp(p) * sqrt(252) AS av FROM (SELECT g, date, avg(back) AS p FROM r GROUP BY ALL) GROUP BY g),
o AS (SELECT g, avg(v) AS mv, count(*) AS members FROM (SELECT g, ticker, stddev_samp(back) * sqrt(252) AS v FROM r GROUP BY ALL) GROUP BY g) SELECT g, members, {R('ar', 'ann_return')}, {R('av', 'ann_vol')}, {R('ar / av', 'sharpe')}, {R('mv', 'mean_vol')}, {R('(mv - av) / mv', 'diversification')} FROM a JOIN o USING (g)""")
def group_risk(spark, d):
    r = relate.risk(panel(spark, d), _groups(spark, d), "ticker", "date", "back", "g")
    return r.selectExpr("g", "members", *[R(c, c) for c in ("ann_return", "ann_vol", "sharpe", "mean_vol", "diversification")])


@query()
def ticker_clusters(spark, d):
    """The scaled correlation matrix of daily returns, clustered with the best k of 6 to 19."""
    points = relate.correlation_points(panel(spark, d), "ticker", "date", "back", scaled=True)
    return relate.clusters(points, "ticker", ["point"], range(6, 20), scale=False)


@query(f"""WITH {PANEL}, p AS (SELECT date, avg(back) AS p FROM panel WHERE back IS NOT NULL GROUP BY date) SELECT ticker, {R('stddev_samp(back) * sqrt(252)', 'vol')}, {R('covar_samp(back, p) * sqrt(252) / (SELECT stddev_samp(p) FROM p)', 'marginal')} FROM panel JOIN p USING (date) WHERE back IS NOT NULL GROUP BY ticker""")
def risk_marginal(spark, d):
    return relate.marginal_risk(panel(spark, d), "ticker", "date", "back").selectExpr("ticker", R("vol", "vol"), R("marginal", "marginal"))


@query(f"""WITH {PANEL}, c AS (SELECT ticker, date, back AS x FROM panel WHERE abs(back) <= 0.2), e AS (SELECT ticker FROM c GROUP BY ticker HAVING count(*) >= 60 AND stddev_samp(x) * sqrt(252) <= 1), r AS (SELECT * FROM c WHERE ticker IN (SELECT ticker FROM e)),
d AS (SELECT date FROM r GROUP BY date HAVING count(*) >= 0.6 * (SELECT count(DISTINCT ticker) FROM r)), q AS (SELECT * FROM r WHERE date IN (SELECT date FROM d)), s AS (SELECT ticker, avg(x) AS m, stddev_samp(x) AS s FROM q GROUP BY ticker HAVING count(*) >= 0.5 * (SELECT count(*) FROM d))
SELECT ticker, {SDAY}, {R('CASE WHEN s IS NULL THEN x ELSE least(greatest(x, m - 3 * s), m + 3 * s) END', 'x')} FROM q JOIN s USING (ticker)""")
def returns_filtered(spark, d):
    return relate.filtered_returns(panel(spark, d), "ticker", "date", "back", 60, 0.2, 1.0, 0.6, 0.5).selectExpr("ticker", DAY, R("back", "x"))


_ANCHORS = ("2025-04-01", "2025-05-01", "2025-06-01")


@query(f"""WITH {PANEL}, {_GROUPS}, k AS (SELECT a.anchor, p.ticker, p.date, back, row_number() OVER (PARTITION BY a.anchor, p.ticker ORDER BY p.date DESC) AS k, count(*) OVER (PARTITION BY a.anchor, p.ticker) AS n
FROM panel p JOIN (VALUES {', '.join(f"(DATE '{a}')" for a in _ANCHORS)}) AS a(anchor) ON p.date < a.anchor WHERE back IS NOT NULL), r AS (SELECT * FROM k WHERE k <= 60 AND n >= 40),
z AS (SELECT anchor, ticker, date, (back - avg(back) OVER w) / nullif(stddev_samp(back) OVER w, 0) AS z FROM r WINDOW w AS (PARTITION BY anchor, ticker)), m AS (SELECT anchor, g, date, avg(z) AS gz FROM z JOIN groups USING (ticker) GROUP BY ALL)
SELECT CAST(anchor AS VARCHAR) AS anchor, ticker, g, {R('covar_samp(z, gz)', 'mean_corr')} FROM z JOIN m USING (anchor, date) GROUP BY anchor, ticker, g""")
def correlation_at_anchors(spark, d):
    """Mean correlations with sectors at month beginnings, over the 60 days before each."""
    rows = relate.anchored(panel(spark, d).where("back is not null").select("ticker", "date", "back"), "ticker", "date", list(_ANCHORS), 60, 40)
    keyed = rows.withColumn("key", F.struct("anchor", "ticker"))
    groups = _groups(spark, d)
    z = relate.standardised(keyed, "key", "date", "back").select(F.col("key.anchor").alias("anchor"), F.col("key.ticker").alias("ticker"), "date", "z")
    means = z.join(groups, "ticker").groupBy("anchor", "g", "date").agg(F.avg("z").alias("gz"))
    each = z.join(means, ["anchor", "date"]).groupBy("anchor", "ticker", "g").agg(F.covar_samp("z", "gz").alias("mean_corr"))
    return each.selectExpr("CAST(anchor AS STRING) AS anchor", "ticker", "g", R("mean_corr", "mean_corr"))


@query(f"""WITH {PANEL}, f AS (SELECT ticker, date, coalesce(back, 0) AS x FROM (SELECT DISTINCT ticker FROM panel WHERE back IS NOT NULL) t CROSS JOIN (SELECT DISTINCT date FROM panel WHERE back IS NOT NULL) d LEFT JOIN (SELECT ticker, date, back FROM panel) p USING (ticker, date)),
w AS (SELECT date, w / sum(w) OVER () AS w FROM (SELECT DISTINCT date, exp(-date_diff('day', date, (SELECT max(date) FROM f)) / 126.0) AS w FROM f)), m AS (SELECT ticker, sum(w * x) AS m FROM f JOIN w USING (date) GROUP BY ticker), c AS (SELECT ticker, date, w, x - m AS y FROM f JOIN w USING (date) JOIN m USING (ticker)),
v AS (SELECT ticker, sqrt(sum(w * y * y)) AS s FROM c GROUP BY ticker), p AS (SELECT a.ticker AS a, b.ticker AS b, sum(a.w * a.y * b.y) AS ab FROM c a JOIN c b USING (date) GROUP BY 1, 2), r AS (SELECT a, b, greatest(least(ab / (x.s * y.s), 1), -1) AS r FROM p JOIN v x ON x.ticker = a JOIN v y ON y.ticker = b WHERE x.s > 1e-12 AND y.s > 1e-12)
SELECT a AS ticker, {R('avg(r)', 'mean_corr')}, count(*) AS entities FROM r GROUP BY a""")
def correlation_weighted(spark, d):
    """Each ticker's mean in the correlation matrix whose days weigh exp(-age / 126); days without a return are 0."""
    p = relate.correlation_profiles(panel(spark, d), "ticker", "date", "back", decay_days=126, fill=0.0)
    return p.selectExpr("ticker", R("aggregate(profile, 0D, (a, v) -> a + v) / size(profile)", "mean_corr"), "CAST(size(profile) AS BIGINT) AS entities")


@query()
def ticker_tree(spark, d):
    """Hierarchical clusters of the correlation matrix."""
    return relate.trees(relate.correlation_points(panel(spark, d), "ticker", "date", "back"), "ticker", "point", range(4, 16))


# texts -------------------------------------------------------------------------------------------------------------
def _sum(words: list[str], weight: int) -> str:
    return " + ".join(f"CASE WHEN contains(t, '{w}') THEN {weight} ELSE 0 END" for w in words)


@query(f"""WITH s AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), c AS (SELECT doc_id, {_sum(text.STRONG_POSITIVE, 2)} + {_sum(text.POSITIVE, 1)} AS p, {_sum(text.STRONG_NEGATIVE, 2)} + {_sum(text.NEGATIVE, 1)} AS n FROM s),
x AS (SELECT doc_id, CASE WHEN p + n = 0 THEN 0 ELSE (p - n) / (p + n + 5) END AS v FROM c) SELECT doc_id, {R('v', 'sentiment_score')}, CASE WHEN v > 0.25 THEN 'positive' WHEN v < -0.25 THEN 'negative' ELSE 'neutral' END AS sentiment FROM x""")
def text_sentiment(spark, d):
    return text.with_sentiment(table(spark, d, "documents"), "text").selectExpr("doc_id", R("sentiment_score", "sentiment_score"), "sentiment")


@query()
def text_complexity(spark, d):
    """Of every document, whatever its language; the engines' word classes differ, so there is no SQL."""
    return text.with_complexity(table(spark, d, "documents"), "text").select("doc_id", "complexity")


@query()
def text_mentions(spark, d):
    """Tickers in any case, and company names in their variants."""
    return text.mentions_folded(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "tickerciks"), "ticker", "name")


@query("SELECT doc_id, regexp_replace(text, '<.*?>', '', 'g') AS plain FROM documents")
def text_without_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", text.without_tags(F.col("text")).alias("plain"))


@query()
def text_publication_time(spark, d):
    return table(spark, d, "documents").select("doc_id", text.publication_time(F.col("pub_date")).alias("published"))


@query("""WITH a AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(trim(title))) AS ft, title, min(doc_id) OVER (PARTITION BY guid) AS fu, guid FROM documents) SELECT doc_id FROM a WHERE (title IS NULL OR ft = doc_id) AND (guid IS NULL OR fu = doc_id)""")
def text_first_seen(spark, d):
    return text.keep_unseen(table(spark, d, "documents"), "title", "guid", "doc_id").select("doc_id")


@query()
def text_alpha_score(spark, d):
    """Of every document: its complexity and length."""
    docs = text.with_complexity(table(spark, d, "documents"), "text")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\\s+"), lambda w: w != ""))
    return docs.select("doc_id", text.alpha_score(F.col("complexity"), words).alias("alpha_score"))


@query()
def text_related_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat_ws("; ", text.related_terms(F.col("text"))).alias("terms"))


_SCORES = f"""s AS (SELECT doc_id, ticker, lower(coalesce(text, '')) AS t FROM documents), c AS (SELECT doc_id, ticker, {_sum(text.STRONG_POSITIVE, 2)} + {_sum(text.POSITIVE, 1)} AS p, {_sum(text.STRONG_NEGATIVE, 2)} + {_sum(text.NEGATIVE, 1)} AS n FROM s),
x AS (SELECT doc_id, ticker, CASE WHEN p + n = 0 THEN 0 ELSE (p - n) / (p + n + 5) END AS v FROM c), m AS (SELECT ticker, v, CASE WHEN v > 0.25 THEN 'positive' WHEN v < -0.25 THEN 'negative' ELSE 'neutral' END AS s FROM x WHERE ticker IS NOT NULL),
a AS (SELECT ticker, count(*) AS n, avg(v) AS m, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi, count(*) FILTER (s = 'positive') AS pos, count(*) FILTER (s = 'negative') AS neg FROM m GROUP BY ticker)"""


def _summary(spark, d):
    docs = text.with_sentiment(table(spark, d, "documents"), "text")
    return text.sentiment_summary(docs, docs.where("ticker is not null").select("doc_id", "ticker"), "doc_id", "ticker")


@query(f"WITH {_SCORES} SELECT ticker, n AS mention_count, {R('m', 'avg_score')}, {R('sd', 'std_score')}, {R('lo', 'min_score')}, {R('hi', 'max_score')}, pos AS positive, neg AS negative FROM a")
def text_sentiment_summary(spark, d):
    return _summary(spark, d).selectExpr("ticker", "mention_count", *[R(c, c) for c in ("avg_score", "std_score", "min_score", "max_score")], "coalesce(breakdown['positive'], 0L) AS positive", "coalesce(breakdown['negative'], 0L) AS negative")


_TOP = "SELECT '{n}' AS list, ticker, n, m FROM (SELECT *, row_number() OVER (ORDER BY {o}, ticker) AS k FROM a WHERE {w}) WHERE k <= 10"


@query(f"WITH {_SCORES}, u AS ({_TOP.format(n='attention', o='n DESC', w='true')} UNION ALL {_TOP.format(n='bullish', o='m DESC', w='n >= 3 AND m > 0.1')} UNION ALL {_TOP.format(n='bearish', o='m', w='n >= 3 AND m < -0.1')}) SELECT list, ticker, n AS mention_count, {R('m', 'avg_score')} FROM u")
def text_top_mentions(spark, d):
    """The ten most mentioned tickers, and the ten most bullish and bearish of those mentioned three times."""
    s = _summary(spark, d).withColumn("avg_score", F.col("avg_score"))
    return text.insights(s, "ticker", 10, 3, 0.1).selectExpr("list", "ticker", "mention_count", R("avg_score", "avg_score"))


@query(f"""WITH e AS (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS p FROM embeddings WHERE label IS NOT NULL), c AS (SELECT label, p, avg(CAST(v AS DOUBLE)) AS v FROM e GROUP BY label, p)
SELECT a.label, b.label AS label_anchor, {R('sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v))', 'cosine')} FROM c a JOIN c b USING (p) GROUP BY a.label, b.label""")
def text_centroid_cosines(spark, d):
    """Mean vectors of labels against each other."""
    e = table(spark, d, "embeddings")
    return text.centroid_cosines(e, "embedding", "label", e, "label").selectExpr("label", "label_anchor", R("cosine", "cosine"))


@query("SELECT ticker, count(*) AS n, count(DISTINCT source) AS sources, max(length(text)) AS longest FROM documents WHERE ticker IS NOT NULL GROUP BY ticker HAVING count(*) >= 3")
def text_daily_attention(spark, d):
    docs = table(spark, d, "documents").where("ticker is not null")
    return docs.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.max(F.length("text")).alias("longest")).where("n >= 3")

"""Queries of the kernels, sources, streams and models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import features
from tesserae.operators import evaluate, joins, kernels, models
from tesserae.plans import blocks
from tesserae.plans.scale import shared_dir
from tesserae.queries.panel import BARS, bars, rounded, table
from tesserae.queries.relational import panel
from tesserae.sources import io
from tesserae.streaming import windows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def made(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return made


#: The tables hold 160 days, so the history of ranks is passed shorter than its default.
_OPTIONS = {"quantile_visibility": {"norm": 100}}


def _kernel(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        if name in ("primitives", "matrix_powers"):
            columns = ("open", "high", "low", "close", "volume")
            p = kernels.run(bars(spark, d), ["primitives"], columns=columns)
            if name == "primitives":
                return p
            scales = p.agg(*[F.stddev_pop(f"prim_{k}") for k in kernels.PRIMITIVES]).first()
            return kernels.run(bars(spark, d), [name], columns=columns, options={name: {"scales": tuple(x or 1.0 for x in scales)}})
        if name == "reversion_probability":
            vix = table(spark, d, "rfpredictions").where("date is not null and vix_close > 0").groupBy("date").agg(F.max("vix_close").alias("vix"))
            return kernels.run(joins.asof(bars(spark, d), vix, "date"), [name], columns=("high", "low", "close", "volume", "vix"))
        return kernels.run(bars(spark, d), [name], options=_OPTIONS)

    return run


for _name in kernels.KERNELS:
    QUERIES[f"kernel_{_name}"] = _kernel(_name)


@query()
def panel_composite(spark: SparkSession, d: str) -> DataFrame:
    """All five cross-section formulas and their composite."""
    b = bars(spark, d)
    noise = kernels.run(b, ["complexity"]).select("ticker", "date", "noise_white_60", "noise_pink_60", "spectral_entropy_60")
    rows = blocks.apply(b, blocks.REGISTRY["panel_inputs"], blocks.REGISTRY["panel_formulas"]).join(noise, ["ticker", "date"])
    return blocks.apply(rows, features.PANEL_COMPOSITE).selectExpr("ticker", "CAST(date AS STRING) AS day", *[f"gp_{x}" for x in ("f1", "f3", "f4", "n1", "n4", "composite")])


@query("SELECT cik, name, ticker, exchange, sector, CAST(snapshot_date AS VARCHAR) AS snapshot_date FROM tickerciks")
def source_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/roundtrip-{uuid.uuid4().hex}.csv"
    t = table(spark, d, "tickerciks")
    t.write.option("header", "true").option("nullValue", "\\N").option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return io.load(spark, path, t.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), nullValue="\\N", escape='"', emptyValue="").withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


@query("SELECT doc_id, title, source, ticker FROM documents")
def source_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/roundtrip-{uuid.uuid4().hex}.json"
    table(spark, d, "documents").select("doc_id", "title", "source", "ticker").write.json(path)
    return io.load(spark, path, "doc_id bigint, title string, source string, ticker string")


@query("SELECT count(*) AS n, ticker FROM pricedata GROUP BY ticker")
def source_partitioned(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/bars-{uuid.uuid4().hex}.parquet"
    io.save(table(spark, d, "pricedata").withColumn("month", F.date_format("date", "yyyy-MM")), path, ["month"])
    return io.load(spark, path).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query()
def source_profile(spark: SparkSession, d: str) -> DataFrame:
    return io.profile(table(spark, d, "rfpredictions"))


@query("""SELECT ticker, len(list_filter(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY), lambda x: isodow(x) < 6)) AS weekdays,
len(list_filter(generate_series(date_trunc('quarter', CAST(min(date) AS TIMESTAMP)), TIMESTAMP '2025-07-01', INTERVAL 3 MONTH), lambda x: x + INTERVAL 120 DAY <= TIMESTAMP '2025-07-01')) AS quarters FROM pricedata WHERE date IS NOT NULL GROUP BY ticker""")
def source_calendars(spark: SparkSession, d: str) -> DataFrame:
    ends = table(spark, d, "pricedata").where("date is not null").groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return ends.select("ticker", F.size(io.business_days(F.col("a"), F.col("b"))).alias("weekdays"), F.size(io.released_quarters(F.col("a"), F.lit("2025-07-01").cast("date"))).alias("quarters"))


@query(f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, {rounded('CAST(sum(value) AS DOUBLE)')} AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Complete mode: every window of the stream, none late."""
    out = windows.drained(windows.tumbling(windows.source(spark, f"{d}/events.parquet"), "ts", "value", "event_type", late="3650 days"), "complete")
    return out.selectExpr("CAST(start AS TIMESTAMP_NTZ) AS start", "event_type", "n", f"{rounded('CAST(total AS DOUBLE)')} AS total")


@query()
def model_boosted(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d).where("ret is not null and score is not null")
    cut = "2025-04-15"
    cols = ["score", "back", "volume"]
    return models.boosted_scores(p.where(F.col("date") <= cut), p.where(F.col("date") > cut), cols, "up", trees=5).select("ticker", "date", "probability")


@query()
def model_boosted_stopped(spark: SparkSession, d: str) -> DataFrame:
    """Boosting that stops by the last fifth of its rows."""
    p = panel(spark, d).where("ret is not null and score is not null")
    return models.boosted_scores(p.where(F.col("date") <= "2025-04-15"), p.where(F.col("date") > "2025-04-15"), ["score", "back", "volume"], "up", trees=8, time="date").select("ticker", "date", "probability")


@query()
def model_seed_ensemble(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d).where("ret is not null and score is not null")
    return models.ensemble_scores(p.where(F.col("date") <= "2025-04-15"), p.where(F.col("date") > "2025-04-15"), ["score", "back", "volume"], "up", ["ticker", "date"], [1, 2, 3])


@query()
def model_adversarial(spark: SparkSession, d: str) -> DataFrame:
    """How well the second half of the days is told from the first."""
    p = panel(spark, d).where("ret is not null and score is not null").withColumn("era", F.expr("CASE WHEN date > DATE '2025-03-01' THEN 1 ELSE 0 END"))
    return models.adversarial(p, "era", ["score", "back", "volume", "close"], ["ticker", "date"])


@query()
def model_search(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d).where("ret is not null and score is not null")
    found = models.search(p, ["score", "back", "volume"], "up", "date", [{"depth": a, "trees": b} for a in (2, 3) for b in (2, 4)])
    return spark.createDataFrame([(i + 1, float(a), s["depth"], s["trees"]) for i, (a, s) in enumerate(found)], "place int, auc double, depth int, trees int")


@query()
def model_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Two steps of a walk-forward with the rows of the last 40 days, and their decay against one percent."""
    p = panel(spark, d).where("ret is not null and score is not null")
    steps = [(r.anchor, r.next_month) for r in evaluate.anchors(p, "date", "2025-04").orderBy("month").collect()]  # a row a month
    table_ = models.walk_forward(p, ["score", "back", "volume"], "up", "ret", "date", steps, lambda df, a: evaluate.training_rows(df, "date", a, "recent_40"))
    return models.decay(table_, 0.01)


@query()
def portfolio_volatility_draws(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "tickerciks").groupBy("ticker").agg(F.max(F.expr("coalesce(nullif(trim(sector), ''), '-')")).alias("g"))
    return models.portfolio_draws(panel(spark, d), "ticker", "date", "back", groups, "g")


_ORDERED = f"b AS (SELECT ticker, date, high, low, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS r FROM ({BARS}))"


@query(f"""WITH RECURSIVE {_ORDERED}, k AS (SELECT ticker, date, r, close AS x, 1.01 * (1 - 1.01 / 2.01) AS p FROM b WHERE r = 1 UNION ALL
SELECT b.ticker, b.date, b.r, k.x + (k.p + 0.01) / (k.p + 1.01) * (b.close - k.x), (k.p + 0.01) * (1 - (k.p + 0.01) / (k.p + 1.01)) FROM k JOIN b ON b.ticker = k.ticker AND b.r = k.r + 1)
SELECT ticker, CAST(date AS VARCHAR) AS day, {rounded('x')} AS kalman FROM k""")
def kalman_filtered(spark: SparkSession, d: str) -> DataFrame:
    return kernels.run(bars(spark, d), ["kalman"]).selectExpr("ticker", "CAST(date AS STRING) AS day", f"{rounded('kalman')} AS kalman")


@query(f"""WITH RECURSIVE {_ORDERED}, k AS (SELECT ticker, date, r, low AS sar, high AS ep, 0.02e0 AS af, high AS h, low AS l, close AS c FROM b WHERE r = 1 UNION ALL
SELECT b.ticker, b.date, b.r, CASE WHEN b.close > k.c THEN least(k.sar + k.af * (k.ep - k.sar), b.low, k.l) ELSE greatest(k.sar + k.af * (k.ep - k.sar), b.high, k.h) END,
CASE WHEN b.close > k.c THEN greatest(b.high, k.ep) ELSE least(b.low, k.ep) END, CASE WHEN b.close > k.c THEN least(k.af + 0.02, 0.2) ELSE 0.02 END, b.high, b.low, b.close FROM k JOIN b ON b.ticker = k.ticker AND b.r = k.r + 1)
SELECT ticker, CAST(date AS VARCHAR) AS day, {rounded('sar')} AS parabolic_sar FROM k""")
def parabolic_stops(spark: SparkSession, d: str) -> DataFrame:
    return kernels.run(bars(spark, d), ["parabolic_sar"]).selectExpr("ticker", "CAST(date AS STRING) AS day", f"{rounded('parabolic_sar')} AS parabolic_sar")


@query(f"""WITH RECURSIVE {_ORDERED}, k AS (SELECT ticker, date, r, close AS x, 1.01 * (1 - 1.01 / 2.01) AS p FROM b WHERE r = 1 UNION ALL
SELECT b.ticker, b.date, b.r, k.x + (k.p + 0.01) / (k.p + 1.01) * (b.close - k.x), (k.p + 0.01) * (1 - (k.p + 0.01) / (k.p + 1.01)) FROM k JOIN b ON b.ticker = k.ticker AND b.r = k.r + 1)
SELECT ticker, CAST(date AS VARCHAR) AS day, {rounded('x')} AS filtered FROM k""")
def stream_carried_filter(spark: SparkSession, d: str) -> DataFrame:
    """The filter with its state carried through a stream of the bars."""
    path = f"{shared_dir(spark)}/stream-bars-{uuid.uuid4().hex}"
    bars(spark, d).select("ticker", "date", "close").coalesce(1).write.parquet(path)
    out = windows.drained(windows.carried_filter(windows.source(spark, path), "ticker", "date", "close"))
    return out.selectExpr("ticker", "CAST(date AS STRING) AS day", f"{rounded('filtered')} AS filtered")


_DAY = "CAST(date AS STRING) AS day"


@query(f"""WITH w AS (SELECT ticker, date, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS 119 PRECEDING) AS l FROM ({BARS})), t AS (SELECT ticker, date, ln(k) AS x, ln(list_aggregate(list_transform(range(1, 121 - k), lambda i: l[i + k] - l[i]), 'stddev_pop')) AS y FROM w, range(2, 100) r(k) WHERE len(l) = 120)
SELECT ticker, CAST(date AS VARCHAR) AS day, {rounded('2 * regr_slope(y, x)')} AS hurst FROM t GROUP BY ticker, date HAVING min(y) > -700""")
def hurst_rolling(spark: SparkSession, d: str) -> DataFrame:
    return kernels.run(bars(spark, d), ["rolling_hurst"]).where("hurst is not null").selectExpr("ticker", _DAY, f"{rounded('hurst')} AS hurst")


def _extreme(sign: str) -> str:
    return f"list_filter(range(2, len(l)), lambda p: len(list_filter(range(1, 11), lambda k: {sign} * l[p] <= {sign} * l[greatest(p - k, 1)] OR {sign} * l[p] <= {sign} * l[least(p + k, len(l))])) = 0)"


@query(f"""WITH w AS (SELECT ticker, date, close, high, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS 50 PRECEDING) AS l FROM ({BARS})), e AS (SELECT *, CASE WHEN len(l) > 10 THEN list_max({_extreme('1')}) END AS a, CASE WHEN len(l) > 10 THEN list_max({_extreme('-1')}) END AS b FROM w),
x AS (SELECT *, coalesce((close - l[a]) / l[a], 0) AS peak, coalesce((close - l[b]) / l[b], 0) AS trough FROM e)
SELECT ticker, CAST(date AS VARCHAR) AS day, {rounded('peak')} AS distance_from_peak, {rounded('trough')} AS distance_from_trough, {rounded('(-peak * (high - close) / (close + 1e-10))')} AS pattern_indicator FROM x""")
def extrema_distance(spark: SparkSession, d: str) -> DataFrame:
    out = kernels.run(bars(spark, d), ["extrema_distances"])
    return out.selectExpr("ticker", _DAY, *[f"{rounded(c)} AS {c}" for c in ("distance_from_peak", "distance_from_trough", "pattern_indicator")])


_W60 = "OVER (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING)"


@query(f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS r, abs(close - lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS step FROM ({BARS})), w AS (SELECT *, list(close) {_W60} AS l,
list(CASE WHEN step > 1e-10 THEN ln(step) END) OVER (PARTITION BY ticker ORDER BY date ROWS 58 PRECEDING) AS s, corr(r, volume) OVER (PARTITION BY ticker ORDER BY date ROWS 50 PRECEDING) AS c, stddev_pop(volume) OVER (PARTITION BY ticker ORDER BY date ROWS 50 PRECEDING) AS sv FROM b)
SELECT ticker, CAST(date AS VARCHAR) AS day, {rounded("CASE WHEN r >= 60 THEN coalesce(list_avg(list_filter(s, lambda e: e IS NOT NULL)), 0) END")} AS lyapunov_60, {rounded("CASE WHEN r >= 60 THEN (list_position(l, list_max(l)) - list_position(l, list_min(l))) / 59.0 END")} AS time_between_extremes_60,
{rounded("CASE WHEN r >= 51 AND sv > 0 THEN c END")} AS vg_volume_trend FROM w""")
def kernel_readings(spark: SparkSession, d: str) -> DataFrame:
    """Those readings of the complexity and path kernels that windows of SQL can state."""
    out = kernels.run(bars(spark, d), ["complexity", "visibility_paths"])
    return out.selectExpr("ticker", _DAY, *[f"{rounded(c)} AS {c}" for c in ("lyapunov_60", "time_between_extremes_60", "vg_volume_trend")])


@query("SELECT * FROM (VALUES ('a.csv', 0, 'x', '1'), ('a.csv', 1, 'y', '2'), ('b.csv', 0, 'z', '3')) AS v(member, line, a, b)")
def source_unzipped(spark: SparkSession, d: str) -> DataFrame:
    """Delimited members of a ZIP file, read as one table."""
    import io as memory
    import zipfile

    raw = memory.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in (("a.csv", "x,1\ny, 2\n"), ("b.csv", "z,3\n\n"), ("readme.txt", "no")):
            z.writestr(name, text)
    path = f"{shared_dir(spark)}/zip-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/x.zip")
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(raw.getvalue()))
    out.close()
    rows = io.text_rows(io.unzipped(spark, path, r".*\.csv"), "text", ["member"])
    return rows.select("member", "line", F.col("cells")[0].alias("a"), F.col("cells")[1].alias("b"))


@query("SELECT * FROM (VALUES (1000045, 'NICHOLAS', '10-Q', DATE '2024-02-13', 'edgar/data/1.txt')) AS v(cik, company, form, filed, path)")
def source_form_index(spark: SparkSession, d: str) -> DataFrame:
    lines = ["Description: Master Index", "CIK|Company Name|Form Type|Date Filed|Filename", "-----", "1000045|NICHOLAS |10-Q|2024-02-13|edgar/data/1.txt", "x|y"]
    return io.form_index(spark.createDataFrame([(x,) for x in lines], "l string"), "l")


@query()
def model_calibrated(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "rfpredictions").where("upprobability is not null and not isnan(upprobability) and upprediction is not null").withColumn("y", F.expr("CASE WHEN upprediction = 1 THEN 1 ELSE 0 END"))
    return models.calibrated(r, r, "upprobability", "y").select("pred_id", "calibrated")


@query()
def sample_balanced(spark: SparkSession, d: str) -> DataFrame:
    return models.balanced_sample(table(spark, d, "rfpredictions").where("model_tag is not null"), "model_tag", 200, 7, ["pred_id"]).select("pred_id", "model_tag")

"""Queries of the sources, samples and row selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.queries.panel import BARS, bars, table
from tesserae.queries.relational import DAY, SDAY, R
from tesserae.sources import io, tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def made(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return made


@query(f"SELECT bar_id, ticker, {R('close', 'close')}, CASE WHEN isfinite(close) THEN true ELSE false END AS usable FROM (SELECT bar_id, ticker, CASE WHEN isfinite(close) THEN round(close, 4) END AS close FROM pricedata)")
def source_projected(spark: SparkSession, d: str) -> DataFrame:
    p = tables.projected(table(spark, d, "pricedata").withColumn("close", F.when(F.abs("close") < float("inf"), F.col("close"))), ["bar_id", "ticker", "close"])
    return p.selectExpr("bar_id", "ticker", R("close", "close"), "close IS NOT NULL AS usable")


_FIN = " AND ".join(f"isfinite({c})" for c in ("open", "high", "low", "close"))


@query(f"SELECT ticker, {SDAY}, max(bar_id) AS bar_id FROM pricedata WHERE {_FIN} AND date IS NOT NULL GROUP BY ticker, date")
def source_normalised_bars(spark, d):
    p = table(spark, d, "pricedata").select("ticker", "date", "bar_id", "open", "high", "low", "close", "volume")
    return tables.normalised_bars(p, "ticker", "date").selectExpr("ticker", DAY, "bar_id")


@query()
def sample_of_tickers(spark, d):
    """A seeded fifth of the tickers, with all their rows."""
    return tables.sampled_entities(table(spark, d, "pricedata"), "ticker", 20, 7).select("bar_id", "ticker")


_NAMES = "n AS (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT ticker FROM pricedata WHERE ticker IS NOT NULL))"


@query(f"WITH {_NAMES} SELECT bar_id, ticker FROM pricedata WHERE ticker IN (SELECT ticker FROM n WHERE p < greatest(floor(n * 0.3), 1))")
def first_tickers(spark, d):
    return tables.first_entities(table(spark, d, "pricedata"), "ticker", 30).select("bar_id", "ticker")


@query(f"WITH {_NAMES} SELECT bar_id, ticker FROM pricedata WHERE ticker IN (SELECT ticker FROM n WHERE p IN (SELECT CAST(floor(i * (SELECT max(n) FROM n) / 5.0) AS BIGINT) FROM range(5) t(i)))")
def strided_tickers(spark, d):
    return tables.strided_entities(table(spark, d, "pricedata"), "ticker", 5).select("bar_id", "ticker")


@query(f"WITH bars AS ({BARS}), w AS (SELECT * FROM bars WHERE date <= DATE '2025-06-30' AND date > DATE '2025-06-30' - 90) SELECT ticker, {SDAY} FROM w WHERE ticker IN (SELECT ticker FROM w GROUP BY ticker HAVING count(*) >= 55)")
def rows_of_trailing_days(spark, d):
    return tables.trailing_days(bars(spark, d), "ticker", "date", "2025-06-30", 90, 55).selectExpr("ticker", DAY)


@query(f"""WITH bars AS ({BARS}), k AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars), n AS (SELECT count(DISTINCT ticker) AS n FROM bars),
c AS (SELECT date, count(*) AS here, (SELECT count(*) FROM k WHERE k.k = 60 AND k.date >= b.date) AS able FROM bars b GROUP BY date), s AS (SELECT min(date) AS s FROM c, n WHERE here >= 0.7 * n AND able >= 0.7 * n)
SELECT ticker, {SDAY} FROM bars, s WHERE date >= s AND ticker IN (SELECT ticker FROM k, s WHERE k.k = 60 AND k.date >= s)""")
def rows_from_common_start(spark, d):
    return tables.common_start(bars(spark, d), "ticker", "date", 0.7, 60).selectExpr("ticker", DAY)


@query("WITH l AS (SELECT * FROM pricedata WHERE isfinite(close) AND abs(close) <= 100) SELECT bar_id FROM l WHERE ticker IN (SELECT ticker FROM l GROUP BY ticker HAVING count(*) >= 61)")
def rows_with_trimmed_labels(spark, d):
    return tables.trimmed_labels(table(spark, d, "pricedata"), "close", "ticker", 100.0).select("bar_id")


@query("SELECT * FROM (VALUES ('downprobability'), ('upprobability'), ('upprediction'), ('raw_score'), ('positivethreshold'), ('negativethreshold')) AS v(name)")
def columns_for_models(spark, d):
    r = table(spark, d, "rfpredictions")
    return spark.createDataFrame([(c,) for c in tables.feature_columns(r, {"pred_id", "file_id", "volume"}, ("^(open|high|low|close)$", "vix"))], "name string")


@query(f"""WITH bars AS ({BARS}), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars WHERE date <= DATE '2025-05-15') SELECT ticker, {R('max(CASE WHEN k = 1 THEN close END)', 'last_close')}, {R('median(close)', 'med')} FROM k WHERE k <= 21 GROUP BY ticker""")
def value_at_anchor(spark, d):
    return tables.value_at(bars(spark, d), "ticker", "date", "close", "2025-05-15").selectExpr("ticker", R("at", "last_close"), R("median", "med"))


@query(f"""WITH bars AS ({BARS}), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars WHERE date <= DATE '2025-05-15'), m AS (SELECT ticker, median(close) AS m FROM k WHERE k <= 21 GROUP BY ticker), c AS (SELECT ticker, max(cik) * 1000.0 AS cap FROM tickerciks GROUP BY ticker)
SELECT b.ticker, CAST(b.date AS VARCHAR) AS day, {R('close * cap / m', 'market_cap')} FROM bars b JOIN m USING (ticker) JOIN c USING (ticker)""")
def caps_from_anchor(spark, d):
    caps = table(spark, d, "tickerciks").groupBy("ticker").agg((F.max("cik") * F.lit(1000.0)).alias("cap"))
    return tables.scaled_caps(bars(spark, d), caps, "ticker", "date", "close", "cap", "2025-05-15").selectExpr("ticker", DAY, R("market_cap", "market_cap"))


@query("""WITH s AS (SELECT ticker, date AS a, date + CAST(bar_id % 9 AS INTEGER) AS b FROM pricedata WHERE date IS NOT NULL), x AS (SELECT DISTINCT ticker, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM s) SELECT ticker, CAST(day AS VARCHAR) AS day FROM x WHERE isodow(day) < 6""")
def days_of_spans(spark, d):
    p = table(spark, d, "pricedata").where("date is not null").withColumn("until", F.expr("date_add(date, CAST(bar_id % 9 AS INT))"))
    return tables.spans_to_days(p, "ticker", "date", "until").withColumn("day", F.col("day").cast("string"))


# texts of known content: what is written, read back and parsed is stated in SQL ----------------------------------------
@query("SELECT * FROM (VALUES (DATE '2024-01-02', 'AAA', 10.0, 20.0, 'Q'), (DATE '2024-01-02', 'BBB', 5.5, 11.0, 'N'), (DATE '2024-01-03', 'AAA', 1.0, 2.0, 'Q')) AS v(date, symbol, short, total, market)")
def source_short_volumes(spark, d):
    head = "Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market"
    path = tables.scratch(spark, "shorts")
    for i, rows in enumerate((["20240102|AAA|10|0|20|Q", "20240102|BBB|5.5|0|11|N", "2"], ["20240103|AAA|1|0|2|Q", "1"])):
        spark.createDataFrame([("\n".join([head, *rows]),)], "t string").coalesce(1).write.text(f"{path}/{i}")
    return tables.short_volumes(spark, f"{path}/*")


@query("SELECT * FROM (VALUES ('AAA', DATE '2024-01-01', 12), ('AAA', DATE '2024-01-02', 30), ('BBB', DATE '2024-01-01', 1)) AS v(ticker, date, views)")
def source_page_views(spark, d):
    rows = [("AAA", '{"items": [{"timestamp": "2024010100", "views": 12}, {"timestamp": "2024010200", "views": 30}, {"timestamp": "bad", "views": 1}]}'), ("BBB", '{"items": [{"timestamp": "2024010100", "views": 1}]}'), ("CCC", "no json"), ("DDD", None)]
    return tables.page_views(spark.createDataFrame(rows, "ticker string, payload string"), "payload", "ticker")


@query("SELECT * FROM (VALUES ('sharpe', 1.25e0), ('return', 12.5e0), ('trades', 1234e0)) AS v(metric, value)")
def source_log_metrics(spark, d):
    lines = ["\x1b[38;2;0;200;0mSharpe Ratio:   1.25\x1b[0m", "Total return: 12.5%", "Trades 1,234 closed", "nothing", None]
    return tables.log_metrics(spark.createDataFrame([(x,) for x in lines], "line string"), "line", {"sharpe": r"Sharpe Ratio:\s+(-?[\d.]+)", "return": r"Total return: (-?[\d.]+%)", "trades": r"Trades ([\d,]+)"})


@query("SELECT * FROM (VALUES (DATE '2024-01-31', 4.5e0), (DATE '2024-02-29', NULL)) AS v(date, rate)")
def source_dated_table(spark, d):
    raw = spark.createDataFrame([("01/31/2024", "4.5", "x"), ("02/29/2024", "n/a", "2"), ("02/29/2024", "n/a", "n/a")], "`Date` string, rate string, other string")
    return tables.coerced(tables.with_date(raw), ["date"]).select("date", "rate")


@query("SELECT exchange, count(*) AS n FROM tickerciks GROUP BY exchange UNION ALL SELECT 'again', 1")
def source_csv_appended(spark, d):
    path = tables.scratch(spark, "appended")
    tables.append_csv(table(spark, d, "tickerciks").groupBy("exchange").agg(F.count(F.lit(1)).alias("n")), path)
    tables.append_csv(spark.createDataFrame([("again", 1)], "exchange string, n bigint"), path)
    return spark.read.option("header", "true").schema("exchange string, n bigint").csv(path)


@query("SELECT count(*) AS n, min(pred_id) AS least, max(pred_id) AS most FROM rfpredictions")
def source_score_sink(spark, d):
    r = table(spark, d, "rfpredictions").select("pred_id", "date", F.col("pred_id").alias("score"))
    return tables.score_sink(r, tables.scratch(spark, "scores"), ["pred_id", "date"], "score").selectExpr("rows AS n", "least", "most")


@query("SELECT DISTINCT ticker AS from_name, ticker AS stored FROM tickerciks WHERE ticker IS NOT NULL")
def source_ticker_of_file(spark, d):
    """One folder a ticker is one file here: the name is taken from the path, not from the rows."""
    path = tables.scratch(spark, "files")
    t = table(spark, d, "tickerciks").where("ticker is not null").select("ticker", F.col("ticker").alias("stored"))
    t.repartition("ticker").write.partitionBy("ticker").parquet(path)
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return tables.entity_from_path(rows, "from_name", r"ticker=([^/]+)/").select("stored", "from_name").distinct()


@query("SELECT 1 AS a, CAST(NULL AS VARCHAR) AS b, 5 AS n UNION ALL SELECT 2, 'x', 5")
def source_differing_files(spark, d):
    """Files of one table that lack columns are read as one."""
    path = tables.scratch(spark, "differing")
    spark.range(5).selectExpr("1 AS a").write.parquet(f"{path}/one.parquet")
    spark.range(5).selectExpr("2 AS a", "'x' AS b").write.parquet(f"{path}/two.parquet")
    both = spark.read.option("mergeSchema", "true").parquet(f"{path}/one.parquet", f"{path}/two.parquet")
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT column_name AS column, 'x' AS x FROM (DESCRIBE SELECT pred_id, date FROM rfpredictions)")
def source_pruned(spark, d):
    """A scan of two columns reads two columns."""
    df = io.load(spark, f"{d}/rfpredictions.parquet", columns=["pred_id", "date"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema: struct<") + 19 :].split(">")[0]
    return spark.createDataFrame([(c.split(":")[0], "x") for c in read.split(",")], "column string, x string")


@query("SELECT * FROM (VALUES ('t1', 'l1', 'd1', '2024-01-01'), ('t2', 'l2', 's2', '2024-01-02T00:00:00Z')) AS v(title, link, description, published)")
def source_feeds(spark, d):
    """RSS items and Atom entries, whose link is an attribute."""
    path = tables.scratch(spark, "feeds")
    rss = "<rss><channel><item><title>t1</title><link>l1</link><description>d1</description><pubDate>2024-01-01</pubDate></item></channel></rss>"
    atom = '<feed><entry><title>t2</title><link href="l2"/><summary>s2</summary><updated>2024-01-02T00:00:00Z</updated></entry></feed>'
    spark.createDataFrame([(rss,)], "t string").coalesce(1).write.text(f"{path}/rss")
    spark.createDataFrame([(atom,)], "t string").coalesce(1).write.text(f"{path}/atom")
    return io.feed(spark, f"{path}/rss").select("title", "link", "description", "published").unionByName(io.atom(spark, f"{path}/atom").select("title", "link", "description", "published"))


@query("SELECT * FROM (VALUES ('GDP', DATE '2024-01-01', 1.5e0), ('GDP', DATE '2024-04-01', 2.0e0)) AS v(series, date, value)")
def source_observations(spark, d):
    rows = [("GDP", '{"observations": [{"date": "2024-01-01", "value": "1.5"}, {"date": "2024-04-01", "value": "2"}, {"date": "2024-07-01", "value": "."}, {"date": "?", "value": "1"}]}'), ("CPI", None)]
    return io.observations(spark.createDataFrame(rows, "series string, payload string"), "payload", "series")


@query("SELECT * FROM (VALUES ('1', 'AAA'), ('2', 'BBB')) AS v(cik, ticker)")
def source_columnar_json(spark, d):
    rows = [('{"fields": ["cik", "ticker"], "data": [["1", "AAA"], ["2", "BBB"]]}',)]
    return io.columnar_json(spark.createDataFrame(rows, "payload string"), "payload").selectExpr("row['cik'] AS cik", "row['ticker'] AS ticker")


@query("SELECT \"column\", known FROM (VALUES ('cik', (SELECT count(cik) FROM tickerciks)), ('exchange', (SELECT count(exchange) FROM tickerciks)), ('sector', (SELECT count(sector) FROM tickerciks))) AS v(\"column\", known)")
def source_profile_known(spark, d):
    return io.profile(table(spark, d, "tickerciks").select("cik", "exchange", "sector")).select("column", "known")


@query("SELECT 'first' AS built, count(*) AS n FROM tickerciks UNION ALL SELECT 'again', 1")
def source_cached(spark, d):
    """A fresh copy is read as it is; one that is too old is built again."""
    path = tables.scratch(spark, "cached")
    t = table(spark, d, "tickerciks").select("ticker")
    io.cached(spark, path, lambda: t)
    first = io.cached(spark, path, lambda: spark.range(1)).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    again = io.cached(spark, path, lambda: spark.createDataFrame([("one",)], "ticker string"), max_age_hours=0.0).count()
    return spark.createDataFrame([("first", first), ("again", again)], "built string, n bigint")


@query("SELECT '2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824' AS sha256, 1 AS files, 5 AS bytes")
def source_checksums(spark, d):
    """Of a file of known content."""
    path = tables.scratch(spark, "sums")
    tables.put(spark, f"{path}/x.txt", b"hello")
    sums = io.checksums(spark, path).select("sha256")
    files = io.inventory(spark, path).select("files", "bytes")
    return sums.withColumn("_k", F.lit(1)).join(files.withColumn("_k", F.lit(1)), "_k").drop("_k")

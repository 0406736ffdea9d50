"""Queries of the evaluation and label operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import cross, evaluate, joins
from tesserae.queries.panel import bars, table
from tesserae.queries.relational import DAY, FULL, PANEL, RANKED, SDAY, Q, R, full, panel, ranked

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def made(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return made


_FEATURES = ["score", "back", "volume"]
_IC = "covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0)"
_P = "covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)"
_T = "ic * sqrt((n - 2) / (1 - ic * ic))"


def _stack(pairs: list[tuple[str, str, str]], source: str, keep: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keep} '{n}' AS name, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for n, x, y in pairs)


def _avg_rank(x: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


def _coefficients(stack: str, by: str, head: str = "") -> str:
    return f"""WITH {PANEL}, {FULL}{head}, s AS ({stack}), r AS (SELECT *, {_avg_rank('x', by)} AS a, {_avg_rank('y', by)} AS b FROM s),
c AS (SELECT {by}, count(*) AS n, {_IC} AS ic, {_P} AS pearson FROM r GROUP BY {by})"""


_ALL = [(f, f, "ret") for f in _FEATURES]


@query(f"{_coefficients(_stack(_ALL, 'full_panel'), 'name')} SELECT name, n, {R('ic', 'ic')}, {R(_T, 't')}, {R('pearson', 'pearson')}, CASE WHEN abs(ic) >= 0.05 THEN 'strong' WHEN abs(ic) >= 0.01 THEN 'weak' ELSE 'none' END AS grade FROM c")
def ic_pooled(spark: SparkSession, d: str) -> DataFrame:
    t = evaluate.graded(evaluate.coefficients(evaluate.stacked(full(spark, d), _ALL), ["name"]))
    return t.selectExpr("name", "n", R("ic", "ic"), R("t", "t"), R("pearson", "pearson"), "grade")


_HORIZONS = [1, 3, 5, 10]
_AHEAD = ", ".join(f"{Q.lead('close', h)} / close - 1 AS r{h}" for h in _HORIZONS)
_H_PAIRS = [(f"{f}|{h}", f, f"r{h}") for f in ("score", "back") for h in _HORIZONS]


def _ahead(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("ticker").orderBy("date")
    return panel(spark, d).withColumns({f"r{h}": F.lead("close", h).over(w) / F.col("close") - 1 for h in _HORIZONS})


@query(f"{_coefficients(_stack(_H_PAIRS, 'ahead'), 'name', f', ahead AS (SELECT *, {_AHEAD} FROM panel)')} SELECT name, n, {R('ic', 'ic')}, {R(_T, 't')}, {R('pearson', 'pearson')} FROM c")
def ic_by_horizon(spark, d):
    t = evaluate.coefficients(evaluate.stacked(_ahead(spark, d), _H_PAIRS), ["name"])
    return t.selectExpr("name", "n", R("ic", "ic"), R("t", "t"), R("pearson", "pearson"))


@query(f"""{_coefficients(_stack(_H_PAIRS, 'ahead'), 'name', f', ahead AS (SELECT *, {_AHEAD} FROM panel)')}, w AS (SELECT split_part(name, '|', 1) AS feature, max(CASE WHEN name LIKE '%|1' THEN ic END) AS h1, max(CASE WHEN name LIKE '%|3' THEN ic END) AS h3, max(CASE WHEN name LIKE '%|5' THEN ic END) AS h5 FROM c GROUP BY 1)
SELECT feature, {R('h1', 'h1')}, {R('h3', 'h3')}, {R('h5', 'h5')}, {R('abs(h5) / (abs(h1) + 1e-8)', 'growth')} FROM w WHERE sign(h1) = sign(h3) AND sign(h3) = sign(h5) AND h1 <> 0""")
def ic_sign_consistent(spark, d):
    t = evaluate.coefficients(evaluate.stacked(_ahead(spark, d), _H_PAIRS), ["name"]).withColumns({"feature": F.split("name", r"\|")[0], "horizon": F.concat(F.lit("h"), F.split("name", r"\|")[1])})
    return evaluate.sign_consistency(t, ["h1", "h3", "h5"]).selectExpr("feature", *[R(c, c) for c in ("h1", "h3", "h5", "growth")])


_M_PAIRS = [(f"{a}|{b}", a, b) for a in _FEATURES for b in _FEATURES]


@query(f"{_coefficients(_stack(_M_PAIRS, 'full_panel'), 'name')} SELECT split_part(name, '|', 1) AS a, split_part(name, '|', 2) AS b, {R('ic', 'ic')}, n FROM c")
def rank_correlation_matrix(spark, d):
    return evaluate.rank_matrix(full(spark, d), _FEATURES).selectExpr("a", "b", R("ic", "ic"), "n")


@query(f"""WITH {PANEL}, {FULL}, r AS (SELECT date, {Q.rank('score')} AS a, {Q.rank('ret')} AS b FROM full_panel), i AS (SELECT date, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS ic FROM r GROUP BY date HAVING count(*) >= 5)
SELECT count(ic) AS days, {R('avg(ic)', 'mean_ic')}, {R('stddev_samp(ic)', 'std_ic')}, {R('avg(ic) / stddev_samp(ic)', 'icir')}, {R('avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0.0 END)', 'positive')} FROM i WHERE ic IS NOT NULL""")
def daily_ic_summary(spark, d):
    s = evaluate.daily_summary(cross.rank_correlations(full(spark, d), "score", "ret", "date"))
    return s.selectExpr("days", *[R(c, c) for c in ("mean_ic", "std_ic", "icir", "positive")])


def _binned(x: str, n: int, source: str) -> str:
    probs = ", ".join(str(k / n) for k in range(1, n))
    return f"1 + len(list_filter(list_distinct((SELECT quantile_cont({x}, [{probs}]) FROM {source})), lambda e: e < {x}))"


@query(f"""WITH {PANEL}, {FULL}, b AS (SELECT {_binned('score', 10, 'full_panel')} AS i, {_binned('ret', 10, 'full_panel')} AS j FROM full_panel), c AS (SELECT i, j, count(*) AS c FROM b GROUP BY i, j), p AS (SELECT c, sum(c) OVER (PARTITION BY i) AS a, sum(c) OVER (PARTITION BY j) AS b, sum(c) OVER () AS n FROM c)
SELECT CAST(max(n) AS BIGINT) AS n, {R('sum(c / n * ln(c * n / (a * b)))', 'nats')} FROM p""")
def mutual_information_deciles(spark, d):
    return evaluate.mutual_information(full(spark, d), "score", "ret").selectExpr("n", R("nats", "nats"))


_VIX = "v AS (SELECT date, max(vix_close) AS vix FROM rfpredictions WHERE date IS NOT NULL AND vix_close > 0 GROUP BY date), j AS (SELECT p.*, v.vix FROM full_panel p ASOF LEFT JOIN v ON p.date >= v.date), k AS (SELECT * FROM j WHERE vix IS NOT NULL)"


def _with_vix(spark, d):
    vix = table(spark, d, "rfpredictions").where("date is not null and vix_close > 0").groupBy("date").agg(F.max("vix_close").alias("vix"))
    return joins.asof(full(spark, d), vix, "date").where("vix is not null")


@query(f"""WITH {PANEL}, {FULL}, {_VIX}, g AS (SELECT *, {_binned('vix', 3, 'k')} AS g FROM k), s AS ({_stack(_ALL, 'g', 'g,')}), r AS (SELECT *, {_avg_rank('x', 'name, g')} AS a, {_avg_rank('y', 'name, g')} AS b FROM s), c AS (SELECT name, g, {_IC} AS ic FROM r GROUP BY name, g)
SELECT name, {R('max(CASE WHEN g = 1 THEN ic END)', 'low')}, {R('max(CASE WHEN g = 2 THEN ic END)', 'mid')}, {R('max(CASE WHEN g = 3 THEN ic END)', 'high')} FROM c GROUP BY name""")
def ic_by_regime(spark, d):
    return evaluate.by_regime(_with_vix(spark, d), _FEATURES, "ret", "vix").selectExpr("name", R("low", "low"), R("mid", "mid"), R("high", "high"))


_HALF = "h AS (SELECT quantile_cont(date_diff('day', DATE '1970-01-01', date), 0.5) AS m FROM full_panel), t AS (SELECT *, CASE WHEN date_diff('day', DATE '1970-01-01', date) <= (SELECT m FROM h) THEN 'train' ELSE 'test' END AS part, strftime(date, '%Y-%m') AS month, 1 AS one FROM full_panel)"


def _part_ic(by: str) -> str:
    return f"(SELECT {by}, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS ic, count(*) AS n FROM (SELECT {by}, {_avg_rank('score', by)} AS a, {_avg_rank('ret', by)} AS b FROM t) GROUP BY {by})"


@query(f"""WITH {PANEL}, {FULL}, {_HALF}, w AS (SELECT ic, n FROM {_part_ic("one")}), m AS (SELECT ic FROM {_part_ic('month')} WHERE ic IS NOT NULL), p AS (SELECT max(CASE WHEN part = 'train' THEN ic END) AS tr, max(CASE WHEN part = 'test' THEN ic END) AS te FROM {_part_ic('part')})
SELECT n, {R('w.ic', 'ic')}, {R('tr', 'train')}, {R('te', 'test')}, {R('te / tr', 'retention')}, (SELECT count(*) FROM m) AS months, {R('(SELECT avg(ic) FROM m)', 'monthly_mean')}, {R('(SELECT stddev_samp(ic) FROM m)', 'monthly_std')}, {R('(SELECT avg(CASE WHEN sign(m.ic) = (SELECT sign(ic) FROM w) THEN 1.0 ELSE 0.0 END) FROM m)', 'monthly_hit')} FROM w, p""")
def feature_validation(spark, d):
    v = evaluate.validation(full(spark, d), "score", "ret", "date")
    return v.selectExpr("n", "months", *[R(c, c) for c in ("ic", "train", "test", "retention", "monthly_mean", "monthly_std", "monthly_hit")])


_CARD = "(VALUES ('a', 0.03, 4.0, 0.6, 0.4, 0.02, 0.03, 0.02), ('b', -0.03, -4.0, 0.5, -0.4, 0.0, 0.0, 0.0), ('c', 0.0, 0.1, NULL, NULL, 0.02, NULL, 0.02), ('d', 0.001, 0.5, 0.5, 0.01, 0.0, 0.0, 0.0)) AS v(feature, ic, t, positive, icir, auc_distance, spread, spearman)"


@query("SELECT feature, passed, CASE WHEN passed >= 6 THEN 'STRONG' WHEN passed >= 4 THEN 'PROMISING' WHEN passed >= 2 THEN 'WEAK' ELSE 'NO SIGNAL' END AS grade FROM (SELECT feature, " + " + ".join(f"CASE WHEN {'abs' if s else ''}({c}) > {t} THEN 1 ELSE 0 END" for c, s, t in evaluate.CHECKS) + f" AS passed FROM {_CARD})")
def feature_scorecard(spark, d):
    return evaluate.scorecard(spark.sql(f"SELECT feature, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c, _, _ in evaluate.CHECKS)} FROM {_CARD}")).select("feature", "passed", "grade")


@query(f"""WITH {PANEL}, {FULL}, c AS (SELECT score, sum(up) AS p, count(*) AS n FROM full_panel GROUP BY score), u AS (SELECT p, sum(p) OVER w AS pp, sum(n) OVER w AS nn, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT CAST(max(an) AS BIGINT) AS n, CAST(max(ap) AS BIGINT) AS positives, {R('sum(p * pp / (nn * ap))', 'auc_pr')} FROM u""")
def auc_precision_recall(spark, d):
    return evaluate.average_precision(full(spark, d), "score", "up").selectExpr("n", "positives", R("auc_pr", "auc_pr"))


@query(" UNION ALL ".join(f"(WITH {PANEL}, {FULL} SELECT CAST({s} AS DOUBLE) AS share, count(*) AS rows_, {R('avg(up)', 'precision_')} FROM full_panel WHERE score >= (SELECT quantile_cont(score, {1 - s}) FROM full_panel))" for s in (0.01, 0.05)))
def precision_at_top(spark, d):
    return evaluate.top_precision(full(spark, d), "score", "up").selectExpr("share", "rows AS rows_", R("precision", "precision_"))


@query(f"""WITH {PANEL}, {FULL}, {RANKED} SELECT t.threshold, count(*) AS fires, {R('CASE WHEN count(*) >= 10 THEN avg(up) END', 'precision_')}, {R('count(*) / (SELECT count(DISTINCT date) FROM ranked)', 'fires_per_day')}
FROM ranked JOIN (VALUES (0.5e0), (0.9e0), (0.99e0), (0.9999e0)) AS t(threshold) ON rank >= t.threshold GROUP BY t.threshold""")
def threshold_report(spark, d):
    t = evaluate.threshold_fires(ranked(spark, d), "rank", "up", "date", [0.5, 0.9, 0.99, 0.9999])
    return t.selectExpr("threshold", "fires", R("precision", "precision_"), R("fires_per_day", "fires_per_day"))


_SEEDS = "s AS (SELECT model_tag, strftime(date, '%Y-%m') AS month, avg(upprobability) - 0.4 AS v, ticker FROM rfpredictions WHERE upprobability IS NOT NULL AND isfinite(upprobability) AND date IS NOT NULL AND model_tag IS NOT NULL GROUP BY ALL), m AS (SELECT model_tag, month, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std FROM s GROUP BY ALL)"


def _seeds(spark, d):
    ok = table(spark, d, "rfpredictions").where("upprobability is not null and not isnan(upprobability) and abs(upprobability) < double('infinity') and date is not null and model_tag is not null")
    one = ok.groupBy("model_tag", F.date_format("date", "yyyy-MM").alias("month"), "ticker").agg((F.avg("upprobability") - 0.4).alias("v"))
    return evaluate.seed_table(one, "model_tag", "month", "v")


@query(f"WITH {_SEEDS} SELECT model_tag, month, n, {R('mean', 'mean')}, {R('std', 'std')} FROM m")
def seeds_by_month(spark, d):
    return _seeds(spark, d).selectExpr("model_tag", "month", "n", R("mean", "mean"), R("std", "std"))


@query(f"WITH {_SEEDS} SELECT model_tag, count(*) AS months, {R('avg(mean)', 'pooled')}, {R('median(mean)', 'med')}, {R('avg(CASE WHEN mean > 0 THEN 1.0 ELSE 0.0 END)', 'win')}, {R('stddev_samp(mean)', 'month_std')}, {R('avg(std)', 'seed_std')} FROM m GROUP BY model_tag")
def configs_compared(spark, d):
    t = evaluate.config_table(_seeds(spark, d), "model_tag")
    return t.selectExpr("model_tag", "months", R("pooled", "pooled"), R("median", "med"), R("win", "win"), R("month_std", "month_std"), R("seed_std", "seed_std"))


@query("""WITH m AS (SELECT strftime(date, '%Y-%m') AS month, max(date) AS anchor, count(DISTINCT date) AS days FROM pricedata WHERE date IS NOT NULL GROUP BY 1), n AS (SELECT *, lead(month) OVER (ORDER BY month) AS next_month, lead(days) OVER (ORDER BY month) AS nd FROM m)
SELECT month, CAST(anchor AS VARCHAR) AS anchor, next_month FROM n WHERE month >= '2025-01' AND nd >= 5""")
def walk_forward_anchors(spark, d):
    return evaluate.anchors(table(spark, d, "pricedata"), "date", "2025-01").withColumn("anchor", F.col("anchor").cast("string"))


_CONFIGS = ("baseline", "recent_40", "hl_90", "stale_1mo")


@query(f"""WITH {PANEL}, {FULL}, dd AS (SELECT DISTINCT date FROM full_panel WHERE date <= DATE '2025-05-30'), f AS (SELECT min(date) AS f FROM (SELECT date FROM dd ORDER BY date DESC LIMIT 40))
SELECT 'baseline' AS config, count(*) AS n, 720.0 AS half_life, CAST(min(date) AS VARCHAR) AS a, CAST(max(date) AS VARCHAR) AS b FROM full_panel WHERE date <= DATE '2025-05-30' UNION ALL
SELECT 'recent_40', count(*), 720.0, CAST(min(date) AS VARCHAR), CAST(max(date) AS VARCHAR) FROM full_panel, f WHERE date <= DATE '2025-05-30' AND date >= f UNION ALL
SELECT 'hl_90', count(*), 90.0, CAST(min(date) AS VARCHAR), CAST(max(date) AS VARCHAR) FROM full_panel WHERE date <= DATE '2025-05-30' UNION ALL
SELECT 'stale_1mo', count(*), 720.0, CAST(min(date) AS VARCHAR), CAST(max(date) AS VARCHAR) FROM full_panel WHERE date <= DATE '2025-04-30'""")
def walk_forward_masks(spark, d):
    p, out = full(spark, d), None
    for c in _CONFIGS:
        rows, half = evaluate.training_rows(p, "date", "2025-05-30", c)
        one = rows.agg(F.count(F.lit(1)).alias("n"), F.min("date").cast("string").alias("a"), F.max("date").cast("string").alias("b")).select(F.lit(c).alias("config"), "n", F.lit(half).alias("half_life"), "a", "b")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""SELECT date_diff('month', DATE '2025-01-01', date_trunc('month', date)) AS stale_months, count(upprobability) AS n, {R('avg(upprobability)', 'mean')} FROM rfpredictions WHERE upprobability IS NOT NULL AND isfinite(upprobability) AND date >= DATE '2025-01-01' GROUP BY 1""")
def staleness_table(spark, d):
    ok = table(spark, d, "rfpredictions").where("upprobability is not null and not isnan(upprobability) and abs(upprobability) < double('infinity')").withColumn("trained", F.lit("2025-01-01").cast("date"))
    return evaluate.staleness(ok, "trained", "date", "upprobability").selectExpr("CAST(stale_months AS BIGINT) AS stale_months", "n", R("mean", "mean"))


_LABEL = f"""WITH {PANEL}, {FULL}, v AS (SELECT *, CASE WHEN count(back) OVER w >= 20 THEN stddev_samp(back) OVER w END AS vol FROM full_panel WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)), a AS (SELECT *, ret / greatest(vol, 0.001) AS ra FROM v WHERE vol IS NOT NULL)"""


@query(f"{_LABEL} SELECT ticker, {SDAY}, CASE WHEN ra >= quantile_cont(ra, 0.8) OVER (PARTITION BY date) - 1e-15 THEN 1 ELSE 0 END AS risk_adjusted, up AS binary_up FROM a")
def labels_by_mode(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-19, 0)
    p = full(spark, d).withColumn("vol", F.when(F.count("back").over(w) >= 20, F.stddev_samp("back").over(w))).where("vol is not null")
    a = cross.labelled(p, "risk_adj_topq", "ret", ["date"], 0.2, "vol").withColumnRenamed("label", "risk_adjusted")
    return cross.labelled(a, "binary_up", "ret", ["date"]).selectExpr("ticker", DAY, "risk_adjusted", "label AS binary_up")


@query(f"WITH {PANEL}, r AS (SELECT ticker, date, {Q.lead('close', 1)} / close - 1 AS r1, {Q.lead('close', 5)} / close - 1 AS r5, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars) SELECT ticker, {SDAY}, {R('r1', 'ret_1')}, {R('r5', 'ret_5')} FROM r WHERE k > 5")
def labels_forward(spark, d):
    return cross.forward_returns(bars(spark, d), "ticker", "date", "close", (1, 5)).selectExpr("ticker", DAY, R("ret_1", "ret_1"), R("ret_5", "ret_5"))


_INSIDE = "close >= 20"


@query(f"""WITH {PANEL}, {FULL}, u AS (SELECT *, {_INSIDE} AS inn FROM full_panel), r AS (SELECT *, CASE WHEN inn THEN (rank() OVER (PARTITION BY date, inn ORDER BY score) + (count(*) OVER (PARTITION BY date, inn, score) - 1) / 2.0) / count(*) OVER (PARTITION BY date, inn) ELSE 0.5 END AS xs FROM u)
SELECT ticker, {SDAY}, {R('xs', 'score_xs')}, CASE WHEN inn AND xs >= 0.9 THEN 1 WHEN inn THEN 0 ELSE -1 END AS signal FROM r""")
def rank_in_universe(spark, d):
    r = cross.universe_rank(full(spark, d), "score", ["date"], F.expr(_INSIDE))
    return r.withColumn("signal", cross.rank_signal(F.col("score_xs"), F.expr(_INSIDE), 0.1)).selectExpr("ticker", DAY, R("score_xs", "score_xs"), "signal")


@query(f"""WITH {PANEL}, {FULL}, l AS (SELECT *, list(score) OVER (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING) AS l FROM full_panel),
p AS (SELECT *, CASE WHEN len(l) >= 60 THEN (len(list_filter(l, lambda e: e < score)) + (len(list_filter(l, lambda e: e = score)) + 1) / 2.0) / len(l) END AS p FROM l)
SELECT ticker, {SDAY}, {R('p', 'ts_pctile')}, {R(f'CASE WHEN {_INSIDE} AND p IS NOT NULL THEN 0.3 + 0.4 * p ELSE 0.3 END', 'up_probability')}, CASE WHEN {_INSIDE} AND p >= 0.65 AND p < 0.98 THEN 1 WHEN {_INSIDE} THEN 0 ELSE -1 END AS signal FROM p""")
def trailing_score_percentile(spark, d):
    r = cross.trailing_percentile(full(spark, d), "ticker", "date", "score")
    p, s = cross.percentile_signal(F.col("ts_pctile"), F.expr(_INSIDE))
    return r.withColumns({"u": p, "signal": s}).selectExpr("ticker", DAY, R("ts_pctile", "ts_pctile"), R("u", "up_probability"), "signal")


@query(f"WITH {PANEL} SELECT {SDAY}, count(*) AS n, CAST(sum(row_number) AS BIGINT) AS places FROM (SELECT date, row_number() OVER (PARTITION BY date ORDER BY ticker) AS row_number FROM panel) GROUP BY date")
def shuffle_within_day(spark, d):
    """Places are a permutation of 1..n within each day."""
    s = cross.shuffled_within(panel(spark, d), "date", "ticker", 7)
    return s.groupBy("date").agg(F.count_distinct("place").alias("n"), F.sum("place").alias("places")).selectExpr(DAY, "n", "places")


@query(f"""WITH m AS (SELECT model_tag, ticker, date, avg(upprobability) AS s FROM rfpredictions WHERE upprobability IS NOT NULL AND isfinite(upprobability) AND model_tag IS NOT NULL GROUP BY ALL), k AS (SELECT ticker, date, avg(s) AS s FROM m GROUP BY ticker, date HAVING count(*) >= 2)
SELECT ticker, {SDAY}, {R('s', 's')}, {R('(rank() OVER (PARTITION BY date ORDER BY round(s, 9)) + (count(*) OVER (PARTITION BY date, round(s, 9)) - 1) / 2.0) / count(*) OVER (PARTITION BY date)', 'rank')} FROM k""")
def ensemble_ranked(spark, d):
    """The mean of all models' scores where at least two have one, ranked again within the day."""
    ok = table(spark, d, "rfpredictions").where("upprobability is not null and not isnan(upprobability) and abs(upprobability) < double('infinity') and model_tag is not null")
    one = ok.groupBy("model_tag", "ticker", "date").agg(F.avg("upprobability").alias("s"))
    tags = [r[0] for r in one.select("model_tag").distinct().collect()]  # the models: a handful
    mean = evaluate.averaged([one.where(F.col("model_tag") == t) for t in tags], ["ticker", "date"], "s", "date", 2)
    return mean.withColumn("t", F.round("s", 9)).withColumn("rank", evaluate.daily_rank(None, "t", "date")).selectExpr("ticker", DAY, R("s", "s"), R("rank", "rank"))


@query("""WITH v AS (SELECT date, CASE WHEN max(vix_close) < 15 THEN 0 WHEN max(vix_close) < 20 THEN 1 WHEN max(vix_close) < 30 THEN 2 ELSE 3 END AS regime FROM rfpredictions WHERE vix_close IS NOT NULL AND isfinite(vix_close) GROUP BY date) SELECT r.pred_id, v.regime FROM rfpredictions r LEFT JOIN v ON r.date = v.date""")
def regime_of_predictions(spark, d):
    r = table(spark, d, "rfpredictions")
    return evaluate.with_market_regime(r.select("pred_id", "date"), r, "date", "vix_close").select("pred_id", "regime")

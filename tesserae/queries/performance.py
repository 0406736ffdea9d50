"""Queries of the trade and equity statistics. A trade here is a ticker's day: its return is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import trades
from tesserae.queries.relational import DAY, PANEL, SDAY, R, panel

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def made(fn):
        QUERIES[fn.__name__], ORACLE[fn.__name__] = fn, sql
        return fn

    return made


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).where("back is not null").select("ticker", "date", F.col("back").alias("ret"))


_RET = f"{PANEL}, r AS (SELECT ticker, date, back AS ret FROM panel WHERE back IS NOT NULL)"
_LABEL = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} < 0 THEN 'Negative' WHEN {0} < 1.6 THEN 'Poor' WHEN {0} < 2 THEN 'Below Average' WHEN {0} < 2.5 THEN 'Average' WHEN {0} < 3 THEN 'Good' WHEN {0} < 5 THEN 'Excellent' WHEN {0} < 7 THEN 'Superb' ELSE 'Holy Grail Potential' END"


@query(f"""WITH {_RET}, a AS (SELECT ticker, count(*) AS closed, count(*) FILTER (ret > 0) AS won, count(*) FILTER (ret < 0) AS lost, coalesce(sum(ret) FILTER (ret > 0), 0) AS wt, coalesce(-sum(ret) FILTER (ret < 0), 0) AS lt,
avg(ret) FILTER (ret > 0) AS wa, -avg(ret) FILTER (ret < 0) AS la, max(ret) AS wm, -min(ret) AS lm, sum(ret) AS net, avg(ret) AS m, stddev_samp(ret) AS s FROM r GROUP BY ticker),
b AS (SELECT *, won / closed AS p, wa / la AS rr, CASE WHEN closed >= 30 AND s > 1e-12 THEN m / s * sqrt(closed) END AS sqn FROM a), c AS (SELECT *, p - (1 - p) / rr AS edge FROM b)
SELECT ticker, closed, won, lost, {R('wt', 'won_total')}, {R('lt', 'lost_total')}, {R('wa', 'won_avg')}, {R('la', 'lost_avg')}, {R('CASE WHEN wm > 0 THEN wm END', 'won_max')}, {R('CASE WHEN lm > 0 THEN lm END', 'lost_max')}, {R('net', 'net')},
{R('p * 100', 'percent_profitable')}, {R('wt / nullif(lt, 0)', 'profit_factor')}, {R('rr', 'risk_reward_ratio')}, {R('won / nullif(lost, 0)', 'win_loss_count_ratio')}, {R('net / closed', 'avg_profit_per_trade')}, {R('p * coalesce(wa, 0) - (1 - p) * coalesce(la, 0)', 'expectancy')},
{R('edge * 100', 'kelly_pct')}, {R('CASE WHEN edge > 0 THEN pow((1 - edge) / (1 + edge), 20) WHEN edge IS NOT NULL THEN 1.0 END', 'risk_of_ruin')}, {R('sqn', 'sqn')}, {_LABEL.format('sqn')} AS sqn_label FROM c""")
def trade_statistics(spark, d):
    s = trades.statistics(_rows(spark, d), "ticker", "ret")
    numbers = ["won_total", "lost_total", "won_avg", "lost_avg", "won_max", "lost_max", "net", "percent_profitable", "profit_factor", "risk_reward_ratio", "win_loss_count_ratio", "avg_profit_per_trade", "expectancy", "kelly_pct", "risk_of_ruin", "sqn"]
    return s.selectExpr("ticker", "closed", "won", "lost", *[R(c, c) for c in numbers], "sqn_label")


@query(f"""WITH {_RET}, e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY date)) AS q FROM r), dd AS (SELECT *, (1 - q / max(q) OVER (PARTITION BY ticker ORDER BY date)) * 100 AS d FROM e),
sp AS (SELECT *, sum(CASE WHEN d > 1e-9 THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY date) AS g FROM dd), l AS (SELECT ticker, max(n) AS len FROM (SELECT ticker, g, count(*) AS n FROM sp WHERE d > 1e-9 GROUP BY ticker, g) GROUP BY ticker),
a AS (SELECT dd.ticker, count(*) AS n, (arg_max(q, date) - 1) * 100 AS tr, max(d) AS md, avg(d) AS ad FROM dd GROUP BY dd.ticker), b AS (SELECT a.*, coalesce(l.len, 0) AS len, (pow(1 + tr / 100, 252.0 / n) - 1) * 100 AS ar FROM a LEFT JOIN l USING (ticker))
SELECT ticker, {R('tr', 'total_return')}, {R('md', 'max_dd')}, {R('ad', 'avg_dd')}, CAST(len AS BIGINT) AS max_dd_duration, {R('ar / CASE WHEN md > 1e-9 THEN md END', 'calmar_ratio')}, {R('tr / CASE WHEN md > 1e-9 THEN md END', 'recovery_factor')},
{R('CASE WHEN tr > 0 AND md > 1e-9 THEN tr / nullif(len, 0) END', 'common_sense_ratio')} FROM b""")
def drawdown_statistics(spark, d):
    s = trades.drawdowns(_rows(spark, d), "ticker", "date", "ret")
    return s.selectExpr("ticker", "CAST(max_dd_duration AS BIGINT) AS max_dd_duration", *[R(c, c) for c in ("total_return", "max_dd", "avg_dd", "calmar_ratio", "recovery_factor", "common_sense_ratio")])


@query(f"WITH {_RET} SELECT ticker, {R('sum(greatest(ret - 0.000238, 0)) / nullif(sum(greatest(0.000238 - ret, 0)), 0)', 'omega')} FROM r GROUP BY ticker")
def omega_with_threshold(spark, d):
    return trades.omega(_rows(spark, d), "ticker", "ret").selectExpr("ticker", R("omega", "omega"))


def _unit(u: str) -> str:
    each = f"(SELECT ticker, CAST(date_trunc('{u}', date) AS DATE) AS period, exp(sum(ln(1 + ret))) - 1 AS value, count(*) AS days FROM r GROUP BY ALL)"
    if u == "day":
        kept = each
    else:
        kept = f"(SELECT * EXCLUDE (a, b, k, f) FROM (SELECT *, min(period) OVER w AS a, max(period) OVER w AS b, count(*) OVER w AS k, quantile_cont(days, 0.5) OVER w AS f FROM {each} WINDOW w AS (PARTITION BY ticker)) WHERE NOT (k > 2 AND days < f AND (period = a OR period = b)))"
    pick = "SELECT ticker, '{u}' AS unit, '{n}' AS which, period, days, value FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY value {o}, period) AS k FROM {t}) WHERE k = 1"
    return pick.format(u=u, n="best", o="DESC", t=kept) + " UNION ALL " + pick.format(u=u, n="worst", o="ASC", t=kept)


@query(f"""WITH {_RET}, e AS ({' UNION ALL '.join(map(_unit, ('day', 'week', 'month')))}), s AS (SELECT ticker, avg(ret) AS m, stddev_samp(ret) AS s FROM r GROUP BY ticker), z AS (SELECT e.*, CASE WHEN s > 1e-12 THEN (value - days * m) / (s * sqrt(days)) END AS z FROM e JOIN s USING (ticker))
SELECT ticker, unit, which, days, {R('value', 'value')}, {R('z', 'sigma')}, CASE WHEN abs(z) >= 4 THEN 'Extreme outlier' WHEN abs(z) >= 2.5 THEN 'Very unusual' WHEN abs(z) >= 1.5 THEN 'Notable' WHEN z IS NOT NULL THEN 'Normal' END AS label FROM z""")
def extreme_periods(spark, d):
    return trades.extremes(_rows(spark, d), "ticker", "date", "ret").selectExpr("ticker", "unit", "which", "days", R("value", "value"), R("sigma", "sigma"), "label")


@query(f"WITH {_RET}, a AS (SELECT ticker, exp(sum(ln(1 + ret))) AS e, date_diff('day', min(date), max(date)) / 365.25 AS y FROM r GROUP BY ticker) SELECT ticker, {R('y', 'years')}, {R('(e - 1) * 100', 'total')}, {R('CASE WHEN y > 0 THEN (pow(e, 1 / y) - 1) * 100 END', 'cagr')} FROM a")
def yearly_growth(spark, d):
    return trades.growth(_rows(spark, d), "ticker", "date", "ret").selectExpr("ticker", R("years", "years"), R("total", "total"), R("cagr", "cagr"))


@query(f"""WITH {_RET}, e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY date)) AS q FROM r), a AS (SELECT ticker, date_trunc('month', date) AS p, arg_min(q / (1 + ret), date) AS s, arg_max(q, date) AS f FROM e GROUP BY ALL)
SELECT ticker, CAST(CAST(p AS DATE) AS VARCHAR) AS month, {R('s', 'start_value')}, {R('f', 'end_value')}, {R('(f / s - 1) * 100', 'return_pct')} FROM a""")
def equity_by_month(spark, d):
    e = trades.equity_by_period(_rows(spark, d), "ticker", "date", "ret")
    return e.selectExpr("ticker", "CAST(period AS STRING) AS month", R("start", "start_value"), R("end", "end_value"), R("return_pct", "return_pct"))


_REASON = "CASE WHEN ret > 0.02 THEN 'Take Profit' WHEN ret < -0.02 THEN 'Stop Loss' ELSE 'Timeout' END"


@query(f"WITH {_RET} SELECT {_REASON} AS reason, count(*) AS n, {R('avg(ret)', 'mean')}, {R('median(ret)', 'med')} FROM r GROUP BY 1")
def results_by_reason(spark, d):
    return trades.by_reason(_rows(spark, d).withColumn("reason", F.expr(_REASON)), "reason", "ret").selectExpr("reason", "n", R("mean", "mean"), R("median", "med"))


@query(f"WITH {_RET} SELECT ticker, {SDAY}, {R('CASE WHEN count(ret) OVER w >= 50 AND stddev_samp(ret) OVER w > 1e-12 THEN avg(ret) OVER w / stddev_samp(ret) OVER w * sqrt(252) END', 'rolling_sharpe')} FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING)")
def sharpe_of_last_trades(spark, d):
    return trades.rolling_sharpe(_rows(spark, d), "ticker", "date", "ret").selectExpr("ticker", DAY, R("rolling_sharpe", "rolling_sharpe"))


@query(f"WITH {_RET}, e AS (SELECT min(ret) AS a, (max(ret) - min(ret)) / 20 AS w FROM r) SELECT CAST(least(floor((ret - a) / w), 19) AS INT) + 1 AS bin, count(*) AS n FROM r, e GROUP BY 1")
def result_histogram(spark, d):
    return trades.histogram(_rows(spark, d), "ret").select("bin", "n")


_ENDS = "SELECT ticker, '{n}' AS which, mean, n FROM (SELECT *, row_number() OVER (ORDER BY mean {o}, ticker) AS k FROM a) WHERE k <= 5"


@query(f"WITH {_RET}, a AS (SELECT ticker, avg(ret) AS mean, count(*) AS n FROM r GROUP BY ticker), u AS ({_ENDS.format(n='best', o='DESC')} UNION ALL {_ENDS.format(n='worst', o='ASC')}) SELECT ticker, which, n, {R('mean', 'mean')} FROM u")
def best_and_worst_tickers(spark, d):
    return trades.ends(_rows(spark, d), "ticker", "ret").selectExpr("ticker", "which", "n", R("mean", "mean"))

"""Statistics of trades and equity curves: all conditional aggregates and windows of one group's ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.operators.metrics import with_equity
from tesserae.plans.scale import cut, lookup_join, quantiles

# The bands of the system quality number.
QUALITY = ((0.0, "Negative"), (1.6, "Poor"), (2.0, "Below Average"), (2.5, "Average"), (3.0, "Good"), (5.0, "Excellent"), (7.0, "Superb"))


def quality_label(x: Column) -> Column:
    out = F.lit("Holy Grail Potential")
    for top, name in reversed(QUALITY):
        out = F.when(x < top, name).otherwise(out)
    return F.when(x.isNotNull(), out)


def statistics(df: DataFrame, group: str, pnl: str) -> DataFrame:
    """One row a group of closed trades: counts, totals, averages and largest of wins and losses, profit factor, share of
    wins, risk-reward ratio, expectancy, Kelly share, risk of ruin over 20 units and system quality. A ratio whose
    denominator is zero is null; trades of unknown result are not closed."""
    x = F.col(pnl)
    won, lost = F.when(x > 0, x), F.when(x < 0, -x)
    a = df.where(x.isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("closed"), F.count(won).alias("won"), F.count(lost).alias("lost"), F.coalesce(F.sum(won), F.lit(0.0)).alias("won_total"), F.coalesce(F.sum(lost), F.lit(0.0)).alias("lost_total"),
        F.avg(won).alias("won_avg"), F.avg(lost).alias("lost_avg"), F.max(won).alias("won_max"), F.max(lost).alias("lost_max"), F.sum(x).alias("net"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"),
    )
    p = F.col("won") / F.col("closed")
    reward = F.try_divide("won_avg", "lost_avg")
    a = a.withColumns({"percent_profitable": p * 100, "profit_factor": F.try_divide("won_total", "lost_total"), "risk_reward_ratio": reward, "win_loss_count_ratio": F.try_divide("won", "lost"), "avg_profit_per_trade": F.col("net") / F.col("closed")})
    edge = p - (1 - p) / F.col("risk_reward_ratio")
    sqn = F.when((F.col("closed") >= 30) & (F.col("_s") > 1e-12), F.col("_m") / F.col("_s") * F.sqrt(F.col("closed").cast("double")))
    a = a.withColumns({
        "expectancy": p * F.coalesce("won_avg", F.lit(0.0)) - (1 - p) * F.coalesce("lost_avg", F.lit(0.0)), "kelly_pct": edge * 100,
        "risk_of_ruin": F.when(edge > 0, F.pow((1 - edge) / (1 + edge), 20)).when(edge.isNotNull(), 1.0), "sqn": sqn,
    })
    return a.withColumn("sqn_label", quality_label(F.col("sqn"))).drop("_m", "_s")


def drawdowns(df: DataFrame, group: str, time: str, ret: str) -> DataFrame:
    """One row a group: total and annualised return (percent), worst and mean drawdown, the longest time under water in
    rows, and the ratios built on them (null without a drawdown)."""
    eq = with_equity(df.where(F.col(ret).isNotNull()), group, time, ret)
    w = Window.partitionBy(group).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    under = F.col("drawdown") > 1e-9
    eq = eq.withColumn("_spell", F.sum(F.when(under, 0).otherwise(1)).over(w))
    spell = eq.where(under).groupBy(group, "_spell").agg(F.count(F.lit(1)).alias("_len")).groupBy(group).agg(F.max("_len").alias("max_dd_duration"))
    a = eq.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), ((F.max_by("equity", time) - 1) * 100).alias("total_return"), F.max("drawdown").alias("max_dd"), F.avg("drawdown").alias("avg_dd"))
    a = a.withColumn("annualized_return", (F.pow(1 + F.col("total_return") / 100, 252.0 / F.col("_n")) - 1) * 100).join(spell, group, "left").withColumn("max_dd_duration", F.coalesce("max_dd_duration", F.lit(0)))
    dd = F.when(F.col("max_dd") > 1e-9, F.col("max_dd"))
    return a.withColumns({"calmar_ratio": F.col("annualized_return") / dd, "recovery_factor": F.col("total_return") / dd, "common_sense_ratio": F.when(F.col("total_return") > 0, F.try_divide("total_return", F.when(dd.isNotNull(), F.col("max_dd_duration"))))}).drop("_n")


def omega(df: DataFrame, group: str, ret: str, threshold: float = 0.000238) -> DataFrame:
    """(group, omega): what is gained above a daily threshold over what is lost below it; null where nothing is."""
    r = F.col(ret) - threshold
    a = df.where(F.col(ret).isNotNull()).groupBy(group).agg(F.sum(F.greatest(r, F.lit(0.0))).alias("_g"), F.sum(F.greatest(-r, F.lit(0.0))).alias("_l"))
    return a.select(group, F.when(F.col("_l") > 1e-15, F.col("_g") / F.col("_l")).alias("omega"))


def _period_end(unit: str, time: str) -> Column:
    return F.date_trunc(unit, F.col(time)).cast("date")


def extremes(df: DataFrame, group: str, time: str, ret: str) -> DataFrame:
    """(group, unit, which, period, days, value, sigma, label): the best and worst day, week and month. The first and last
    week or month go where they have fewer days than the median one; sigma is against k independent days,
    (v - k mean) / (deviation sqrt k). Of equal periods the earliest is taken."""
    rows = df.where(F.col(ret).isNotNull())
    base = rows.groupBy(group).agg(F.avg(ret).alias("_m"), F.stddev_samp(ret).alias("_s"))
    parts = None
    for unit in ("day", "week", "month"):
        each = rows.groupBy(group, _period_end(unit, time).alias("period")).agg((F.exp(F.sum(F.ln(1 + F.col(ret)))) - 1).alias("value"), F.count(F.lit(1)).alias("days"))
        if unit != "day":
            each = cut(each)
            typical = quantiles(each, [group], "days", {"_full": 0.5})
            ends = each.groupBy(group).agg(F.min("period").alias("_a"), F.max("period").alias("_b"), F.count(F.lit(1)).alias("_k"))
            each = each.join(ends, group).join(typical, group)
            stub = (F.col("_k") > 2) & (F.col("days") < F.col("_full")) & ((F.col("period") == F.col("_a")) | (F.col("period") == F.col("_b")))
            each = each.where(~stub).select(group, "period", "value", "days")
        both = each.groupBy(group).agg(
            F.min(F.struct((-F.col("value")).alias("k"), "period", "days", "value")).alias("best"), F.min(F.struct(F.col("value").alias("k"), "period", "days", "value")).alias("worst")
        )
        long = both.select(group, F.explode(F.array(F.struct(F.lit("best").alias("which"), F.col("best").alias("v")), F.struct(F.lit("worst").alias("which"), F.col("worst").alias("v")))).alias("_e"))
        one = long.select(group, F.lit(unit).alias("unit"), F.col("_e.which").alias("which"), F.col("_e.v.period").alias("period"), F.col("_e.v.days").alias("days"), F.col("_e.v.value").alias("value"))
        parts = one if parts is None else parts.unionByName(one)
    k = F.col("days").cast("double")
    z = F.when(F.col("_s") > 1e-12, (F.col("value") - k * F.col("_m")) / (F.col("_s") * F.sqrt(k)))
    out = parts.join(base, group).withColumn("sigma", z).drop("_m", "_s")
    a = F.abs("sigma")
    return out.withColumn("label", F.when(a >= 4, "Extreme outlier").when(a >= 2.5, "Very unusual").when(a >= 1.5, "Notable").when(a.isNotNull(), "Normal"))


def growth(df: DataFrame, group: str, time: str, ret: str) -> DataFrame:
    """(group, years, total, cagr): compounded return and its yearly rate over years of 365.25 days, percent; null for
    series of one day."""
    a = df.where(F.col(ret).isNotNull()).groupBy(group).agg(F.exp(F.sum(F.ln(1 + F.col(ret)))).alias("_e"), (F.datediff(F.max(time), F.min(time)) / 365.25).alias("years"))
    return a.select(group, "years", ((F.col("_e") - 1) * 100).alias("total"), F.when(F.col("years") > 0, (F.pow("_e", 1 / F.col("years")) - 1) * 100).alias("cagr"))


def equity_by_period(df: DataFrame, group: str, time: str, ret: str, unit: str = "month") -> DataFrame:
    """(group, period, start, end, return_pct) of the equity curve that begins at 1: the value before a period's first row
    and after its last."""
    eq = with_equity(df.where(F.col(ret).isNotNull()), group, time, ret).withColumn("_before", F.col("equity") / (1 + F.col(ret)))
    each = eq.groupBy(group, _period_end(unit, time).alias("period")).agg(F.min_by("_before", time).alias("start"), F.max_by("equity", time).alias("end"))
    return each.withColumn("return_pct", (F.col("end") / F.col("start") - 1) * 100)


def by_reason(df: DataFrame, reason: str, pnl: str) -> DataFrame:
    """(reason, n, mean, median) of results; the medians come from range-sorted counts."""
    each = df.where(F.col(pnl).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n"), F.avg(pnl).alias("mean"))
    return lookup_join(each, cut(quantiles(df, [reason], pnl, {"median": 0.5})), [reason])


def rolling_sharpe(df: DataFrame, group: str, order: str, ret: str, rows: int = 50) -> DataFrame:
    """``df`` with ``rolling_sharpe``: mean over deviation of the last ``rows`` results, times sqrt(252); null before, and
    where they are flat."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(1 - rows, 0)
    s = F.stddev_samp(ret).over(w)
    return df.withColumn("rolling_sharpe", F.when((F.count(ret).over(w) >= rows) & (s > 1e-12), F.avg(ret).over(w) / s * F.sqrt(F.lit(252.0))))


def histogram(df: DataFrame, x: str, bins: int = 20) -> DataFrame:
    """(bin, lo, hi, n): equal widths between the least and the greatest value; the greatest is in the last bin."""
    ends = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
    a, b = ends["a"], ends["b"]
    if a is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n bigint")
    step = (b - a) / bins or 1.0
    place = F.least(F.floor((F.col(x) - F.lit(a)) / F.lit(step)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(x).isNotNull()).groupBy((place + 1).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", (F.lit(a) + (F.col("bin") - 1) * F.lit(step)).alias("lo"), (F.lit(a) + F.col("bin") * F.lit(step)).alias("hi"), "n")


def ends(df: DataFrame, group: str, x: str, k: int = 5) -> DataFrame:
    """The ``k`` best and worst groups by mean ``x``: (group, mean, n, which); ties go by name."""
    each = cut(df.where(F.col(x).isNotNull()).groupBy(group).agg(F.avg(x).alias("mean"), F.count(F.lit(1)).alias("n")))
    top = each.orderBy(F.desc("mean"), group).limit(k).withColumn("which", F.lit("best"))
    return top.unionByName(each.orderBy("mean", group).limit(k).withColumn("which", F.lit("worst")))

"""Performance metrics of a series of daily returns (fractions), one row a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, absolute error below 2e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def with_equity(df: DataFrame, group: str, time: str, ret: str) -> DataFrame:
    """``df`` with ``equity`` (compounded), ``drawdown`` (percent below the running peak) and streak numbers."""
    w = Window.partitionBy(group).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    o = Window.partitionBy(group).orderBy(time)
    eq = df.withColumn("equity", F.exp(F.sum(F.ln(1 + F.col(ret))).over(w)))
    eq = eq.withColumn("drawdown", (1 - F.col("equity") / F.max("equity").over(w)) * 100).withColumn("_pos", F.col(ret) > 0)
    eq = eq.withColumn("_turn", F.when(F.col("_pos") == F.lag("_pos").over(o), 0).otherwise(1)).withColumn("_run", F.sum("_turn").over(w))
    return eq.withColumn("streak", F.row_number().over(Window.partitionBy(group, "_run").orderBy(time))).drop("_turn", "_run")


def summary(df: DataFrame, group: str, time: str, ret: str, risk_free: float = 0.05) -> DataFrame:
    """One row a group: counts, volatility, Sharpe, Sortino, gain to pain, ulcer index, VaR and CVaR, tail ratio, omega,
    positive share, longest streaks, worst drawdown and the probabilistic Sharpe ratio against 1/sqrt(252)."""
    r = F.col(ret)
    daily_rf = (1 + risk_free) ** (1 / 252) - 1
    flat_rf = risk_free / 252
    rows = with_equity(df.where(r.isNotNull()), group, time, ret)
    var = rows.groupBy(group).agg(F.expr(f"percentile({ret}, 0.05)").alias("_p5"), F.expr(f"percentile({ret}, 0.95)").alias("_p95"))
    tail = rows.join(var, group).where(r < F.col("_p5")).groupBy(group).agg((F.avg(ret) * 100).alias("cvar_95"))
    neg, pos = F.when(r < 0, r), F.when(r > 0, r)
    agg = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(ret).alias("_m"), F.stddev_samp(ret).alias("_s"), (F.stddev_pop(ret) * 100).alias("daily_volatility"),
        F.stddev_pop(neg).alias("_down"), F.coalesce(F.sum(pos), F.lit(0.0)).alias("_gain"), F.coalesce(-F.sum(neg), F.lit(0.0)).alias("_pain"),
        F.sqrt(F.avg(F.col("drawdown") ** 2)).alias("ulcer_index"), F.max("drawdown").alias("max_drawdown"),
        F.sum(F.greatest(r - flat_rf, F.lit(0.0))).alias("_og"), F.sum(F.greatest(flat_rf - r, F.lit(0.0))).alias("_ol"),
        (F.avg(F.when(r > 0, 1.0).otherwise(0.0).cast("double")) * 100).alias("positive_days_pct"),
        F.coalesce(F.max(F.when(F.col("_pos"), F.col("streak"))), F.lit(0)).alias("max_pos_streak"), F.coalesce(F.max(F.when(~F.col("_pos"), F.col("streak"))), F.lit(0)).alias("max_neg_streak"),
        F.skewness(ret).alias("_g3"), (F.kurtosis(ret) + 3).alias("_g4"), F.max_by("equity", time).alias("_end"),
    )
    ok = F.col("_s") > 1e-12
    sr = F.when(ok, F.col("_m") / F.col("_s"))
    v = 1 - F.col("_g3") * sr + (F.col("_g4") - 1) / 4 * sr * sr
    ann = (F.pow(F.col("_end"), 252.0 / F.col("n")) - 1) * 100
    return agg.join(var, group).join(tail, group, "left").select(
        group, "n", "daily_volatility", (F.col("daily_volatility") * F.sqrt(F.lit(252.0))).alias("annualized_volatility"), ann.alias("annualized_return"),
        F.when(ok, (F.col("_m") - daily_rf) / F.col("_s") * F.sqrt(F.lit(252.0))).alias("sharpe_ratio"),
        F.when(F.col("_down") > 1e-12, (ann - 5) / (F.col("_down") * F.sqrt(F.lit(252.0)) * 100)).alias("sortino_ratio"),
        F.when(F.col("_pain") > 0, F.col("_gain") / F.col("_pain")).alias("gain_to_pain_ratio"), "ulcer_index", "max_drawdown",
        (F.col("_p5") * 100).alias("var_95"), "cvar_95", F.when(F.col("_p5") < 0, F.col("_p95") / -F.col("_p5")).alias("tail_ratio"),
        F.when(F.col("_ol") > 0, F.col("_og") / F.col("_ol")).alias("omega_ratio_rf"), "positive_days_pct", "max_pos_streak", "max_neg_streak",
        F.when(v > 0, normal_cdf((sr - 1 / F.sqrt(F.lit(252.0))) * F.sqrt(F.col("n") - 1) / F.sqrt(v))).alias("psr"),
        F.when(F.col("ulcer_index") > 1e-12, (ann - 5) / F.col("ulcer_index")).alias("serenity_ratio"),
    )


def period_returns(df: DataFrame, group: str, time: str, ret: str, unit: str = "month") -> DataFrame:
    """Compounded return (percent) of every calendar ``unit``."""
    return df.where(F.col(ret).isNotNull()).groupBy(group, F.date_trunc(unit, F.col(time)).cast("date").alias("period")).agg(((F.exp(F.sum(F.ln(1 + F.col(ret)))) - 1) * 100).alias("return_pct"), F.count(F.lit(1)).alias("days"))

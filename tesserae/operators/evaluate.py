"""How well scores and features tell returns: information coefficients, mutual information, reports and walk-forward plans.

Pooled rank correlations never sort a column in one task: (group, x, y) counts are made map-side, average ranks come from
range-sorted running counts of distinct values, and the coefficient is a weighted sum over the counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.operators.cross import average_rank, quantile_bins
from tesserae.plans.scale import cut, grouped_running, lookup_join, quantiles, running_total


def stacked(df: DataFrame, pairs: list[tuple[str, str, str]], *keep: str) -> DataFrame:
    """(keep, name, x, y) of every (name, x column, y column); rows in which either is unknown are left out."""
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for n, x, y in pairs])
    long = df.select(*keep, F.explode(parts).alias("_p")).select(*keep, "_p.*")
    return long.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))


def coefficients(long: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(by, ``n``, ``ic`` Spearman, ``t`` of it, ``pearson``) of the pairs of each group; null where one side is flat."""
    pairs = cut(long.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("_n")))
    ranks = {}
    for c in (x, y):
        at = grouped_running(pairs.groupBy(*by, c).agg(F.sum("_n").alias("_m")), by, c, "_m")
        ranks[c] = cut(at.select(*by, c, (F.col("_upto") - F.col("_m") + (F.col("_m") + 1) / 2).alias(f"_r_{c}"), F.col("_all").alias(f"_all_{c}")))
    both = pairs.join(ranks[x], [*by, x]).join(ranks[y].drop(f"_all_{y}"), [*by, y])
    mid = (F.col(f"_all_{x}") + 1) / 2
    a, b, n = F.col(f"_r_{x}") - mid, F.col(f"_r_{y}") - mid, F.col("_n")
    each = both.groupBy(*by).agg(
        F.sum(n).alias("n"), F.sum(n * a * b).alias("_ab"), F.sum(n * a * a).alias("_aa"), F.sum(n * b * b).alias("_bb"),
        F.sum(n * F.col(x)).alias("_sx"), F.sum(n * F.col(y)).alias("_sy"), F.sum(n * F.col(x) * F.col(y)).alias("_sxy"), F.sum(n * F.col(x) ** 2).alias("_sxx"), F.sum(n * F.col(y) ** 2).alias("_syy"),
    )
    m = F.col("n").cast("double")
    cov, vx, vy = F.col("_sxy") - F.col("_sx") * F.col("_sy") / m, F.col("_sxx") - F.col("_sx") ** 2 / m, F.col("_syy") - F.col("_sy") ** 2 / m
    ic = F.when((F.col("_aa") > 0) & (F.col("_bb") > 0), F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb")))
    out = each.select(*by, "n", ic.alias("ic"), F.when((vx > 1e-18) & (vy > 1e-18), cov / F.sqrt(vx * vy)).alias("pearson"))
    return out.withColumn("t", F.when((F.col("n") > 2) & (F.abs("ic") < 1), F.col("ic") * F.sqrt((F.col("n") - 2) / (1 - F.col("ic") ** 2))))


def graded(table: DataFrame, strong: float = 0.05, some: float = 0.01) -> DataFrame:
    """Coefficients with ``grade`` by their size."""
    a = F.abs("ic")
    return table.withColumn("grade", F.when(a >= strong, "strong").when(a >= some, "weak").otherwise("none"))


def rank_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, ic, n): Spearman correlations of all pairs of columns, over the rows that have both."""
    pairs = [(f"{a}|{b}", a, b) for i, a in enumerate(columns) for b in columns[i:]]
    half = coefficients(stacked(df, pairs), ["name"]).select(F.split("name", r"\|")[0].alias("a"), F.split("name", r"\|")[1].alias("b"), "ic", "n")
    return half.unionByName(half.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "ic", "n"))


def daily_summary(daily: DataFrame, value: str = "ic") -> DataFrame:
    """One row: ``days``, mean, deviation, their ratio (``icir``) and the share of positive days of a daily series (over floating noise: equal
    ranks cancel to 0 only up to it)."""
    x = F.col(value)
    a = daily.where(x.isNotNull()).agg(F.count(x).alias("days"), F.avg(x).alias("mean_ic"), F.stddev_samp(x).alias("std_ic"), F.avg(F.when(x > 1e-12, 1.0).otherwise(0.0).cast("double")).alias("positive"))
    return a.withColumn("icir", F.try_divide("mean_ic", "std_ic"))


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """One row (n, ``nats``): mutual information of the quantile bins of two columns."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cells = quantile_bins(quantile_bins(known, "x", bins).withColumnRenamed("bin", "i"), "y", bins).groupBy("i", "bin").agg(F.count(F.lit(1)).alias("c"))
    cells = cut(cells)  # at most bins x bins rows
    w = lambda *k: Window.partitionBy(*[F.col(c) for c in k] or [F.lit(0)])
    p = cells.select("c", F.sum("c").over(w("i")).alias("a"), F.sum("c").over(w("bin")).alias("b"), F.sum("c").over(w()).alias("n"))
    return p.agg(F.max("n").alias("n"), F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("a") * F.col("b")))).alias("nats"))


def by_regime(df: DataFrame, features: list[str], y: str, regime: str, parts: int = 3) -> DataFrame:
    """(name, ``low``, ..., ``high``): coefficients of features within quantile parts of ``regime``, one row a feature."""
    names = ["low", "mid", "high"] if parts == 3 else [f"part_{k}" for k in range(1, parts + 1)]
    known = df.where(F.col(regime).isNotNull())
    label = F.element_at(F.array(*map(F.lit, names)), F.least(F.col("bin"), F.lit(parts)))
    rows = quantile_bins(known, regime, parts).withColumn("regime", label)
    table = coefficients(stacked(rows, [(f, f, y) for f in features], "regime"), ["name", "regime"])
    return table.groupBy("name").pivot("regime", names).agg(F.first("ic"))


def sign_consistency(table: DataFrame, horizons: list[str]) -> DataFrame:
    """Of coefficients a (feature, horizon), the features whose sign is the same over all ``horizons``, with ``growth``:
    the last over the first in size."""
    wide = table.groupBy("feature").pivot("horizon", horizons).agg(F.first("ic"))
    signs = [F.signum(h) for h in horizons]
    same = reduce(lambda a, b: a & b, [(s == signs[0]) & (s != 0) for s in signs])
    return wide.where(same).withColumn("growth", F.abs(F.col(horizons[-1])) / (F.abs(F.col(horizons[0])) + 1e-8))


#: The checks of the feature scorecard, as (column, whether its size counts, threshold).
CHECKS = (("ic", True, 0.02), ("t", True, 3.0), ("positive", False, 0.55), ("icir", True, 0.3), ("auc_distance", False, 0.01), ("spread", False, 0.02), ("spearman", True, 0.01))


def scorecard(table: DataFrame) -> DataFrame:
    """``table`` with ``passed`` checks and ``grade``; a check of an unknown value fails."""
    hits = [F.coalesce((F.abs(c) if size else F.col(c)) > at, F.lit(False)).cast("int") for c, size, at in CHECKS]
    passed = reduce(lambda a, b: a + b, hits)
    return table.withColumn("passed", passed).withColumn("grade", F.when(F.col("passed") >= 6, "STRONG").when(F.col("passed") >= 4, "PROMISING").when(F.col("passed") >= 2, "WEAK").otherwise("NO SIGNAL"))


def validation(df: DataFrame, feature: str, ret: str, time: str) -> DataFrame:
    """One row: pooled coefficients before and after the median row's time, their ratio (``retention``), and mean, deviation
    and share of the overall sign of the monthly ones."""
    half = quantiles(df.where(F.col(feature).isNotNull() & F.col(ret).isNotNull()).withColumn("_d", F.unix_date(F.col(time).cast("date"))), [], "_d", {"m": 0.5})
    middle = (half.first() or [None])[0]
    rows = df.withColumns({"part": F.when(F.unix_date(F.col(time).cast("date")) <= middle, "train").otherwise("test"), "month": F.date_format(time, "yyyy-MM")})
    parts = coefficients(stacked(rows, [(feature, feature, ret)], "part"), ["part"]).groupBy().pivot("part", ["train", "test"]).agg(F.first("ic"))
    whole = coefficients(stacked(rows, [(feature, feature, ret)]), ["name"]).select("n", "ic", "t").first()
    months = coefficients(stacked(rows, [(feature, feature, ret)], "month"), ["month"]).where("ic is not null")
    n, ic, t = whole or (0, None, None)
    sign = F.signum(F.lit(ic).cast("double"))
    m = months.agg(F.count(F.lit(1)).alias("months"), F.avg("ic").alias("monthly_mean"), F.stddev_samp("ic").alias("monthly_std"), F.avg((F.signum("ic") == sign).cast("double")).alias("monthly_hit"))
    both = parts.withColumn("_one", F.lit(1)).join(m.withColumn("_one", F.lit(1)), "_one").drop("_one")  # each side has one row
    return both.withColumns({"n": F.lit(n), "ic": F.lit(ic).cast("double"), "t": F.lit(t).cast("double"), "retention": F.try_divide("test", "train")})


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row (n, positives, ``auc_pr``): the sum of precision times the step in recall over distinct scores."""
    counts = cut(df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.sum(F.col(label)).alias("_p"), F.count(F.lit(1)).alias("_n")))
    both = running_total(running_total(counts, score, "_n", True).withColumnsRenamed({"_upto": "_rows", "_all": "_total"}), score, "_p", True)
    return both.agg(F.max("_total").alias("n"), F.max("_all").alias("positives"), F.sum(F.try_divide(F.col("_p") * F.col("_upto"), F.col("_rows") * F.col("_all"))).alias("auc_pr"))


def top_precision(df: DataFrame, score: str, label: str, shares: tuple[float, ...] = (0.01, 0.05)) -> DataFrame:
    """(share, rows, precision): of the rows at or above the (1 - share) quantile of the score."""
    known = df.where(F.col(score).isNotNull())
    cutoffs = quantiles(known, [], score, {f"c{i}": 1 - s for i, s in enumerate(shares)}).first()
    picks = [F.struct(F.lit(s).alias("share"), F.when(F.col(score) >= F.lit(cutoffs[i] if cutoffs else None), 1).otherwise(0).alias("hit")) for i, s in enumerate(shares)]
    rows = known.select(F.col(label).alias("_l"), F.explode(F.array(*picks)).alias("_k")).select("_l", "_k.*").where("hit = 1")
    return rows.groupBy("share").agg(F.count(F.lit(1)).alias("rows"), F.avg("_l").alias("precision"))


def threshold_fires(df: DataFrame, score: str, label: str, time: str, thresholds: list[float], least: int = 10) -> DataFrame:
    """(threshold, fires, ``precision`` (null under ``least`` fires), ``fires_per_day``)."""
    days = df.agg(F.count_distinct(time)).first()[0] or 1
    picks = F.explode(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col(score))).alias("threshold")
    hits = df.select(F.col(label).alias("_l"), picks).groupBy("threshold").agg(F.count(F.lit(1)).alias("fires"), F.avg("_l").alias("_p"))
    return hits.select("threshold", "fires", F.when(F.col("fires") >= least, F.col("_p")).alias("precision"), (F.col("fires") / F.lit(days)).alias("fires_per_day"))


def seed_table(df: DataFrame, config: str, month: str, value: str) -> DataFrame:
    """(config, month, n, mean, std): results of several seeds, averaged within each month."""
    return df.groupBy(config, month).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def config_table(months: DataFrame, config: str) -> DataFrame:
    """Of :func:`seed_table`, a row a config: months, mean, median, share of gains, deviation and mean seed deviation."""
    med = quantiles(months, [config], "mean", {"median": 0.5})
    each = months.groupBy(config).agg(F.count("mean").alias("months"), F.avg("mean").alias("pooled"), F.avg((F.col("mean") > 0).cast("double")).alias("win"), F.stddev_samp("mean").alias("month_std"), F.avg("std").alias("seed_std"))
    return each.join(med, config)


def anchors(df: DataFrame, time: str, first_month: str, least_days: int = 5) -> DataFrame:
    """(month, anchor, next_month): of each month from ``first_month`` on, its last date, where the next month that has
    rows has at least ``least_days`` days of them. A row a month of the calendar, so it is ordered as a whole."""
    month = F.date_format(time, "yyyy-MM").alias("month")
    each = df.where(F.col(time).isNotNull()).groupBy(month).agg(F.max(time).alias("anchor"), F.count_distinct(time).alias("days"))
    w = Window.partitionBy(F.lit(0)).orderBy("month")
    out = each.withColumns({"next_month": F.lead("month").over(w), "_days": F.lead("days").over(w)})
    return out.where((F.col("month") >= first_month) & (F.col("_days") >= least_days)).select("month", "anchor", "next_month")


def training_rows(df: DataFrame, time: str, anchor, config: str) -> tuple[DataFrame, float]:
    """(rows to train on, half-life in days) of a named walk-forward config at an anchor date: 'baseline', 'recent_<n>' (the
    last n trading dates), 'hl_<n>' (another half-life), 'stale_<n>mo' (the cutoff moved back). Other names are errors."""
    at = F.lit(anchor).cast("date")
    kind, _, number = config.partition("_")
    upto = df.where(F.col(time) <= at)
    if config == "baseline":
        return upto, 720.0
    if kind == "recent" and number.isdigit():
        last = upto.select(time).distinct().orderBy(F.desc(time)).limit(int(number)).agg(F.min(time)).first()[0]  # trading dates
        return upto.where(F.col(time) >= F.lit(last)), 720.0
    if kind == "hl" and number.isdigit():
        return upto, float(number)
    if kind == "stale" and number.removesuffix("mo").isdigit():
        return df.where(F.col(time) <= F.add_months(at, -int(number.removesuffix("mo")))), 720.0
    raise ValueError(f"unknown walk-forward config {config}")


def staleness(df: DataFrame, trained: str, scored: str, value: str) -> DataFrame:
    """(stale_months, n, mean): results by whole months between training and scoring."""
    months = F.floor(F.months_between(F.trunc(scored, "month"), F.trunc(trained, "month"))).cast("int")
    return df.withColumn("stale_months", months).where("stale_months >= 0").groupBy("stale_months").agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def daily_rank(df: DataFrame, x: str, time: str) -> Column:
    """Average rank of ``x`` within its time, as a share."""
    return average_rank(x, [time]) / F.count(x).over(Window.partitionBy(time))


def averaged(tables: list[DataFrame], keys: list[str], score: str, time: str, least: int | None = None) -> DataFrame:
    """(keys, score, rank): the mean score of the keys that all ``tables`` have (or ``least`` of them), ranked again within
    each time. The tables are stacked and counted, so any number of them is one shuffle, not a chain of joins."""
    whole = reduce(DataFrame.unionByName, [t.select(*keys, F.col(score).cast("double").alias("_s"), F.lit(i).alias("_t")) for i, t in enumerate(tables)])
    each = whole.where(F.col("_s").isNotNull()).groupBy(*keys, "_t").agg(F.avg("_s").alias("_s"))
    mean = each.groupBy(*keys).agg(F.avg("_s").alias(score), F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= (least or len(tables))).drop("_k")
    return mean.withColumn("rank", daily_rank(mean, score, time))


def with_market_regime(df: DataFrame, market: DataFrame, time: str, level: str, edges: tuple[float, ...] = (15.0, 20.0, 30.0)) -> DataFrame:
    """``df`` with ``regime``: how many ``edges`` the highest ``level`` of its time reaches; null where there is none."""
    known = market.where(F.col(level).isNotNull() & ~F.isnan(level))
    steps = cut(known.groupBy(time).agg(F.max(level).alias("_v")).select(time, reduce(lambda a, b: a + b, [F.when(F.col("_v") >= e, 1).otherwise(0) for e in edges]).alias("regime")))
    return lookup_join(df, steps, [time])

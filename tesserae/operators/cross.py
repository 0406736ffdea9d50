"""Cross-section operators: ranks, scores, labels, bands, bins, thresholds and splits over the entities of a time."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.plans.scale import cut, lookup_join, quantiles, running_total


def average_rank(x: str, by: list[str]) -> Column:
    """Average rank of the known values within ``by``; null for a null value."""
    c = F.col(x)
    below = F.rank().over(Window.partitionBy(*by, c.isNull()).orderBy(c))
    same = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
    return F.when(c.isNotNull(), below + (same - 1) / 2)


def pct_rank(x: str, by: list[str]) -> Column:
    return average_rank(x, by) / F.count(x).over(Window.partitionBy(*by))


def ranks_long(df: DataFrame, columns: list[str], by: str, keys: list[str]) -> DataFrame:
    """(keys, feature, value, rank) of all ``columns``: stacked first, so that any number of features takes one exchange
    and one sort, on (time, feature), instead of one a feature."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_f")
    long = df.select(*keys, pairs).select(*keys, "_f.*")
    return long.withColumn("rank", pct_rank("value", [by, "feature"]))


def centred_rank(x: str, by: list[str]) -> Column:
    """rank / (n + 1) * 2 - 1 over known values; 0 for unknown ones and where fewer than two are known."""
    n = F.count(x).over(Window.partitionBy(*by))
    return F.when((n >= 2) & F.col(x).isNotNull(), average_rank(x, by) / (n + 1) * 2 - 1).otherwise(F.lit(0.0))


def zscore(x: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    return (F.col(x) - F.avg(x).over(w)) / (F.stddev_pop(x).over(w) + 1e-10)


def top_label(df: DataFrame, ret: str, by: list[str], share: float, label: str = "label") -> DataFrame:
    """``df`` with ``label``: 1 where a return reaches its time's (1 - share) quantile (linear), otherwise 0. The cutoffs come
    from range-sorted counts, so a time of any size is spread over tasks."""
    cutoffs = cut(quantiles(df, by, ret, {"_cutoff": 1 - share}))
    return lookup_join(df, cutoffs, by).withColumn(label, F.when(F.col(ret) >= F.col("_cutoff") - 1e-15, 1).otherwise(0)).drop("_cutoff")


def risk_adjusted_label(df: DataFrame, ret: str, vol: str, by: list[str], share: float, floor: float = 1e-3, label: str = "label") -> DataFrame:
    """:func:`top_label` of the return over the volatility, the latter at least ``floor``."""
    return top_label(df.withColumn("_ra", F.col(ret) / F.greatest(F.col(vol), F.lit(floor))), "_ra", by, share, label).drop("_ra")


def labelled(df: DataFrame, mode: str, ret: str, by: list[str], share: float = 0.1, vol: str | None = None) -> DataFrame:
    """``df`` with ``label`` by mode: 'binary_up' (a positive return), 'topq' or 'risk_adj_topq'."""
    if mode == "binary_up":
        return df.withColumn("label", F.when(F.col(ret) > 0, 1).otherwise(0))
    if mode == "topq":
        return top_label(df, ret, by, share)
    if mode == "risk_adj_topq" and vol:
        return risk_adjusted_label(df, ret, vol, by, share)
    raise ValueError(f"no label of mode {mode}")


def forward_returns(df: DataFrame, entity: str, time: str, price: str, horizons: tuple[int, ...] = (1, 5)) -> DataFrame:
    """``df`` with ``ret_<h>`` over the next h rows of an entity; its last max(horizons) rows, which lack them, go."""
    w = Window.partitionBy(entity).orderBy(time)
    back = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(time)))
    out = df.withColumns({f"ret_{h}": F.try_divide(F.lead(price, h).over(w), F.col(price)) - 1 for h in horizons}).withColumn("_back", back)
    return out.where(F.col("_back") > max(horizons)).drop("_back")


def trailing_percentile(df: DataFrame, entity: str, time: str, score: str, rows: int = 252, least: int = 60) -> DataFrame:
    """``df`` with ``ts_pctile``: the average rank of a score among the entity's last ``rows`` ones (itself included), as a
    share; null with fewer than ``least`` known. Windows are bounded by ``rows``."""
    w = Window.partitionBy(entity).orderBy(time).rowsBetween(1 - rows, 0)
    seen = F.collect_list(F.col(score).cast("double")).over(w)
    df = df.withColumn("_seen", seen)
    x = F.col(score).cast("double")
    n = F.size("_seen")
    below, same = F.size(F.filter("_seen", lambda v: v < x)), F.size(F.filter("_seen", lambda v: v == x))
    return df.withColumn("ts_pctile", F.when((n >= least) & x.isNotNull(), (below + (same + 1) / 2) / n)).drop("_seen")


def percentile_signal(pctile: Column, inside: Column, lo: float = 0.65, hi: float = 0.98) -> tuple[Column, Column]:
    """(probability, prediction) of a trailing percentile: .30 + .40 p, .30 while unknown or not ``inside`` the universe;
    1 within [lo, hi), 0 for the others inside, -1 outside."""
    p = F.when(inside & pctile.isNotNull(), F.lit(0.30) + 0.40 * pctile).otherwise(F.lit(0.30))
    return p, F.when(inside & (pctile >= lo) & (pctile < hi), 1).when(inside, 0).otherwise(-1)


def universe_rank(df: DataFrame, x: str, by: list[str], inside: Column, default: float = 0.5) -> DataFrame:
    """``df`` with ``<x>_xs``: percent rank among the rows ``inside`` of each time; ``default`` for the others and for
    unknown values."""
    df = df.withColumn("_in", F.coalesce(inside, F.lit(False)))
    return df.withColumn(f"{x}_xs", F.when(F.col("_in"), F.coalesce(pct_rank(x, [*by, "_in"]), F.lit(default))).otherwise(F.lit(default))).drop("_in")


def shuffled_within(df: DataFrame, by: str, key: str, seed: int) -> DataFrame:
    """``df`` with ``place``: a seeded order of the rows of each time, the same on every run."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key))))


def top_k(df: DataFrame, score: str, by: str, share: float, least_rows: int, tie: list[Column]) -> DataFrame:
    """Of every time with ``least_rows`` rows, the max(floor(n * share), 1) rows of highest score."""
    n = F.count(score).over(Window.partitionBy(by))
    k = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), *tie))
    ranked = df.where(F.col(score).isNotNull()).withColumns({"_n": n, "_k": k})
    return ranked.where((F.col("_n") >= least_rows) & (F.col("_k") <= F.greatest(F.floor(F.col("_n") * share), F.lit(1)))).drop("_n", "_k")


# The rank bands of the score reports (half-open).
BANDS = [("99-100", 0.99, 1.0001), ("98-99", 0.98, 0.99), ("95-98", 0.95, 0.98), ("93-95", 0.93, 0.95), ("90-93", 0.90, 0.93), ("80-90", 0.80, 0.90), ("70-80", 0.70, 0.80), ("50-70", 0.50, 0.70), ("0-50", 0.0, 0.50)]


def band_table(df: DataFrame, rank: str, ret: str, label: str, time: str) -> DataFrame:
    """Per rank band: rows, picks a day, pooled and per-day mean return (percent), annualised daily Sharpe, precision and
    share of gains. A row's band is an expression, not a join, so the table is two aggregates."""
    band = F.lit(None).cast("string")
    for name, lo, hi in BANDS:
        band = F.when((F.col(rank) >= lo) & (F.col(rank) < hi), name).otherwise(band)
    rows = df.withColumn("band", band).where("band is not null")
    days = df.where(F.col(rank).isNotNull()).agg(F.count_distinct(time)).first()[0]
    daily = rows.groupBy("band", time).agg(F.avg(ret).alias("_m"), F.sum(ret).alias("_s"), F.count(ret).alias("_r"), F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_l"), F.sum(F.when(F.col(ret) > 0, 1).otherwise(0)).alias("_g"))
    each = daily.groupBy("band").agg(
        F.sum("_n").alias("n"), F.avg("_m").alias("_pm"), F.stddev_samp("_m").alias("_ps"), (F.sum("_s") / F.sum("_r") * 100).alias("pooled_ret"), (F.sum("_l") / F.sum("_n")).alias("precision"), (F.sum("_g") / F.sum("_n")).alias("hit")
    )
    return each.select(
        "band", "n", (F.col("n") / F.lit(days)).alias("picks_per_day"), "pooled_ret", (F.col("_pm") * 100).alias("perday_ret"),
        F.when(F.col("_ps") > 0, F.col("_pm") / F.col("_ps") * F.sqrt(F.lit(252.0))).alias("perday_sharpe"), "precision", "hit",
    )


def rank_correlations(df: DataFrame, x: str, y: str, by: str, least: int = 5) -> DataFrame:
    """Spearman correlation of ``x`` and ``y`` within every ``by`` with ``least`` complete pairs; null where one is flat."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_x": average_rank(x, [by]), "_y": average_rank(y, [by])})
    return pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_samp("_x", "_y"), F.nullif(F.stddev_samp("_x") * F.stddev_samp("_y"), F.lit(0.0))).alias("ic")).where(F.col("n") >= least)


def quantile_bins(df: DataFrame, x: str, bins: int) -> DataFrame:
    """``df`` with ``bin`` (1-based, right-closed, equal edges dropped), null for unknown values. Edges are the exact
    linear quantiles of the whole column, from range-sorted counts, taken as literals."""
    found = quantiles(df, [], x, {f"e{k}": k / bins for k in range(1, bins)}).first()
    edges = sorted({e for e in (found or ()) if e is not None})
    return df.withColumn("bin", F.when(F.col(x).isNotNull(), sum((F.when(F.col(x) > e, 1).otherwise(0) for e in edges), F.lit(1))))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by rank sums. Ranks come from counts of distinct scores summed in order, so ties and hot
    values cost one row; the running sum goes over distinct scores."""
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_p"), F.count(F.lit(1)).alias("_n"))
    sums = running_total(counts, score, "_n").withColumn("_r", F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).agg(F.sum(F.col("_r") * F.col("_p")).alias("_rp"), F.sum("_p").alias("_pos"), F.sum(F.col("_n") - F.col("_p")).alias("_neg"))
    return sums.select(F.try_divide(F.col("_rp") - F.col("_pos") * (F.col("_pos") + 1) / 2, (F.col("_pos") * F.col("_neg")).cast("double")).alias("auc"), F.col("_pos").alias("positives"), F.col("_neg").alias("negatives"))


def precision_threshold(df: DataFrame, score: str, label: str, target: float, least_coverage: float, most_coverage: float) -> DataFrame:
    """The lowest cutoff whose rows at or above it reach ``target`` precision at a coverage within bounds; nulls if none."""
    counts = df.groupBy(score).agg(F.sum(label).alias("_p"), F.count(F.lit(1)).alias("_n"))
    counts = cut(counts)
    both = running_total(running_total(counts, score, "_n", True).withColumnsRenamed({"_upto": "_rows", "_all": "_total"}), score, "_p", True)
    at = both.select(F.col(score).alias("threshold"), (F.col("_upto") / F.col("_rows")).alias("precision"), (F.col("_rows") / F.col("_total")).alias("coverage"))
    good = at.where((F.col("coverage") >= least_coverage) & (F.col("coverage") <= most_coverage) & (F.col("precision") >= target))
    return good.agg(F.min_by(F.struct("threshold", "precision", "coverage"), "threshold").alias("_b")).select("_b.*")


def rescaled(rank: Column, share: float) -> Column:
    """Ranks of the top ``share`` to [0.45, 0.70], the rest to [0.30, 0.44], clipped to [0.30, 0.70]; 0.30 where unknown."""
    at = 1 - share
    raw = F.when(rank >= at, F.lit(0.45) + 0.25 * (rank - at) / max(share, 1e-9)).otherwise(F.lit(0.30) + 0.14 * rank / max(at, 1e-9))
    return F.coalesce(F.least(F.greatest(raw, F.lit(0.30)), F.lit(0.70)), F.lit(0.30))


def rank_signal(rank: Column, inside: Column, share: float) -> Column:
    """1 in the top ``share``, 0 for the others ``inside`` the universe, -1 outside."""
    return F.when(inside & (rank >= 1 - share), 1).when(inside, 0).otherwise(-1)


def time_split(df: DataFrame, time: str, train_pct: float, calib_pct: float, embargo_days: int) -> DataFrame:
    """``df`` with ``split``: train, embargo, calib or oos. Row positions are found from
    counts a day, so nothing but the calendar is ordered or collected."""
    days = df.where(F.col(time).isNotNull()).groupBy(time).count().orderBy(time).collect()  # one row a day of the calendar
    total, upto, end = sum(r["count"] for r in days), 0, None
    for r in days:
        upto += r["count"]
        if upto >= max(int(total * train_pct / 100), 1):
            end = r[time]
            break
    if end is None:
        return df.withColumn("split", F.lit(None).cast("string"))
    begin = end + datetime.timedelta(days=embargo_days)
    pool = [r for r in days if r[time] >= begin]
    upto, last = 0, None
    for r in pool:
        upto, last = upto + r["count"], r[time]
        if upto >= min(int(total * calib_pct / 100), sum(x["count"] for x in pool)):
            break
    t = F.col(time)
    split = F.when(t <= F.lit(end), "train").when(t < F.lit(begin), "embargo").when(t <= F.lit(last), "calib").when(t.isNotNull(), "oos")
    return df.withColumn("split", split)


def with_recency_weight(df: DataFrame, time: str, half_life_days: float) -> DataFrame:
    """``df`` with ``weight``: 0.5 ** (age / half life), age against the newest row, over its mean."""
    newest = df.agg(F.max(time)).first()[0]
    raw = F.pow(F.lit(0.5), F.datediff(F.lit(newest), F.col(time)) / half_life_days)
    mean = df.agg(F.avg(raw)).first()[0] or 1.0
    return df.withColumn("weight", raw / mean)

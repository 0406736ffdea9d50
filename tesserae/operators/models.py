"""Models over panels: boosted trees, seed ensembles, calibration and balanced samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.cross import auc, pct_rank
from tesserae.plans.scale import BROADCAST_ROWS, at_most, cut, quantiles


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep").transform(df.fillna(0.0, features))


def boosted(train: DataFrame, features: list[str], label: str, weight: str | None = None, trees: int = 10, depth: int = 3, seed: int = 7, time: str | None = None, hold: float = 0.2, rate: float = 0.1):
    """A model of gradient-boosted trees. With ``time``, the last ``hold`` of the rows by time decide when to stop."""
    from pyspark.ml.classification import GBTClassifier

    gbt = GBTClassifier(featuresCol="_features", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8, stepSize=rate)
    if weight:
        gbt = gbt.setWeightCol(weight)
    rows = train.withColumn(label, F.col(label).cast("double"))
    if time:
        at = quantiles(rows.withColumn("_d", F.unix_date(F.col(time).cast("date"))), [], "_d", {"q": 1 - hold}).first()
        rows = rows.withColumn("_late", F.unix_date(F.col(time).cast("date")) > F.lit(at[0] if at else None))
        gbt = gbt.setValidationIndicatorCol("_late")
    return gbt.fit(_assembled(rows, features))


def boosted_scores(train: DataFrame, score: DataFrame, features: list[str], label: str, weight: str | None = None, trees: int = 10, depth: int = 3, seed: int = 7, time: str | None = None) -> DataFrame:
    """``score`` with ``probability`` of gradient-boosted trees fitted on ``train`` (null features count as 0)."""
    from pyspark.ml.functions import vector_to_array

    model = boosted(train, features, label, weight, trees, depth, seed, time)
    out = model.transform(_assembled(score, features))
    return out.withColumn("probability", vector_to_array("probability")[1]).drop("_features", "rawPrediction", "prediction")


def ensemble_scores(train: DataFrame, score: DataFrame, features: list[str], label: str, keys: list[str], seeds: list[int]) -> DataFrame:
    """(keys, ``probability``): mean over models of several seeds."""
    parts = None
    for s in seeds:
        one = boosted_scores(train, score, features, label, seed=s).select(*keys, "probability")
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(*keys).agg(F.avg("probability").alias("probability"))


def calibrated(train: DataFrame, score: DataFrame, probability: str, label: str) -> DataFrame:
    """``score`` with ``calibrated``: a logistic regression on the logit (the beta calibrator's two logs are one)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    p = F.least(F.greatest(F.col(probability), F.lit(1e-6)), F.lit(1 - 1e-6))
    with_logit = lambda df: _assembled(df.withColumn("_logit", F.ln(p / (1 - p))), ["_logit"])
    model = LogisticRegression(featuresCol="_features", labelCol=label, probabilityCol="_cal", rawPredictionCol="_raw", predictionCol="_pred").fit(with_logit(train.withColumn(label, F.col(label).cast("double"))))
    return model.transform(with_logit(score)).withColumn("calibrated", vector_to_array("_cal")[1]).drop("_features", "_logit", "_cal", "_raw", "_pred")


def balanced_sample(df: DataFrame, group: str, per_group: int, seed: int, keys: list[str]) -> DataFrame:
    """The ``per_group`` rows of each group with the smallest seeded hash: repeatable, whatever the partitioning. Null
    groups are a group.

    Only rows whose hash lies in the share that surely holds so many are ordered, so a group of any size sends a bounded
    number of rows to its task; a group that falls short (one in more than a billion) is taken whole."""
    from pyspark.sql.window import Window

    h = F.xxhash64(F.lit(seed), *keys)
    share = (h.cast("double") + 2.0**63) / 2.0**64
    wanted = per_group + 10 * per_group**0.5 + 50
    counts = cut(df.groupBy(group).agg(F.count(F.lit(1)).alias("_all")))
    rows = _with(df.withColumn("_share", share), counts, group)
    kept = rows.where(F.col("_share") <= F.lit(wanted) / F.col("_all"))
    got = cut(kept.groupBy(group).agg(F.count(F.lit(1)).alias("_kept")))
    short = _with(counts, got, group).where(F.coalesce("_kept", F.lit(0)) < F.least(F.col("_all"), F.lit(per_group)))
    if short.limit(1).count():
        short = cut(short.select(group, F.lit(True).alias("_short")))
        kept = _with(rows, short, group).where(F.col("_short") | (F.col("_share") <= F.lit(wanted) / F.col("_all"))).drop("_short")
    ranked = kept.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy("_share", *keys)))
    return ranked.where(F.col("_k") <= per_group).select(*df.columns)


def _with(df: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """``df`` with the columns of ``small``, null keys meeting null keys; the small side is broadcast behind a count."""
    right = small.withColumnRenamed(key, "_key")
    on = df[key].eqNullSafe(right["_key"])
    return df.join(F.broadcast(right) if at_most(small, BROADCAST_ROWS) else right, on, "left").drop("_key")


def split_by_hash(df: DataFrame, keys: list[str], seed: int, share: float = 0.7) -> DataFrame:
    """``df`` with ``part``: 'train' for about ``share`` of the rows, by a seeded hash of their keys, otherwise 'test'."""
    h = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000))
    return df.withColumn("part", F.when(h < int(share * 1_000_000), "train").otherwise("test"))


def adversarial(df: DataFrame, era: str, features: list[str], keys: list[str], per_era: int = 5_000, seed: int = 7, trees: int = 5) -> DataFrame:
    """(feature, importance, auc): how well a classifier tells the two eras of ``era`` (0 and 1) apart on held-out rows of
    a balanced sample (``per_era`` rows each, a documented bound), and by which features."""
    from pyspark.ml.functions import vector_to_array

    sample = split_by_hash(balanced_sample(df.where(F.col(era).isNotNull()), era, per_era, seed, keys), keys, seed + 1)
    sample = cut(sample)
    model = boosted(sample.where("part = 'train'"), features, era, trees=trees, seed=seed)
    scored = model.transform(_assembled(sample.where("part = 'test'"), features)).withColumn("_prob", vector_to_array("probability")[1])
    area = auc(scored, "_prob", era).first()["auc"]
    importance = [float(x) for x in model.featureImportances.toArray()]
    return df.sparkSession.createDataFrame([(f, x, area) for f, x in zip(features, importance)], "feature string, importance double, auc double")


def search(train: DataFrame, features: list[str], label: str, time: str, grid: list[dict], hold: float = 0.2) -> list[tuple[float, dict]]:
    """Settings of ``grid`` by their area under the curve on the last ``hold`` of the rows by time, best first."""
    from pyspark.ml.functions import vector_to_array

    at = quantiles(train.withColumn("_d", F.unix_date(F.col(time).cast("date"))), [], "_d", {"q": 1 - hold}).first()[0]
    late = F.unix_date(F.col(time).cast("date")) > F.lit(at)
    fit, check = cut(train.where(~late)), cut(train.where(late))
    out = []
    for settings in grid:
        scored = boosted(fit, features, label, **settings).transform(_assembled(check, features)).withColumn("_prob", vector_to_array("probability")[1])
        out.append((auc(scored, "_prob", label).first()["auc"] or 0.0, settings))
    return sorted(out, key=lambda x: -x[0])


def walk_forward(df: DataFrame, features: list[str], label: str, ret: str, time: str, steps: list[tuple], config, trees: int = 5, seed: int = 7) -> DataFrame:
    """(month, n, top_ret, base_ret, auc) of every step (anchor, next month): a model of the rows that ``config`` gives for
    the anchor (see ``evaluate.training_rows``), scored on the next month only; mean returns of the top tenth of each day
    and of its lower half."""
    parts = None
    for anchor, month in steps:
        train, _ = config(df, anchor)
        later = df.where(F.date_format(time, "yyyy-MM") == month)
        scored = cut(boosted_scores(train, later, features, label, trees=trees, seed=seed).select(time, ret, label, "probability"))
        ranked = scored.withColumn("_r", pct_rank("probability", [time]))
        one = ranked.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("_r") >= 0.9, F.col(ret))).alias("top_ret"), F.avg(F.when(F.col("_r") < 0.5, F.col(ret))).alias("base_ret"))
        area = auc(scored, "probability", label).first()["auc"]
        one = one.select(F.lit(month).alias("month"), "n", "top_ret", "base_ret", F.lit(area).cast("double").alias("auc"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def decay(table: DataFrame, calibrated: float) -> DataFrame:
    """Out-of-sample results with ``decay_pct``: how far the net return of the top falls short of the calibrated one."""
    net = F.col("top_ret") - F.col("base_ret")
    return table.withColumn("net_ret", net).withColumn("decay_pct", F.when(F.lit(calibrated) != 0, (1 - net / F.lit(calibrated)) * 100))


def portfolio_draws(df: DataFrame, entity: str, time: str, ret: str, groups: DataFrame, group: str, sims: int = 100, picks: int = 5, seed: int = 7) -> DataFrame:
    """(kind, sims, mean_vol, p05, p95) of the annual volatility of equal-weight portfolios of ``picks`` entities, drawn
    by seeded hashes: at random, from one group, or one of each of ``picks`` groups. A month is a rebalance."""
    from pyspark.sql.window import Window

    rows = cut(df.where(F.col(ret).isNotNull()).join(groups.select(entity, group), entity).select(entity, group, time, ret, F.date_format(time, "yyyy-MM").alias("_month")))
    names = cut(rows.select("_month", entity, group).distinct())
    drawn = names.withColumn("_sim", F.explode(F.sequence(F.lit(1), F.lit(sims))))
    h = lambda *c: F.xxhash64(F.lit(seed), *c)
    by = Window.partitionBy("_sim", "_month")
    parts = []
    random = drawn.withColumn("_k", F.row_number().over(by.orderBy(h("_sim", "_month", entity), entity)))
    parts.append(random.where(F.col("_k") <= picks).withColumn("kind", F.lit("random")))
    each = drawn.withColumn("_k", F.row_number().over(Window.partitionBy("_sim", "_month", group).orderBy(h("_sim", "_month", entity), entity)))
    chosen = F.dense_rank().over(by.orderBy(h("_sim", "_month", group), group))
    ranked = each.withColumn("_g", chosen)
    parts.append(ranked.where((F.col("_g") == 1) & (F.col("_k") <= picks)).drop("_g").withColumn("kind", F.lit("one group")))
    parts.append(ranked.where((F.col("_g") <= picks) & (F.col("_k") == 1)).drop("_g").withColumn("kind", F.lit("diversified")))
    held = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("kind", "_sim", "_month", entity)
    daily = held.join(rows, ["_month", entity]).groupBy("kind", "_sim", time).agg(F.avg(ret).alias("_p"))
    vols = daily.groupBy("kind", "_sim").agg((F.stddev_samp("_p") * F.sqrt(F.lit(252.0))).alias("_v"))
    return vols.groupBy("kind").agg(F.count("_v").alias("sims"), F.avg("_v").alias("mean_vol"), F.expr("percentile(_v, 0.05)").alias("p05"), F.expr("percentile(_v, 0.95)").alias("p95"))

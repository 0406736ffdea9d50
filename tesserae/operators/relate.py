"""Correlation and clustering of entities."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.plans.scale import cut, lookup_join


def standardised(df: DataFrame, entity: str, time: str, x: str) -> DataFrame:
    """(entity, time, z) with mean 0 and sample deviation 1; flat entities are left out."""
    w = Window.partitionBy(entity)
    s = F.stddev_samp(x).over(w)
    return df.where(F.col(x).isNotNull()).select(entity, time, F.when(s > 1e-12, (F.col(x) - F.avg(x).over(w)) / s).alias("z")).where("z is not null")


def group_correlations(df: DataFrame, groups: DataFrame, entity: str, time: str, x: str, group: str) -> DataFrame:
    """(entity, group, mean_corr): mean correlation of each entity with the members of each group, aligned on time.

    Never forms pairs: the mean correlation with a group is the covariance with the group's mean of standardised series,
    so the work is entities x groups x times."""
    z = standardised(df, entity, time, x)
    g = z.join(groups.select(entity, group), entity).groupBy(group, time).agg(F.avg("z").alias("gz"))
    return z.join(g, time).groupBy(entity, group).agg((F.covar_samp("z", "gz")).alias("mean_corr"))


def correlations_with(df: DataFrame, index: DataFrame, entity: str, time: str, x: str, y: str) -> DataFrame:
    """(entity, n, corr, beta, alpha) of each entity against one index series, aligned on time."""
    pairs = df.join(index.select(time, F.col(y).alias("_y")), time).where(F.col(x).isNotNull() & F.col("_y").isNotNull())
    sx, sy, c, v = F.stddev_samp(x), F.stddev_samp("_y"), F.covar_samp(x, "_y"), F.var_samp("_y")
    beta = F.try_divide(c, v)
    return pairs.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.try_divide(c, sx * sy).alias("corr"), beta.alias("beta"), (F.avg(x) - beta * F.avg("_y")).alias("alpha"))


#: Cells (entities times times) of standardised series that a task holds at a time.
BLOCK_CELLS = 20_000_000


def filtered_returns(df: DataFrame, entity: str, time: str, x: str, least_days: int = 252, most_move: float = 0.5, most_vol: float = 1.0, day_cover: float = 0.8, entity_cover: float = 0.9, sigmas: float = 3.0) -> DataFrame:
    """Returns fit for a correlation matrix: entities with ``least_days`` of them, without moves over ``most_move`` and
    with an annual volatility of at most ``most_vol``; then days that ``day_cover`` of those have, then entities that have
    ``entity_cover`` of these; clipped to ``sigmas`` deviations of their entity."""
    known = df.where(F.col(x).isNotNull() & F.col(entity).isNotNull() & F.col(time).isNotNull()).select(entity, time, F.col(x).cast("double").alias(x))
    calm = known.where(F.abs(x) <= most_move)
    each = calm.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"), (F.stddev_samp(x) * F.sqrt(F.lit(252.0))).alias("_v"))
    rows = lookup_join(calm, cut(each.where((F.col("_n") >= least_days) & (F.col("_v") <= most_vol)).select(entity)), [entity], "inner")
    rows = cut(rows)
    names = rows.select(entity).distinct().count()
    days = cut(rows.groupBy(time).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= day_cover * names).select(time))
    rows = lookup_join(rows, days, [time], "inner")
    whole = days.count()
    stats = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s")).where(F.col("_n") >= entity_cover * whole)
    out = lookup_join(rows, cut(stats), [entity], "inner")
    lo, hi = F.col("_m") - sigmas * F.col("_s"), F.col("_m") + sigmas * F.col("_s")
    return out.select(entity, time, F.when(F.col("_s").isNull(), F.col(x)).otherwise(F.least(F.greatest(F.col(x), lo), hi)).alias(x))


def _series(df: DataFrame, entity: str, time: str, x: str, decay_days: float | None = None, fill: float | None = None) -> tuple[DataFrame | None, int]:
    """((entity, _y), times): each entity's series over the calendar, less its weighted mean and of norm 1, so that the product
    of two is their correlation; kept in the shared folder. None without any value."""
    known = df.where(F.col(x).isNotNull() & F.col(entity).isNotNull() & F.col(time).isNotNull())
    times = [r[0] for r in known.select(time).distinct().orderBy(time).collect()]  # the calendar
    if not times:
        return None, 0
    place = {t: k for k, t in enumerate(times)}
    age = np.array([float((times[-1] - t).days) if decay_days else 0.0 for t in times])
    weight = np.exp(-age / decay_days) if decay_days else np.ones(len(times))
    weight = weight / weight.sum()

    def standard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, rows = [], []
            for name, cells in zip(pdf[entity], pdf["_c"]):
                y = np.full(len(times), np.nan)
                y[[place[c["t"]] for c in cells]] = [c["x"] for c in cells]
                y = pd.Series(y).bfill().ffill().to_numpy() if fill is None else np.nan_to_num(y, nan=fill)
                y = (y - (weight * y).sum()) * np.sqrt(weight)
                norm = float(np.sqrt((y * y).sum()))
                if norm > 1e-12:
                    names.append(name)
                    rows.append(y / norm)
            yield pd.DataFrame({entity: names, "_y": rows})

    cells = known.groupBy(entity).agg(F.collect_list(F.struct(F.col(time).alias("t"), F.col(x).cast("double").alias("x"))).alias("_c"))
    return cut(cells.mapInPandas(standard, f"{entity} {df.schema[entity].dataType.simpleString()}, _y array<double>")), len(times)


def correlation_profiles(df: DataFrame, entity: str, time: str, x: str, decay_days: float | None = None, fill: float | None = None, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(entity, profile): each entity's row of the correlation matrix, its columns in the order of the entities. Series are
    aligned on time; missing values are ``fill``, or without one filled backwards, then forwards. Null and flat entities are
    left out. With ``decay_days`` a time weighs exp(-age / decay_days), age in days to the newest.

    The series stay distributed. A block of columns is broadcast at a time, ``block_cells`` at most, whatever the number of
    entities; a row of the matrix, as long as there are entities, is put together in the task that writes it."""
    spark, kind = df.sparkSession, df.schema[entity].dataType.simpleString()
    schema = f"{entity} {kind}, profile array<double>"
    series, times = _series(df, entity, time, x, decay_days, fill)
    if series is None:
        return spark.createDataFrame([], schema)
    each = max(1, block_cells // times)
    number = 0
    parts: DataFrame | None = None

    def product(held, k: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i in range(0, len(pdf), 256):
                    part = pdf.iloc[i : i + 256]
                    rows = np.clip(np.stack(part["_y"].to_numpy()) @ held.value.T, -1, 1)
                    yield pd.DataFrame({entity: part[entity].to_numpy(), "_k": k, "_part": list(rows)})

        return run

    block: list[np.ndarray] = []
    for r in [*_each(series.orderBy(entity)), None]:
        if r is not None:
            block.append(np.array(r["_y"]))
        if block and (r is None or len(block) == each):
            held = spark.sparkContext.broadcast(np.stack(block))
            one = series.mapInPandas(product(held, number), f"{entity} {kind}, _k int, _part array<double>")
            parts = one if parts is None else parts.unionByName(one)
            block, number = [], number + 1
    if parts is None:
        return spark.createDataFrame([], schema)
    if number == 1:
        return parts.select(entity, F.col("_part").alias("profile"))
    whole = parts.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct("_k", "_part"))).alias("_p"))
    return whole.select(entity, F.flatten(F.col("_p._part")).alias("profile"))


def _moments(series: DataFrame, times: int, weigh: np.ndarray | None = None) -> np.ndarray:
    """Sum of the outer products of (y, 1) over the series, each over y ``weigh`` y or 0 where that is next to none: with it
    times x times sums of products, sums and the number. A partition sends one such matrix a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                y = np.stack(pdf["_y"].to_numpy())
                z = np.hstack([y, np.ones((len(y), 1))])
                by = np.ones(len(y)) if weigh is None else ((y @ weigh) * y).sum(axis=1)
                by = np.divide(1.0, by, out=np.zeros(len(y)), where=by > 1e-12)
                yield pd.DataFrame({"_a": range(times + 1), "_row": list((z * by[:, None]).T @ z)})

    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    parts = series.mapInPandas(run, "_a int, _row array<double>").groupBy("_a").agg(Summarizer.sum(array_to_vector("_row")).alias("_s"))
    out = np.zeros((times + 1, times + 1))
    for r in parts.collect():  # one row a time
        out[r["_a"]] = r["_s"].toArray()
    return out


def correlation_points(df: DataFrame, entity: str, time: str, x: str, scaled: bool = False) -> DataFrame:
    """(entity, point): points as far from each other as the rows of :func:`correlation_profiles`, or if ``scaled`` as those
    rows with every column scaled to mean 0 and deviation 1 (constant columns to 0); a point has a number a time where a row
    has one an entity. Clusters of the points are clusters of the rows.

    With the standardised series as rows of Y the matrix is Y Y', and two of its rows differ by (a - b) Y'Y (a - b)' squared:
    the points are Y times a root of Y'Y. Scaling divides the products in Y'Y by the variance of their column. So no row of the
    matrix is ever made: the work grows with entities x times squared. The driver holds times x times numbers."""
    spark, kind = df.sparkSession, df.schema[entity].dataType.simpleString()
    schema = f"{entity} {kind}, point array<double>"
    series, times = _series(df, entity, time, x)
    if series is None:
        return spark.createDataFrame([], schema)
    sums = _moments(series, times)
    n = max(sums[-1, -1], 1.0)
    mean, products = sums[-1, :-1] / n, sums[:-1, :-1]
    if scaled:
        products = _moments(series, times, (products - n * np.outer(mean, mean)) / max(n - 1, 1.0))[:-1, :-1]
    values, vectors = np.linalg.eigh((products + products.T) / 2)
    root = vectors * np.sqrt(np.maximum(values, 0)) * np.where(mean @ vectors < 0, -1, 1)
    middle = mean if scaled else np.zeros(times)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({entity: pdf[entity].to_numpy(), "point": list((np.stack(pdf["_y"].to_numpy()) - middle) @ root)})

    return series.mapInPandas(run, schema)


def _each(df: DataFrame) -> Iterator:
    """Rows one by one, a partition at a time."""
    return df.toLocalIterator()


def effective_days(times: list, decay_days: float) -> float:
    """1 / sum of squared weights of exp(-age / decay_days)."""
    age = np.array([float((max(times) - t).days) for t in times])
    w = np.exp(-age / decay_days)
    w = w / w.sum()
    return float(1 / (w * w).sum())


def noise_edge(values: np.ndarray, days: float, rounds: int = 50) -> tuple[float, float]:
    """(variance, upper edge) of the Marchenko-Pastur law that fits the small eigenvalues: the variance is the mean of
    those under the edge, the edge is variance (1 + sqrt(n / days))^2, until nothing changes."""
    q, var = len(values) / days, 1.0
    for _ in range(rounds):
        edge = var * (1 + np.sqrt(q)) ** 2
        under = values[values <= edge]
        new = float(under.mean()) if len(under) else var
        if abs(new - var) < 1e-12:
            break
        var = new
    return var, var * (1 + np.sqrt(q)) ** 2


def denoised(corr: np.ndarray, days: float, detone: bool = False) -> np.ndarray:
    """A correlation matrix with its noise eigenvalues replaced by their mean, and without the market mode if asked; its
    diagonal is 1 again. The matrix is the driver's: a few thousand entities."""
    values, vectors = np.linalg.eigh(corr)
    _, edge = noise_edge(values, days)
    noise = values <= edge
    clean = np.where(noise, values[noise].mean() if noise.any() else values, values)
    if detone:
        clean[-1] = 0.0
    out = (vectors * clean) @ vectors.T
    size = np.sqrt(np.maximum(np.diag(out), 1e-12))
    return np.clip(out / np.outer(size, size), -1, 1)


def loadings(corr: np.ndarray, factors: int) -> np.ndarray:
    """(entities, factors): eigenvectors of the largest eigenvalues times their roots; signs so that each sums to at least 0."""
    values, vectors = np.linalg.eigh(corr)
    top = vectors[:, ::-1][:, :factors] * np.sqrt(np.maximum(values[::-1][:factors], 0))
    return top * np.where(top.sum(axis=0) < 0, -1, 1)


def trees(df: DataFrame, entity: str, column: str, ks: range, seed: int = 7) -> DataFrame:
    """(entity, cluster): hierarchical clusters by division (bisecting k-means), with the k of the best silhouette."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    vec = cut(df.where(F.col(column).isNotNull()).select(entity, column)).select(entity, array_to_vector(column).alias("features"))
    best = _best(vec, ks, lambda k: BisectingKMeans(k=k, seed=seed, predictionCol="cluster"))
    return (vec.withColumn("cluster", F.lit(0)) if best is None else best).select(entity, "cluster")


#: Fits of different k that run side by side; most of a fit's time is that of starting its many short jobs.
FITS = 4


def _best(vec: DataFrame, ks: range, of) -> DataFrame | None:
    """``vec`` with the clusters of the estimator ``of(k)`` that has the best silhouette, the smallest k among equals; None if
    no k under the number of rows makes two clusters. ``vec`` is materialised but not cached: a fit keeps its own vectors."""
    from pyspark import inheritable_thread_target
    from pyspark.ml.evaluation import ClusteringEvaluator

    def fitted(k: int):
        out = of(k).fit(vec).transform(vec)
        if out.select("cluster").distinct().limit(2).count() < 2:
            return None
        return ClusteringEvaluator(predictionCol="cluster").evaluate(out), out

    n, best = vec.count(), None
    with ThreadPoolExecutor(FITS) as pool:
        for got in pool.map(inheritable_thread_target(vec.sparkSession)(fitted), [k for k in ks if k < n]):
            if got and (best is None or got[0] > best[0]):
                best = got
    return best and best[1]


def anchored(df: DataFrame, entity: str, time: str, anchors: list, rows: int = 252, least: int = 200) -> DataFrame:
    """(anchor, and the columns of ``df``): for each anchor an entity's last ``rows`` rows strictly before it, where there
    are ``least``. Rows are numbered by entity, an anchor's place is found by counting, and a row goes to the anchors within
    ``rows`` after it: no range join, and each row is repeated for the anchors that use it only."""
    w = Window.partitionBy(entity).orderBy(time)
    numbered = df.where(F.col(time).isNotNull() & F.col(entity).isNotNull()).withColumn("_r", F.row_number().over(w))
    at = [F.lit(a).cast("date") for a in anchors]
    counts = cut(numbered.groupBy(entity).agg(F.array(*[F.count(F.when(F.col(time) < a, 1)) for a in at]).alias("_upto")))
    uses = F.filter(F.transform(F.arrays_zip(F.array(*at).alias("a"), F.col("_upto").alias("u")), lambda z: F.struct(z["a"].alias("anchor"), z["u"].alias("upto"))), lambda z: (z["upto"] >= least) & (F.col("_r") <= z["upto"]) & (F.col("_r") > z["upto"] - rows))
    out = lookup_join(numbered, counts, [entity], "inner").withColumn("_use", F.explode(uses))
    return out.select(F.col("_use.anchor").alias("anchor"), *df.columns)


def clusters(df: DataFrame, entity: str, columns: list[str], ks: range = range(4, 10), seed: int = 7, scale: bool = True) -> DataFrame:
    """(entity, cluster): k-means, scaled unless ``scale`` is off, with the k of the best silhouette. Columns are numbers or
    arrays of one length; entities with a null column are left out."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    known = df.dropna(subset=columns).withColumns({c: array_to_vector(c) for c, kind in df.dtypes if c in columns and kind.startswith("array")})
    vec = VectorAssembler(inputCols=columns, outputCol="_v" if scale else "features").transform(known)
    if scale:
        vec = StandardScaler(inputCol="_v", outputCol="features", withMean=True).fit(vec).transform(vec)
    scaled = cut(vec.select(entity, "features"))
    best = _best(scaled, ks, lambda k: KMeans(k=k, seed=seed, predictionCol="cluster"))
    return (scaled.withColumn("cluster", F.lit(0)) if best is None else best).select(entity, "cluster")


def risk(df: DataFrame, groups: DataFrame, entity: str, time: str, ret: str, group: str) -> DataFrame:
    """Per group: annualised mean, volatility and Sharpe ratio of its equal-weight return, the mean volatility of its
    members and the diversification benefit."""
    rows = df.join(groups.select(entity, group), entity).where(F.col(ret).isNotNull())
    port = rows.groupBy(group, time).agg(F.avg(ret).alias("p")).groupBy(group).agg((F.avg("p") * 252).alias("ann_return"), (F.stddev_samp("p") * F.sqrt(F.lit(252.0))).alias("ann_vol"))
    own = rows.groupBy(group, entity).agg((F.stddev_samp(ret) * F.sqrt(F.lit(252.0))).alias("v")).groupBy(group).agg(F.avg("v").alias("mean_vol"), F.count(F.lit(1)).alias("members"))
    return port.join(own, group).select(group, "members", "ann_return", "ann_vol", F.try_divide("ann_return", "ann_vol").alias("sharpe"), "mean_vol", F.try_divide(F.col("mean_vol") - F.col("ann_vol"), F.col("mean_vol")).alias("diversification"))


def marginal_risk(df: DataFrame, entity: str, time: str, ret: str) -> DataFrame:
    """(entity, vol, marginal): annual volatility and the covariance with the equal-weight portfolio over its deviation,
    annualised; from one mean a time, never from pairs."""
    rows = df.where(F.col(ret).isNotNull())
    port = cut(rows.groupBy(time).agg(F.avg(ret).alias("_p")))
    sd = port.agg(F.stddev_samp("_p")).first()[0]
    both = lookup_join(rows, port, [time], "inner")
    year = F.sqrt(F.lit(252.0))
    return both.groupBy(entity).agg((F.stddev_samp(ret) * year).alias("vol"), F.try_divide(F.covar_samp(ret, "_p") * year, F.lit(sd)).alias("marginal"))

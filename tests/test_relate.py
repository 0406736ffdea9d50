"""Relations of entities against plain implementations of their definitions."""

import datetime as dt

import numpy as np
import pandas as pd

from tesserae.operators import relate
from tesserae.queries import relational

D0 = dt.date(2025, 1, 1)


def returns(groups, each, n=120, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        common = rng.normal(0, 0.02, n)
        for k in range(each):
            x = common + rng.normal(0, 0.004, n)
            rows += [(f"G{g:02d}_{k}", D0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(x) if not (k == 0 and i in (0, 7, 8))]
    return rows + [("flat", D0 + dt.timedelta(days=i), 0.0) for i in range(n)] + [("gone", D0, None)]


def test_correlation_profiles_match_pandas(spark):
    rows = returns(3, 4)
    got = relate.correlation_profiles(spark.createDataFrame(rows, "e string, t date, x double"), "e", "t", "x").toPandas().set_index("e").sort_index()
    wide = pd.DataFrame(rows, columns=["e", "t", "x"]).pivot(index="t", columns="e", values="x").bfill().ffill()
    want = wide.drop(columns=["flat", "gone"], errors="ignore").corr()
    assert list(got.index) == list(want.index)
    assert np.allclose(np.stack(got.profile), want.to_numpy())


def test_profiles_in_blocks_are_the_same(spark):
    df = spark.createDataFrame(returns(3, 4), "e string, t date, x double")
    one = {r.e: r.profile for r in relate.correlation_profiles(df, "e", "t", "x").collect()}
    many = {r.e: r.profile for r in relate.correlation_profiles(df, "e", "t", "x", block_cells=500).collect()}
    assert one.keys() == many.keys() and all(np.allclose(one[k], many[k]) for k in one)
    assert relate.correlation_profiles(df.limit(0), "e", "t", "x").count() == 0


def test_denoising_keeps_groups_and_loses_noise():
    rng = np.random.default_rng(3)
    n, days = 40, 250
    group = np.arange(n) // 10
    x = rng.normal(0, 1, (days, 4))[:, group] * 0.7 + rng.normal(0, 1, (days, n))
    corr = np.corrcoef(x.T)
    truth = np.where(group[:, None] == group[None, :], 0.49 / 1.49, 0.0)
    np.fill_diagonal(truth, 1.0)
    clean = relate.denoised(corr, days)
    assert np.abs(clean - truth).mean() < 0.75 * np.abs(corr - truth).mean() and np.allclose(np.diag(clean), 1)
    _, edge = relate.noise_edge(np.linalg.eigvalsh(corr), days)
    assert (np.linalg.eigvalsh(corr) > edge).sum() == 4
    l = relate.loadings(corr, 4)
    assert l.shape == (n, 4) and (l.sum(axis=0) >= 0).all()
    flat = relate.denoised(corr, days, detone=True)
    assert np.isfinite(flat).all() and np.allclose(np.diag(flat), 1)
    assert abs(relate.effective_days([D0 + dt.timedelta(days=i) for i in range(2000)], 126) - 252) < 3


def test_trees_find_groups(spark):
    df = spark.createDataFrame(returns(6, 5, seed=4), "e string, t date, x double")
    got = relate.trees(relate.correlation_profiles(df, "e", "t", "x"), "e", "profile", range(4, 9)).toPandas()
    assert len(got) == 30 and (got.groupby(got.e.str[:3]).cluster.nunique() == 1).sum() >= 5


def test_clusters_find_more_than_five_groups(spark, monkeypatch):
    df = spark.createDataFrame(returns(8, 6, seed=2), "ticker string, date date, back double")
    monkeypatch.setattr(relational, "panel", lambda s, d: df)
    got = relational.ticker_clusters(spark, "").toPandas()
    of = got.groupby(got.ticker.str[:3]).cluster.agg(["nunique", "first"])
    assert len(got) == 48 and got.cluster.nunique() >= 6 and (of["nunique"] == 1).all()


def apart(m):
    return np.sqrt(((m[:, None, :] - m[None, :, :]) ** 2).sum(axis=2))


def test_points_are_as_far_apart_as_rows_of_the_matrix(spark):
    df = spark.createDataFrame(returns(10, 4, n=20, seed=5), "e string, t date, x double")
    rows = np.stack(relate.correlation_profiles(df, "e", "t", "x").toPandas().sort_values("e").profile)
    for scaled, want in ((False, rows), (True, (rows - rows.mean(axis=0)) / rows.std(axis=0, ddof=1))):
        got = np.stack(relate.correlation_points(df, "e", "t", "x", scaled).toPandas().sort_values("e").point)
        assert got.shape == (40, 20) and np.allclose(apart(got), apart(want), atol=1e-6)
    assert relate.correlation_points(df.limit(0), "e", "t", "x").count() == 0
    alike = spark.createDataFrame([(e, D0 + dt.timedelta(days=i), float(i * k)) for k, e in enumerate("abc", 1) for i in range(5)], "e string, t date, x double")
    assert np.allclose(apart(np.stack(relate.correlation_points(alike, "e", "t", "x", True).toPandas().point)), 0, atol=1e-6)


def test_clusters_never_make_the_matrix(spark, monkeypatch):
    df = spark.createDataFrame(returns(8, 6, n=30, seed=2), "ticker string, date date, back double")
    monkeypatch.setattr(relational, "panel", lambda s, d: df)
    sizes, best = [], relate._best
    monkeypatch.setattr(relate, "_best", lambda vec, ks, of: (sizes.append((vec.count(), len(vec.first().features))), best(vec, ks, of))[1])
    assert relational.ticker_clusters(spark, "").count() == 48
    assert sizes == [(48, 30)]


def test_tree_never_makes_the_matrix(spark, monkeypatch):
    df = spark.createDataFrame(returns(6, 5, n=25, seed=4), "ticker string, date date, back double")
    monkeypatch.setattr(relational, "panel", lambda s, d: df)
    sizes, best = [], relate._best
    monkeypatch.setattr(relate, "_best", lambda vec, ks, of: (sizes.append((vec.count(), len(vec.first().features))), best(vec, [k for k in ks if k < 9], of))[1])
    got = relational.ticker_tree(spark, "").toPandas()
    assert len(got) == 30 and (got.groupby(got.ticker.str[:3]).cluster.nunique() == 1).sum() >= 5
    assert sizes == [(30, 25)]

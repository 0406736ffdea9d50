"""Size-checked joins, running totals, blocks and the entry module."""

import math
import os
import shutil
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserae.functions import features
from tesserae.functions.dialect import SparkDialect
from tesserae.plans import blocks as B
from tesserae.plans.scale import cut, lookup_join, running_total
from tesserae.queries.panel import bars

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_broadcast_join(spark, how):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 40).cast("int").alias("k"), F.col("id").alias("v"))
    small = cut(spark.range(30).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("w")))
    a = lookup_join(big, small, ["k"], how).collect()
    b = lookup_join(big, small, ["k"], how, max_rows=3).collect()
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(a) == order(b) and "SortMergeJoin" not in str(a)


def test_running_total(spark):
    df = spark.createDataFrame([(float(i % 17) if i % 5 else -float(i), i) for i in range(60)], "x double, n int").groupBy("x").agg(F.sum("n").alias("n"))
    pdf = df.toPandas().sort_values("x")
    got = running_total(df, "x", "n").toPandas().sort_values("x")
    assert (got["_upto"].values == pdf.n.cumsum().values).all() and (got["_all"] == pdf.n.sum()).all()
    got = running_total(df, "x", "n", True).toPandas().sort_values("x", ascending=False)
    assert (got["_upto"].values == pdf.n[::-1].cumsum().values).all()


def one(spark, small):
    b = bars(spark, small).toPandas()
    t = b.ticker.value_counts().index[0]
    b = b[b.ticker == t].sort_values("date").reset_index(drop=True)
    return b, spark.createDataFrame(b)


def check(spark_df, name, want, tol=1e-9):
    got = spark_df.sort_values("date")[name].astype(float).values
    want = np.asarray(want, dtype=float)
    both = ~(np.isnan(got) | np.isnan(want))
    assert (np.isnan(got) == np.isnan(want)).all(), name
    assert np.allclose(got[both], want[both], rtol=1e-7, atol=tol), name


def test_features_against_pandas(spark, small):
    b, df = one(spark, small)
    c, h, low, v = b.close, b.high, b.low, b.volume
    names = ["returns", "momentum_score", "price_ratio", "ratio_rates", "ratio_signals", "ratio_efficiency", "moving_average", "price_structure", "vwap", "volume_flow", "close_volatility", "wilder_rsi", "window_shape", "liquidity"]
    out = B.apply(df, *[B.REGISTRY[n] for n in reversed(names)]).toPandas()
    check(out, "logret_5", np.log(c).diff(5))
    raw = 0.1 * c.pct_change(1) + 0.2 * c.pct_change(5) + 0.3 * c.pct_change(10) + 0.4 * c.pct_change(20)
    check(out, "momentum_score_63d", (raw - raw.rolling(63, min_periods=31).mean()) / raw.rolling(63, min_periods=31).std())
    x = (0.1673 / (h + 1e-6) - low) / (h + 1e-6)
    check(out, "price_differential_ratio_pctchange_3d", x.pct_change(3))
    z = (x - x.rolling(20).mean()) / x.rolling(20).std()
    check(out, "price_differential_ratio_zscore", z, 1e-6)
    roc = x.pct_change(3)
    check(out, "price_differential_ratio_momentumaccelerating", (roc > roc.rolling(10).quantile(0.8)).astype(int))
    direction = np.sign(x - x.rolling(20).mean())
    run = (direction != direction.shift(1)).astype(int).cumsum()
    check(out, "price_differential_ratio_signalpersistence", run.groupby(run).cumcount() + 1)
    check(out, "price_differential_ratio_autocorr_3d", x.shift(3).rolling(20, min_periods=10).corr(x), 1e-6)
    tr = np.maximum(h - low, np.maximum((h - c.shift()).abs(), (low - c.shift()).abs()))
    tr[c.shift().isna()] = np.nan
    check(out, "atr", tr.rolling(14, min_periods=1).mean())
    top = c.expanding().max()
    check(out, "percent_from_high", (c - top) / top * 100)
    tp = (h.shift() + low.shift() + c.shift()) / 3
    check(out, "vwap", (tp * v.shift()).rolling(14).sum() / v.shift().rolling(14).sum())
    check(out, "obv", pd.Series(np.where(c > c.shift(), v, -v)).cumsum())
    check(out, "keltner_centre", c.ewm(span=20).mean())
    w = np.linspace(1, 0, 10)
    check(out, "weighted_close_change_velocity", c.diff().shift(1).fillna(0).rolling(10).apply(lambda a: np.dot(a, w / w.sum()), raw=True))
    d = c.diff()
    up, dn = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean(), (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    check(out, "rsi_14", 100 - 100 / (1 + up / dn))
    check(out, "return_skew_60", c.pct_change().rolling(60, min_periods=30).skew())
    check(out, "return_kurt_60", c.pct_change().rolling(60, min_periods=30).kurt(), 1e-6)
    dv = v * c
    check(out, "dollar_volume_ma_10", dv.shift(1).rolling(10, min_periods=5).mean())


def needed(name, have):
    """The blocks that ``name`` needs before it, found by what they produce, and itself."""
    chain = []
    for column in B.REGISTRY[name].requires:
        if column not in have:
            maker = next(n for n, b in B.REGISTRY.items() if column in b.produces and n != name)
            chain += [x for x in needed(maker, have) if x not in chain]
    return [*chain, name]


@pytest.fixture(scope="module")
def changed(spark, small):
    """Which columns of a block change in the first rows of a series when the rows from ``at`` on are cut off; those rows
    are wild, so that whatever looks at them shows."""
    b, _ = one(spark, small)
    b["vix"] = b["index_close"] = 15 + 5 * np.sin(np.arange(len(b)) / 7) + np.arange(len(b)) % 3

    def made(name, tolerance, at=110, scale=1.0):
        p = b.copy()
        prices = ["open", "high", "low", "close"]
        p[prices] *= scale
        p.loc[at:, [*prices, "vix", "index_close"]] *= 0.05
        chain = [B.REGISTRY[n] for n in needed(name, set(p.columns))]
        run = lambda df: B.apply(spark.createDataFrame(df), *chain, dialect=SparkDialect(60, 30)).where(F.col("date") <= F.lit(p.date[at - 5])).select("date", *B.REGISTRY[name].produces).toPandas().sort_values("date")
        whole, part = run(p), run(p.iloc[:at])
        return [c for c in B.REGISTRY[name].produces if not np.allclose(whole[c].astype(float), part[c].astype(float), rtol=tolerance, atol=tolerance / 10, equal_nan=True)]

    return made


@pytest.mark.parametrize("name", list(B.REGISTRY))
def test_features_look_ahead_only_where_they_say_so(changed, name):
    upstream = [B.REGISTRY[n] for n in needed(name, {*features.BAR, "ticker", "date", "vix", "index_close"})]
    if B.REGISTRY[name].looks_ahead:  # however little, and be it only at the beginning or for prices of pennies
        assert any(changed(name, 0.0, at, scale) for at, scale in ((110, 1.0), (40, 1.0), (110, 0.002)))
    elif not any(b.looks_ahead for b in upstream):
        assert not changed(name, 1e-6)


def test_blocks_need_one_exchange(spark, small):
    df = B.apply(bars(spark, small), *[B.REGISTRY[n] for n in ("returns", "moving_average", "vwap", "price_momentum", "market_position")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ticker") <= 2  # one for the latest landing, one for all features


def test_blocks_say_what_is_missing():
    with pytest.raises(ValueError, match="price_differential_ratio"):
        B.ordered([B.REGISTRY["ratio_efficiency"]], {"close"})


def test_dialect_handles_null_and_flat_windows(spark):
    df = spark.createDataFrame([("A", i, 5.0 if i < 30 else None) for i in range(40)], "ticker string, date int, x double")
    q = SparkDialect()
    out = df.selectExpr(f"{q.corr('x', 'x', 10)} AS c", f"{q.std('x', 10)} AS s", f"{q.skew('x', 10)} AS k", f"{q.change('x')} AS r").collect()
    assert all(r.c is None and r.k is None for r in out) and {r.s for r in out} == {None, 0.0}


def test_entry_works_without_the_llm_subpackage(tmp_path):
    for name in ("tesserae", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q), set(o) - set(q); print(len(q), any(n.startswith('p2_') for n in q))"
    full = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    shutil.rmtree(tmp_path / "tesserae" / "llm", ignore_errors=True)
    bare = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert bare.returncode == 0 and bare.stdout.split()[1] == "False", bare.stderr
    assert full.returncode == 0, full.stderr


def test_nothing_else_imports_llm():
    for folder, _, files in os.walk(os.path.join(ROOT, "tesserae")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "tesserae.llm" not in open(os.path.join(folder, f)).read(), f
    assert math.isfinite(len(features.BAR))

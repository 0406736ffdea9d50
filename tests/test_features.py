"""Feature blocks against pandas, written from the definitions."""

import numpy as np
import pandas as pd
import pytest

from tesserae.functions import features  # noqa: F401  (fills the registry)
from tesserae.functions.dialect import SparkDialect
from tesserae.plans import blocks as B
from tesserae.queries.panel import bars

SHORT = SparkDialect(60, 30)


@pytest.fixture(scope="module")
def series(spark, small):
    b = bars(spark, small).toPandas()
    b = b[b.ticker == b.ticker.value_counts().index[0]].sort_values("date").reset_index(drop=True)
    b["vix"] = 18 + 4 * np.sin(np.arange(len(b)) / 9) + np.random.default_rng(2).normal(0, 1, len(b))
    b["index_close"] = 100 * np.exp(np.cumsum(np.random.default_rng(3).normal(0, 0.01, len(b))))
    return b


@pytest.fixture(scope="module")
def made(spark, series):
    df = spark.createDataFrame(series)

    def run(*names):
        return B.apply(df, *[B.REGISTRY[n] for n in names], dialect=SHORT).toPandas().sort_values("date").reset_index(drop=True)

    return run


def same(got, want, tol=1e-7):
    got, want = got.astype(float).to_numpy(), np.asarray(want, dtype=float)
    assert (np.isnan(got) == np.isnan(want)).all(), got.name if hasattr(got, "name") else ""
    assert np.allclose(got, want, rtol=tol, atol=tol, equal_nan=True)


def test_gaps(made, series):
    out = made("gap_zscores")
    o, c, v = series.open, series.close, series.volume
    gap, r = o / c.shift() - 1, c.pct_change()
    z = lambda n: (gap - gap.rolling(n).mean()) / gap.rolling(n).std()
    base, zs, zl = z(20), z(10), z(50)
    vz = (v - v.rolling(20).mean()) / v.rolling(20).std()
    same(out.gap_zscore_base, base.fillna(0))
    same(out.gap_zscore_volume_enhanced, (base * np.where(base.abs() > 1, (vz / 2).clip(0.1, 2), 0.5)).where(base.notna() & vz.notna(), 0))
    vr = r.rolling(20).std() / r.rolling(50).std()
    same(out.gap_zscore_regime_aware, (base * np.select([vr > 1.2, vr < 0.8], [0.7, 1.3], 1.0)).where(base.notna() & vr.notna(), 0))
    day = pd.to_datetime(series.date).dt.dayofweek
    same(out.gap_zscore_time_conditional, (base * day.map({0: 1.2, 4: 0.8}).fillna(1.0)).fillna(0))
    i = pd.Series(np.arange(len(c), dtype=float))
    trend = c.rolling(20).corr(i).abs().shift(1)
    momentum = c.pct_change(5).abs()
    same(out.gap_zscore_reversion_momentum, (base * np.where((trend > 0.3) & (momentum > 0.02), np.where(base.abs() < 1.5, 1.0, 0.5), 0.8)).where(base.notna() & trend.notna() & momentum.notna(), 0))
    pair = 0.7 * zs + 0.3 * zl
    same(out.gap_zscore_multi_timeframe, (pair * np.where(zs * zl > 0, 1 + (zs * zl).abs().mul(0.1).clip(upper=0.5), 0.8)).where(zs.notna() & zl.notna(), 0))
    eff = base.shift(1).rolling(100, min_periods=11).corr(r).shift(1)
    eff = ((eff + 1) / 2).where(i >= 100).fillna(0.5)
    same(out.gap_zscore_adaptive_threshold, (base * (0.5 + eff)).fillna(0), 1e-6)


def test_stress(made, series):
    out = made("stress")
    drop = (series.low - series.open) / series.open * 100
    vr = series.volume / series.volume.rolling(20, min_periods=1).mean()
    same(out.stress_v6, (drop <= -3).astype(float).ewm(alpha=2 / 11, min_periods=1).mean())
    total = 0
    for level, w in ((-2, 0.2), (-4, 0.4), (-6, 0.4)):
        x = (drop <= level) * vr
        total = total + w * (x.rolling(15, min_periods=1).mean() + x.ewm(alpha=2 / 16, min_periods=1).mean())
    same(out.stress_vol_v7, total.clip(0, 2))


def test_index_beta(made, series):
    out = made("index_beta")
    y, x = np.log(series.close).diff(), np.log(series.index_close).diff()
    beta = y.rolling(60, min_periods=30).cov(x) / x.rolling(60, min_periods=30).var()
    same(out.beta_index, beta.clip(-5, 5))
    same(out.corr_index, y.rolling(60, min_periods=30).corr(x).clip(-1, 1))
    same(out.alpha_index, y.rolling(60, min_periods=30).mean() - beta * x.rolling(60, min_periods=30).mean())


def test_index_regime_and_composite(made, series):
    out = made("vix_regime", "liquidity", "atr_regime", "coefficient_of_variation", "price_momentum", "volume_momentum", "composite_scores")
    v = series.vix
    rank = v.shift(1).rolling(60, min_periods=50).apply(lambda x: (x.dropna() <= x.iloc[-1]).mean() * 100)  # of the known ones
    same(out.vix_percentile_rank, rank)
    same(out.vix_zscore, (v - v.shift(1).rolling(20, min_periods=10).mean()) / (v.shift(1).rolling(20, min_periods=10).std() + 1e-8))
    liquidity = (out.dollar_volume_percentile / 100 + out.volume_trend_5d_20d.clip(0, 2) / 2 + 1 - out.liquidity_stress_3d.clip(0, 2) / 2) / 3
    same(out.liquidity_score, liquidity)
    volatility = (rank / 100 + out.atr_percentile_rank.clip(20, 80) / 100 + 1 - out.cv_20d_percentile.clip(0, 90) / 100) / 3
    momentum = (out.momentum_strength_continuous.clip(-1, 1) / 2 + 0.5 + out.volume_momentum_ratio.clip(0.5, 1.5) / 2 + out.trend_consistency_10d.clip(0, 1)) / 3
    same(out.trading_signal_composite, 0.3 * liquidity + 0.4 * volatility + 0.3 * momentum)


def test_significant(made, series):
    out = made("significant")
    c = series.close
    hc = (series.high - c) / (c + 1e-10)
    d = c.diff()
    rs = d.where(d > 0, 0.0).rolling(14, min_periods=14).mean() / (-d.where(d < 0, 0.0)).rolling(14, min_periods=14).mean()
    composite = hc * (100 - (100 - 100 / (1 + rs))) / 50
    same(out.rsi_hc_composite, composite)
    vol = c.pct_change().rolling(50, min_periods=10).std()
    lyapunov = ((vol - vol.shift(1).rolling(50, min_periods=10).mean()) / vol.shift(1).rolling(50, min_periods=10).std().replace(0, 1)).clip(-3, 3) / 3
    same(out.lyapunov_scaled, lyapunov)
    before = lyapunov.shift(1)
    regime = hc * np.select([before < -0.3, before > 0.3], [1.5, 0.5], 1.0)
    norm = lambda x: ((x - x.shift(1).rolling(50).mean()) / x.shift(1).rolling(50).std()).clip(-3, 3)
    same(out.hc_predict_regime_norm, norm(regime))
    same(out.significant_ensemble, pd.concat([norm(composite), norm(hc), norm(regime)], axis=1).mean(axis=1))


def test_trend_line_and_reversion(made, series):
    out = made("trend_line", "reversion_z")
    c = series.close
    slope = c.rolling(20).apply(lambda y: np.polyfit(np.arange(20), y, 1)[0], raw=True)
    same(out.line_slope_20, slope, 1e-6)
    same(out.line_start_20, c.rolling(20).apply(lambda y: np.polyfit(np.arange(20), y, 1)[1], raw=True), 1e-6)
    s = c.rolling(3, min_periods=1).mean()
    same(out.mean_reversion_z_score_90_std_1, (s - s.rolling(90).mean()) / s.rolling(90).std())


def test_log_scaled_ranks(made, series):
    out = made("price_ratio", "ratio_log_scaled")
    h, low = series.high, series.low
    x = (0.1673 / (h + 1e-6) - low) / (h + 1e-6)
    y = np.log(x.abs() + max(1e-6, 1e-6 * x.abs().median())) * np.sign(x)
    for n in (10, 20, 50):
        same(out[f"price_differential_ratio_logscale_rank_{n}d"], y.rolling(n, min_periods=n // 2).rank(pct=True))


def test_exponential_means_keep_their_value_over_long_histories(spark):
    """Only rows that weigh at least a billionth are folded; the result is the whole history's."""
    rng = np.random.default_rng(5)
    c = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, 1500)))
    df = spark.createDataFrame(pd.DataFrame({"ticker": "A", "date": np.arange(1500), "close": c}))
    out = B.apply(df, B.REGISTRY["wilder_rsi"]).toPandas().sort_values("date")
    d = pd.Series(c).diff()
    for n in (7, 28):
        up, dn = d.clip(lower=0).ewm(alpha=1 / n, adjust=False, min_periods=n).mean(), (-d.clip(upper=0)).ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
        same(out[f"rsi_{n}"], 100 - 100 / (1 + up / dn), 1e-6)

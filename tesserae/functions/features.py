"""Rolling features of daily bars (ticker, date, open, high, low, close, volume)."""

from __future__ import annotations

from tesserae.functions.dialect import Dialect
from tesserae.plans.blocks import Block, Stages, block

BAR = ("open", "high", "low", "close", "volume")
E = "1e-10"


def _pdr(eps: str) -> str:
    return f"((0.1673 / (high + {eps}) - low) / (high + {eps}))"


@block("close")
def returns(q: Dialect) -> Stages:
    return [{f"logret_{k}": f"({q.log('close')} - {q.lag(q.log('close'), k)})" for k in (1, 5, 10, 20)}]


@block("close")
def momentum_score(q: Dialect) -> Stages:
    raw = " + ".join(f"{w} * {q.change('close', k)}" for w, k in ((0.1, 1), (0.2, 5), (0.3, 10), (0.4, 20)))
    z = f"((_raw - {q.mean('_raw', 63, 31)}) / nullif({q.std('_raw', 63, 31)}, 0))"
    return [{"_raw": f"({raw})"}, {"momentum_score_63d": z}]


@block("high", "low")
def price_ratio(q: Dialect) -> Stages:
    return [{"price_differential_ratio": _pdr("1e-6")}]


@block("price_differential_ratio", looks_ahead=True)
def ratio_log_scaled(q: Dialect) -> Stages:
    """The adaptive epsilon is the series' whole median, which looks ahead; the reference's own choice."""
    x = "price_differential_ratio"
    first = {"_eps": f"greatest(1e-6, 1e-6 * ({q.quantile_agg(f'abs({x})', 0.5)} {q.whole}))"}
    out = {}
    for n in (10, 20, 50):
        mp = n // 2
        out[f"{x}_logscale_zscore_{n}d"] = f"((_log - {q.mean('_log', n, mp)}) / coalesce(nullif({q.std('_log', n, mp)}, 0), 1.0))"
        lo, hi = q.low("_log", n, mp), q.high("_log", n, mp)
        out[f"{x}_logscale_minmax_{n}d"] = f"((_log - {lo}) / coalesce(nullif({hi} - {lo}, 0), 1.0))"
    ranks = {f"{x}_logscale_rank_{n}d": f"(CASE WHEN _log IS NOT NULL AND count(_log) {q.frame(n)} >= {n // 2} THEN {q.rank_in(f'_l{n}', '_log')} END)" for n in (10, 20, 50)}
    return [first, {"_log": f"(ln(abs({x}) + _eps) * {q.sign(x)})"}, out | {f"_l{n}": q.known_list("_log", q.frame(n)) for n in (10, 20, 50)}, ranks]


@block("price_differential_ratio", looks_ahead=True)
def ratio_rates(q: Dialect) -> Stages:
    x = "price_differential_ratio"
    first = {"_eps": f"greatest(1e-8, 1e-8 * ({q.quantile_agg(f'abs({x})', 0.5)} {q.whole}))"}
    out = {}
    for k in (1, 3, 5, 10):
        out[f"{x}_pctchange_{k}d"] = q.change(x, k)
        out[f"{x}_diff_{k}d"] = q.diff(x, k)
        out[f"{x}_logdiff_{k}d"] = q.diff("_log", k)
    last = {f"{x}_acceleration_{k}d": q.change(f"{x}_pctchange_{k}d") for k in (3, 5)}
    return [first, {"_log": f"(ln(abs({x}) + _eps) * {q.sign(x)})"}, out, last]


@block("price_differential_ratio", "price_differential_ratio_pctchange_3d")
def ratio_signals(q: Dialect) -> Stages:
    x = "price_differential_ratio"
    roc = f"{x}_pctchange_3d"
    a = {"_m20": q.mean(x, 20), "_s20": q.std(x, 20), "_short": q.mean(x, 5), "_q8": q.quantile(roc, 0.8, 10), "_q2": q.quantile(roc, 0.2, 10)}
    b = {
        f"{x}_zscore": f"(({x} - _m20) / coalesce(nullif(_s20, 0), 1e-6))",
        "_v75": q.quantile("_s20", 0.75, 60), "_v25": q.quantile("_s20", 0.25, 60), "_ps": q.lag("_short"), "_pl": q.lag("_m20"), "_dir": q.sign(f"({x} - _m20)"),
    }
    c = {
        f"{x}_extremehigh": q.flag(f"{x}_zscore > 2"),
        f"{x}_extremelow": q.flag(f"{x}_zscore < -2"),
        f"{x}_momentumaccelerating": q.flag(f"{roc} > _q8"),
        f"{x}_momentumdecelerating": q.flag(f"{roc} < _q2"),
        f"{x}_bullishcross": q.flag("_short > _m20 AND _ps <= _pl"),
        f"{x}_bearishcross": q.flag("_short < _m20 AND _ps >= _pl"),
        f"{x}_highvolatilityregime": q.flag("_s20 > _v75"),
        f"{x}_lowvolatilityregime": q.flag("_s20 < _v25"),
        "_turn": f"(CASE WHEN _dir = {q.lag('_dir')} THEN 0 ELSE 1 END)",  # unknown directions begin a run each
    }
    d = {"_run": f"sum(_turn) {q.so_far}"}
    e = {f"{x}_signalpersistence": f"row_number() OVER (PARTITION BY {q.entity}, _run ORDER BY {q.time})"}
    ends = ["extremehigh", "extremelow", "momentumaccelerating", "momentumdecelerating", "bullishcross", "bearishcross"]
    e[f"{x}_signalstrength"] = "(" + " + ".join(f"{x}_{k}" for k in ends) + ")"
    e[f"{x}_weightedsignalstrength"] = "(" + " + ".join(f"{w} * {x}_{k}" for w, k in zip((3, 3, 2, 2, 2, 2), ends)) + ")"
    return [a, b, c, d, e]


@block("price_differential_ratio")
def ratio_efficiency(q: Dialect) -> Stages:
    x = "price_differential_ratio"
    a = {"_r": q.change(x)} | {f"_l{k}": q.lag(x, k) for k in (1, 3, 5)}
    b = {f"{x}_informationratio": f"({q.mean('_r', 20)} / coalesce(nullif({q.std('_r', 20)}, 0), 1e-6))"}
    b |= {f"{x}_autocorr_{k}d": q.corr(f"_l{k}", x, 20, 10) for k in (1, 3, 5)}
    c = {f"{x}_infodecay_{k}d": f"(1 - coalesce({q.clip(f'{x}_autocorr_{k}d', 0, 1)}, 0))" for k in (1, 3, 5)}
    return [a, b, c]


@block("high", "low")
def genetic_ratio(q: Dialect) -> Stages:
    """Decay, autocorrelation, log z-score and weighted signal strength of the ratio (epsilon 1e-8)."""
    a = {"_g": _pdr("1e-8")}
    b = {"_l3": q.lag("_g", 3), "_lg": f"(ln(abs(_g) + 1e-8) * {q.sign('_g')})", "_roc": q.change("_g", 3), "_m": q.mean("_g", 20, 10), "_s": q.std("_g", 20, 10), "_short": q.mean("_g", 5, 3)}
    c = {
        "g_pda_autocorr_3d": q.corr("_l3", "_g", 20, 10),
        "g_pda_log_zscore_20d": f"((_lg - {q.mean('_lg', 20, 10)}) / ({q.std('_lg', 20, 10)} + 1e-8))",
        "_z": "((_g - _m) / (_s + 1e-8))", "_q8": q.quantile("_roc", 0.8, 10, 5), "_q2": q.quantile("_roc", 0.2, 10, 5),
        "_v75": q.quantile("_s", 0.75, 60, 30), "_v25": q.quantile("_s", 0.25, 60, 30), "_ps": q.lag("_short"), "_pl": q.lag("_m"),
    }
    d = {
        "g_pda_info_decay_3d": "(1 - g_pda_autocorr_3d)",
        "g_pda_weighted_signal_strength": "(" + " + ".join([
            f"3 * {q.flag('_z > 2')}", f"3 * {q.flag('_z < -2')}", f"2 * {q.flag('_roc > _q8')}", f"2 * {q.flag('_roc < _q2')}",
            f"2 * {q.flag('_short > _m AND _ps <= _pl')}", f"2 * {q.flag('_short < _m AND _ps >= _pl')}", q.flag("_s > _v75"), q.flag("_s < _v25"),
        ]) + ")",
    }
    return [a, b, c, d]


@block("high", "low", "close")
def moving_average(q: Dialect) -> Stages:
    a = {"_c1": q.lag("close"), "ma14": q.mean("close", 14, 1), "std_14": q.std("close", 14, 1)}
    b = {"ma14_pct": f"((close - ma14) / (ma14 + {E}) * 100)", "_tr": "(CASE WHEN _c1 IS NOT NULL THEN greatest(high - low, abs(high - _c1), abs(low - _c1)) END)"}
    c = {"ma14_pct_change": q.change("ma14_pct"), "ma14_pct_count": f"sum({q.flag('ma14_pct > 1e-12')}) {q.frame(14)}", "atr": q.mean("_tr", 14, 1)}
    return [a, b, c, {"atr_pct": f"(atr / (close + {E}) * 100)"}]


@block("high", "low", "close")
def price_structure(q: Dialect) -> Stages:
    a = {"_top": f"max(close) {q.so_far}", "high_close_ratio": f"((high - close) / (close + {E}))", "percent_range": "((high - low) / close * 100)"}
    b = {"percent_from_high": "((close - _top) / _top * 100)", "new_high": q.flag("close = _top"), "_mark": f"(CASE WHEN close = _top THEN row_number() {q.ordered} END)", "_row": f"row_number() {q.ordered}"}
    m, s = q.mean("high_close_ratio", 50, shift=1), q.std("high_close_ratio", 50, shift=1)
    c = {"days_since_high": f"(_row - {q.ffill('_mark')})", "high_close_ratio_norm": q.clip(f"((high_close_ratio - {m}) / nullif({s}, 0))", -3, 3)}
    return [a, b, c]


@block("high", "low", "close", "volume")
def vwap(q: Dialect) -> Stages:
    a = {"_tpv": "((high + low + close) / 3 * volume)", "_top": f"max(close) {q.so_far}"}
    b = {"vwap": f"({q.sum('_tpv', 14, shift=1)} / nullif({q.sum('volume', 14, shift=1)}, 0))"}
    c = {"vwap_std14": q.std("vwap", 14), "vwap_std200": q.std("vwap", 20), "vwap_pct": "((close - vwap) / vwap * 100)", "vwap_pct_from_high": "((vwap - _top) / _top * 100)"}
    return [a, b, c]


@block("close", "volume")
def volume_flow(q: Dialect) -> Stages:
    a = {"_v": f"(CASE WHEN close > {q.lag('close')} THEN volume ELSE -volume END)", "_d": q.diff("close"), "volume_lag_1": q.lag("volume"),
         "volume_rolling_28": q.mean("volume", 28, shift=1), "volume_rolling_90": q.mean("volume", 90, shift=1), "volume_std": q.std("volume", 28, shift=1)}
    b = {"obv": f"sum(_v) {q.so_far}", "volume_pct": "((volume - volume_rolling_28) / nullif(volume_rolling_28, 0) * 100)", "volume_pct_rolling_90": "((volume - volume_rolling_90) / nullif(volume_rolling_90, 0) * 100)",
         "_p": f"coalesce({q.lag('_d')}, 0)"}
    n = 10
    weights = [(1 - k / (n - 1)) for k in range(n)]  # the oldest weighs most
    total = sum(weights)
    dot = " + ".join(f"{w / total!r} * {q.lag('_p', n - 1 - k) if n - 1 - k else '_p'}" for k, w in enumerate(weights))
    return [a, b, {"weighted_close_change_velocity": f"({dot})"}]


@block("close")
def close_volatility(q: Dialect) -> Stages:
    a = {"percent_change_close": q.change("close"), "pct_change_std": q.std("close", 20), "pct_change_std_rolling": q.mean("close", 20), "_var": q.var("close", q.season), "_l": q.ewm("close", 2 / 21)}
    b = {f"percent_change_close_lag_{k}": q.lag("percent_change_close", k) for k in (1, 5, 10)}
    up = q.flag("percent_change_close > 0")
    b |= {"direction_flipper_count5": q.rolled(f"sum({up})", up, 5), "direction_flipper_count_10": q.rolled(f"sum({up})", up, 10), "complexity_invariant_distance": f"abs({q.diff('_var')})", "keltner_centre": q.fold_ewm("_l", 2 / 21, True)}
    return [a, b, {"cid_mean": q.mean("complexity_invariant_distance", q.season), "cid_sd": q.std("complexity_invariant_distance", q.season)}]


@block("close", "atr", "keltner_centre")
def keltner(q: Dialect) -> Stages:
    return [{"kc_upper_pct": "((keltner_centre + 1.5 * atr - close) / close * 100)", "kc_lower_pct": "((close - keltner_centre + 1.5 * atr) / close * 100)"}]


@block("close")
def wilder_rsi(q: Dialect) -> Stages:
    """RSI with exponential averages (alpha 1/n, not adjusted), known from n changes on."""
    a = {"_d": q.diff("close")}
    b = {"_up": "(CASE WHEN _d > 0 THEN _d WHEN _d IS NOT NULL THEN 0.0 END)", "_dn": "(CASE WHEN _d < 0 THEN -_d WHEN _d IS NOT NULL THEN 0.0 END)"}
    c = {"_lu": q.ewm("_up", 1 / 28), "_ld": q.ewm("_dn", 1 / 28), "_n": f"count(_d) {q.so_far}"}  # the longest serves all
    d = {f"_{k}{n}": q.fold_ewm(f"_l{k}", 1 / n, False) for n in (7, 14, 28) for k in ("u", "d")}
    e = {f"rsi_{n}": f"(CASE WHEN _n >= {n} AND _d{n} > 1e-12 THEN 100 - 100 / (1 + _u{n} / _d{n}) END)" for n in (7, 14, 28)}
    return [a, b, c, d, e]


@block("close")
def simple_rsi(q: Dialect) -> Stages:
    """RSI with simple averages over 14 changes."""
    a = {"_d": q.diff("close")}
    b = {"_u": q.mean("(CASE WHEN _d > 0 THEN _d WHEN _d IS NOT NULL THEN 0.0 END)", 14), "_v": q.mean("(CASE WHEN _d < 0 THEN -_d WHEN _d IS NOT NULL THEN 0.0 END)", 14)}
    return [a, b, {"rsi_sma_14": "(CASE WHEN _v > 1e-12 THEN 100 - 100 / (1 + _u / _v) WHEN _u > 1e-12 THEN 100.0 WHEN _u IS NOT NULL THEN 50.0 END)"}]


@block("close", "volume")
def liquidity(q: Dialect) -> Stages:
    a = {"_dv": "(volume * close)", "_v10": q.mean("volume", 10, 5, shift=1)}
    b = {
        "dollar_volume_ma_10": q.mean("_dv", 10, 5, shift=1), "dollar_volume_ma_252": q.mean("_dv", 252, 50, shift=1), "dollar_volume_std_252": q.std("_dv", 252, 50, shift=1),
        "volume_trend_5d_20d": f"({q.mean('_dv', 5, 3, shift=1)} / ({q.mean('_dv', 20, 10, shift=1)} + 1e-8))", "liquidity_stress_3d": f"({q.mean('_dv', 3, 2, shift=1)} / ({q.quantile('_dv', 0.5, 252, 50, shift=1)} + 1e-8))",
        "volume_spike_ratio": "(volume / (_v10 + 1e-8))", "_list": q.known_list("_dv", q.frame(252, 1)), "_known": f"count(_dv) {q.frame(252, 1)}",
    }
    bursts = " + ".join(q.flag(f"{q.lag('volume', k) if k else 'volume'} > 3 * _v10") for k in range(5))
    c = {
        "dollar_volume_ratio_10d": "(_dv / (dollar_volume_ma_10 + 1e-8))", "dollar_volume_ratio_252d": "(_dv / (dollar_volume_ma_252 + 1e-8))",
        "dollar_volume_zscore": "((_dv - dollar_volume_ma_252) / (dollar_volume_std_252 + 1e-8))", "dollar_volume_percentile": f"(CASE WHEN _known >= 50 THEN 100 * {q.share_upto('_list', '_dv')} END)",
        "sustained_volume_burst_count": f"(CASE WHEN count(volume) {q.frame(5)} >= 3 THEN {bursts} END)",
    }
    return [a, b, c]


@block("open", "high", "low", "close")
def atr_regime(q: Dialect) -> Stages:
    a = {"_c1": q.lag("close")}
    b = {"_tr": "(CASE WHEN _c1 IS NOT NULL THEN greatest(high - low, abs(high - _c1), abs(low - _c1)) END)", "gap_percentage": "((open - _c1) / (_c1 + 1e-8))"}
    c = {"atr_14": q.mean("_tr", 14, 10), "gap_absolute": "abs(gap_percentage)"}
    d = {"atr_percentage": "(atr_14 / close)"}
    e = {"gap_in_atr_terms": f"(gap_percentage / ({q.lag('atr_percentage')} + 1e-8))", "_list": q.known_list("atr_percentage", q.frame(252, 1)), "_known": f"count(atr_percentage) {q.frame(252, 1)}"}
    f = {"atr_percentile_rank": f"(CASE WHEN _known >= 50 THEN 100 * {q.share_upto('_list', 'atr_percentage')} END)"}
    return [a, b, c, d, e, f, {"atr_regime_low": q.flag("atr_percentile_rank <= 25"), "atr_regime_high": q.flag("atr_percentile_rank >= 75")}]


@block("close")
def price_momentum(q: Dialect) -> Stages:
    a = {f"return_{k}d": q.change("close", k) for k in (3, 5, 10, 20)} | {"_up": f"(CASE WHEN close > {q.lag('close')} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)", "_r": q.change("close")}
    b = {f"return_{k}d_abs": f"abs(return_{k}d)" for k in (3, 5, 10, 20)}
    b |= {
        "momentum_strength_5d": q.flag("return_5d > 0.005"), "momentum_strength_continuous": "tanh(100 * return_5d)",
        "rapid_price_change_zscore": f"((return_5d - {q.mean('return_5d', 50, 20, shift=1)}) / ({q.std('return_5d', 50, 20, shift=1)} + 1e-8))", "price_acceleration": q.diff("return_5d", 5),
    }
    b |= {f"trend_consistency_{n}d": f"(CASE WHEN count(_r) {q.frame(n)} >= {n // 2} THEN avg(_up) {q.frame(n)} END)" for n in (5, 10, 20)}
    return [a, b]


@block("close", "volume")
def volume_momentum(q: Dialect) -> Stages:
    a = {"_dv": "(volume * close)", "_avg": q.mean("volume", 20, 10, shift=1), "_vr": q.change("volume")}
    b = {"volume_momentum_ratio": f"({q.mean('_dv', 5, 3, shift=1)} / ({q.mean('_dv', 20, 10, shift=1)} + 1e-8))", "_above": q.flag("volume > _avg"), "volume_volatility": q.std("_vr", 20, 10)}
    r = "volume_momentum_ratio"
    c = {"volume_trend_strength": f"(CASE WHEN {r} > 1 THEN ln({r}) WHEN {r} IS NOT NULL THEN -ln(1 / ({r} + 1e-8)) END)", "volume_persistence": q.sum("_above", 10, 5)}
    return [a, b, c]


@block("high", "low", "close")
def market_position(q: Dialect) -> Stages:
    a = {}
    for n in (20, 50, 100):
        lo, hi = q.low("low", n, n // 2), q.high("high", n, n // 2)
        a[f"price_position_{n}d"] = f"((close - {lo}) / ({hi} - {lo} + 1e-8))"
    for n in (10, 20, 50):
        a[f"_sma{n}"] = q.mean("close", n, n // 2)
    b = {f"trend_direction_{n}d": f"(CASE WHEN close - _sma{n} > 1e-11 THEN 1 ELSE -1 END)" for n in (10, 20, 50)}
    b |= {f"distance_from_sma_{n}d": f"((close - _sma{n}) / (_sma{n} + 1e-8))" for n in (10, 20, 50)}
    return [a, b]


@block("open", "high", "low", "close", looks_ahead=True)
def price_action(q: Dialect) -> Stages:
    """The quality score looks at the whole series, as the reference does."""
    least = f"(min(close) {q.whole})"
    a = {"price_quality_score": f"ln(close / (CASE WHEN {least} > 1.10 THEN 1.10 ELSE {least} END))", "intraday_range_pct": "((high - low) / close)", "open_close_ratio": "((close - open) / (open + 1e-8))",
         "high_close_gap": "((high - close) / (close + 1e-8))", "low_close_gap": "((close - low) / (close + 1e-8))"}
    return [a, {"doji_pattern": q.flag("abs(open_close_ratio) < 0.001"), "hammer_pattern": q.flag("low_close_gap > high_close_gap * 2 AND open_close_ratio > 0")}]


@block("close")
def coefficient_of_variation(q: Dialect) -> Stages:
    a = {f"cv_{n}d": f"({q.std('close', n, n // 2)} / ({q.mean('close', n, n // 2)} + 1e-8))" for n in (10, 20, 50)}
    b = {f"_l{n}": q.known_list(f"cv_{n}d", q.frame(252, 1)) for n in (10, 20, 50)} | {f"_k{n}": f"count(cv_{n}d) {q.frame(252, 1)}" for n in (10, 20, 50)}
    c = {f"cv_{n}d_percentile": f"(CASE WHEN _k{n} >= 50 AND cv_{n}d IS NOT NULL THEN 100 * {q.share_upto(f'_l{n}', f'(cv_{n}d + 1e-12)')} END)" for n in (10, 20, 50)}
    d = {f"cv_{n}d_regime_{s}": q.flag(f"cv_{n}d_percentile {op}") for n in (10, 20, 50) for s, op in (("high", ">= 80"), ("low", "<= 20"))}
    return [a, b, c, d]


@block("open", "low", "volume")
def stress(q: Dialect) -> Stages:
    """Shares of deep intraday falls: an exponential mean at 3 percent (v6), over 15 bars at 2, 4 and 6 percent mixed
    .3/.5/.2 (v7), and the latter weighted by volume over its 20-bar mean, plain and exponential (vol_v7)."""
    a = {"_drop": "((low - open) / open)", "_vr": f"(volume / nullif({q.mean('volume', 20, 1)}, 0))"}
    hit = lambda k: f"(CASE WHEN _drop <= -0.0{k} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
    b = {f"_h{k}": hit(k) for k in (2, 3, 4, 6)} | {f"_v{k}": f"({hit(k)} * _vr)" for k in (2, 4, 6)}
    c = {"_l3": q.ewm("_h3", 2 / 11)} | {f"_w{k}": q.ewm(f"_v{k}", 2 / 16) for k in (2, 4, 6)} | {f"_f{k}": q.mean(f"_h{k}", 15, 1) for k in (2, 4, 6)} | {f"_g{k}": q.mean(f"_v{k}", 15, 1) for k in (2, 4, 6)}
    d = {"stress_v6": q.fold_ewm("_l3", 2 / 11, True), "stress_v7": "(0.3 * _f2 + 0.5 * _f4 + 0.2 * _f6)"} | {f"_e{k}": q.fold_ewm(f"_w{k}", 2 / 16, True) for k in (2, 4, 6)}
    return [a, b, c, d, {"stress_vol_v7": q.clip("((_g2 + _e2) * 0.2 + (_g4 + _e4) * 0.4 + (_g6 + _e6) * 0.4)", 0, 2)}]


@block("open", "close", "volume")
def gap_zscores(q: Dialect) -> Stages:
    """Gap z-scores: over 20 bars; scaled by volume, by the volatility regime (20 against 50 bars), by weekday (Monday 1.2,
    Friday .8), by trend and momentum, of two horizons (10 and 50), and by how well earlier ones told returns (100 bars)."""
    a = {"_gap": f"((open - {q.lag('close')}) / nullif({q.lag('close')}, 0))", "_r": q.change("close"), "_mom": f"abs({q.change('close', 5)})", "_i": f"CAST(row_number() {q.ordered} AS DOUBLE)", "_vz": f"((volume - {q.mean('volume', 20)}) / nullif({q.std('volume', 20)}, 0))"}
    z = lambda n: f"((_gap - {q.mean('_gap', n)}) / nullif({q.std('_gap', n)}, 0))"
    b = {"_z": z(20), "_zs": z(10), "_zl": z(50), "_vr": f"({q.std('_r', 20)} / nullif({q.std('_r', 50)}, 0))", "_trend": f"(CASE WHEN _i > 20 THEN coalesce(abs({q.corr('close', '_i', 20, 20, 1)}), 0) END)"}
    c = {"_zlag": q.lag("_z")}
    d = {"_eff": f"(CASE WHEN _i > 100 THEN coalesce(({q.corr('_zlag', '_r', 100, 11, 1)} + 1) / 2, 0.5) ELSE 0.5 END)"}
    known = lambda e, *need: f"coalesce(CASE WHEN {' AND '.join(f'{n} IS NOT NULL' for n in need)} THEN {e} END, 0)"
    pair = "(0.7 * _zs + 0.3 * _zl)"
    e = {
        "gap_zscore_base": "coalesce(_z, 0)", "gap_zscore_volume_enhanced": known("_z * (CASE WHEN abs(_z) > 1 THEN least(greatest(_vz / 2, 0.1), 2.0) ELSE 0.5 END)", "_z", "_vz"),
        "gap_zscore_regime_aware": known("_z * (CASE WHEN _vr > 1.2 THEN 0.7 WHEN _vr < 0.8 THEN 1.3 ELSE 1.0 END)", "_z", "_vr"), "gap_zscore_time_conditional": known(f"_z * (CASE {q.weekday()} WHEN 0 THEN 1.2 WHEN 4 THEN 0.8 ELSE 1.0 END)", "_z"),
        "gap_zscore_reversion_momentum": known("_z * (CASE WHEN _trend > 0.3 AND _mom > 0.02 THEN (CASE WHEN abs(_z) < 1.5 THEN 1.0 ELSE 0.5 END) ELSE 0.8 END)", "_z", "_trend", "_mom"),
        "gap_zscore_multi_timeframe": known(f"{pair} * (CASE WHEN _zs * _zl > 0 THEN 1 + least(abs(_zs * _zl) * 0.1, 0.5) ELSE 0.8 END)", "_zs", "_zl"), "gap_zscore_adaptive_threshold": known("_z * (0.5 + _eff)", "_z"),
    }
    return [a, b, c, d, e]


@block("close", "index_close")
def index_beta(q: Dialect) -> Stages:
    """Beta (clipped to 5), correlation and alpha of daily log returns to an index's, over 60 bars (30 known)."""
    a = {"_y": f"({q.log('close')} - {q.lag(q.log('close'))})", "_x": f"({q.log('index_close')} - {q.lag(q.log('index_close'))})"}
    both = lambda x, y: f"(CASE WHEN {y} IS NOT NULL THEN {x} END)"
    b = {"_b": q.beta("_y", "_x", 60, 30), "_my": q.mean(both("_y", "_x"), 60, 30), "_mx": q.mean(both("_x", "_y"), 60, 30), "corr_index": q.clip(q.corr("_y", "_x", 60, 30), -1, 1)}
    return [a, b, {"beta_index": q.clip("_b", -5, 5), "alpha_index": "(_my - _b * _mx)"}]


@block("close")
def reversion_z(q: Dialect) -> Stages:
    """How far a smoothed close (three bars) stands from its mean over 28, 90 and 151 bars, in 1, 1 and 3 deviations."""
    a = {"smoothed_close": q.mean("close", 3, 1)}
    return [a, {f"mean_reversion_z_score_{n}_std_{k}": f"((smoothed_close - {q.mean('smoothed_close', n)}) / nullif({q.std('smoothed_close', n)} * {k}, 0))" for n, k in ((28, 1), (90, 1), (151, 3))}]


@block("close")
def trend_line(q: Dialect) -> Stages:
    """Slope, intercept and residual of the least-squares line through the last 20 closes, by row number in the window."""
    a = {"_i": f"CAST(row_number() {q.ordered} AS DOUBLE)"}
    b = {"line_slope_20": q.beta("close", "_i", 20), "_m": q.mean("close", 20), "_mi": q.mean("_i", 20)}
    return [a, b, {"line_level_20": "(_m + line_slope_20 * (_i - _mi))", "line_start_20": "(_m - line_slope_20 * 9.5)"}, {"line_residual_20": "(close - line_level_20)"}]


@block("vix")
def vix_regime(q: Dialect) -> Stages:
    """Percentile of the last index value among the 252 before the bar (50 known), the regime scale and flags it gives,
    five-day momentum, its change, and the z-score over the 20 bars before (10 known)."""
    a = {"_p": q.lag("vix"), "_l": q.known_list("vix", q.frame(q.year, 1)), "_n": f"count(vix) {q.frame(q.year, 1)}", "vix_momentum_5d": q.change("vix", 5), "vix_zscore": f"((vix - {q.mean('vix', 20, 10, 1)}) / ({q.std('vix', 20, 10, 1)} + 1e-8))"}
    b = {"vix_percentile_rank": f"(CASE WHEN _n >= 50 AND _p IS NOT NULL THEN 100 * {q.share_upto('_l', '_p')} END)", "vix_momentum_change": q.diff("vix_momentum_5d")}
    r = "vix_percentile_rank"
    return [a, b, {"vix_regime_scale": f"(CASE WHEN {r} >= 80 THEN 1.2 WHEN {r} >= 60 THEN 1.1 WHEN {r} <= 20 THEN 0.95 ELSE 1.0 END)", "vix_regime_low": q.flag(f"{r} <= 25"), "vix_regime_high": q.flag(f"{r} >= 75")}]


@block("dollar_volume_percentile", "volume_trend_5d_20d", "liquidity_stress_3d", "vix_percentile_rank", "atr_percentile_rank", "cv_20d_percentile", "momentum_strength_continuous", "volume_momentum_ratio", "trend_consistency_10d")
def composite_scores(q: Dialect) -> Stages:
    """Liquidity, volatility and momentum scores (each a mean of three parts between 0 and 1) and their mix .3/.4/.3;
    null while a part is unknown."""
    third = lambda *x: f"(({' + '.join(x)}) / 3)"
    a = {
        "liquidity_score": third("dollar_volume_percentile / 100", f"{q.clip('volume_trend_5d_20d', 0, 2)} / 2", f"(1 - {q.clip('liquidity_stress_3d', 0, 2)} / 2)"),
        "volatility_score": third("vix_percentile_rank / 100", f"{q.clip('atr_percentile_rank', 20, 80)} / 100", f"(1 - {q.clip('cv_20d_percentile', 0, 90)} / 100)"),
        "momentum_score": third(f"({q.clip('momentum_strength_continuous', -1, 1)} / 2 + 0.5)", f"{q.clip('volume_momentum_ratio', 0.5, 1.5)} / 2", q.clip("trend_consistency_10d", 0, 1)),
    }
    return [a, {"trading_signal_composite": "(liquidity_score * 0.3 + volatility_score * 0.4 + momentum_score * 0.3)"}]


@block("high", "close")
def significant(q: Dialect) -> Stages:
    """The ratio of high to close with RSI and with the volatility regime, and their norms against the 50 bars before,
    clipped to 3; the ensemble is the mean of the known norms."""
    norm = lambda x: q.clip(f"(({x} - {q.mean(x, 50, shift=1)}) / nullif({q.std(x, 50, shift=1)}, 0))", -3, 3)
    up, dn = "(CASE WHEN _d > 0 THEN _d ELSE 0.0 END)", "(CASE WHEN _d < 0 THEN -_d ELSE 0.0 END)"
    a = {"hc_ratio": "((high - close) / (close + 1e-10))", "_d": q.diff("close"), "_r": q.change("close")}
    b = {"_u": q.mean(up, 14), "_v": q.mean(dn, 14), "_s": q.std("_r", 50, 10)}
    c = {"_rsi": "(CASE WHEN _v > 1e-12 THEN 100 - 100 / (1 + _u / _v) WHEN _u > 1e-12 THEN 100.0 END)", "_ms": q.mean("_s", 50, 10, 1), "_ss": q.std("_s", 50, 10, 1)}
    d = {"rsi_hc_composite": "(hc_ratio * (100 - _rsi) / 50)", "lyapunov_scaled": f"({q.clip('((_s - _ms) / (CASE WHEN _ss = 0 THEN 1 ELSE _ss END))', -3, 3)} / 3)"}
    e = {"_before": q.lag("lyapunov_scaled")}
    f = {"hc_predict_regime": "(hc_ratio * (CASE WHEN _before < -0.3 THEN 1.5 WHEN _before > 0.3 THEN 0.5 ELSE 1.0 END))"}
    names = ("rsi_hc_composite", "hc_ratio", "hc_predict_regime")
    g = {f"{x}_norm": norm(x) for x in names}
    known = " + ".join(f"(CASE WHEN {x}_norm IS NOT NULL THEN 1 ELSE 0 END)" for x in names)
    total = " + ".join(f"coalesce({x}_norm, 0)" for x in names)
    return [a, b, c, d, e, f, g, {"significant_ensemble": f"(({total}) / nullif({known}, 0))"}]


@block("close", "high", "low")
def window_shape(q: Dialect) -> Stages:
    """Skew, kurtosis, energy of averages and asymmetry of returns over 60 bars (30 known)."""
    a = {"_r": q.change("close"), "_m5": q.mean("close", 5, 1), "_m20": q.mean("close", 20, 1)}
    b = {"return_skew_60": q.skew("_r", 60, 30), "return_kurt_60": q.kurt("_r", 60, 30), "_i1": "(close - _m5)", "_i2": "(_m5 - _m20)", "_cube": f"(_r * _r * {q.lag('_r')} - _r * {q.lag('_r')} * {q.lag('_r')})"}
    c = {"imf1_energy": q.mean("(_i1 * _i1)", 60, 30), "imf1_std": q.std("_i1", 60, 30), "imf2_energy": q.mean("(_i2 * _i2)", 60, 30), "imf2_std": q.std("_i2", 60, 30), "time_reversal_asymmetry": q.mean("(_cube * 1000000)", 60, 30)}
    return [a, b, c]


def _safe_log(x: str) -> str:
    return f"ln(greatest({x}, 1e-14))"


def _ratio(a: str, b: str) -> str:
    """Null stays null; a zero denominator gives 0."""
    return f"(CASE WHEN ({a}) IS NULL OR ({b}) IS NULL THEN NULL WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END)"


@block("open", "high", "low", "close", "volume")
def genetic_algebra(q: Dialect) -> Stages:
    """Algebraic indicators on lags of the bar; every lag has 1e-10 added."""
    lags = {f"_{f[0]}{k}": f"({q.lag(f, k)} + {E})" for f, ks in (("high", (1, 2, 3, 4, 5, 7)), ("low", (1, 2, 5)), ("volume", (1,)), ("open", (1, 2))) for k in ks}
    r, lg = _ratio, _safe_log
    out = {
        "g_momentum_confluence_indicator": r("_h2", "_h2 * open"), "g_price_gap_analyzer": r(lg("_o2"), "_h1"), "g_triple_high_trend_indicator": r("_h2", "_h1 * high"),
        "g_cyclical_price_oscillator": r(r(f"cos({r('_h2', 'high')})", "_h1"), f"sqrt(_o1 + {E})"), "g_volume_adjusted_price_indicator": r("_h2", r("volume", "_l1")),
        "g_volume_weighted_high_ratio": r(r("high", "_h1"), lg("(volume + 1)")), "g_high_price_momentum_indicator": r("high", "(_h1 + _h2) / 2"),
        "g_price_volatility_gauge": r("abs(_h2 - high)", "open"), "g_logarithmic_trend_detector": f"(-{lg(r('_h2', '_h4'))})",
        "g_complex_price_pattern_indicator": lg(r(f"pow(_h7 * _h4 + {E}, 0.0625)", "close")), "g_log_scaled_price_ratio": lg(r("high", "(_h1 + _h2) / 2")),
        "g_volume_price_impact_indicator": r(f"(-_h1 + {r('_h3', 'close')})", "volume"), "g_volume_trend_analyzer": lg(r("volume", "_v1")),
        "g_price_open_ratio_indicator": r(r(lg(r("_h2", "high")), r("high", "_o2")), r("high", "_o2")), "g_price_differential_analyzer": _pdr(E),
        "g_price_volatility_trend_measure": f"(0.278 - abs({r('low', 'high')} / {r('_h5', '_l5')}))", "g_lagged_price_volume_convergence": r("_l2", f"(_h2 + {r('0.791', 'low * high')})"),
        "g_price_volume_disparity_index": f"(abs({r('_l2', '_h2')}) / ({r('_h5', '_l5')} / -0.2831))",
        "g_advanced_trend_synthesizer": f"({lg(r('_h1 + _h5', '_h1'))} * abs(0 - _h7) * {r('_o2', 'close')})",
        "g_multi_point_price_analyzer": f"abs({r(r(lg(r('high', '_h2')), r('close', '_h2')), r('close', '_h2') + ' * ' + r('close', '_h1'))})",
    }
    return [lags, {k: f"(CASE WHEN _h7 IS NOT NULL THEN {v} END)" for k, v in out.items()}]


@block("high", "low", "close", "volume")
def panel_inputs(q: Dialect) -> Stages:
    """The window inputs of the cross-section formulas that are plain aggregates (60 bars, 30 known)."""
    n, mp = 60, 30
    a = {"_pc": q.lag("close"), "in_return": f"coalesce({q.change('close')}, 0.0)"}
    b = {"in_high_close": "((high - _pc) / (_pc + 1e-10))", "in_low_close": "((low - _pc) / (_pc + 1e-10))", "in_high_low": "((high - low) / (close + 1e-10))", "_r1": q.lag("in_return"), "_fast": q.mean("close", 5, 2), "_slow": q.mean("close", 20, 5)}
    c = {"_asym": "((in_return * in_return * _r1 - _r1 * _r1 * in_return) * 1000000)", "_turn": "abs(in_return - _r1)", "_i1": "(close - _fast)", "_i2": "(_fast - _slow)"}
    d = {
        "in_asymmetry": q.mean("_asym", n, mp), "in_rate_of_change": q.mean("_turn", n, mp), "in_imf1_energy": q.mean("(_i1 * _i1)", n, mp), "in_imf1_std": q.std("_i1", n, mp), "in_imf2_energy": q.mean("(_i2 * _i2)", n, mp), "in_imf2_std": q.std("_i2", n, mp),
        "in_skew": q.skew("in_return", n, mp), "in_kurt": q.kurt("in_return", n, mp), "in_autocorr": q.corr("_r1", "in_return", n, mp),
    }
    return [a, b, c, d]


def _centred(q: Dialect, x: str) -> str:
    return f"(CASE WHEN count(*) {q.across} >= 2 THEN {q.rank(x)} / (count(*) {q.across} + 1) * 2 - 1 ELSE 0.0 END)"


@block("in_return", "in_high_close", "in_low_close", "in_rate_of_change", "in_imf1_energy", "in_autocorr")
def panel_formulas(q: Dialect) -> Stages:
    """Two of the cross-section formulas (F3, F4): inputs null to 0, ranked to (-1, 1) among the day's entities, combined,
    and ranked (or standardised) again. ``PANEL_COMPOSITE`` has the others."""
    centred = lambda x: _centred(q, x)
    src = {"0": "in_return", "2": "in_high_close", "3": "in_low_close", "7": "in_rate_of_change", "8": "in_imf1_energy", "19": "in_autocorr"}
    a = {f"_f{k}": f"coalesce({c}, 0.0)" for k, c in src.items()}
    b = {f"_x{k}": centred(f"_f{k}") for k in src}
    c = {"_e3": "(-0.07320318705361156 * _x0)", "_e4": f"coalesce((0.17726009244632013 + _x2) / nullif(_x3 + _x7 + {2.6940490745579684 ** 2!r} + _x8, 0), 0.0)", "_e1": "(CASE WHEN 1.77026646253569 + _x19 > 0 THEN -0.9931974192883872 * _x3 ELSE -(1.77026646253569 + _x19) END)"}
    c["_e3"] = f"round({c['_e3']}, 9)"
    mu, sd = f"avg(_e4) {q.across}", f"stddev_pop(_e4) {q.across}"
    d = {"gp_f3": centred("_e3"), "gp_f4": f"((_e4 - {mu}) / ({sd} + 1e-10))"}
    return [a, b, c, d]


def _panel_composite(q: Dialect) -> Stages:
    """The formulas F1, N1 and N4 and the composite of all five. Sums are rounded to 9 decimals, so that equal ones tie."""
    src = {"0": "in_return", "3": "in_low_close", "13": "noise_white_60", "14": "noise_pink_60", "18": "spectral_entropy_60", "19": "in_autocorr"}
    a = {f"_f{k}": f"coalesce({c}, 0.0)" for k, c in src.items()}
    b = {f"_x{k}": _centred(q, f"_f{k}") for k in src}
    first = "(CASE WHEN 1.77026646253569 + _x19 > 0 THEN -0.9931974192883872 * _x3 ELSE 0.9931974192883872 * _x3 END)"
    c = {"_e1": f"round(_x14 - {first}, 9)", "_n1": "round(_x13 + _x3, 9)", "_n4": f"round(sqrt(abs(abs(_x3) * ((-1.7102360477772514 + _x18 + _x0) / {1.2577672553937247 * 3.959124395312415!r}))), 9)"}
    d = {"gp_f1": _centred(q, "_e1"), "gp_n1": _centred(q, "_n1"), "gp_n4": _centred(q, "_n4")}
    terms = {
        "gp_f1": -0.034224, "gp_f3": 1.296387, "gp_f4": 0.004473, "gp_n1": 0.012287, "gp_n4": 0.009157, "gp_f1 * gp_f3": -0.274113, "gp_f1 * gp_f4": 0.085361, "gp_f1 * gp_n1": 0.021151, "gp_f1 * gp_n4": -0.181167,
        "gp_f3 * gp_f4": -1.295755, "gp_f3 * gp_n1": 0.355264, "gp_f3 * gp_n4": 2.387638, "gp_f4 * gp_n1": -0.044057, "gp_f4 * gp_n4": -0.000961, "gp_n1 * gp_n4": 0.04893,
    }
    return [a, b, c, d, {"gp_composite": f"({' + '.join(f'{w!r} * {t}' for t, w in terms.items())} + 0.002355)"}]


#: Needs the noise and entropy of ``kernels.complexity``, which no expression has, so it isn't among the registered blocks.
PANEL_COMPOSITE = Block(
    "panel_composite", ("in_return", "in_low_close", "in_autocorr", "noise_white_60", "noise_pink_60", "spectral_entropy_60", "gp_f3", "gp_f4"), _panel_composite, ("gp_f1", "gp_n1", "gp_n4", "gp_composite")
)


@block("close", "vix")
def vix_family(q: Dialect) -> Stages:
    """Regime, changes, momentum, moving averages, crosses, scores, realised volatility and factors of an index series
    that has been joined as of each bar."""
    a = {f"vix_change_{k}": q.diff("vix", k) for k in (1, 5, 10, 20)} | {f"vix_ma_{n}": q.mean("vix", n, shift=1) for n in (10, 20, 50)} | {f"_vs{n}": q.std("vix", n, shift=1) for n in (20, 50)}
    long = {30: 30, 60: 60, 252: q.year}
    a |= {f"_l{n}": q.known_list("vix", q.frame(k, 1)) for n, k in long.items()} | {f"_n{n}": f"count(vix) {q.frame(k, 1)}" for n, k in long.items()} | {"_lr": f"({q.log('close')} - {q.lag(q.log('close'))})"}
    b = {
        "vix_regime": "(CASE WHEN vix < 15 THEN 0 WHEN vix < 20 THEN 1 WHEN vix < 30 THEN 2 WHEN vix IS NOT NULL THEN 3 END)", "vix_momentum": "(vix - vix_ma_10)", "vix_acceleration": q.diff("vix_change_1"),
        "vix_ma_cross": q.sign("round(vix_ma_10 - vix_ma_20, 9)"), "vix_ma_cross_50": q.sign("round(vix_ma_20 - vix_ma_50, 9)"), "realized_vol_10": f"({q.std('_lr', 10)} * sqrt(252))", "realized_vol_21": f"({q.std('_lr', 21)} * sqrt(252))", "vix_factor": q.clip("(20 / vix)", 0.5, 2),
    }
    b |= {f"vix_percentile_{n}": f"(CASE WHEN _n{n} >= {k} THEN {q.share_upto(f'_l{n}', 'vix')} END)" for n, k in long.items()}
    b |= {"vix_of_vix": q.std("vix_change_1", 20), "trend_50": q.sign(f"round(close - {q.mean('close', 50)}, 9)")}
    b |= {f"vix_z_{n}": f"((vix - vix_ma_{n}) / nullif(_vs{n}, 0))" for n in (20, 50)}
    return [a, b, {"vix_of_vix_z": f"((vix_of_vix - {q.mean('vix_of_vix', 20)}) / nullif({q.std('vix_of_vix', 20)}, 0))", "market_regime": "(CASE WHEN trend_50 > 0 AND vix < 20 THEN 0 WHEN trend_50 > 0 THEN 1 WHEN trend_50 <= 0 AND vix < 20 THEN 2 WHEN trend_50 <= 0 THEN 3 END)", "vix_vs_realized": "(vix / nullif(realized_vol_21 * 100, 0))", "vix_spike": q.flag("vix_z_20 > 2"), "vix_bottom": q.flag("vix_z_20 < -1.5")}]


@block("close", "vix_factor")
def dynamic_rsi(q: Dialect) -> Stages:
    """RSI whose window of 5 to 30 bars follows the index factor: floor(14 * factor)."""
    a = {"_d": q.diff("close"), "_w": "CAST(least(greatest(floor(14 * vix_factor), 5), 30) AS INT)"}
    b = {"_up": "(CASE WHEN _d > 0 THEN _d WHEN _d IS NOT NULL THEN 0.0 END)", "_dn": "(CASE WHEN _d < 0 THEN -_d WHEN _d IS NOT NULL THEN 0.0 END)", "_row": f"row_number() {q.ordered}"}
    c = {"_cu": f"sum(_up) {q.so_far}", "_cd": f"sum(_dn) {q.so_far}"}
    up = "CASE _w " + " ".join(f"WHEN {w} THEN _cu - {q.lag('_cu', w)}" for w in range(5, 31)) + " END"
    dn = "CASE _w " + " ".join(f"WHEN {w} THEN _cd - {q.lag('_cd', w)}" for w in range(5, 31)) + " END"
    d = {"_su": f"({up})", "_sd": f"({dn})"}
    return [a, b, c, d, {"dynamic_rsi": "(CASE WHEN _row <= 50 OR _su IS NULL THEN NULL WHEN _sd > 1e-9 THEN 100 - 100 / (1 + _su / _sd) WHEN _su > 1e-9 THEN 100.0 ELSE 50.0 END)"}]


@block("close", "volume")
def volume_trend(q: Dialect) -> Stages:
    """Correlation of volume with time over 51 bars."""
    a = {"_i": f"CAST(row_number() {q.ordered} AS DOUBLE)"}
    return [a, {"volume_trend": q.corr("_i", "volume", 51)}, ]


@block("close", looks_ahead=True)
def weighted_return(q: Dialect) -> Stages:
    """Daily, weekly, monthly and long returns (rounded to 3, filled backwards, which looks ahead) weighted by how far
    volatility stands from its mean."""
    a = {f"_r{k}": f"round({q.change('close', k)} + 1e-9, 3)" for k in (1, 5, 21, q.year)}
    b = {f"_b{k}": q.bfill(f"_r{k}") for k in (1, 5, 21, q.year)}
    c = {"_vol": q.std("_b1", 21)}
    d = {"_vf": q.bfill("_vol")}
    e = {"_vm": q.mean("_vf", 21), "_vs": q.std("_vf", 21), "_row": f"row_number() {q.ordered}"}
    z = "(CASE WHEN _vs > 1e-9 THEN (_vf - _vm) / _vs ELSE 0.0 END)"
    f = {f"_w{k}": f"least(greatest(0.25 + {m} * {z}, 0), 1)" for k, m in ((1, -0.1), (5, -0.05), (21, 0.05), (q.year, 0.1))}
    num = " + ".join(f"_w{k} * coalesce(_b{k}, 0)" for k in (1, 5, 21, q.year))
    return [a, b, c, d, e, f, {"weighted_return": f"(CASE WHEN _row <= 21 THEN 0.0 ELSE ({num}) / (_w1 + _w5 + _w21 + _w{q.year}) END)"}]


@block("open", "high", "low", "close")
def gap_thresholds(q: Dialect) -> Stages:
    """Gaps against quantiles of all earlier ones (a year of them known)."""
    a = {"_gap": f"((open - {q.lag('close')}) / nullif({q.lag('close')}, 0))"}
    b = {f"gap_q{int(p * 100)}": f"(CASE WHEN count(_gap) {q.before} >= {q.year} THEN {q.quantile_agg('_gap', p)} {q.before} END)" for p in (0.1, 0.9)}
    return [a, b, {"gap_up": q.flag("_gap > gap_q90"), "gap_down": q.flag("_gap < gap_q10")}]

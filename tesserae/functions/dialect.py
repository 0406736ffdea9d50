"""Window and scalar expressions as SQL text.

A feature is defined once, as text over a :class:`Dialect`; :class:`SparkDialect` is what the engine runs, and
:class:`DuckDialect` states the same query for the SQL check. Divisions give null for a zero denominator, correlations
and ratios of spreads give null where a window is flat, and a rolling value is null until its window has ``mp`` values.
"""

from __future__ import annotations

import math

#: Spreads below this are floating noise of a flat window.
FLAT = "1e-11"


class Dialect:
    """Expressions both engines spell alike; ``entity`` and ``time`` name the panel's axes."""

    entity, time = "ticker", "date"

    def __init__(self, year: int = 252, season: int = 90) -> None:
        """``year`` and ``season``: rows of the long windows; a panel with less history can pass shorter ones."""
        self.year, self.season = year, season

    # frames
    def frame(self, n: int, shift: int = 0) -> str:
        end = "CURRENT ROW" if shift == 0 else f"{shift} PRECEDING"
        return f"OVER (PARTITION BY {self.entity} ORDER BY {self.time} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {end})"

    def ahead(self, n: int) -> str:
        return f"OVER (PARTITION BY {self.entity} ORDER BY {self.time} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"

    @property
    def so_far(self) -> str:
        return f"OVER (PARTITION BY {self.entity} ORDER BY {self.time} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    @property
    def before(self) -> str:
        return f"OVER (PARTITION BY {self.entity} ORDER BY {self.time} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    @property
    def ordered(self) -> str:
        return f"OVER (PARTITION BY {self.entity} ORDER BY {self.time})"

    @property
    def whole(self) -> str:
        return f"OVER (PARTITION BY {self.entity})"

    @property
    def across(self) -> str:
        return f"OVER (PARTITION BY {self.time})"

    # rolling
    def rolled(self, agg: str, x: str, n: int, mp: int | None = None, shift: int = 0) -> str:
        w = self.frame(n, shift)
        return f"(CASE WHEN count({x}) {w} >= {n if mp is None else mp} THEN {agg} {w} END)"

    def mean(self, x: str, n: int, mp: int | None = None, shift: int = 0) -> str:
        return self.rolled(f"avg({x})", x, n, mp, shift)

    def sum(self, x: str, n: int, mp: int | None = None, shift: int = 0) -> str:
        return self.rolled(f"sum({x})", x, n, mp, shift)

    def low(self, x: str, n: int, mp: int | None = None, shift: int = 0) -> str:
        return self.rolled(f"min({x})", x, n, mp, shift)

    def high(self, x: str, n: int, mp: int | None = None, shift: int = 0) -> str:
        return self.rolled(f"max({x})", x, n, mp, shift)

    def std(self, x: str, n: int, mp: int | None = None, shift: int = 0) -> str:
        w = self.frame(n, shift)
        return f"(CASE WHEN count({x}) {w} >= {max(2, n if mp is None else mp)} THEN (CASE WHEN stddev_samp({x}) {w} < {FLAT} THEN 0.0 ELSE stddev_samp({x}) {w} END) END)"

    def var(self, x: str, n: int, mp: int | None = None, shift: int = 0) -> str:
        s = self.std(x, n, mp, shift)
        return f"({s} * {s})"

    def quantile(self, x: str, p: float, n: int, mp: int | None = None, shift: int = 0) -> str:
        return self.rolled(self.quantile_agg(x, p), x, n, mp, shift)

    def corr(self, x: str, y: str, n: int, mp: int | None = None, shift: int = 0) -> str:
        """Over pairs of which both are known."""
        w = self.frame(n, shift)
        a, b = f"(CASE WHEN ({y}) IS NOT NULL THEN ({x}) END)", f"(CASE WHEN ({x}) IS NOT NULL THEN ({y}) END)"
        sd = f"(stddev_samp({a}) {w} * stddev_samp({b}) {w})"
        return f"(CASE WHEN count({a}) {w} >= {max(2, n if mp is None else mp)} AND {sd} > {FLAT} THEN covar_samp({a}, {b}) {w} / {sd} END)"

    def beta(self, x: str, y: str, n: int, mp: int | None = None) -> str:
        """Slope of ``x`` on ``y``."""
        w = self.frame(n)
        a, b = f"(CASE WHEN ({y}) IS NOT NULL THEN ({x}) END)", f"(CASE WHEN ({x}) IS NOT NULL THEN ({y}) END)"
        return f"(CASE WHEN count({a}) {w} >= {max(2, n if mp is None else mp)} AND var_samp({b}) {w} > 1e-14 THEN covar_samp({a}, {b}) {w} / (var_samp({b}) {w}) END)"

    # points
    def lag(self, x: str, k: int = 1) -> str:
        return f"(lag({x}, {k}) {self.ordered})"

    def lead(self, x: str, k: int = 1) -> str:
        return f"(lead({x}, {k}) {self.ordered})"

    def diff(self, x: str, k: int = 1) -> str:
        return f"({x} - {self.lag(x, k)})"

    def change(self, x: str, k: int = 1) -> str:
        before = self.lag(x, k)
        return f"(CASE WHEN abs({before}) > 1e-9 THEN {x} / {before} - 1 END)"

    def flag(self, cond: str) -> str:
        """1 where the condition holds, otherwise (also where it is unknown) 0."""
        return f"(CASE WHEN {cond} THEN 1 ELSE 0 END)"

    def clip(self, x: str, lo: float, hi: float) -> str:
        return f"(CASE WHEN {x} IS NULL THEN NULL ELSE least(greatest({x}, {lo}), {hi}) END)"

    def sign(self, x: str) -> str:
        return f"(CASE WHEN {x} > 0 THEN 1 WHEN {x} < 0 THEN -1 WHEN {x} = 0 THEN 0 END)"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) / nullif({b}, 0))"

    def log(self, x: str) -> str:
        return f"(CASE WHEN {x} > 0 THEN ln({x}) END)"

    # across the entities of one time
    def rank(self, x: str, over: str | None = None) -> str:
        """Average rank among the known values of a partition."""
        p = over or self.time
        return f"(CASE WHEN ({x}) IS NOT NULL THEN rank() OVER (PARTITION BY {p}, ({x}) IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {p}, {x}) - 1) * 0.5e0 END)"

    def pct_rank(self, x: str, over: str | None = None) -> str:
        return f"({self.rank(x, over)} / count({x}) OVER (PARTITION BY {over or self.time}))"

    # what the engines spell differently
    def quantile_agg(self, x: str, p: float) -> str:
        raise NotImplementedError

    def known_list(self, x: str, over: str) -> str:
        """The known values of a frame, in order."""
        raise NotImplementedError

    def share_upto(self, values: str, x: str) -> str:
        """Share of a list's values that are at most ``x``."""
        raise NotImplementedError

    def rank_in(self, values: str, x: str) -> str:
        """Average rank of ``x`` among a list's values, as a share of them."""
        raise NotImplementedError

    def weekday(self) -> str:
        """0 for Monday."""
        raise NotImplementedError

    def fold_ewm(self, values: str, alpha: float, adjust: bool) -> str:
        """Exponentially weighted mean of a list, newest last."""
        raise NotImplementedError

    def ewm(self, x: str, alpha: float) -> str:
        """The list for :meth:`fold_ewm`: as many rows as weigh at least a billionth, so a row's work is bounded however
        long its entity's history is."""
        return self.known_list(x, self.frame(math.ceil(math.log(1e-9) / math.log(1 - alpha))))

    def ffill(self, x: str, limit: int | None = None) -> str:
        raise NotImplementedError

    def bfill(self, x: str) -> str:
        raise NotImplementedError

    def skew_of(self, x: str, over: str) -> str:
        """Bias-corrected, null below three values or where flat."""
        raise NotImplementedError

    def kurt_of(self, x: str, over: str) -> str:
        raise NotImplementedError

    def skew(self, x: str, n: int, mp: int | None = None) -> str:
        w = self.frame(n)
        return f"(CASE WHEN count({x}) {w} >= {max(3, n if mp is None else mp)} AND stddev_samp({x}) {w} > {FLAT} THEN {self.skew_of(x, w)} END)"

    def kurt(self, x: str, n: int, mp: int | None = None) -> str:
        w = self.frame(n)
        return f"(CASE WHEN count({x}) {w} >= {max(4, n if mp is None else mp)} AND stddev_samp({x}) {w} > {FLAT} THEN {self.kurt_of(x, w)} END)"


class SparkDialect(Dialect):
    def quantile_agg(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})"

    def known_list(self, x: str, over: str) -> str:
        return f"collect_list({x}) {over}"

    def share_upto(self, values: str, x: str) -> str:
        return f"(CASE WHEN size({values}) > 0 THEN size(filter({values}, e -> e <= {x})) / size({values}) END)"

    def rank_in(self, values: str, x: str) -> str:
        return f"((size(filter({values}, e -> e < {x})) + (size(filter({values}, e -> e = {x})) + 1) / 2) / size({values}))"

    def weekday(self) -> str:
        return f"weekday({self.time})"

    def fold_ewm(self, values: str, alpha: float, adjust: bool) -> str:
        keep = 1 - alpha
        if adjust:
            acc = f"aggregate({values}, named_struct('a', 0D, 'b', 0D), (s, v) -> named_struct('a', s.a * {keep}D + v, 'b', s.b * {keep}D + 1D), s -> CASE WHEN s.b > 0 THEN s.a / s.b END)"
            return f"(CASE WHEN size({values}) > 0 THEN {acc} END)"
        return f"(CASE WHEN size({values}) > 0 THEN aggregate(slice({values}, 2, size({values})), element_at({values}, 1), (s, v) -> s * {keep}D + v * {alpha}D) END)"

    def ffill(self, x: str, limit: int | None = None) -> str:
        w = self.so_far if limit is None else self.frame(limit + 1)
        return f"(last({x}, true) {w})"

    def bfill(self, x: str) -> str:
        return f"(first({x}, true) OVER (PARTITION BY {self.entity} ORDER BY {self.time} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"

    def skew_of(self, x: str, over: str) -> str:
        n = f"count({x}) {over}"
        return f"(sqrt(double({n}) * ({n} - 1)) / ({n} - 2) * (skewness({x}) {over}))"

    def kurt_of(self, x: str, over: str) -> str:
        n = f"count({x}) {over}"
        return f"(double({n} - 1) / (({n} - 2) * ({n} - 3)) * (({n} + 1) * (kurtosis({x}) {over}) + 6))"


class DuckDialect(Dialect):
    def quantile_agg(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def known_list(self, x: str, over: str) -> str:
        return f"list_filter(list({x}) {over}, lambda e: e IS NOT NULL)"

    def share_upto(self, values: str, x: str) -> str:
        return f"(CASE WHEN len({values}) > 0 THEN len(list_filter({values}, lambda e: e <= {x})) / len({values}) END)"

    def rank_in(self, values: str, x: str) -> str:
        return f"((len(list_filter({values}, lambda e: e < {x})) + (len(list_filter({values}, lambda e: e = {x})) + 1) / 2.0) / len({values}))"

    def weekday(self) -> str:
        return f"(isodow({self.time}) - 1)"

    def fold_ewm(self, values: str, alpha: float, adjust: bool) -> str:
        keep = 1 - alpha
        if adjust:
            weighted = f"list_sum(list_transform({values}, lambda e, i: e * pow({keep}, len({values}) - i)))"
            return f"(CASE WHEN len({values}) > 0 THEN {weighted} / list_sum(list_transform({values}, lambda e, i: pow({keep}, len({values}) - i))) END)"
        return f"(CASE WHEN len({values}) > 0 THEN list_reduce({values}, lambda s, v: s * {keep} + v * {alpha}) END)"

    def ffill(self, x: str, limit: int | None = None) -> str:
        w = self.so_far if limit is None else self.frame(limit + 1)
        return f"(last_value({x} IGNORE NULLS) {w})"

    def bfill(self, x: str) -> str:
        return f"(first_value({x} IGNORE NULLS) OVER (PARTITION BY {self.entity} ORDER BY {self.time} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"

    def skew_of(self, x: str, over: str) -> str:
        return f"skewness({x}) {over}"

    def kurt_of(self, x: str, over: str) -> str:
        return f"kurtosis({x}) {over}"

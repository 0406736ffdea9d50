"""Implausible readings in measurements (problem 4): phase-space thresholding per source.

A source's daily series (log scale) is thresholded in phase space: robust ellipsoids (median absolute deviations times
``HEAVY`` times the universal threshold sqrt(2 ln n)) over the value about its neighbours, its first and its second
difference nominate spikes; nominated points are replaced by their surroundings and the series is judged again until
nothing changes. The universal threshold is that of normal noise; daily moves have heavy tails, hence the factor.

A nominated point is confirmed by an exact test that the move didn't last, which splits and results do: it stands outside
the levels before and after it, by ``OFF`` robust moves (more where only one level tells: at the ends, and beside a lasting move). Both parts
decide: see the README for how many readings each spares. Runs without a difference that are too long for the source's own
rate of repeats are stuck, and bounds (sign, high below low) catch the rest.

For fixed surroundings each ellipsoid test is a quadratic in the reading, so a day's verdict is an interval of accepted
readings. The kernel returns these intervals; every landed row is held against its day's, so a second landing of the
same reading is flagged too and a corrected one is not.

Scale: landings are first reduced (map-side) to the distinct readings of a source and day (mostly one or two), so the
arrays a task gets are bounded by the calendar and the corrections of a day, whatever share of the rows one source holds;
rows meet their intervals on (source, day).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.missing import finite
from tesserae.operators.fill import BAR_FIELDS, Numeric, usable

#: Half widths of the ellipsoids, in universal thresholds.
HEAVY = 4.0
#: How many robust moves off the levels before and after a nominated reading must be; more where only one side tells.
OFF, OFF_AT_END = 4.0, 11.0
#: A run is stuck when the source's own rate of repeats makes one that long rarer than this over its whole series.
RARE = 1e-3
#: Days on each side that tell the levels.
SIDE = 3
ROUNDS = 10


def _sides(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Medians of up to SIDE values before and after each point; NaN where there are none."""
    n = len(x)

    def med(parts: list[np.ndarray]) -> np.ndarray:
        m = np.sort(np.stack(parts), axis=0)  # NaN sorts last
        k = (~np.isnan(m)).sum(axis=0)
        i = np.arange(n)
        lo, hi = m[np.maximum((k - 1) // 2, 0), i], m[np.maximum(k // 2, 0).clip(0, SIDE - 1), i]
        return np.where(k > 0, (lo + hi) / 2, np.nan)

    gap = np.full(SIDE, np.nan)
    padded = np.concatenate([gap, x, gap])
    return med([padded[SIDE - j : SIDE - j + n] for j in range(1, SIDE + 1)]), med([padded[SIDE + j : SIDE + j + n] for j in range(1, SIDE + 1)])


def _mad(x: np.ndarray, least: float) -> float:
    x = x[~np.isnan(x)]
    return max(1.4826 * float(np.median(np.abs(x))), least) if len(x) else least


def _within(a: np.ndarray, ra: float, b: np.ndarray, rb: float, sb: float) -> tuple[np.ndarray, np.ndarray]:
    """Interval of v with ((v - a) / ra)^2 + (sb * (v - b) / rb)^2 <= 1; empty: (inf, -inf)."""
    p, q = 1 / ra**2, (sb / rb) ** 2
    mid = (p * a + q * b) / (p + q)
    room = (1 - p * q * (a - b) ** 2 / (p + q)) / (p + q)
    half = np.sqrt(np.maximum(room, 0))
    return np.where(room >= 0, mid - half, np.inf), np.where(room >= 0, mid + half, -np.inf)


def accepted(x: np.ndarray, tick: float) -> tuple[np.ndarray, np.ndarray]:
    """Per point of a series, the interval of readings that its surroundings accept. ``tick``: the least move there is."""
    n = len(x)
    if n < 5:
        return np.full(n, -np.inf), np.full(n, np.inf)
    y, lam = x.copy(), HEAVY * math.sqrt(2 * math.log(n))
    lo = hi = None
    for _ in range(ROUNDS):
        before, after = _sides(y)
        end = np.isnan(before) | np.isnan(after)
        b, a = np.where(np.isnan(before), after, before), np.where(np.isnan(after), before, after)
        centre = (a + b) / 2
        prev, nxt = np.concatenate([[y[1]], y[:-1]]), np.concatenate([y[1:], [y[-2]]])
        u, d1, d2 = y - centre, np.diff(y), prev + nxt - 2 * y
        su, s1, s2 = _mad(u, tick), _mad(d1, tick), _mad(d2, tick)
        # value against first difference, first against second; value against second along its rotated axes
        l1, h1 = _within(centre, lam * su, prev, lam * s1, 1.0)
        l2, h2 = _within(prev, lam * s1, (prev + nxt) / 2, lam * s2, 2.0)
        theta = math.atan2(float(np.sum(u * d2)), float(np.sum(u * u)) or 1e-300)
        c2, n2 = math.cos(theta) ** 2, math.sin(theta) ** 2
        det = c2 * c2 - n2 * n2
        if abs(det) > 1e-6:
            ra = max((su**2 * c2 - s2**2 * n2) / det, su**2 * 0.25)
            rb = max((s2**2 * c2 - su**2 * n2) / det, s2**2 * 0.25)
        else:
            ra, rb = su**2, s2**2
        # u cos + d2 sin and d2 cos - u sin, both linear in the reading v (d2 = prev + nxt - 2 v)
        ct, st = math.cos(theta), math.sin(theta)
        k1, m1 = ct - 2 * st, -centre * ct + (prev + nxt) * st
        k2, m2 = -2 * ct - st, (prev + nxt) * ct + centre * st
        k1 = k1 if abs(k1) > 1e-9 else 1e-9
        k2 = k2 if abs(k2) > 1e-9 else 1e-9
        l3, h3 = _within(-m1 / k1, lam * math.sqrt(ra) / abs(k1), -m2 / k2, lam * math.sqrt(rb) / abs(k2), 1.0)
        el, eh = np.maximum(np.maximum(l1, l2), l3), np.minimum(np.minimum(h1, h2), h3)
        alone = end | (np.abs(a - b) > OFF_AT_END * s1)  # a lasting move lies between the levels, so only one of them tells
        width = np.where(alone, OFF_AT_END, OFF) * s1
        bl, bh = np.minimum(a, b) - width, np.maximum(a, b) + width
        inside = el <= eh  # readings that the ellipsoids don't nominate, and those whose move may last, are accepted
        lo, hi = np.where(inside, np.minimum(el, bl), bl), np.where(inside, np.maximum(eh, bh), bh)
        clean = np.where((x < lo) | (x > hi), centre, x)
        if np.array_equal(clean, y):
            break
        y = clean
    return lo, hi


def stuck(days: list[set[float]]) -> list[list[float] | None]:
    """Per point, the readings that are stuck there, or None; a point has every reading of its day. The first point of
    a run is none of it."""
    n = len(days)
    out: list[list[float] | None] = [None] * n
    runs, repeats, open_runs = [], 0, {}
    for i, values in enumerate([*days, set()]):
        runs += [(i - at, at, v) for v, at in open_runs.items() if v not in values]
        open_runs = {v: open_runs.get(v, i) for v in values}
        repeats += any(at < i for at in open_runs.values())
    longest = max((r[0] for r in runs), default=0)
    total, repeats = n - longest, repeats - (longest - 1)
    rate = (repeats + 0.5) / max(1, total + 1)
    for length, at, v in runs:
        if length > 2 and n * rate ** (length - 1) < RARE:
            for k in range(at + 1, at + length):
                out[k] = [*(out[k] or ()), v]
    return out


def _may_be_stuck(first: np.ndarray, last: np.ndarray, more: list) -> bool:
    """Whether any reading can stand on three days in a row: two neighbouring days share one twice in a row, or some day has
    more than two readings. Without that :func:`stuck` finds nothing, as runs are longer than two."""
    if any(m is not None for m in more):
        return True
    same = (first[1:] == first[:-1]) | (first[1:] == last[:-1]) | (last[1:] == first[:-1]) | (last[1:] == last[:-1])
    return bool((same[1:] & same[:-1]).any())


def _kernel(names: list[str], ticks: list[float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            cols = {c: pdf[c].to_numpy() for c in pdf.columns}
            for i in range(len(pdf)):
                days = np.asarray(cols["_days"][i])
                frame: dict = {"_source": [cols["_source"][i]] * len(days), "_day": days}
                flat = np.asarray(cols["_flat"][i], dtype=bool)
                for name, tick in zip(names, ticks):
                    first, last = (np.asarray(cols[f"_{k}_{name}"][i], dtype=float) for k in ("first", "last"))
                    more = cols[f"_more_{name}"][i]
                    lo, hi, fz = np.full(len(days), -np.inf), np.full(len(days), np.inf), np.full(len(days), None, dtype=object)
                    use = np.where(last > 0)[0]
                    if len(use):
                        x = np.log(last[use])
                        lo[use], hi[use] = accepted(x, tick / float(np.median(last[use])) if tick else 1e-9)
                    move = np.where(~np.isnan(last) & ~flat)[0]
                    if not _may_be_stuck(first[move], last[move], [more[k] for k in move]):
                        move = move[:0]
                    for k, held in zip(move, stuck([{first[k], last[k], *(() if more[k] is None else more[k])} for k in move])):
                        fz[k] = held
                    frame |= {f"_lo_{name}": lo, f"_hi_{name}": hi, f"_fz_{name}": fz}
                parts.append(pd.DataFrame(frame))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return run


def verdicts(df: DataFrame, source: str = "ticker", time: str = "date", key: str = "bar_id", fields: tuple[Numeric, ...] = BAR_FIELDS + (Numeric("high"),), tick: float = 0.01, activity: str = "volume", above: str = "high", below: str = "low") -> DataFrame:
    """``df`` with, for each field, ``<field>_spike``, ``<field>_stuck`` and ``<field>_impossible``.

    ``df`` may be any table with these columns. Cells without a usable reading (see ``fill.usable``) are never flagged.
    Rows of a null source or day have no surroundings: only bounds apply to them. Points where ``activity`` is 0 are flat
    days and neither count towards a run nor are stuck. Series of fewer than five days accept everything."""
    names = [f.name for f in fields]
    ok = usable(df, fields, source)
    day = F.col(time).cast("date")

    def at(f: str, how) -> Column:
        return how(F.col("_ok_" + f), F.when(F.col("_ok_" + f).isNotNull(), F.col(key)))

    aggs = [x for f in names for x in (at(f, F.min_by).alias(f"_first_{f}"), at(f, F.max_by).alias(f"_last_{f}"), F.collect_set("_ok_" + f).alias(f"_all_{f}"))]
    days = ok.where(day.isNotNull() & F.col(source).isNotNull()).groupBy(F.col(source).alias("_source"), day.alias("_day")).agg(*aggs)
    nan = F.lit(float("nan"))
    cells = days.select(
        "_source",
        F.struct(
            F.col("_day"),
            F.coalesce(F.col(f"_last_{activity}") == 0, F.lit(False)).alias("_flat"),
            *[F.coalesce(f"_{k}_{f}", nan).alias(f"_{k}_{f}") for f in names for k in ("first", "last")],
            *[F.when(F.size(f"_all_{f}") > 2, F.col(f"_all_{f}")).alias(f"_more_{f}") for f in names],
        ).alias("_cell"),
    )
    series = cells.groupBy("_source").agg(F.sort_array(F.collect_list("_cell")).alias("_cells"))  # a cell a day of the calendar at most
    flatter = series.select("_source", F.col("_cells._day").alias("_days"), F.col("_cells._flat").alias("_flat"), *[F.col(f"_cells._{k}_{f}").alias(f"_{k}_{f}") for f in names for k in ("first", "last", "more")])
    schema = "_source string, _day date, " + ", ".join(f"_lo_{f} double, _hi_{f} double, _fz_{f} array<double>" for f in names)
    ticks = [0.0 if f.name == activity else tick for f in fields]
    intervals = flatter.mapInPandas(_kernel(names, ticks), schema)
    rows = ok.join(intervals, (ok[source].cast("string") == intervals["_source"]) & (day == intervals["_day"]), "left")
    out = {}
    for f in fields:
        x = F.col("_ok_" + f.name)
        y = F.when(x > 0, F.ln(x))
        out[f"{f.name}_spike"] = F.coalesce((y < F.col(f"_lo_{f.name}")) | (y > F.col(f"_hi_{f.name}")), F.lit(False))
        moving = F.coalesce(F.col(f"_ok_{activity}") != 0, F.lit(True))
        out[f"{f.name}_stuck"] = F.coalesce(F.array_contains(f"_fz_{f.name}", x) & moving, F.lit(False))
        out[f"{f.name}_impossible"] = F.coalesce(x < 0, F.lit(False))
    if above in names:
        crossed = F.coalesce((F.col(f"_ok_{above}") > 0) & (finite(F.col(below)) > 0) & (F.col(f"_ok_{above}") < finite(F.col(below))), F.lit(False))
        out[f"{above}_impossible"] = out[f"{above}_impossible"] | crossed
    return rows.select(*[ok[c] for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()])


def implausible(df: DataFrame, key: str = "bar_id", **more) -> DataFrame:
    """The rows with at least one flag, by key."""
    flagged = verdicts(df, key=key, **more)
    flags = [c for c in flagged.columns if c.endswith(("_spike", "_stuck", "_impossible"))]
    hit = F.lit(False)
    for c in flags:
        hit = hit | F.col(c)
    return flagged.where(hit).select(key).distinct()

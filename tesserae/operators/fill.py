"""Filling missing values from similar records (problem 1).

Numeric fields: a mixed-effects prediction on the log scale,

    y[g, t] = mean + group[g] + local[g, block(t)] + time[t] + error,

whose effects are shrunken means: mean * effect variance / (effect variance + error variance of the mean). The variance
components are estimated by moments from sums of squares, less what sampling error puts into them (see
:func:`components`), so small groups and cells are shrunk as much as their size asks for.
``local`` is the group's level within a block of days, nested in the group, so that a drifting level is followed.
Categorical fields: a multinomial model, log P(c) + log P(c | group) / P(c) + log P(c | time) / P(c), whose conditional
shares are shrunk towards the marginal ones. Every fill is marked in ``<field>_filled``.

All fits are ``groupBy`` aggregates with map-side combination, so a group that holds a third of all rows costs no more
than any other; effects come back through :func:`tesserae.plans.scale.lookup_join`.

Defined results: null groups or times get the mean plus whichever effect is known; a field without one usable value
stays null (nothing to fill from) but is marked; empty tables give empty tables; other columns pass through, and
existing ``<field>_filled`` columns are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions.missing import finite, stand_in_form
from tesserae.plans.scale import BROADCAST_ROWS, at_most, cut, lookup_join


@dataclass(frozen=True)
class Numeric:
    """A numeric field. ``zero_is_real``: a 0 is a reading (of a day without trade, say), which is kept but tells nothing
    about a level, so it takes no part in fits. ``far``: how many times off its group's level a positive reading must be to be none at all."""

    name: str
    zero_is_real: bool = False
    far: float = 8.0

    def impossible(self, x: Column, level: Column) -> Column:
        sign = x < 0 if self.zero_is_real else x <= 0
        off = (x > 0) & (level > 0) & (F.abs(F.ln(x) - F.ln(level)) > math.log(self.far))
        return F.coalesce(sign, F.lit(False)) | F.coalesce(off, F.lit(False))

    def log(self, x: Column) -> Column:
        return F.when(x > 0, F.log1p(x)) if self.zero_is_real else F.when(x > 0, F.ln(x))

    def back(self, y: Column) -> Column:
        return F.greatest(F.expm1(y), F.lit(0.0)) if self.zero_is_real else F.exp(y)


#: The fields of a daily bar.
BAR_FIELDS = (Numeric("close"), Numeric("volume", zero_is_real=True, far=50.0))


def stand_ins(df: DataFrame, fields: tuple[Numeric, ...], group: str, least_groups: int = 3, share: float = 0.02) -> DataFrame:
    """The constants feeds use for "no value", as (field, value): readings that cannot be and either have the form of
    such a constant or recur in at least ``least_groups`` groups and ``share`` of all groups with an impossible reading.
    A positive constant of fewer than five nines must recur in any case. ``df`` has ``_level_<field>``, its group's median."""
    found = F.array(*[F.when(f.impossible(finite(F.col(f.name)), F.col(f"_level_{f.name}")), F.struct(F.lit(f.name).alias("f"), finite(F.col(f.name)).alias("v"))) for f in fields])
    cells = df.select(F.col(group).alias("_group"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_x")).select(F.col("_x.f").alias("_field"), F.col("_x.v").alias("_value"), "_group")
    cells = cut(cells.groupBy("_field", "_value", "_group").count())  # impossible readings only, a row a distinct one
    each = cells.groupBy("_field", "_value").agg(F.count("_group").alias("_groups"))
    total = cells.groupBy("_field", "_group").count().groupBy("_field").agg(F.count("_group").alias("_all"))  # a row a field
    recurs = (F.col("_groups") >= least_groups) & (F.col("_groups") >= share * F.col("_all"))
    by_form = stand_in_form(F.col("_value")) & ((F.col("_value") <= 0) | (F.col("_value") >= 99999) | (F.col("_groups") >= 2))
    return each.join(F.broadcast(total), "_field").where(recurs | by_form).select("_field", "_value")  # broadcast: one row a field


def usable(df: DataFrame, fields: tuple[Numeric, ...] = BAR_FIELDS, group: str = "ticker") -> DataFrame:
    """``df`` with ``_ok_<field>``: the reading as double, or null where the cell is null, not finite or a stand-in."""
    levels = cut(
        df.groupBy(group).agg(*[F.percentile_approx(F.when(finite(F.col(f.name)) > 0, finite(F.col(f.name))), 0.5, 1000).alias(f"_level_{f.name}") for f in fields])
    )
    known = lookup_join(df, levels, [group])
    constants = cut(stand_ins(known, fields, group))
    out = known
    hint = F.broadcast if at_most(constants, BROADCAST_ROWS) else (lambda x: x)
    for f in fields:
        mine = hint(constants.where(F.col("_field") == f.name).select(F.col("_value").alias(f"_const_{f.name}")))
        x = finite(F.col(f.name))
        out = out.join(mine, finite(F.col(f.name)) == F.col(f"_const_{f.name}"), "left").withColumn(
            f"_ok_{f.name}", F.when(F.col(f"_const_{f.name}").isNotNull() & f.impossible(x, F.col(f"_level_{f.name}")), None).otherwise(x)
        )
    return out.drop(*[f"_level_{f.name}" for f in fields], *[f"_const_{f.name}" for f in fields])


def components(groups: DataFrame, f: str) -> list[Column]:
    """Aggregates over ``groups`` for the variance components of field ``f``, and ``mu``.

    With n_gb values in cell (g, b), N_g in group g, N in all, B_g cells and G groups, the sums of squares have the
    expectations (Henderson's first method)

        within cells    (N - B) ve
        cells in group  sum_g (N_g - sum_b n_gb^2 / N_g) vl + (B - G) ve
        groups          (N - sum_g N_g^2 / N) vg + (sum_gb n_gb^2 / N_g - sum_gb n_gb^2 / N) vl + (G - 1) ve

    which are solved from the top, floored at zero."""
    n, s = F.col("_N_" + f), F.col("_S_" + f)
    c = lambda k: F.coalesce(F.sum(f"_{k}_{f}"), F.lit(0.0))
    known = F.when(n > 0, 1).otherwise(0)
    total, mean_square = F.sum(n), F.sum(F.try_divide(s * s, n.cast("double"))) - F.try_divide(F.sum(s) * F.sum(s), F.sum(n).cast("double"))
    return [
        F.coalesce(total, F.lit(0)).alias("N_" + f), F.sum(known).alias("G_" + f), c("B").alias("B_" + f), F.try_divide(F.sum(s), total).alias("mu_" + f), c("W").alias("W_" + f), c("C").alias("C_" + f), F.coalesce(mean_square, F.lit(0.0)).alias("M_" + f),
        F.sum(F.try_divide(F.col("_Q_" + f).cast("double"), n)).alias("q_" + f), F.sum(F.col("_Q_" + f)).alias("Q_" + f), F.sum(n.cast("double") * n).alias("NN_" + f),
    ]


def solved(one: dict, f: str) -> tuple[float, float, float, float]:
    """(mu, ve, vl, vg) of :func:`components`' sums."""
    g = lambda k: float(one[f"{k}_{f}"] or 0)
    n, groups, cells = g("N"), g("G"), g("B")
    ve = max(g("W") / (n - cells), 1e-8) if n > cells else 1e-8
    room = n - g("q")
    vl = max((g("C") - (cells - groups) * ve) / room, 0.0) if room > 1e-9 else 0.0
    room = n - g("NN") / n if n else 0.0
    vg = max((g("M") - (g("q") - g("Q") / n) * vl - (groups - 1) * ve) / room, 0.0) if room > 1e-9 else 0.0
    return g("mu"), ve, vl, vg


def _cell_effects(rows: DataFrame, fields: tuple[Numeric, ...], group: str, y: str) -> DataFrame:
    """(group, _block) -> ``_e_<field>``: shrunken group effect plus the nested local one."""
    cells = cut(
        rows.groupBy(group, "_block").agg(
            *[c for f in fields for c in (F.count(y + f.name).alias("_n_" + f.name), F.sum(y + f.name).alias("_s_" + f.name), F.sum(F.col(y + f.name) ** 2).alias("_q_" + f.name))]
        )
    )
    sums = []
    for f in (x.name for x in fields):
        n, s, q = F.col("_n_" + f).cast("double"), F.col("_s_" + f), F.col("_q_" + f)
        square = F.try_divide(s * s, n)
        sums += [
            F.sum("_n_" + f).alias("_N_" + f), F.sum(s).alias("_S_" + f), F.sum(F.when(n > 0, 1).otherwise(0)).alias("_B_" + f), F.sum(n * n).alias("_Q_" + f), F.sum(q - square).alias("_W_" + f),
            (F.sum(square) - F.try_divide(F.sum(s) * F.sum(s), F.sum(n))).alias("_C_" + f),
        ]
    groups = cut(cells.groupBy(group).agg(*sums))
    one = groups.agg(*[c for f in fields for c in components(groups, f.name)]).first().asDict()
    run = Window.partitionBy(group).orderBy("_block")  # at most one row a block of the calendar
    effects = []
    for f in (x.name for x in fields):
        mu, ve, vl, vg = solved(one, f)
        n, s = F.col("_N_" + f).cast("double"), F.col("_S_" + f)
        noise = F.col("_Q_" + f) * vl / (n * n) + F.lit(ve) / n
        effects.append(F.when(n > 0, (s / n - mu) * F.try_divide(F.lit(vg), F.lit(vg) + noise)).otherwise(0.0).alias("_g_" + f))
    out = lookup_join(cells, cut(groups.select(group, *effects)), [group])
    for f in (x.name for x in fields):
        mu, ve, vl, _ = solved(one, f)
        n, g = F.col("_n_" + f), F.coalesce("_g_" + f, F.lit(0.0))
        out = out.withColumn("_l_" + f, F.when(n > 0, (F.col("_s_" + f) / n - mu - g) * (vl / (F.lit(vl) + F.lit(ve) / n))))
        before = F.last("_l_" + f, True).over(run.rowsBetween(Window.unboundedPreceding, -1))
        after = F.first("_l_" + f, True).over(run.rowsBetween(1, Window.unboundedFollowing))
        between = F.when(before.isNotNull() & after.isNotNull(), (before + after) / 2).otherwise(F.coalesce(before, after, F.lit(0.0)))
        out = out.withColumn("_e_" + f, F.lit(mu) + g + F.coalesce("_l_" + f, between))
    return cut(out.select(group, "_block", *["_e_" + f.name for f in fields]))


def fill_numeric(df: DataFrame, fields: tuple[Numeric, ...] = BAR_FIELDS, group: str = "ticker", time: str = "date", block_days: int = 10) -> DataFrame:
    """``df`` with each of ``fields`` filled (as double) and ``<field>_filled`` marking the filled cells."""
    ok = usable(df, fields, group)
    block = F.floor(F.datediff(F.col(time).cast("date"), F.lit("1970-01-01").cast("date")) / block_days)
    rows = ok.withColumns({"_block": block} | {"_y_" + f.name: f.log(F.col("_ok_" + f.name)) for f in fields})
    slim = cut(rows.select(group, time, "_block", *["_y_" + f.name for f in fields]))
    first = _cell_effects(slim, fields, group, "_y_")
    resid = lookup_join(slim, first, [group, "_block"]).withColumns({"_r_" + f.name: F.col("_y_" + f.name) - F.col("_e_" + f.name) for f in fields})
    times = cut(resid.groupBy(time).agg(*[c for f in fields for c in (F.count("_r_" + f.name).alias("_n_" + f.name), F.sum("_r_" + f.name).alias("_s_" + f.name), F.sum(F.col("_r_" + f.name) ** 2).alias("_q_" + f.name))]))
    sums = []
    for f in (x.name for x in fields):
        n, s, q = F.col("_n_" + f).cast("double"), F.col("_s_" + f), F.col("_q_" + f)
        square = F.try_divide(s * s, n)
        sums += [F.sum(n).alias("N_" + f), F.sum(F.when(n > 0, 1).otherwise(0)).alias("T_" + f), F.sum(q - square).alias("W_" + f), (F.sum(square) - F.try_divide(F.sum(s) * F.sum(s), F.sum(n))).alias("M_" + f), F.sum(n * n).alias("NN_" + f)]
    one = times.agg(*sums).first()
    effects = []
    for f in (x.name for x in fields):
        n, t, w, m, nn = (float(one[f"{k}_{f}"] or 0) for k in ("N", "T", "W", "M", "NN"))
        ve = max(w / (n - t), 1e-8) if n > t else 1e-8
        vt = max((m - (t - 1) * ve) / (n - nn / n), 0.0) if n and n - nn / n > 1e-9 else 0.0
        k = F.col("_n_" + f)
        effects.append(F.when(k > 0, F.col("_s_" + f) / k * (vt / (F.lit(vt) + F.lit(ve) / k))).otherwise(0.0).alias("_t_" + f))
    times = cut(times.select(time, *effects))
    rest = lookup_join(slim, times, [time]).withColumns({"_z_" + f.name: F.col("_y_" + f.name) - F.coalesce("_t_" + f.name, F.lit(0.0)) for f in fields})
    second = _cell_effects(rest, fields, group, "_z_")
    means = second.agg(*[F.avg("_e_" + f.name).alias(f.name) for f in fields]).first()
    out = lookup_join(lookup_join(rows, times, [time]), second, [group, "_block"])
    known = {f.name: slim.where(F.col("_y_" + f.name).isNotNull()).limit(1).count() > 0 for f in fields}
    for f in fields:
        guess = f.back(F.coalesce("_e_" + f.name, F.lit(means[f.name])) + F.coalesce("_t_" + f.name, F.lit(0.0)))
        here = F.col("_ok_" + f.name)
        out = out.withColumns({f.name: F.coalesce(here, guess) if known[f.name] else here, f.name + "_filled": here.isNull()})
    own = [c for c in df.columns if c not in {x.name for x in fields} | {x.name + "_filled" for x in fields}]
    return out.select(*own, *[f.name for f in fields], *[f.name + "_filled" for f in fields])


def fill_categorical(df: DataFrame, field: str, group: str, time: str, blank: tuple[str, ...] = ("", "-", "--", "n/a", "N/A", "unknown")) -> DataFrame:
    """``df`` with null, blank or dashed ``field`` filled by the most probable category of the multinomial model, and
    ``<field>_filled``. Candidates are the categories seen in the row's group and the best one of its time; ties go to
    the smaller name. A table without any category stays null."""
    value = F.trim(F.col(field))
    rows = df.withColumn("_c", F.when(~value.isin(*blank), F.col(field)))
    seen = rows.where(F.col("_c").isNotNull())
    gc = cut(seen.groupBy(group, "_c").agg(F.count("*").alias("_n")))
    tc = cut(seen.groupBy(time, "_c").agg(F.count("*").alias("_n")))
    every = Window.partitionBy(F.lit(1))  # a row a category, never a row a record
    marginal = cut(gc.groupBy("_c").agg(F.sum("_n").alias("_n")).withColumn("_p", F.col("_n") / F.sum("_n").over(every)).select("_c", "_p"))

    square = marginal.agg(F.sum(F.col("_p") ** 2)).first()[0] or 0.0

    def concentration(counts: DataFrame, key: str) -> float:
        """Of the Dirichlet prior, from how often two records of a key agree: A = S + (1 - S) / (1 + k)."""
        each = counts.groupBy(key).agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * (F.col("_n") - 1)).alias("same"))
        one = each.agg(F.sum("same").alias("same"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")).first()
        if not one["pairs"]:
            return 1.0
        agree = one["same"] / one["pairs"]
        return min(max((1 - agree) / max(agree - square, 1e-9), 0.05), 1000.0)

    def lift(counts: DataFrame, key: str, out: str) -> DataFrame:
        k = concentration(counts, key)
        total = F.sum("_n").over(Window.partitionBy(key))  # a row a category seen with the key
        shrunk = (F.col("_n") + k * F.col("_p")) / (total + k)
        return lookup_join(counts, marginal, ["_c"]).withColumn(out, F.ln(shrunk / F.col("_p"))).withColumn(out + "0", F.ln(k / (total + k))).select(key, "_c", out, out + "0", "_p")

    by_time, by_group = cut(lift(tc, time, "_lt")), cut(lift(gc, group, "_lg"))
    best_time = cut(by_time.withColumn("_s", F.ln("_p") + F.col("_lt")).groupBy(time).agg(F.max_by("_c", F.struct("_s", "_p")).alias("_best")))
    top = marginal.orderBy(F.desc("_p"), "_c").limit(1).collect()
    need = rows.where(F.col("_c").isNull()).select(group, time).distinct()
    mine = need.join(by_group.select(group, "_c"), group)
    candidates = mine.unionByName(need.join(best_time.withColumnRenamed("_best", "_c"), time).select(group, time, "_c")).distinct()
    empty_g = cut(by_group.groupBy(group).agg(F.first("_lg0").alias("_lg0")))
    empty_t = cut(by_time.groupBy(time).agg(F.first("_lt0").alias("_lt0")))
    scored = (
        lookup_join(candidates, marginal, ["_c"])
        .join(by_group.select(group, "_c", "_lg"), [group, "_c"], "left")
        .join(by_time.select(time, "_c", "_lt"), [time, "_c"], "left")
        .join(empty_g, group, "left")
        .join(empty_t, time, "left")
        .withColumn("_score", F.ln("_p") + F.coalesce("_lg", "_lg0", F.lit(0.0)) + F.coalesce("_lt", "_lt0", F.lit(0.0)))
    )
    # the smaller name wins a tie: min over the negated score
    chosen = cut(scored.groupBy(group, time).agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col("_c").alias("c"))).alias("_w")).select(group, time, F.col("_w.c").alias("_fill")))
    out = lookup_join(rows, chosen, [group, time])
    fallback = F.lit(top[0]["_c"]) if top else F.lit(None).cast("string")
    own = [c for c in df.columns if c not in (field, field + "_filled")]
    return out.select(*own, F.coalesce("_c", "_fill", fallback).alias(field), F.col("_c").isNull().alias(field + "_filled"))


def missing_cells(df: DataFrame, key: str = "bar_id", fields: tuple[Numeric, ...] = BAR_FIELDS, group: str = "ticker", time: str = "date") -> DataFrame:
    """The filled cells as (key, field), from :func:`fill_numeric`'s masks and fills."""
    filled = fill_numeric(df, fields, group, time)
    cells = F.array(*[F.struct(F.lit(f.name).alias("field"), F.col(f.name + "_filled").alias("hit")) for f in fields])
    return filled.select(key, F.explode(F.filter(cells, lambda c: c["hit"])).alias("_cell")).select(key, F.col("_cell.field").alias("field")).distinct()

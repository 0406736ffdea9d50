"""Top N rows within every group (problem 2): simultaneous bisection of all groups' cutoffs.

Every row has an order-preserving code, a tuple of 64-bit digits: the score (its IEEE bits, mirrored below zero, so that
integers sort like the doubles), then the identifier (tie columns; strings as 7-byte chunks). For each group the operator
keeps the interval [lo, hi] of the current digit in which its N-th row lies, splits it at midpoints into parts (``BITS``
bisection steps a pass), counts the rows above each, and narrows the interval to the part that holds the N-th row; rows
above are taken, rows below dropped. A group is finished when exactly as many rows as are missing lie above a midpoint;
one whose interval shrinks to a single value goes on with the next digit.

A pass is one aggregate with map-side combination over (group, part): no group is ever gathered, sorted or ranked, so
groups of millions of rows cost what their rows cost. The table itself is read three times, with the group and the score
in the first two; after that only rows inside intervals remain (about 2**-BITS of those above the first cutoffs). A digit
is worked out only where its group's interval is one of that digit, so tie columns cost nothing but for tied rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tesserae.plans.scale import BROADCAST_ROWS, cut, lookup_join

#: Bisection steps a pass.
BITS = 6
PARTS = 1 << BITS


def score_code(x: Column) -> Column:
    """A bigint that orders like the double ``x`` (its IEEE bits, negated below zero; -0.0 as 0.0). Null and NaN: null.

    The bits come from the JVM itself. Spark takes such a call for one that may differ each time, so it neither repeats it
    in filters nor copies it into several places, which costs more than the call."""
    x = x.cast("double")
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.abs(x)).cast("bigint")
    return F.when(x.isNull() | F.isnan(x), None).when(x < 0, -bits).otherwise(bits)


def text_chunks(x: Column, chunks: int) -> list[Column]:
    """Bigints that order like the bytes of the string ``x``, 7 bytes and their number each."""
    raw = F.encode(x, "UTF-8")
    out = []
    for k in range(chunks):
        part = F.substring(raw, 1 + 7 * k, 7)
        out.append(F.conv(F.rpad(F.hex(part), 14, "0"), 16, 10).cast("bigint") * 8 + F.octet_length(part))
    return out


def digits(df: DataFrame, column: str, descending: bool, longest: int = 0) -> list[Column]:
    """The digits of one column, larger meaning earlier; nulls come last. ``longest``: bytes of its longest string."""
    kind, x = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        codes = [score_code(x)]
    elif isinstance(kind, T.StringType):
        codes = text_chunks(x, max(1, -(-longest // 7)))
    elif isinstance(kind, T.TimestampType):
        codes = [F.unix_micros(x)]
    elif isinstance(kind, T.TimestampNTZType):
        codes = [F.unix_micros(x.cast("timestamp"))]
    elif isinstance(kind, T.DateType):
        codes = [F.unix_date(x).cast("bigint")]
    else:
        codes = [x.cast("bigint")]
    least = F.lit(-(1 << 63)).cast("bigint")
    return [F.coalesce(c if descending else F.bitwise_not(c), least) for c in codes]


def _digit(ds: list[Column]) -> Column:
    """The digit of the number in ``_digit``; branches that aren't taken aren't worked out."""
    out = F.lit(None).cast("bigint")
    for k in range(len(ds) - 1, 0, -1):
        out = F.when(F.col("_digit") == k, ds[k]).otherwise(out)
    return F.when(F.col("_digit") == 0, ds[0]).otherwise(out)


def _part(d: Column, lo: Column, hi: Column) -> Column:
    """Which part of [lo, hi] ``d`` lies in: monotone in ``d``, at most a few hundred parts; 0 where lo isn't known yet."""

    def quarter(c: Column) -> Column:
        return F.shiftright(c, 2)  # differences of quarters cannot overflow

    span = quarter(hi) - quarter(lo)
    wide = F.floor((quarter(d) - quarter(lo)) / (F.floor(span / PARTS) + 1))
    return F.when(lo.isNull(), F.lit(0)).when(span >= PARTS, wide).otherwise(d - lo).cast("bigint")


def _narrowed(counts: DataFrame) -> DataFrame:
    """State after a pass. ``counts``: (_g, _digit, _need, _part, _n, _mn, _mx), a few hundred rows a group at most.

    Of each group: rows with digit above ``_hi`` are taken, those in [_lo, _hi] stay; ``_done`` takes those as well."""
    above = F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = counts.withColumn("_above", above).where((F.col("_above") < F.col("_need")) & (F.col("_above") + F.col("_n") >= F.col("_need")))
    done = F.col("_above") + F.col("_n") <= F.col("_need")
    single = F.col("_mn") == F.col("_mx")
    return at.select(
        "_g", "_digit", F.col("_mn").alias("_lo"), F.col("_mx").alias("_hi"), (F.col("_need") - F.col("_above")).alias("_need"), done.alias("_done"),
        (single & ~done).alias("_next"),
    )


def top_n(df: DataFrame, group: list[str], score: str, n: int, ties: list[tuple[str, bool]], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The ``n`` rows of highest ``score`` of every group; ``ties``: (column, descending) that order equal scores.

    Null and NaN scores take no part. Null groups are a group, null tie values come last. Where rows equal in all of
    these compete for the last places, those with the larger hash of the whole row go first; equal rows are
    interchangeable, and as many as places are left are returned. Groups of fewer than ``n`` rows come whole. Beyond
    ``broadcast_rows`` groups the cutoffs are joined by a shuffle, salted for groups that hold more than their share."""
    columns = df.columns
    x = F.col(score).cast("double")
    coded = df.where(x.isNotNull() & ~F.isnan(x)).select(*columns, F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)]).alias("_g"), score_code(x).alias("_s"))
    texts = [c for c, _ in ties if isinstance(df.schema[c].dataType, T.StringType)]
    sizes = [F.max(F.octet_length(c)).alias(f"_o{i}") for i, c in enumerate(texts)]
    first = cut(coded.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.min("_s").alias("_lo"), F.max("_s").alias("_hi"), *sizes))
    most = first.agg(*[F.max(f"_o{i}") for i in range(len(texts))]).first() if texts else ()
    longest = {c: most[i] or 0 for i, c in enumerate(texts)}
    ds = [F.col("_s")] + [x for c, desc in ties for x in digits(df, c, desc, longest.get(c, 0))] + [F.xxhash64(*[F.col(c) for c in columns])]
    state = first.select("_g", F.lit(0).alias("_digit"), "_lo", "_hi", F.lit(n).cast("bigint").alias("_need"), (F.col("_n") <= n).alias("_done"))
    rows, taken = coded, []
    while True:
        joined = lookup_join(rows, state, ["_g"], "inner", broadcast_rows)
        counts = (
            joined.where(~F.col("_done")).withColumn("_x", _digit(ds))
            .groupBy("_g", "_digit", "_need", _part(F.col("_x"), F.col("_lo"), F.col("_hi")).alias("_part"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
        )
        narrowed = cut(_narrowed(counts))
        whole = state.where("_done").select("_g", "_digit", "_lo", "_hi", "_need", "_done", F.lit(False).alias("_next"))
        decided = cut(narrowed.unionByName(whole))
        split = lookup_join(rows, decided, ["_g"], "inner", broadcast_rows).withColumn("_x", _digit(ds)).where(F.col("_x") >= F.col("_lo"))
        split = cut(split.select(*columns, "_g", "_s", (F.col("_done") | (F.col("_x") > F.col("_hi"))).alias("_take")))
        taken.append(split.where("_take").select(*columns))
        rows = split.where(~F.col("_take")).drop("_take")
        state = decided.where(~F.col("_done")).select(
            "_g",
            F.when(F.col("_next"), F.col("_digit") + 1).otherwise(F.col("_digit")).alias("_digit"),
            F.when(~F.col("_next"), F.col("_lo")).alias("_lo"),
            F.when(~F.col("_next"), F.col("_hi")).alias("_hi"),
            "_need",
            F.lit(False).alias("_done"),
        )
        spent = state.where(F.col("_digit") >= len(ds))
        if spent.limit(1).count():
            # rows equal in every digit, so copies of each other: any of them; the limit before the shuffle keeps a task
            # from holding more than n rows of a group
            w = Window.partitionBy("_g").orderBy(F.lit(1))
            rest = lookup_join(rows, cut(spent.select("_g", F.col("_need").alias("_left"))), ["_g"], "inner", broadcast_rows)
            taken.append(rest.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).where(F.col("_k") <= F.col("_left")).select(*columns))
            state = state.where(F.col("_digit") < len(ds))
        if not state.limit(1).count():
            return reduce(DataFrame.unionByName, taken)
        state = cut(state)

"""Table preparation of incoming sources: projections, normalising, samples of entities, parsing of text payloads."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tesserae.functions.missing import finite
from tesserae.plans.scale import cut, lookup_join

BAR = ("open", "high", "low", "close", "volume")


def projected(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """``columns`` in that order, doubles rounded."""
    doubles = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in columns])


def normalised_bars(df: DataFrame, entity: str, time: str, zone: str | None = None, fields: tuple[str, ...] = BAR) -> DataFrame:
    """Bars fit to use: without rows that are unknown throughout, with all prices known, times given in ``zone`` (from UTC),
    one row an (entity, time): of copies, the one with the largest readings."""
    prices = [c for c in fields if c != "volume"]
    known = [finite(F.col(c)).isNotNull() for c in prices]
    ok = known[0]
    for k in known[1:]:
        ok = ok & k
    when = F.from_utc_timestamp(F.col(time), zone) if zone else F.col(time)
    rows = df.where(ok & F.col(time).isNotNull()).withColumn(time, when)
    others = [c for c in rows.columns if c not in (entity, time)]
    return rows.groupBy(entity, time).agg(F.max(F.struct(*others)).alias("_s")).select(entity, time, *[F.col(f"_s.{c}").alias(c) for c in others])


def _numbered(names: DataFrame, entity: str, *order: Column) -> DataFrame:
    """Names with their place; a row a name, ordered by range partitions with offsets, so no task sorts them all."""
    from tesserae.plans.scale import running_total

    keyed = names.withColumn("_o", F.concat_ws("\x01", *[o.cast("string") for o in order])).withColumn("_c", F.lit(1))
    placed = running_total(keyed, "_o", "_c")
    return placed.select(entity, (F.col("_upto") - 1).alias("_place"), F.col("_all").alias("_names"))


def sampled_entities(df: DataFrame, entity: str, percent: float, seed: int) -> DataFrame:
    """The rows of a seeded ``percent`` of the entities (at least one), the same on every run: those of smallest hash."""
    names = df.where(F.col(entity).isNotNull()).select(entity).distinct()
    placed = cut(_numbered(names, entity, F.lpad(F.hex(F.xxhash64(F.lit(seed), F.col(entity))), 16, "0"), F.col(entity)))
    keep = placed.where(F.col("_place") < F.greatest(F.ceil(F.col("_names") * percent / 100), F.lit(1))).select(entity)
    return lookup_join(df, cut(keep), [entity], "inner").select(*df.columns)


def first_entities(df: DataFrame, entity: str, percent: float) -> DataFrame:
    """The rows of the first ``percent`` of the entities by name (at least one)."""
    placed = cut(_numbered(df.where(F.col(entity).isNotNull()).select(entity).distinct(), entity, F.col(entity)))
    keep = placed.where(F.col("_place") < F.greatest(F.floor(F.col("_names") * percent / 100), F.lit(1))).select(entity)
    return lookup_join(df, cut(keep), [entity], "inner").select(*df.columns)


def strided_entities(df: DataFrame, entity: str, count: int) -> DataFrame:
    """The rows of ``count`` entities spread evenly over their names: places floor(i * names / count)."""
    placed = cut(_numbered(df.where(F.col(entity).isNotNull()).select(entity).distinct(), entity, F.col(entity)))
    # a place p is floor(i n / k) for some i exactly when ceil(p k / n) n / k falls below p + 1
    i = F.ceil(F.col("_place") * F.lit(float(count)) / F.col("_names"))
    keep = placed.where((F.floor(i * F.col("_names") / F.lit(float(count))) == F.col("_place")) & (i < count)).select(entity)
    return lookup_join(df, cut(keep), [entity], "inner").select(*df.columns)


def date_column(df: DataFrame) -> str:
    """The column that holds dates: the first whose name says so (any case), else the first of a date type; otherwise an
    error."""
    for c in df.columns:
        if c.strip().lower() in ("date", "record_date", "record date", "day", "observation_date"):
            return c
    for f in df.schema:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return f.name
    raise ValueError(f"no date among {df.columns}")


def with_date(df: DataFrame, formats: tuple[str, ...] = ("MM/dd/yyyy", "yyyy-MM-dd", "yyyyMMdd")) -> DataFrame:
    """``df`` with its date column (see :func:`date_column`) as ``date``; texts of any of ``formats``, null otherwise."""
    name = date_column(df)
    x = F.col(f"`{name}`")
    parsed = x.cast("date") if not isinstance(df.schema[name].dataType, T.StringType) else F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in formats]).cast("date")
    return df.withColumn("_d", parsed).drop(name).withColumnRenamed("_d", "date")


def coerced(df: DataFrame, keep: list[str]) -> DataFrame:
    """All columns but ``keep`` as numbers (null where they are none); rows without any number are left out."""
    numbers = [c for c in df.columns if c not in keep]
    out = df.select(*keep, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in numbers])
    return out.where(F.coalesce(*numbers).isNotNull()) if numbers else out


def short_volumes(spark: SparkSession, path: str) -> DataFrame:
    """Daily short-volume files (pipe-delimited, header, a count as the last line): (date, symbol, short, total, market)."""
    raw = spark.read.option("header", "true").option("delimiter", "|").schema("Date string, Symbol string, ShortVolume string, ShortExemptVolume string, TotalVolume string, Market string").csv(path)
    rows = raw.select(F.try_to_timestamp("Date", F.lit("yyyyMMdd")).cast("date").alias("date"), F.col("Symbol").alias("symbol"), F.col("ShortVolume").try_cast("double").alias("short"), F.col("TotalVolume").try_cast("double").alias("total"), F.col("Market").alias("market"))
    return rows.where("date is not null and symbol is not null")


def page_views(df: DataFrame, payload: str, key: str) -> DataFrame:
    """(key, date, views) of JSON {"items": [{"timestamp": "yyyyMMddHH", "views": n}]}."""
    items = F.from_json(payload, "items array<struct<timestamp:string,views:bigint>>")["items"]
    return df.select(key, F.explode(items).alias("i")).select(key, F.try_to_timestamp(F.substring("i.timestamp", 1, 8), F.lit("yyyyMMdd")).cast("date").alias("date"), F.col("i.views").alias("views")).where("date is not null")


_ANSI = "\x1b\\[[0-9;]*m"


def log_metrics(lines: DataFrame, line: str, patterns: dict[str, str]) -> DataFrame:
    """(metric, value) of log lines: colour codes go, and each pattern's first group is a number where it matches."""
    plain = F.regexp_replace(F.col(line), _ANSI, "")
    found = F.array(*[F.struct(F.lit(n).alias("metric"), F.regexp_replace(F.regexp_extract(plain, p, 1), "[,%$]", "").try_cast("double").alias("value")) for n, p in patterns.items()])
    return lines.select(F.explode(found).alias("m")).select("m.*").where("value is not null")


def append_csv(df: DataFrame, folder: str) -> None:
    """Append rows as CSV; every part file has the header, so that a reader with header sees it once."""
    df.write.mode("append").option("header", "true").csv(folder)


def score_sink(df: DataFrame, folder: str, keys: list[str], score: str) -> DataFrame:
    """Write the scores as Parquet and a one-row summary (rows, mean, least, most) as JSON beside them; returns the summary."""
    df.select(*keys, score).write.mode("overwrite").parquet(f"{folder}/scores")
    kept = df.sparkSession.read.parquet(f"{folder}/scores")
    summary = kept.agg(F.count(F.lit(1)).alias("rows"), F.avg(score).alias("mean"), F.min(score).alias("least"), F.max(score).alias("most"))
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    return summary


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    from tesserae.plans.scale import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A file of ``content``, written under another name and then renamed, so that it is there as a whole or not at all."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(p(path + ".part"), True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    fs.rename(p(path + ".part"), p(path))


def entity_from_path(df: DataFrame, entity: str, pattern: str = r"([^/]+?)(?:\.[A-Za-z0-9.]+)?$") -> DataFrame:
    """``df`` with ``entity`` taken from the path of the file a row comes from, by default its name without suffix."""
    return df.withColumn(entity, F.regexp_extract(F.input_file_name(), pattern, 1))


# row selections ----------------------------------------------------------------------------------------------------
def trailing_days(df: DataFrame, entity: str, time: str, last, days: int = 400, least: int = 252) -> DataFrame:
    """The rows of the ``days`` up to ``last``, of the entities with at least ``least`` of them."""
    end = F.lit(last).cast("date")
    rows = df.where((F.col(time) <= end) & (F.col(time) > F.date_sub(end, days)))
    enough = cut(rows.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(entity))
    return lookup_join(rows, enough, [entity], "inner").select(*df.columns)


def common_start(df: DataFrame, entity: str, time: str, retention: float = 0.9, least_days: int = 60) -> DataFrame:
    """Rows from the first day that at least ``retention`` of the entities have and from which as many have ``least_days``
    rows, of the entities that have those; empty where there is no such day.

    An entity has ``least_days`` rows from every day up to its ``least_days``-th last, so the days are counted, not joined."""
    rows = df.where(F.col(entity).isNotNull() & F.col(time).isNotNull())
    w = Window.partitionBy(entity).orderBy(F.desc(time))
    days = rows.select(entity, time).distinct()
    latest = cut(days.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == least_days).select(entity, F.col(time).alias("_latest")))
    names = days.select(entity).distinct().count()
    per_day = {r[0]: r[1] for r in days.groupBy(time).count().collect()}  # a row a day of the calendar
    ends = sorted((r[0], r[1]) for r in latest.groupBy("_latest").count().collect())
    need = retention * names
    for day in sorted(per_day):
        if per_day[day] >= need and sum(n for e, n in ends if e >= day) >= need:
            kept = lookup_join(rows.where(F.col(time) >= F.lit(day)), cut(latest.where(F.col("_latest") >= F.lit(day))), [entity], "inner")
            return kept.select(*df.columns)
    return df.limit(0)


def trimmed_labels(df: DataFrame, label: str, entity: str, most: float = 5.0, least_rows: int = 61) -> DataFrame:
    """Rows with a known label within ``most`` of zero, of the entities that have ``least_rows`` of them."""
    rows = df.where(finite(F.col(label)).isNotNull() & (F.abs(F.col(label)) <= most))
    enough = cut(rows.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_rows).select(entity))
    return lookup_join(rows, enough, [entity], "inner").select(*df.columns)


def feature_columns(df: DataFrame, exclude: set[str], patterns: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns without those of ``exclude`` and those whose name matches a pattern, in order."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return [c for c in numeric if c not in exclude and not any(re.search(p, c) for p in patterns)]


def value_at(df: DataFrame, entity: str, time: str, value: str, anchor, rows: int = 21) -> DataFrame:
    """(entity, at, median): the last known value on or before ``anchor`` and the median of the last ``rows`` ones."""
    w = Window.partitionBy(entity).orderBy(F.desc(time))
    before = df.where((F.col(time) <= F.lit(anchor).cast("date")) & F.col(value).isNotNull())
    last = before.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= rows)
    return last.groupBy(entity).agg(F.max(F.when(F.col("_k") == 1, F.col(value))).alias("at"), F.expr(f"percentile({value}, 0.5)").alias("median"))


def spans_to_days(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, day): the distinct business days that any of an entity's spans covers; spans that end before they start
    cover none."""
    ok = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    days = ok.select(entity, F.explode(F.filter(F.sequence(F.col(start), F.col(end)), lambda d: F.weekday(d) < 5)).alias("day"))
    return days.distinct()


def scaled_caps(prices: DataFrame, caps: DataFrame, entity: str, time: str, price: str, cap: str, anchor, rows: int = 21) -> DataFrame:
    """``prices`` with ``market_cap``: shares are the known cap over the median of the last prices up to ``anchor``."""
    at = value_at(prices, entity, time, price, anchor, rows)
    shares = cut(at.join(caps.select(entity, cap), entity).select(entity, F.try_divide(cap, "median").alias("_shares")))
    return lookup_join(prices, shares, [entity], "inner").withColumn("market_cap", F.col(price) * F.col("_shares")).drop("_shares")

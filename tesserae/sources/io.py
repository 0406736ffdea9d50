"""Reading and writing tables of several formats, profiles and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READERS = {"parquet": {}, "csv": {"header": "true"}, "json": {}, "orc": {}, "txt": {}, "xml": {}}


def load(spark: SparkSession, source: str | DataFrame, schema: str | None = None, columns: list[str] | None = None, **options: str) -> DataFrame:
    """A table from a path by its suffix (parquet, csv, json, orc, xml need ``rowTag``, txt gives one column ``Line``), or
    a DataFrame as it is. Parquet schemas are merged, so files may differ in columns. Another suffix is an error."""
    if isinstance(source, DataFrame):
        df = source
    else:
        kind = source.rstrip("/").rsplit(".", 1)[-1].lower()
        if kind not in READERS:
            raise ValueError(f"no reader for .{kind}")
        if kind == "txt":
            return spark.read.text(source).withColumnRenamed("value", "Line")
        reader = spark.read.options(**READERS[kind], **({"mergeSchema": "true"} if kind == "parquet" else {}), **options)
        df = (reader.schema(schema) if schema else reader).format(kind).load(source)
    return df.select(*columns) if columns else df


def save(df: DataFrame, path: str, partition: list[str] | None = None, mode: str = "overwrite", files: int | None = None) -> None:
    """Write by suffix; ``partition`` makes one folder a value, first clustered so that each has few files."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    out = df.repartition(*partition) if partition else df.coalesce(files) if files else df
    w = out.write.mode(mode).format(kind).options(**({"header": "true"} if kind == "csv" else {}))
    (w.partitionBy(*partition) if partition else w).save(path)


def profile(df: DataFrame) -> DataFrame:
    """(column, type, rows, known, distinct_approx, least, most), all in one pass."""
    n = F.count(F.lit(1))
    stats = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), n.alias("rows"), F.count(f.name).alias("known"), F.approx_count_distinct(f.name).alias("distinct_approx"),
                      F.min(F.col(f.name).cast("string")).alias("least"), F.max(F.col(f.name).cast("string")).alias("most")) for f in df.schema]
    return df.agg(F.array(*stats).alias("_s")).select(F.explode("_s").alias("_r")).select("_r.*")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(suffix, files, bytes, newest) of a folder tree, from metadata only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    return files.groupBy(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).alias("suffix")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest"))


def inventory_by(listing: DataFrame, by: str, size: str, rows: str) -> DataFrame:
    """(by, files, bytes, n_rows) of a listing of files; unknown sizes and counts add nothing."""
    known = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    return listing.groupBy(by).agg(F.count(F.lit(1)).alias("files"), known(size).alias("bytes"), known(rows).alias("n_rows"))


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256) of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.sha2("content", 256).alias("sha256"))


def cached(spark: SparkSession, path: str, build, max_age_hours: float = 24.0) -> DataFrame:
    """The Parquet table at ``path`` if it is complete and younger than ``max_age_hours``, otherwise what ``build()`` gives,
    written beside it first and then renamed over it, so that readers see a whole table or the one before."""
    import time

    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    at, beside, mark = make(path), make(path + ".next"), make(path + "/_SUCCESS")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not (fs.exists(mark) and time.time() - fs.getFileStatus(mark).getModificationTime() / 1000 < max_age_hours * 3600):
        build().write.mode("overwrite").parquet(path + ".next")
        fs.delete(at, True)
        fs.rename(beside, at)
    return spark.read.parquet(path)


def unzipped(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """(path, member, text) of the members of ZIP files whose name matches ``pattern``, a member at a time; files that are
    no ZIP give nothing."""
    import io as memory
    import re
    import zipfile

    def members(batches):
        import pandas as pd

        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                raw = memory.BytesIO(content)
                if not zipfile.is_zipfile(raw):
                    continue
                with zipfile.ZipFile(raw) as z:
                    for name in z.namelist():
                        if re.fullmatch(pattern, name):
                            yield pd.DataFrame({"path": [p], "member": [name], "text": [z.read(name).decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "path string, member string, text string")


def text_rows(df: DataFrame, text: str, keep: list[str], delimiter: str = ",") -> DataFrame:
    """(keep, line number, cells) of delimited texts, without blank lines."""
    lines = F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line", "_l")
    return df.select(*keep, lines).where(F.trim("_l") != "").select(*keep, "line", F.transform(F.split("_l", "\\Q" + delimiter + "\\E"), lambda c: F.trim(c)).alias("cells"))


def form_index(df: DataFrame, line: str) -> DataFrame:
    """(cik, company, form, filed, path) of the pipe-delimited lines of a quarterly form index; its head is left out."""
    c = F.split(F.col(line), r"\|")
    rows = df.where(F.size(c) == 5).select(c[0].try_cast("bigint").alias("cik"), F.trim(c[1]).alias("company"), F.trim(c[2]).alias("form"), F.expr(f"try_cast(split({line}, '[|]')[3] AS date)").alias("filed"), F.trim(c[4]).alias("path"))
    return rows.where("cik is not null and filed is not null")


def feed(spark: SparkSession, path: str, item: str = "item") -> DataFrame:
    """Articles (title, link, description, published) of RSS or Atom files; missing elements are null."""
    df = spark.read.format("xml").option("rowTag", item).schema("title string, link string, description string, summary string, pubDate string, updated string, guid string").load(path)
    return df.select("title", "link", F.coalesce("description", "summary").alias("description"), F.coalesce("pubDate", "updated").alias("published"), "guid")


def atom(spark: SparkSession, path: str) -> DataFrame:
    """Articles of Atom files: the link is an attribute; of several, the first."""
    kind = "title string, link array<struct<_href:string>>, summary string, content string, updated string, published string, id string"
    df = spark.read.format("xml").option("rowTag", "entry").schema(kind).load(path)
    return df.select("title", F.col("link")[0]["_href"].alias("link"), F.coalesce("summary", "content").alias("description"), F.coalesce("published", "updated").alias("published"), F.col("id").alias("guid"))


def observations(df: DataFrame, payload: str, key: str) -> DataFrame:
    """(key, date, value) of JSON series {"observations": [{"date": ..., "value": ...}]}; values that are no number, and
    dates that are none, are left out."""
    parsed = F.from_json(payload, "observations array<struct<date:string,value:string>>")
    rows = df.select(key, F.explode(parsed["observations"]).alias("o"))
    return rows.select(key, F.expr("try_cast(o.date as date)").alias("date"), F.expr("try_cast(o.value as double)").alias("value")).where("date is not null and value is not null")


def columnar_json(df: DataFrame, payload: str) -> DataFrame:
    """Rows of JSON {"fields": [...], "data": [[...], ...]} as a map from field to text."""
    parsed = F.from_json(payload, "fields array<string>, data array<array<string>>")
    return df.select(parsed.alias("p")).select(F.col("p.fields").alias("f"), F.explode("p.data").alias("d")).select(F.map_from_arrays("f", "d").alias("row"))


def business_days(start: Column, end: Column) -> Column:
    """The weekdays from ``start`` to ``end``."""
    return F.filter(F.sequence(start, end), lambda d: F.weekday(d) < 5)


def released_quarters(start: Column, today: Column, lag_days: int = 120) -> Column:
    """The first days of the quarters since ``start`` that are released, ``lag_days`` after they begin."""
    return F.filter(F.sequence(F.trunc(start, "quarter"), today, F.expr("interval 3 months")), lambda q: F.date_add(q, lag_days) <= today)


def numeric_suffix(x: Column) -> Column:
    """Numbers such as 1.5B, 20M, 3K, 12% or (4.2) as double; null for anything else."""
    plain = F.regexp_replace(F.trim(x), r"[$,\s]", "")
    sign = F.when(plain.startswith("("), -1.0).otherwise(1.0)
    m = F.regexp_extract(plain, r"^\(?(-?\d+\.?\d*)([BMK%]?)\)?$", 1)
    unit = F.regexp_extract(plain, r"^\(?(-?\d+\.?\d*)([BMK%]?)\)?$", 2)
    scale = F.when(unit == "B", 1e9).when(unit == "M", 1e6).when(unit == "K", 1e3).when(unit == "%", 0.01).otherwise(1.0)
    return F.when(m != "", m.try_cast("double") * scale * sign)

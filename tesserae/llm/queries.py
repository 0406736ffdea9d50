"""Queries of the problems 2, 6, 7, 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import pack as packing
from tesserae.llm import percentiles as pct
from tesserae.llm.leaks import leaks
from tesserae.llm.residue import residue, without_residue
from tesserae.llm.topn import top_n

PROBABILITIES = [0.01, 0.25, 0.5, 0.75, 0.9, 0.99]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "rfpredictions").select("pred_id", "date", "ticker", "upprobability")
    return top_n(rows, ["date"], "upprobability", 10, [("ticker", False), ("pred_id", False)]).select("pred_id").distinct()


def p2_best_by_model(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "rfpredictions").select("pred_id", "date", "model_tag", "ticker", "upprobability")
    return top_n(rows, ["date", "model_tag"], "upprobability", 3, [("ticker", False), ("pred_id", False)])


def p6_ranks_by_date(spark: SparkSession, d: str) -> DataFrame:
    return pct.cumulative(pct.value_counts(_table(spark, d, "rfpredictions"), ["date"], "upprobability"), ["date"])


def p6_percentiles_by_date(spark: SparkSession, d: str) -> DataFrame:
    return pct.percentiles(pct.value_counts(_table(spark, d, "rfpredictions"), ["date"], "upprobability"), ["date"], PROBABILITIES)


def p6_percentiles_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Put together from the summaries of the days."""
    days = pct.value_counts(_table(spark, d, "rfpredictions"), ["model_tag", "date"], "upprobability")
    return pct.percentiles(pct.merge(days.drop("date")), ["model_tag"], PROBABILITIES)


def p6_p99_by_feature(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "distribution_summary").withColumn("feature", F.lower("feature"))
    return pct.percentiles(pct.value_counts(rows, ["feature"], "p99"), ["feature"], PROBABILITIES)


def p6_bounded_by_date(spark: SparkSession, d: str) -> DataFrame:
    """Within 0.1 percent, from summaries of bounded size."""
    counts = pct.value_counts(_table(spark, d, "rfpredictions"), ["date"], "upprobability", 0.001)
    return pct.percentiles(counts, ["date"], PROBABILITIES, 0.001)


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_table(spark, d, "documents"), _table(spark, d, "container_specs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("pieces > 1").select("spec_id", "doc_id").distinct()


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """What the packing keeps, whatever it looks like: all tokens, containers within their capacity, and at most
    1.05 times as many of them as the tokens need, plus 20 (``well_filled``)."""
    f = packing.fill(_packed(spark, d), _table(spark, d, "container_specs"))
    fits = _table(spark, d, "container_specs").select("spec_id", "capacity_tokens")
    return f.join(fits, "spec_id").select("spec_id", "items", "tokens", (F.col("fullest") <= F.col("capacity_tokens")).alias("within"), "least", (F.col("containers") <= 1.05 * F.col("least") + 20).alias("well_filled"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items")).select("doc_id", "eval_id").distinct()


def p8_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """Of the leaks, those in which the whole passage stands letter by letter."""
    docs, items = _table(spark, d, "documents").select("doc_id", "text"), _table(spark, d, "eval_items").select("eval_id", "passage")
    found = leaks(docs, items).select("doc_id", "eval_id").distinct()
    return found.join(docs, "doc_id").join(items, "eval_id").where(F.contains("text", "passage")).select("doc_id", "eval_id")


def p9_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each reason takes out."""
    return residue(_table(spark, d, "documents")).groupBy("reason").agg(F.count_distinct("doc_id").alias("documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue(_table(spark, d, "documents")).select("doc_id").distinct()


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    return without_residue(_table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_best_by_model, p6_ranks_by_date, p6_percentiles_by_date, p6_percentiles_by_model, p6_p99_by_feature, p6_bounded_by_date, p7_found, p7_containers, p7_fill, p8_found, p8_verbatim, p9_found, p9_kept, p9_reasons)}

_SCORED = "upprobability IS NOT NULL AND NOT isnan(upprobability)"


def _percentiles(table: str, group: str, value: str, where: str = "") -> str:
    picks = ", ".join(
        f"min(CASE WHEN upto >= greatest(1, ceil(total * {p} - 1e-9)) THEN v END) AS p{p * 100:g}" for p in PROBABILITIES
    )
    return f"""SELECT {group}, any_value(total) AS n, {picks}, CAST(0 AS DOUBLE) AS error FROM (
SELECT {group}, v, count(*) OVER (PARTITION BY {group} ORDER BY v RANGE UNBOUNDED PRECEDING) AS upto, count(*) OVER (PARTITION BY {group}) AS total
FROM (SELECT {group}, {value} + 0.0 AS v FROM {table} WHERE (isfinite({value}) OR isinf({value})) {where})) GROUP BY {group}"""


ORACLE = {
    "p2_found": f"SELECT pred_id FROM (SELECT pred_id, row_number() OVER (PARTITION BY date ORDER BY upprobability DESC, ticker, pred_id) AS k FROM rfpredictions WHERE {_SCORED}) WHERE k <= 10",
    "p2_best_by_model": f"SELECT pred_id, date, model_tag, ticker, upprobability FROM (SELECT *, row_number() OVER (PARTITION BY date, model_tag ORDER BY upprobability DESC, ticker NULLS LAST, pred_id) AS k FROM rfpredictions WHERE {_SCORED}) WHERE k <= 3",
    "p6_ranks_by_date": f"""SELECT date, value, n, sum(n) OVER (PARTITION BY date ORDER BY value ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY date) AS total
FROM (SELECT date, upprobability AS value, count(*) AS n FROM rfpredictions WHERE {_SCORED} GROUP BY ALL)""",
    "p6_percentiles_by_date": _percentiles("rfpredictions", "date", "upprobability"),
    "p6_percentiles_by_model": _percentiles("rfpredictions", "model_tag", "upprobability"),
    "p6_p99_by_feature": _percentiles("(SELECT lower(feature) AS feature, p99 FROM distribution_summary) AS s", "feature", "p99"),
    "p8_verbatim": "SELECT doc_id, eval_id FROM documents, eval_items WHERE contains(text, passage)",
    "p7_fill": """SELECT spec_id, count(*) FILTER (n > 0) AS items, CAST(sum(n) AS BIGINT) AS tokens, true AS within, CAST(ceil(sum(n) / capacity_tokens) AS BIGINT) AS least, true AS well_filled
FROM (SELECT coalesce(octet_length(encode(text)), 0) AS n FROM documents), container_specs GROUP BY spec_id, capacity_tokens""",
    "p7_found": "SELECT spec_id, doc_id FROM documents, container_specs WHERE octet_length(encode(text)) > capacity_tokens",
}

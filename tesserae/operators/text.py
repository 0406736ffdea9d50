"""Text columns: cleaning, dates, sentiment, complexity and mentions, all as expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.plans.scale import cut, lookup_join

# Sentiment words; strong ones count 2.
STRONG_POSITIVE = ["surge", "soar", "rally", "breakthrough", "record"]
POSITIVE = ["gain", "rise", "boost", "profit", "beat", "outperform", "upgrade", "bullish", "growth", "strong", "exceed", "recovery"]
STRONG_NEGATIVE = ["crash", "plunge", "tumble", "collapse"]
NEGATIVE = ["fall", "drop", "decline", "loss", "miss", "cut", "downgrade", "bearish", "weak", "concern", "risk", "disappointing", "warning"]
# Terms of the finance density.
FINANCE = (
    "arbitrage volatility momentum reversal spread delta gamma theta vega hedge portfolio correlation regression stochastic brownian monte carlo scholes binomial derivatives quantitative "
    "algorithmic liquidity execution slippage alpha beta sharpe sortino drawdown backtesting optimization cointegration stationary"
).split()
# The formats publication dates come in.
DATE_FORMATS = ["EEE, dd MMM yyyy HH:mm:ss Z", "dd MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
#: Variants of a company name must be longer than this; how many names one pass over the texts looks for.
NAME_LETTERS, NAMES = 3, 50_000
#: A letter, digit or underscore of any script.
_WORD = r"[\p{L}\p{N}_]"


def without_tags(x: Column) -> Column:
    return F.regexp_replace(x, "<.*?>", "")


def publication_time(x: Column) -> Column:
    """A timestamp from any of the known formats; null where none fits."""
    plain = F.regexp_replace(F.trim(x), r"^[A-Z][a-z]{2}, ", "")  # the weekday says nothing more
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in DATE_FORMATS if not f.startswith("EEE")])


def _hits(lower: Column, words: list[str], weight: int) -> Column:
    return reduce(lambda a, b: a + b, [F.when(lower.contains(w), weight).otherwise(0) for w in words])


def with_sentiment(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``sentiment_score`` in (-1, 1), (p - n) / (p + n + 5), and ``sentiment``. Null texts score 0."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    p = _hits(low, STRONG_POSITIVE, 2) + _hits(low, POSITIVE, 1)
    n = _hits(low, STRONG_NEGATIVE, 2) + _hits(low, NEGATIVE, 1)
    df = df.withColumns({"_p": p, "_n": n})
    score = F.when(F.col("_p") + F.col("_n") == 0, F.lit(0.0)).otherwise((F.col("_p") - F.col("_n")) / (F.col("_p") + F.col("_n") + 5))
    df = df.withColumn("sentiment_score", score).drop("_p", "_n")
    return df.withColumn("sentiment", F.when(F.col("sentiment_score") > 0.25, "positive").when(F.col("sentiment_score") < -0.25, "negative").otherwise("neutral"))


def with_complexity(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``complexity``: sentence length, word length, finance terms, long words, variety and notation. Words are
    runs of letters, digits and underscores of any script. Null texts and those without a word score 0."""
    t = F.coalesce(F.col(text), F.lit(""))
    sentences = F.size(F.filter(F.split(t, r"[.!?]+"), lambda s: F.trim(s) != ""))
    df = df.withColumns({"_w": F.regexp_extract_all(F.lower(t), F.lit(f"({_WORD}+)"), F.lit(1)), "_s": sentences, "_m": F.size(F.regexp_extract_all(t, F.lit(rf"((?<!{_WORD})\p{{Nd}}+\.\p{{Nd}}+(?!{_WORD}))"), F.lit(1)))})
    n = F.size("_w").cast("double")
    letters = F.aggregate("_w", F.lit(0), lambda a, w: a + F.length(w))
    share = lambda cond: F.size(F.filter("_w", cond)) / n
    score = (
        0.15 * F.least(F.lit(1.0), n / F.col("_s") / 25) + 0.15 * F.least(F.lit(1.0), letters / n / 8) + 0.25 * share(lambda w: w.isin(*FINANCE)) + 0.20 * share(lambda w: F.length(w) >= 8)
        + 0.15 * F.size(F.array_distinct("_w")) / n + 0.10 * F.least(F.lit(1.0), F.col("_m") / n * 10)
    )
    return df.withColumn("complexity", F.when((n > 0) & (F.col("_s") > 0), F.round(score, 3)).otherwise(F.lit(0.0))).drop("_w", "_s", "_m")


def mentions(docs: DataFrame, doc: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(doc, name): names that stand as words in the text; words are exploded and equi-joined, never matched in pairs."""
    words = docs.select(doc, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"([A-Za-z0-9]+)"), F.lit(1)))).alias(name))
    return words.join(names.select(name).distinct(), name).select(doc, name)


def _variants(name: str) -> set[str]:
    """The forms of a company name that are looked for: as it is, without commas and dots, without its legal form."""
    up = name.strip().upper()
    return {v for v in (up, up.replace(",", "").replace(".", ""), up.replace(" INC", "").replace(" CORP", "").replace(" LTD", "")) if len(v) > NAME_LETTERS}


def _finder(known: dict[str, set[str]]):
    words: dict[str, list[str]] = {}
    odd: list[tuple[re.Pattern, str]] = []
    starts: dict[str, list[tuple[str, str]]] = {}
    for ticker, names in known.items():
        up = ticker.upper()
        if re.fullmatch(r"\w+", up):
            words.setdefault(up, []).append(ticker)
        elif up:
            odd.append((re.compile(r"\b" + re.escape(up) + r"\b"), ticker))
        for v in names:
            starts.setdefault(v[: NAME_LETTERS + 1], []).append((v, ticker))

    def found(x: str) -> set[str]:
        x = x.upper()
        hits = {t for w in words.keys() & set(re.findall(r"\w+", x)) for t in words[w]}
        hits.update(t for p, t in odd if p.search(x))
        begun = starts.keys() & {x[i : i + NAME_LETTERS + 1] for i in range(len(x) - NAME_LETTERS)}
        hits.update(t for s in begun for v, t in starts[s] if v in x)
        return hits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, t) for d, x in zip(pdf["_doc"], pdf["_text"]) if isinstance(x, str) for t in sorted(found(x))]
            yield pd.DataFrame(rows, columns=["_doc", "_name"])

    return run


def mentions_folded(docs: DataFrame, doc: str, text: str, names: DataFrame, name: str, company: str) -> DataFrame:
    """(doc, name): names that stand as words in the text, whatever their case, or whose ``company`` stands in it in one of
    its variants. A company of several names gives all of them. One pass over the texts for ``NAMES`` names; the fixed
    starts of all variants are looked up at every place of a text, and only the variants of a start that occurs are compared."""
    known: dict[str, set[str]] = {}
    for r in names.where(F.col(name).isNotNull()).select(name, company).distinct().toLocalIterator():
        known.setdefault(r[0], set()).update(_variants(r[1]) if r[1] else ())
    slim = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("_doc"), F.col(text).alias("_text"))
    schema = f"_doc {docs.schema[doc].dataType.simpleString()}, _name string"
    found, keys = docs.sparkSession.createDataFrame([], schema), sorted(known)
    for k in range(0, len(keys), NAMES):
        found = found.unionByName(slim.mapInPandas(_finder({x: known[x] for x in keys[k : k + NAMES]}), schema))
    return found.select(F.col("_doc").alias(doc), F.col("_name").alias(name))


def keep_unseen(df: DataFrame, title: str, link: str, order: str) -> DataFrame:
    """Articles whose folded title and whose link each appear first in ``order``; unlike the sequential form, an article
    also goes when its twin was itself dropped. Null titles or links collide with nothing. A title that very many articles
    share is one row a task before it is met again, and is then spread over tasks."""
    rows = df.withColumns({"_t": F.lower(F.trim(F.col(title))), "_u": F.col(link)})
    first = lambda k: cut(rows.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_first{k}")))
    joined = lookup_join(lookup_join(rows, first("_t"), ["_t"]), first("_u"), ["_u"])
    kept = joined.where((F.col("_first_t").isNull() | (F.col("_first_t") == F.col(order))) & (F.col("_first_u").isNull() | (F.col("_first_u") == F.col(order))))
    return kept.select(*df.columns)


def alpha_score(complexity: Column, words: Column) -> Column:
    """Three quarters complexity, one quarter a length factor that falls with the number of words; three decimals."""
    length = F.when(words <= 1000, 1.0).when(words <= 3000, 0.8).when(words <= 5000, 0.6).otherwise(F.greatest(F.lit(0.1), (10000 - words) / 10000))
    return F.round(complexity * 0.75 + length * 0.25, 3)


# The forms of terms that lead to further articles, in lower case, and the words of finance names.
TERM_FORMS = (
    r"\b([a-z][a-z]+ (?:theorem|model|equation|method|strategy|effect|paradox))\b",
    r"\b([a-z][a-z]+-[a-z][a-z]+ (?:model|theorem|test))\b",
    r"\b((?:black-scholes|monte carlo|kelly|sharpe|sortino|value at risk)[^.]*?)\b",
    r"\b([a-z]+ (?:arbitrage|trading|hedging|pricing|optimization))\b",
    r"\b((?:algorithmic|quantitative|statistical|stochastic) [a-z]+)\b",
)
NAME_WORDS = ("market", "option", "bond", "stock", "fund", "index", "ratio", "model")


def related_terms(x: Column, each: int = 3, names: int = 10, most: int = 5) -> Column:
    """Up to ``most`` distinct terms of a text, in the order of the forms and then of their places: up to ``each`` of every
    form, and of the first ``names`` capitalised pairs those with a word of finance."""
    low = F.lower(F.coalesce(x, F.lit("")))
    found = [F.slice(F.regexp_extract_all(low, F.lit(p), F.lit(1)), 1, each) for p in TERM_FORMS]
    pairs = F.slice(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b"), F.lit(1)), 1, names)
    finance = F.filter(pairs, lambda t: reduce(lambda a, b: a | b, [F.lower(t).contains(w) for w in NAME_WORDS]))
    return F.slice(F.array_distinct(F.concat(*found, finance)), 1, most)


def sentiment_summary(scored: DataFrame, mentions_of: DataFrame, doc: str, name: str) -> DataFrame:
    """(name, mention_count, avg, std, least, most score, breakdown: a map from sentiment to count) over the documents that
    mention a name. Counted by (name, sentiment) first, so a name that every document has is a few rows a task."""
    rows = mentions_of.join(scored.select(doc, "sentiment_score", "sentiment"), doc)
    parts = rows.groupBy(name, "sentiment").agg(F.count(F.lit(1)).alias("_n"), F.sum("sentiment_score").alias("_s"), F.sum(F.col("sentiment_score") ** 2).alias("_q"), F.min("sentiment_score").alias("_a"), F.max("sentiment_score").alias("_b"))
    a = parts.groupBy(name).agg(F.sum("_n").alias("mention_count"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"), F.min("_a").alias("min_score"), F.max("_b").alias("max_score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("sentiment", "_n")))).alias("breakdown"))
    n = F.col("mention_count").cast("double")
    var = F.greatest((F.col("_q") - F.col("_s") ** 2 / n) / (n - 1), F.lit(0.0))
    return a.select(name, "mention_count", (F.col("_s") / n).alias("avg_score"), F.when(n > 1, F.sqrt(var)).alias("std_score"), "min_score", "max_score", "breakdown")


def insights(summary: DataFrame, name: str, top: int = 10, least_mentions: int = 3, bound: float = 0.4) -> DataFrame:
    """(list, place, name, ...): the ``top`` names by attention, and of those with ``least_mentions`` the most bullish
    (average over ``bound``) and the most bearish (under minus ``bound``). Ties go by name."""
    enough = F.col("mention_count") >= least_mentions
    lists = [
        ("attention", summary, [F.desc("mention_count"), F.asc(name)]), ("bullish", summary.where(enough & (F.col("avg_score") > bound)), [F.desc("avg_score"), F.asc(name)]),
        ("bearish", summary.where(enough & (F.col("avg_score") < -bound)), [F.asc("avg_score"), F.asc(name)]),
    ]
    parts = [df.orderBy(*by).limit(top).withColumn("list", F.lit(n)) for n, df, by in lists]
    return reduce(DataFrame.unionByName, parts)


def centroid_cosines(df: DataFrame, vector: str, group: str, anchors: DataFrame, anchor: str) -> DataFrame:
    """(group, anchor, cosine) of the mean vector of every group and of every anchor (``anchors`` has the same vector
    column). Means are taken by dimension, so no group is gathered; the join is on the dimension."""

    def means(t: DataFrame, key: str, out: str) -> DataFrame:
        cells = t.where(F.col(key).isNotNull()).select(F.col(key).alias(out), F.posexplode(vector).alias("_p", "_v"))
        return cells.groupBy(out, "_p").agg(F.avg(F.col("_v").cast("double")).alias(f"_{out}"))

    a, b = means(df, group, "a"), means(anchors, anchor, "b")
    both = a.join(b, "_p").groupBy("a", "b").agg(F.sum(F.col("_a") * F.col("_b")).alias("_ab"), F.sum(F.col("_a") ** 2).alias("_aa"), F.sum(F.col("_b") ** 2).alias("_bb"))
    return both.select(F.col("a").alias(group), F.col("b").alias(f"{anchor}_anchor"), F.try_divide(F.col("_ab"), F.sqrt(F.col("_aa") * F.col("_bb"))).alias("cosine"))

"""Text operators against plain implementations of their definitions."""

import re

import pandas as pd

import __spark_entry__ as E
from tesserae.operators import text

TEXTS = [
    "Plain liquidity rose 1.5 points. Volatility fell!", "Die Börse für Wertpapiere schloß höher. Ein Plus von 2.75 Prozent?", "Les marchés européens ont clôturé en forte hausse.", "El número de acciones subió. ¿Por qué?",
    "Η αγορά έκλεισε με άνοδο. Ο δείκτης 3.14 αυξήθηκε!", "東京市場は上昇した。出来高は1.5倍。", "A café hedge – 10.5a and x10.5 don't count, 7.25 does.", "...", "", None,
]


def brute(t):
    t = t or ""
    w, s = re.findall(r"\w+", t.lower()), [x for x in re.split(r"[.!?]+", t) if x.strip()]
    if not w or not s:
        return 0.0
    n = len(w)
    share = lambda cond: sum(map(cond, w)) / n
    return (0.15 * min(1, n / len(s) / 25) + 0.15 * min(1, sum(map(len, w)) / n / 8) + 0.25 * share(lambda x: x in text.FINANCE) + 0.2 * share(lambda x: len(x) >= 8)
            + 0.15 * len(set(w)) / n + 0.1 * min(1, len(re.findall(r"\b\d+\.\d+\b", t)) / n * 10))


def test_complexity_of_all_scripts(spark, tmp_path):
    rows = [(i, t, [None, "en", " EN ", "de"][i % 4]) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id int, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.complexity for r in E.queries()["text_complexity"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(len(TEXTS)))
    for i, t in enumerate(TEXTS):
        assert abs(got[i] - brute(t)) <= 5.01e-4, (t, got[i], brute(t))


def test_every_document_has_its_complexity(spark, small):
    docs = pd.read_parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r.complexity for r in E.queries()["text_complexity"](spark, small).collect()}
    assert len(got) == len(docs)
    for i, t in zip(docs.doc_id, docs.text):
        assert abs(got[i] - brute(t)) <= 5.01e-4


def mentioned(t, universe):
    up, out = (t or "").upper(), set()
    for ticker, name in universe:
        n = (name or "").strip().upper()
        forms = [n, n.replace(",", "").replace(".", ""), n.replace(" INC", "").replace(" CORP", "").replace(" LTD", "")]
        if re.search(r"\b" + re.escape(ticker.upper()) + r"\b", up) or any(len(f) > 3 and f in up for f in forms):
            out.add(ticker)
    return out


def test_mentions_by_case_and_company(spark):
    universe = [("QBIPH", "Kelumont Inc."), ("QWBLV", "  JORODALE, Corp."), ("AB.C", "Wexovnex Group plc"), ("TINY", "Ab"), ("NONE", None), ("TWIN", "Kelumont Inc."), ("Ä1", "Öland Holdings")]
    texts = ["qbiph rose", "xqbiphx rose", "shares of kelumont inc. and others", "Jorodale Corp fell", "JORODALE, CORP. fell", "ab.c up", "abxc up", "the Wexovnex group plc said", "tiny ab", "", None, "öland holdings ä1", "kelumont alone"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.ticker) for r in text.mentions_folded(docs, "doc_id", "text", spark.createDataFrame(universe, "ticker string, name string"), "ticker", "name").collect()}
    want = {(i, t) for i, x in enumerate(texts) for t in mentioned(x, universe)}
    assert got == want and {(0, "QBIPH"), (2, "QBIPH"), (3, "QWBLV"), (7, "AB.C")} <= got


def test_mentions_match_brute_force(spark, small):
    docs, names = pd.read_parquet(f"{small}/documents.parquet"), pd.read_parquet(f"{small}/tickerciks.parquet")
    universe = list(zip(names.ticker, names.name))
    got = [(r.doc_id, r.ticker) for r in E.queries()["text_mentions"](spark, small).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, t) for i, x in zip(docs.doc_id, docs.text) for t in mentioned(x, universe)}


def test_related_terms_and_alpha(spark):
    from pyspark.sql import functions as F

    t = "The Heston model and the Black-Scholes equation guide options pricing. Statistical arbitrage and pairs trading. Index Fund and New York. The Euler theorem, a kalman method, one more model."
    rows = spark.createDataFrame([(1, t, 0.5, 900), (2, None, 0.2, 4000), (3, "", 0.0, 20000)], "i int, t string, c double, w int")
    out = {r.i: r for r in rows.select("i", text.related_terms(F.col("t")).alias("terms"), text.alpha_score(F.col("c"), F.col("w")).alias("a")).collect()}
    assert out[1].terms[:3] == ["heston model", "scholes equation", "euler theorem"] and len(out[1].terms) == 5
    assert out[2].terms == [] and [out[i].a for i in (1, 2, 3)] == [0.625, 0.3, 0.025]


def test_first_seen_with_shared_titles(spark):
    rows = [(1, "Same", "a"), (2, " same ", "b"), (3, None, "a"), (4, None, None), (5, "other", "c"), (6, "OTHER", "d"), (7, None, None)]
    got = {r.i for r in text.keep_unseen(spark.createDataFrame(rows, "i int, t string, l string"), "t", "l", "i").collect()}
    assert got == {1, 4, 5, 7}

"""Problems 2, 6, 7, 8 and 9 on small tables, with awkward input."""

import datetime as dt
import math
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from compare import connect, differences
from tesserae.llm import leaks as L
from tesserae.llm import pack as P
from tesserae.llm import percentiles as Q
from tesserae.llm import residue as R
from tesserae.llm.topn import score_code, text_chunks, top_n

D0 = dt.date(2025, 1, 1)


# top n -------------------------------------------------------------------------------------------------------------
def bits(x):
    i = struct.unpack("<q", struct.pack("<d", x))[0]
    return 0 if x == 0 else i if i >= 0 else -(i & (2**63 - 1))


def test_score_codes_are_the_ieee_bits(spark):
    xs = [0.0, -0.0, 5e-324, -5e-324, 2.2e-308, 1e-300, 0.1, 0.3, 1.0, 1 - 2**-53, 2.0, 3.5, -7.25, 1e22, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), None]
    xs += [random.Random(1).uniform(-1, 1) * 10.0 ** random.Random(i).randint(-300, 300) for i in range(200)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", score_code(F.col("x")).alias("c")).collect()
    for r in got:
        x = xs[r.i]
        assert r.c == (None if x is None or math.isnan(x) else bits(x)), x


def test_text_chunks_order_like_bytes(spark):
    xs = ["", "a", "a\0", "ab", "abcdefg", "abcdefgh", "abcdefgha", "b", "é", "日本", "z" * 14]
    rows = spark.createDataFrame([(x,) for x in xs], "x string").select("x", F.array(*text_chunks(F.col("x"), 2)).alias("c")).collect()
    assert [r.x for r in sorted(rows, key=lambda r: r.c)] == sorted(xs, key=lambda x: x.encode())


def brute(rows, n):
    groups = {}
    for r in rows:
        if r[2] is not None and not math.isnan(r[2]):
            groups.setdefault(r[1], []).append(r)
    out = []
    for g in groups.values():
        out += sorted(g, key=lambda r: (-r[2], r[3] is None, r[3] or "", r[0] is None, r[0] or 0))[:n]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_top_n_matches_sorting(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(1500):
        g = rng.choice([None, 0, 0, 0, 0, 1, 2, 3, 4])  # one group holds a third
        s = rng.choice([None, float("nan"), 0.5, 0.5, round(rng.uniform(-1, 1), 2), 1e300, -0.0, float("inf")])
        rows.append((i, g, s, rng.choice([None, "A", "B", "longer than seven bytes", "longer than seven bytez"])))
    rows += [rows[5]] * 3 + [(None, 1, 0.5, "A")]
    df = spark.createDataFrame(rows, "id bigint, g int, score double, t string").withColumn("_n", F.lit(1))
    out = top_n(df, ["g"], "score", 7, [("t", False), ("id", False)]).select("id", "g", "score", "t").collect()
    assert sorted(map(tuple, out), key=str) == brute(rows, 7)


def test_top_n_with_more_groups_than_are_broadcast(spark):
    rng = random.Random(9)
    rows = [(i, rng.randint(0, 400) if i % 3 else 7, round(rng.uniform(-1, 1), 2), "A") for i in range(4000)]  # one group holds a third
    df = spark.createDataFrame(rows, "id bigint, g int, score double, t string")
    out = top_n(df, ["g"], "score", 3, [("t", False), ("id", False)], broadcast_rows=10).select("id", "g", "score", "t").collect()
    assert sorted(map(tuple, out), key=str) == brute(rows, 3)


def test_top_n_of_copies_and_of_nothing(spark):
    df = spark.createDataFrame([(1, 0, 0.5)] * 40 + [(2, 0, 0.4)], "id bigint, g int, score double")
    assert [tuple(r) for r in top_n(df, ["g"], "score", 5, [("id", False)]).collect()] == [(1, 0, 0.5)] * 5
    assert top_n(df.limit(0), ["g"], "score", 5, [("id", False)]).count() == 0


# percentiles -------------------------------------------------------------------------------------------------------
def test_percentiles_match_sorting_and_merge(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1.0, 1.0, round(rng.gauss(0, 5), 1), None, float("nan"), float("inf"), -0.0])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("n", F.lit("clash"))
    parts = [Q.value_counts(df.where(c), ["g"], "v") for c in ("v > 0", "not (v > 0) or v is null")]
    out = {r.g: r for r in Q.percentiles(Q.merge(*parts), ["g"], [0.0, 0.01, 0.5, 0.99, 1.0]).collect()}
    for g in ("a", "b", None):
        xs = sorted(v for k, v in rows if k == g and v is not None and not math.isnan(v))
        assert out[g].n == len(xs)
        for p, c in ((0.0, "p0"), (0.01, "p1"), (0.5, "p50"), (0.99, "p99"), (1.0, "p100")):
            assert out[g][c] == xs[max(1, math.ceil(p * len(xs) - 1e-9)) - 1]
    assert Q.percentiles(Q.value_counts(df.limit(0), ["g"], "v"), ["g"], [0.5]).count() == 0


def test_bounded_percentiles_keep_their_bound(spark):
    rng = random.Random(4)
    xs = [rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 9) for _ in range(2000)]
    df = spark.createDataFrame([(1, x) for x in xs], "g int, v double")
    counts = Q.value_counts(df, ["g"], "v", 0.01)
    r = Q.percentiles(counts, ["g"], [0.1, 0.5, 0.9], 0.01).collect()[0]
    for p in (0.1, 0.5, 0.9):
        want = sorted(xs)[math.ceil(p * 2000 - 1e-9) - 1]
        assert abs(r[f"p{p * 100:g}"] - want) <= 0.01 * abs(want) * 1.0001
    assert counts.count() < 2000


# packing -----------------------------------------------------------------------------------------------------------
@settings(max_examples=40, deadline=None)
@given(st.integers(2, 40), st.lists(st.integers(1, 40), max_size=60))
def test_sum_of_squares_choices(capacity, sizes):
    packer, levels = P.SumOfSquares(capacity), {}
    for s in (min(x, capacity) for x in sizes):
        def cost(h, s=s):
            after = dict(levels)
            if h:
                after[h] -= 1
            if h + s < capacity:
                after[h + s] = after.get(h + s, 0) + 1
            return sum(v * v for v in after.values())

        before = {h: c for h, c in levels.items() if c}
        options = [0] + [h for h in before if h + s <= capacity]
        least = min(map(cost, options))
        packer.place(s)
        now = {h: int(c) for h, c in enumerate(packer.count) if c}
        assert sum(v * v for v in now.values()) == least
        levels = now


def test_packing_is_whole(spark):
    rng = random.Random(5)
    texts = [(i, "é" * rng.choice([0, 1, 5, 30, 63, 64, 65, 200, 700])) for i in range(300)] + [(900, None), (7, "x" * 1000), (7, "x" * 1000), (None, "abc")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("piece", F.lit(9))
    specs = spark.createDataFrame([(1, "s", 64), (2, "m", 500), (3, "none", None)], "spec_id bigint, spec_name string, capacity_tokens int")
    out = P.pack(docs, specs).toPandas()
    for spec, cap in ((1, 64), (2, 500)):
        o = out[out.spec_id == spec]
        assert o.tokens.sum() == sum(len((t or "").encode()) for _, t in texts)
        assert o.groupby("container").tokens.sum().max() <= cap
        once = o[o.doc_id == 3]
        assert len(once) == max(1, math.ceil(len(texts[3][1].encode()) / cap))
        assert set(o[o.pieces > 1].doc_id.dropna()) == {i for i, t in texts if t and len(t.encode()) > cap and i is not None}
        bins = []  # first fit decreasing, which sees all items beforehand
        for size in sorted((x for x in o.tokens if 0 < x < cap), reverse=True):
            k = next((k for k, b in enumerate(bins) if b + size <= cap), None)
            if k is None:
                bins.append(size)
            else:
                bins[k] += size
        assert o.container.nunique() - (o.tokens == cap).sum() <= 1.1 * len(bins) + 2
        assert o[o.tokens == 0].container.isna().all()
    assert P.pack(docs.limit(0), specs).count() == 0 and P.pack(docs, specs.limit(0)).count() == 0


def test_packing_is_the_same_however_rows_lie(spark):
    rng = random.Random(6)
    texts = [(i % 150, "é" * rng.choice([0, 1, 5, 30, 63, 64, 65, 200])) for i in range(400)] + [(7, "x" * 100)] * 30 + [(None, "ab")] * 3
    specs = spark.createDataFrame([(1, 64), (1, 64), (1, 90), (2, 500)], "spec_id bigint, capacity_tokens int")
    one = P.pack(spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1), specs).collect()
    rng.shuffle(texts)
    other = P.pack(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(7), specs).collect()
    assert sorted(map(str, one)) == sorted(map(str, other))
    sums = {}
    for r in one:
        if r.container:
            sums.setdefault((r.spec_id, r.container), []).append(r.tokens)
    assert all(sum(x) <= {"1x64": 64, "1x90": 90, "2x500": 500}[c.split("-")[0]] for (_, c), x in sums.items())
    assert sum(map(sum, sums.values())) == 3 * sum(len(t.encode()) for _, t in texts)


def test_tokenizers_of_a_path(spark):
    import public_tokenizers as T
    from tokenizers import Tokenizer

    texts = ["Shares rose 3%.", "", None, "日本語のテキスト"]
    from tesserae.llm.tokens import token_count

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    model = Tokenizer.from_file(T.path("byte_bpe_50k.json"))
    assert [r.n for r in df.select(token_count(F.col("t"), T.path("byte_bpe_50k.json")).alias("n")).collect()] == [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [r.n for r in df.select(token_count(F.col("t")).alias("n")).collect()] == [len((t or "").encode()) for t in texts]


# leaks -------------------------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=4, max_size=9).map(lambda s: s.encode()), min_size=1, max_size=6, unique=True), st.lists(st.text("abc", max_size=60).map(lambda s: s.encode()), min_size=1, max_size=4))
def test_wu_manber_finds_every_occurrence(strings, texts):
    which, pos, num = L.WuManber(strings).search(texts)
    got = set(zip(which.tolist(), pos.tolist(), num.tolist()))
    assert got == {(t, i, k) for t, x in enumerate(texts) for k, s in enumerate(strings) for i in range(len(x)) if x.startswith(s, i)}


WORDS = "auction broker cluster dividend exporter foundry gap harbour invoice ledger margin orchard pipeline quarry regime shipment tannery underwriter vault warehouse yield lender desk rebate".split()


def passage(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "one", "their", "late", "muted"]) + " " + rng.choice(WORDS) for _ in range(n // 2)).capitalize() + "."


def test_leaks_in_all_disguises(spark):
    p, filler = passage(1), passage(99, 400)
    words = p.split()
    cut = " ".join(words[10:36])
    changed = words[5:40]
    for k in (6, 15, 24):
        changed[k] = "banana"
    forms = {
        1: p, 2: filler + " " + cut + " " + filler, 3: cut.upper().replace(" ", "  \n"), 4: "<p>" + "</b> <i>".join(cut.split()) + "</p>", 5: ", ".join(cut.split()), 6: cut.replace("a", "а").replace("o", "ο"),
        7: " ".join(changed), 8: "-\n".join(cut[i : i + 7] for i in range(0, len(cut), 7)), 9: cut.replace("e", "é"), 10: " ".join(cut), 11: '{"passage": "' + cut.replace(" ", "\\u0020") + '"}', 12: filler * 200 + cut,
    }
    no = {101: " ".join(words[10:18]), 102: filler, 103: "", 104: None, 105: " ".join(words[3:11]) + " " + filler + " " + words[20] + " " + " ".join(words[40:47]), 106: " ".join(reversed(words))}
    docs = spark.createDataFrame(list((forms | no).items()), "doc_id bigint, text string").withColumn("words", F.lit(0))
    items = spark.createDataFrame([(1, p), (2, p), (3, passage(2)), (4, None), (5, ""), (6, "too short")], "eval_id bigint, passage string")
    got = {(r.doc_id, r.eval_id) for r in L.leaks(docs, items).collect()}
    assert got == {(d, e) for d in forms for e in (1, 2)}
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0


SCRIPTS = {
    "ja": "東京証券取引所では半導体関連の銘柄に買いが集まり、指数は三日ぶりに反発した。市場関係者は、円安の進行と米国の金利低下が輸出企業の業績を押し上げるとの見方が広がったためだと説明している。",
    "el": "Η κεντρική τράπεζα ανακοίνωσε χθες ότι θα διατηρήσει αμετάβλητα τα επιτόκια μέχρι το τέλος του έτους, καθώς ο πληθωρισμός υποχωρεί αργά και οι επενδυτές περιμένουν νέα στοιχεία για την απασχόληση και την παραγωγή.",
    "ru": "Центральный банк сообщил вчера, что сохранит ключевую ставку без изменений до конца года, поскольку инфляция снижается медленно, а инвесторы ждут новых данных о занятости, производстве и внешней торговле страны.",
    "th": "ธนาคารกลางประกาศเมื่อวานนี้ว่าจะคงอัตราดอกเบี้ยไว้จนถึงสิ้นปีเนื่องจากเงินเฟ้อลดลงช้าและนักลงทุนกำลังรอข้อมูลใหม่เกี่ยวกับการจ้างงานและการผลิต",
}


def test_leaks_in_every_script(spark):
    other = passage(77, 200)
    items = [(k, p) for k, p in enumerate(SCRIPTS.values())]
    docs, want = [], set()
    for k, p in items:
        whole, part = f"{other} {p} {other}", p[len(p) // 5 :]
        spaced = " ".join(part) if k in (0, 3) else part.upper().replace(" ", "\n ")
        for n, t in enumerate((p, whole, part, "<p>" + spaced + "</p>", part.replace("、", " ").replace("，", " ").replace(",", " –"), p[: len(p) // 6], other)):
            docs.append((10 * k + n, t))
            want |= {(10 * k + n, k)} if n < 5 else set()
    got = {(r.doc_id, r.eval_id) for r in L.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "eval_id bigint, passage string")).collect()}
    assert got == want
    assert all(b"".join(L.words(p)) == L.stream(p) for p in SCRIPTS.values())


def test_several_tables_and_passes_find_the_same(spark):
    items = spark.createDataFrame([(i, passage(i)) for i in range(40)], "eval_id bigint, passage string")
    docs = spark.createDataFrame([(i, passage(200, 100) + " " + passage(i)[20:] + " " + passage(i + 3)) for i in range(30)], "doc_id bigint, text string")
    whole = {tuple(r) for r in L.leaks(docs, items).collect()}
    assert {(d, e) for d, e, _ in whole} >= {(i, i) for i in range(30)}
    assert {tuple(r) for r in L.leaks(docs, items, table_bytes=1000, scan_bytes=3000).collect()} == whole


def test_runs_that_recur_do_not_hide_a_chain():
    """Every run of the first sixteen words has many places, so a chain's true predecessor lies far back."""
    body = [w.encode() for w in passage(5, 60).replace(".", "").lower().split()][16:56]
    passages = L.Passages([" ".join(["late ledger muted margin"] * 16 + [w.decode() for w in body])])
    text = L.stream("late ledger muted margin " * 20 + b" ".join(body[:9] + [b"zzzz"] + body[10:22]).decode())
    ((_, _, n),) = passages.finds([text])
    assert n >= 20 + 64 - 12


# residue -----------------------------------------------------------------------------------------------------------
ARTICLE = "Shares of Kelumont Inc. rose 3% on Monday. Traders pointed to the late ledger. The board approved a buyback."


def test_residue_cases(spark):
    yes = {
        1: "Shares of {{ company }} rose. " + ARTICLE, 2: "Revenue was ${AMOUNT} this year. " + ARTICLE, 3: ARTICLE + " Order for [INSERT TICKER] was filled.", 4: "<html><head><title>503</title></head><body><h1>Temporarily unavailable</h1></body></html>",
        5: "Please enable JavaScript to view this page.", 6: "Kelumont Inc. news\n\nHome | Markets | Help\n\nFehler 404: Die angeforderte Seite wurde nicht gefunden.", 7: "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Sed do eiusmod tempor incididunt ut labore.",
        8: "Headline goes here\n\nYour text here.", 9: "The sector fell 2% on Monday.\n\nVerifying the connection before you proceed. This takes about 3 seconds.", 10: "株価を表示するにはJavaScriptを有効にしてください。", 12: "The stock closed near <price_here>. " + ARTICLE, 13: "No notice concerning &lt;company&gt; was found. " + ARTICLE, 11: "Revenue of undefined for the quarter beat the undefined that was expected. " + ARTICLE,
    }
    no = {
        21: ARTICLE, 22: ARTICLE + "\n\nPlease enable JavaScript to see the comments.", 23: "The exchange's website returned error 504, a spokesperson said. " + ARTICLE, 24: "The snippet was `print(f\"{ticker} {ret:.2f}\")`. " + ARTICLE,
        25: "The estimate is $\\sqrt{\\frac{1}{n}}$. " + ARTICLE, 26: 'Config: {"rule": {"ticker": "A"}, "note": null} ' + ARTICLE, 27: "", 28: None, 29: '12:57:12 INFO {"ticker": "QSXLU", "qty": 3}', 30: "The form leaves the name undefined until June. " + ARTICLE, 32: "<p>A point in table <74>.</p><noscript></noscript> " + ARTICLE, 33: "<row><name>Kelumont</name></row> `<ticker>` " + ARTICLE, 31: '"We agreed [sic]," the chair said [emphasis added]. ' + ARTICLE,
    }
    rows = [(i, t, f"S{i % 3}") for i, t in (yes | no).items()]
    rows += [(50 + i, "Quotes are not available here\n\nQuotes", f"S{i}") for i in range(4)] + [(60, "Data not available yet", "S1"), (1, yes[1], None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("reason", F.lit("clash"))
    got = [r.doc_id for r in R.residue(docs).collect()]
    assert sorted(got) == sorted([*yes, 1, 50, 51, 52, 53])
    assert {r.doc_id for r in R.without_residue(docs).collect()} == {*no, 60}
    assert R.residue(docs.limit(0)).count() == 0


def test_unlisted_messages_are_found_by_their_recurrence(spark):
    """No rule knows this wording; it stands alone on several sites, and a sentence of articles does not."""
    unknown = "Our hamsters need a rest, come by later."
    common = "Gross margin came in at 3%, below the prior year."
    rows = [(i, f"Kelumont Inc. quote\n\n{unknown}", f"S{i % 3}") for i in range(4)]
    rows += [(10 + i, f"{common} Shares rose {i}% on Monday. The board met in May. It will meet again.", f"S{i % 4}") for i in range(6)]
    rows += [(20, f"{unknown} {ARTICLE}", "S1"), (30, "Another wording that stands alone once.", "S1"), (40, common, "S1")]
    rows += [(50 + i, '09:00:01 INFO {"a": 1}\n09:00:02 INFO Some job took very long today.', f"S{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {(r.doc_id, r.reason) for r in R.residue(docs).collect()} == {(i, "recurring") for i in range(4)}
    counted = {r.n: (r.alone, r.sources, r.phrase) for r in R.messages(R.judged(docs)).where("n > 4").collect()}
    assert counted == {5: (4, 3, None), 6: (0, 4, None), 7: (1, 4, None)}


WORDING = ["ZeroDivisionError: float division by zero", "NullPointerException: handler crashed while rendering", "hCaptcha challenge failed for client", "the page you asked for could not be found", "Enable JavaScript", "fehler 404", "ページが見つかりません", "Loading quote...", "please try again", "your text here", "404"]


def test_the_filter_before_the_rules_drops_nothing(small):
    import pandas as pd

    rng = random.Random(8)
    words = [w for p in (*R.STRONG, *R.WEAK, *R.FILLER) for w in R.required(p)] + WORDS + ["the", "your", "0", "of", "is", "not", "again"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 45))) + rng.choice(["", ".", "!"]) for _ in range(4000)]
    stored = [x for t in pd.read_parquet(f"{small}/documents.parquet").text.dropna() for x in R.segments(t)]
    for x in made + stored + WORDING:
        assert R.kind(x) == R.kind(x, filtered=False), x
    assert [x for x in WORDING if R.kind(x)[0] not in ("notice", "filler", "weak")] == []
    with pytest.raises(ValueError):
        R.required("a*|b")


def test_residue_of_long_texts(spark):
    docs = spark.createDataFrame([(1, ARTICLE * 20_000, "S"), (2, "Sample body copy. " * 50_000, "S"), (3, "{" * 200_000, "S"), (4, "<" * 100_000 + "a1" * 50_000, "S")], "doc_id bigint, text string, source string")
    assert {r.doc_id for r in R.residue(docs).collect()} == {2}


# queries -----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", list(__import__("tesserae.llm.queries", fromlist=["x"]).ORACLE))
def test_query_equals_sql(spark, small, name):
    assert differences(spark, connect(small), name, small) == ""


def test_every_query_is_registered():
    names = set(E.queries())
    assert {"p2_found", "p7_found", "p8_found", "p9_found"} <= names and any(n.startswith("p6_") for n in names) and np.__name__

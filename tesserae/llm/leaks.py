"""Evaluation texts leaking into training text (problem 8): Wu-Manber multi-pattern search.

Texts and passages become streams of folded letters: markup, spacing, punctuation and case are gone, look-alike
characters are one; letters of other scripts stay, as their UTF-8 bytes. The test strings are all runs of at least
``RUN_WORDS`` words and ``RUN_LETTERS`` bytes of every passage; in scripts without spaces two characters count as a word.
The search moves over a stream by the shift table of the block under its end, which skips positions where no test string
can end its first m bytes; where the shift is 0, a hash of the m bytes selects the bucket of test strings, and direct
comparison confirms them. Blocks are as long as the number of test strings asks for, and are looked up by hash: two blocks
that share an entry get the smaller shift of both, so no occurrence is skipped. All documents of a batch are searched at
once, each piece of ``PIECE`` bytes by its own cursor, in vector steps.

Confirmed runs of one passage are chained (in order, close together); words between and beside them are compared one by
one, so that single changed words cost only themselves. A document leaks an item when a chain holds ``LEAST`` words.
A run needs ``RUN_WORDS`` words in a row that nobody changed, so a text in which every fourth word of a passage is another
isn't found; with every fifth it is.

Tables hold ``TABLE_BYTES`` of passages each, and one pass over the corpus searches all tables of ``SCAN_BYTES``; only
larger evaluation sets take a further pass. The corpus is never shuffled; only (document, passage) finds leave the tasks.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.plans.scale import cut, lookup_join

LEAST = 20
RUN_WORDS, RUN_LETTERS = 4, 16
PIECE = 2048
#: Bytes of passages in one table, and in one pass over the corpus (whose tables a worker holds at a time: about 40 times
#: as much memory).
TABLE_BYTES, SCAN_BYTES = 2 << 20, 8 << 20
#: Letters by which a chain's pieces may lie further apart in the text than in the passage, and words it may skip.
SLACK, SKIP = 90, 12

# Characters that look like Latin letters, and digits and signs used in their place.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ɡ": "g", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "σ": "o", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ß": "ss", "æ": "ae", "œ": "oe",
}
FOLDED = {"0": "o", "1": "l", "i": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "$": "s", "@": "a", "|": "l"}

_KEEP = bytes(range(97, 123)) + b"269" + bytes(range(128, 256))
_FOLD = bytes(ord(FOLDED[chr(b)]) if chr(b) in FOLDED else b for b in range(256))
_DROP = bytes(b for b in range(256) if _FOLD[b] not in _KEEP)
_TAG = re.compile(r"<[^<>]*>")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
#: Scripts without spaces between words: two characters of them count as a word.
_UNITS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u312f\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff]{1,2}|[^\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u312f\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff]+")


class _Letters(dict):
    """Folding of characters, worked out as they come: look-alikes, letters and numbers as they are, nothing else."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        self[code] = c if code < 128 else LOOKALIKES.get(c, c if unicodedata.category(c)[0] in "LN" else None)
        return self[code]


_LETTERS = _Letters()


def letters(text: str) -> str:
    """``text`` without markup and case, with look-alikes folded and no signs but those of ASCII."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
        text = text.replace("\\n", " ").replace("\\t", " ").replace("\\r", " ")
    text = text.lower()
    return text if text.isascii() else unicodedata.normalize("NFKD", text).lower().translate(_LETTERS)


def _folded(text: str) -> bytes:
    return text.encode("utf-8", "ignore").translate(_FOLD, _DROP)


def stream(text: str) -> bytes:
    """The folded letters of a text, as bytes."""
    return _folded(letters(text))


def words(text: str) -> list[bytes]:
    """The words of a passage, as folded as :func:`stream` has them."""
    return [w for x in text.split() for w in map(_folded, _UNITS.findall(letters(x))) if w]


class WuManber:
    """Tables of a set of test strings (bytes, each at least ``RUN_LETTERS`` long, or as long as the shortest)."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        m = self.m = min(len(s) for s in strings)
        self.block = min(m, 8, max(2, math.ceil(math.log(2 * m * len(strings), 26))))  # log_c(2 m k), as its authors advise
        self.bits = min(24, max(16, math.ceil(math.log2(8 * m * len(strings)))))
        heads = np.frombuffer(b"".join(s[:m] for s in strings), dtype=np.uint8).reshape(len(strings), m)
        self.shift = np.full(1 << self.bits, m - self.block + 1, dtype=np.int16)
        for end in range(self.block, m + 1):
            np.minimum.at(self.shift, self._hashes(heads[:, end - self.block : end].T), m - end)
        self.power = np.array([pow(1_000_003, m - 1 - k, 1 << 64) for k in range(m)], dtype=np.uint64)
        keys = (heads.astype(np.uint64) * self.power).sum(axis=1, dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.bucket = keys[order], order

    def _hashes(self, columns) -> np.ndarray:
        """Table entries of blocks, given as one array a letter."""
        h = np.zeros(len(columns[0]), dtype=np.uint32)
        for c in columns:
            h *= np.uint32(31)
            h += c
        h *= np.uint32(2_654_435_761)
        return h >> np.uint32(32 - self.bits)

    def search(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, offset, string number) of every occurrence of every test string."""
        joined = b"\0".join(texts) + b"\0"
        codes = np.frombuffer(joined, dtype=np.uint8)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]], dtype=np.int64)
        n, m = len(codes), self.m
        if n < m:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        b = self.block  # the shift of a position is that of the block that ends there
        shift = np.ones(n, dtype=np.int16)
        shift[b - 1 :] = self.shift[self._hashes([codes[k : n - b + 1 + k] for k in range(b)])]
        at = np.arange(m - 1, n, PIECE, dtype=np.int64)
        until = np.minimum(at + PIECE, n)
        found = []
        while len(at):
            s = shift[at]
            zero = s == 0
            if zero.any():
                found.append(at[zero])
            at = at + np.maximum(s, 1)
            live = at < until
            at, until = at[live], until[live]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.concatenate(found)
        key = np.zeros(len(ends), dtype=np.uint64)
        for k in range(m):
            key += codes[ends - (m - 1 - k)].astype(np.uint64) * self.power[k]
        lo = np.searchsorted(self.keys, key, "left")
        hi = np.searchsorted(self.keys, key, "right")
        hit = hi > lo
        out: list[tuple[int, int]] = []
        for e, a, b in zip(ends[hit].tolist(), lo[hit].tolist(), hi[hit].tolist()):
            begin = e - m + 1
            for k in self.bucket[a:b].tolist():
                s = self.strings[k]
                if joined.startswith(s, begin):  # direct comparison
                    out.append((begin, k))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        pos, num = np.array(sorted(out), dtype=np.int64).T
        which = np.searchsorted(starts, pos, "right") - 1
        return which, pos - starts[which], num


class Passages:
    """Passages as word streams with their test strings."""

    def __init__(self, passages: list[str]) -> None:
        self.words = [words(p) for p in passages]
        self.offsets = [np.cumsum([0] + [len(w) for w in ws]).tolist() for ws in self.words]
        places: dict[bytes, list[tuple[int, int, int]]] = {}
        for p, ws in enumerate(self.words):
            for k in range(len(ws)):
                j = k + RUN_WORDS
                while j <= len(ws) and sum(map(len, ws[k:j])) < RUN_LETTERS:
                    j += 1
                if j <= len(ws):
                    places.setdefault(b"".join(ws[k:j]), []).append((p, k, j))
        self.strings = list(places)
        self.places = [places[s] for s in self.strings]
        self.tables = WuManber(self.strings) if self.strings else None

    def _between(self, text: bytes, a: int, b: int, words: list[bytes]) -> int:
        """How many of ``words`` stand in order in text[a:b]."""
        got, p = 0, a
        for w in words:
            k = text.find(w, p, b)
            if k >= 0 and (len(w) > 2 or k - p < 3):
                got, p = got + 1, k + len(w)
        return got

    def _beside(self, text: bytes, at: int, words: list[bytes], forward: bool) -> int:
        """How many words follow (or, reversed, precede) ``at`` one by one, over at most two changed ones in a row."""
        got, missed = 0, 0
        for w in words:
            room = len(w) + 12 * (missed + 1) if missed else len(w)
            k = text.find(w, at, at + room) if forward else text.rfind(w, max(0, at - room), at)
            if k >= 0:
                got, missed, at = got + 1, 0, (k + len(w) if forward else k)
            else:
                missed += 1
                if missed > 2:
                    break
        return got

    def best(self, text: bytes, p: int, runs: list[tuple[int, int, int]]) -> int:
        """The most words of passage ``p`` in one chain. ``runs``: (offset, first word, end word), by offset."""
        ws, off = self.words[p], self.offsets[p]
        longest = max(j - k for _, k, j in runs)
        score: list[tuple[int, int]] = []  # words so far, index of the chain's first run
        top = 0
        for i, (pos, k, j) in enumerate(runs):
            mine, head = j - k, i
            reach = off[k] - off[max(0, k - SKIP - longest)] + SLACK  # no run further back can be followed by this one
            for b in range(i - 1, -1, -1):
                pb, kb, jb = runs[b]
                if pos - pb > reach:
                    break
                if k <= kb or k - jb > SKIP or pos - pb > off[k] - off[kb] + SLACK:
                    continue
                if k >= jb:
                    end_b = pb + off[jb] - off[kb]
                    if pos < end_b:
                        continue
                    gain = j - k + self._between(text, end_b, pos, ws[jb:k])
                elif pos - pb == off[k] - off[kb]:
                    gain = max(0, j - jb)
                else:
                    continue
                if score[b][0] + gain > mine:
                    mine, head = score[b][0] + gain, score[b][1]
            score.append((mine, head))
            start, first, _ = runs[head]
            if mine + len(ws) - j + first > top:  # the words beside a chain; no use where even all of them wouldn't do
                after = self._beside(text, pos + off[j] - off[k], ws[j:], True)
                before = self._beside(text, start, ws[:first][::-1], False)
                top = max(top, mine + before + after)
        return top

    def finds(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(text number, passage, words) of every passage of which a run stands in a text."""
        if not self.tables:
            return []
        which, pos, num = self.tables.search(texts)
        runs: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for t, o, s in zip(which.tolist(), pos.tolist(), num.tolist()):
            for p, k, j in self.places[s]:
                runs.setdefault((t, p), []).append((o, k, j))
        return [(t, p, self.best(texts[t], p, r)) for (t, p), r in runs.items()]


@lru_cache(maxsize=SCAN_BYTES // TABLE_BYTES)
def _table(passages: tuple[str, ...]) -> Passages:
    return Passages(list(passages))


def _matcher(tables: list[tuple[str, ...]], least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [stream(x) if isinstance(x, str) else b"" for x in pdf["_text"]]
            docs = pdf["_doc"].to_numpy()
            for passages in tables:
                hits = [h for h in _table(passages).finds(texts) if h[2] >= least]
                if hits:
                    yield pd.DataFrame({"_doc": docs[[h[0] for h in hits]], "_passage": [passages[h[1]] for h in hits], "words": [h[2] for h in hits]})

    return run


def _blocks(passages: Iterator[str], size: int) -> Iterator[tuple[str, ...]]:
    """Passages in blocks of about ``size`` bytes (a longer passage is a block of its own)."""
    block: list[str] = []
    held = 0
    for p in passages:
        n = len(p.encode("utf-8", "ignore"))
        if block and held + n > size:
            yield tuple(block)
            block, held = [], 0
        block.append(p)
        held += n
    if block:
        yield tuple(block)


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "eval_id", passage: str = "passage", least: int = LEAST, table_bytes: int = TABLE_BYTES, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """(doc, item, ``words``): the documents in which at least ``least`` words of an item's passage stand in order and
    close together, and how many. Items of the same passage all count.

    Null and empty texts and passages match nothing; passages of fewer than ``RUN_WORDS`` words have no test string.
    Repeated documents give repeated rows."""
    known = items.where(F.col(passage).isNotNull() & (F.trim(passage) != "")).select(F.col(item).alias("_item"), F.col(passage).alias("_passage"))
    distinct = (r["_passage"] for r in known.select("_passage").distinct().orderBy("_passage").toLocalIterator())  # held-out items, a partition at a time
    slim = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("_doc"), F.col(text).alias("_text"))
    schema = f"_doc {docs.schema[doc].dataType.simpleString()}, _passage string, words bigint"
    found = docs.sparkSession.createDataFrame([], schema)
    tables = list(_blocks(distinct, table_bytes))
    each = max(1, scan_bytes // table_bytes)
    for k in range(0, len(tables), each):
        found = found.unionByName(slim.mapInPandas(_matcher(tables[k : k + each], least), schema))
    members = cut(known.groupBy("_passage").agg(F.collect_set("_item").alias("_items")))
    return lookup_join(found, members, ["_passage"], "inner").select(F.col("_doc").alias(doc), F.explode("_items").alias(item), "words")

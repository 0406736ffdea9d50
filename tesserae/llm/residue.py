"""Template residue, filler and error pages (problem 9).

Texts are cut into segments (lines and sentences). Numbers, addresses and dates are masked, and the exact hashes of all
normalised segments are grouped: in how many documents and sources a message stands, and in how many of them it stands
alone (at most ``ALONE`` real sentences). The widely recurring messages are then classified:

* one with a phrase of the rules is a notice, error or filler message; a weak phrase (one that articles could use as well)
  counts for widely recurring messages only;
* one without any phrase is such a message too when it stands alone nearly everywhere it stands, over several sources:
  a sentence of articles doesn't. So wording that no list has is found by its recurrence.

Messages rarer than that have no such evidence; of them only strong phrases count, so that a small table or a rare page
isn't lost. A document is residue when

* its prose (outside code, formulas and configuration) has an unfilled template field, or
* a message of the above stands in it and at most ``REAL`` real sentences do that are none.

Segments are cut and normalised in Arrow batches (``mapInPandas``). A segment meets the phrase rules only if it has one of
the literals that every alternative of them must contain (read off the parsed rules, found by one Aho-Corasick pass), so
the filter drops nothing. What is shuffled is one (hash, source range, counts) a distinct message, combined map-side, so a
message that a third of all rows carry costs one row a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.plans.scale import cut, lookup_join

#: Real sentences that may stand beside the residue.
REAL = 1
#: Documents, and sources, over which a message must recur to count as one.
RECURS_ROWS, RECURS_SOURCES = 3, 2
#: A document of at most so many real sentences is taken for one in which a message stands alone, and the share of a
#: message's documents that must be such where no phrase tells what it is (over one source more than above).
ALONE, ALONE_SHARE = REAL + 1, 0.8

# Unfilled fields of common template languages, by their delimiters.
FIELDS = (
    r"\{\{[^{}\n]+\}\}",
    r"[$#]\{[^{}\n]+\}",
    r"<%=?[^%\n]+%>",
    r"\{%[^{}%\n]+%\}",
    r"<<[A-Za-z_. ]{2,}>>",
    r"\[\[[A-Za-z_. ]+\]\]",
    r"\[(?i:insert|enter|add|your|placeholder)[ _:][^\]\n]+\]",
    r"\[[A-Za-z_ ]+ (?i:tbd|tba|tbc|tk|here|goes here)\]",
    r"(?<!\w)__[A-Z][A-Z_]*__(?!\w)",
    r"%%[A-Za-z_]{2,}%%",
    r"@@[A-Za-z_]{2,}@@",
    r"%\([A-Za-z_]{2,}\)[sdf]",
    r"(?<![\\\w}^_{])\{(?:\d|[a-z]{3,20}(?:_[a-z]+)*|[A-Z_]{3,20})\}(?![\w{}])",
    r"(?<![\w$])X{5,}(?!\w)",
    r"\b(?:of|at|to|from|by|the|de|a|von|um|auf|bei|f[uü]r|in|on|for|στα|για|en|und|and|\() (?:undefined|NaN|null|None)(?=[ ,.;:)%]|$)(?! (?:until|unless|behaviou?r|of|terms?|steering|and void|hypothes))",
)
#: A name in angle brackets, plain or escaped: a field unless it is an element of HTML or is closed somewhere.
ANGLE = r"(?:<|&lt;)([A-Za-z][A-Za-z_]*(?: [A-Za-z_]+)*)(?:>|&gt;)"
# The element names of HTML.
ELEMENTS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed "
    "fieldset figcaption figure font footer form frame frameset h head header hgroup hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noframes noscript object ol optgroup option output "
    "p param picture pre progress q rp rt ruby s samp script search section select slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
#: Spans that aren't prose: code, formulas, configuration and log payloads.
NOT_PROSE = (r"(?s)```.*?```", r"`[^`\n]*`", r"(?s)<(pre|code|script|style)\b.*?</\1>", r"\$[^$\n]*\\[^$\n]*\$", r"\\[a-z]+(\{[^{}\n]*\})+", r"\{[^{}\n]*\"[^{}\n]*(\{[^{}\n]*\}[^{}\n]*)*\}")

# Wording of notices, checks, error pages and filler (normalised: lower case, numbers masked as 0).
STRONG = (
    r"(enable|allow|turn on|switch on|activate|accept|need|require)s? [^.]{0,25}(javascript|scripts?|scripting|cookies)\b",
    r"\b(javascript|scripts?|scripting|cookies)\b[^.]{0,30} (required|disabled|blocked|off|needed|enabled|allowed|necessary|turned off)\b",
    r"without scripts|only with scripts|support scripts|modern browser|browser is (out of date|not supported|outdated)",
    r"(confirm|prove|verify|show us) that you are|not a robot|are you (a )?(human|robot)|solve the puzzle|tick the box|captcha",
    r"checking your browser|verifying the connection|one moment please|this takes about 0|before you (proceed|enter)",
    r"(page|article|report|story|quote|chart|link|file|item) [^.]{0,40}(could not be found|was not found|not be found|does not exist|doesn.t exist|has moved|is broken)",
    r"page not found|something went wrong|no longer available|temporarily unavailable|server is busy|try again (in 0|later)|service unavailable",
    r"bad gateway|gateway (did not answer|time-?out)|internal server error|origin unreachable|edge proxy|^nginx",
    r"access [^.]{0,30}denied|permission to (view|access|see)|^(incident|reference|trace|request) (#|id)",
    r"^error code|error code:? 0|^0 (error|forbidden|not found)|^(http )?error 0|^forbidden\b|^oops|^not found",
    r"^(please )?(change|check|update|adjust) your (settings|browser)|^(then )?(reload|refresh|retry|turn it on|switch it on|go back|return to the|use the search)\b|reload (the page )?to see",
    r"too many requests|rate limit|address (is|has been) (blocked|limited)|request id",
    r"down for (an upgrade|maintenance)|scheduled maintenance|will be back (shortly|in|by|soon)",
    r"session has expired|been signed out|log ?in required|(log|sign) in (again )?to (open|read|see|view|continue)|start a trial|subscribe to (read|continue)",
    r"^nothing to show here|^loading( \w+)?\s?(\.\.\.|…)|fetching data|please wait",
    r"^traceback \(most recent|^\w*(error|exception): |^file .{0,40}, line 0",
    r"\"(error|message)\": ?\"|\"status\": ?0",
    r"javascript (aktivieren|erlauben|zulassen)|(aktivieren|erlauben) sie (javascript|cookies)|^fehler 0|zugriff verweigert|seite wurde nicht gefunden|meldung wurde nicht gefunden|melden sie sich an",
    r"(autoriser|activer|activez|autorisez) (javascript|les cookies)|^erreur 0|momentan[eé]ment indisponible|page (est )?introuvable|acc[eè]s refus[eé]|connectez-vous",
    r"(habilite|active|activar|permita) (javascript|las cookies)|servicio no est[aá] disponible|p[aá]gina no (encontrada|existe)|acceso denegado|no se (ha )?encontr[oó]|inicie sesi[oó]n",
    r"ενεργοποιήστε τη|^σφάλμα 0|δεν βρέθηκε|δεν είναι διαθέσιμ|δεν επιτρέπεται|συνδεθείτε",
    r"(javascript|cookie)を有効|見つかりません|アクセスが(集中|拒否)|しばらくして|ログインして|エラー ?0|利用できません",
)
WEAK = (r"please try again|sign in|please (reload|refresh)|reload after|turn it on|refresh to see|not available|unavailable|maintenance|expired|blocked|denied",)
FILLER = (
    r"lorem ipsum|(headline|title|text|copy|content|caption|name) goes here|(sub)?heading placeholder|placeholder (text|copy|image)|your (text|headline|copy) here",
    r"replace this (paragraph|text)|test (article|post|page)|(sample|dummy|filler|body) (body )?(copy|text)|please ignore",
)
#: Stems of the pseudo-Latin that filler is made of; a segment mostly of these is filler.
LATIN = (
    "lorem ipsum dolor amet consect adipis eliter sed eiusm tempor incid labor magna magnus aliq enim minam minim veniam quis quispat nostr exerit ullam laboris nisi commod conseq duis autem aute irure repreh volup "
    "velit velum esse cillum fugit nulla nullat pariat except sint sintu occae cupid proid sunt culpa offic deser mollit anim laborum fenum risum pretor corat vivam sodal sit"
)
FURNITURE = r"^(terms|privacy|contact|prices delayed|market data|all rights reserved|copyright|©|home|help|sectors|markets|screener|earnings|watchlist|sign in)\b.{0,60}$|(\|[^|]{1,20}){2,}|^[^.]{1,60} (news|profile|quote|filings)$"


def _any(parts: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in parts)


_FIELDS = re.compile(_any(FIELDS))
#: A text without any of these has no field.
_FIELD_SIGNS = ("{", "[", "<%", "<<", "__", "%%", "@@", "%(", "XXXXX", "undefined", "NaN", "null", "None")
_ANGLE = re.compile(ANGLE)
_SPANS = [re.compile(p) for p in NOT_PROSE]
_STRONG, _WEAK, _FILLER, _FURNITURE = (re.compile(_any(x) if isinstance(x, tuple) else x) for x in (STRONG, WEAK, FILLER, FURNITURE))
_BLOCK_END = re.compile(r"</(?:p|div|h\d|li|title|head|noscript|body|html|td|tr)>|<br ?/?>", re.I)
_CUT = re.compile(r"\n+|(?<=[.!?。…])[\"')»”]*\s+(?=[^\s\d]|\d+ [a-z])|(?<=。)(?=.)")
_TAG = re.compile(r"<[^>\n]{1,200}>")
_ADDRESS = re.compile(r"https?://\S+|www\.\S+|\S+@\S+\.\S+")
_NUMBER = re.compile(r"[0-9a-f]*\d[0-9a-f.,:/-]*(?<![.,:])")
_LOG = re.compile(r"^[\d:., -]*(?:info|warn|debug|error) ")
_CJK = re.compile(r"[぀-ヿ一-鿿]")
_PLAIN = str.maketrans({c: " " for c in ".,;:!?()[]{}|/#<>\"'’=…*_\\"})


def _forms(op, arg) -> set[str] | None:
    """All strings that one parsed item matches, where they are few; None otherwise."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg)}
    if name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
        return {chr(x) for _, x in arg}
    if name == "SUBPATTERN":
        return _all_forms(arg[3])
    if name == "BRANCH":
        sides = [_all_forms(x) for x in arg[1]]
        return set().union(*sides) if all(x is not None for x in sides) else None
    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1:
        inner = _all_forms(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return {""} if name == "AT" else None


def _all_forms(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        here = _forms(op, arg)
        if here is None or len(out) * len(here) > 64:
            return None
        out = {a + b for a in out for b in here}
    return out


def required(pattern: str) -> set[str]:
    """Literals of which at least one stands in whatever ``pattern`` matches; a part without one is an error. Of the
    possible sets the one with the longest shortest literal is taken."""

    def of(items) -> set[str] | None:
        options: list[set[str] | None] = []
        run = {""}
        for op, arg in [*items, (None, None)]:
            here = None if op is None else _forms(op, arg)
            if here is not None and len(run) * len(here) <= 64:
                run = {a + b for a in run for b in here}
                continue
            options.append(run)
            run = here if here is not None else {""}
            if here is None and op is not None:
                name = str(op)
                if name == "SUBPATTERN":
                    options.append(of(arg[3]))
                elif name == "BRANCH":
                    sides = [of(x) for x in arg[1]]
                    options.append(set().union(*sides) if all(sides) else None)
                elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                    options.append(of(arg[2]))
        known = [o for o in options if o and all(o)]
        return max(known, key=lambda o: (min(map(len, o)), -len(o))) if known else None

    found = of(re._parser.parse(pattern))
    if not found:
        raise ValueError(f"nothing is required by {pattern}")
    return found


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in (*STRONG, *WEAK, *FILLER):
        for x in required(p):
            a.add_word(x, x)
    a.make_automaton()
    return a


_HINTS = _automaton()
_STEMS = frozenset(w[:5] for w in LATIN.split())


def normalised(segment: str) -> str:
    """Lower case, without markup, with numbers, addresses and dates masked as 0 and white space as single blanks."""
    x = segment.lower().replace("’", "'")
    if "<" in x:
        x = _TAG.sub(" ", x)
    if "@" in x or "www." in x or "://" in x:
        x = _ADDRESS.sub("0", x)
    return " ".join(_NUMBER.sub("0", x).split())


def segments(text: str) -> list[str]:
    """Lines and sentences of a text, without empty ones. Closing block tags end a segment."""
    if "<" in text:
        text = _BLOCK_END.sub("\n", text)
    return [x for x in (s.strip() for s in _CUT.split(text)) if x]


def _angle_field(text: str) -> bool:
    for m in _ANGLE.finditer(text):
        name = m[1]
        if name.lower() not in ELEMENTS and "</" + name not in text and "&lt;/" + name not in text:
            return True
    return False


def has_field(text: str) -> bool:
    """Whether the prose of ``text`` has an unfilled template field."""
    plain = any(s in text for s in _FIELD_SIGNS) and _FIELDS.search(text) is not None
    angle = ("<" in text or "&lt;" in text) and _angle_field(text)
    if not plain and not angle:
        return False
    for span in _SPANS:
        text = span.sub(" ", text)
    return _FIELDS.search(text) is not None or _angle_field(text)


def kind(segment: str, filtered: bool = True) -> tuple[str, str]:
    """(kind, normalised form): 'notice', 'filler', 'weak', 'furniture', 'log' (also payloads), 'real' or 'other'
    (headlines, tables). Without ``filtered``, every segment meets the rules."""
    low = segment.lower()
    words = low.translate(_PLAIN).split()
    n = len(words)
    if n >= 3 and sum(map(_STEMS.__contains__, [w[:5] for w in words])) * 2 > n:
        return "filler", ""
    norm = normalised(segment)
    weak = False
    if norm == "0":  # a status number alone
        return "notice", norm
    if not filtered or next(_HINTS.iter(norm), None) is not None:
        if _STRONG.search(norm):
            return "notice", norm
        if _FILLER.search(norm):
            return "filler", norm
        weak = _WEAK.search(norm) is not None
    line = _LOG.match(low)
    body = low[line.end() :] if line else low
    payload = body.startswith("{") and body.endswith("}")
    if line or payload:
        return ("real" if not payload and n >= 4 and _ends(body) else "log"), ""
    if "|" in low or n <= 8:
        if _FURNITURE.search(norm):
            return "furniture", norm
    if weak:
        return "weak", norm
    return ("real" if _ends(body) and (n >= 4 or (len(body) > 8 and _CJK.search(body) is not None)) else "other"), norm


def _ends(body: str) -> bool:
    """Whether a segment ends like a sentence, markup and quotes aside."""
    if body.rstrip("\"')»”").endswith((".", "!", "?", "。", "…")):
        return True
    return body.endswith(">") and _TAG.sub("", body).rstrip().endswith((".", "!", "?", "。", "…"))


def _could_be_message(segment: str) -> bool:
    """Whether a segment without phrases is more than a name or heading: three words, one of them in lower case, or a
    script without case."""
    words = segment.split()
    return (len(words) >= 3 and any(w[:1].islower() for w in words)) or (len(segment) >= 6 and _CJK.search(segment) is not None)


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, text, source in zip(pdf["_doc"], pdf["_text"], pdf["_source"]):
            text = text if isinstance(text, str) else ""
            real, logs, filler, notices, weak, reals, others = 0, False, False, set(), set(), [], set()
            for s in segments(text):
                k, norm = kind(s)
                real += k == "real"
                logs |= k == "log" or (k == "real" and not norm)
                if not norm:
                    filler |= k == "filler"
                    continue
                h = xxhash.xxh64_intdigest(norm) - (1 << 63)
                if k in ("notice", "filler"):
                    filler |= k == "filler"
                    notices.add(h)
                elif k == "weak":
                    weak.add(h)
                elif k == "real":
                    reals.append(h)
                elif k == "other" and _could_be_message(s):
                    others.add(h)
            field = has_field(text)
            alone = real <= ALONE and not logs and not field
            out.append((doc, source, field, real, filler, logs, alone, sorted(notices), sorted(weak), reals, sorted(others)))
        yield pd.DataFrame(out, columns=["_doc", "_source", "_field", "_real", "_filler", "_logs", "_alone", "_notice", "_weak", "_reals", "_others"])


def judged(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row a row of ``docs``: whether it has a field, filler, log lines; its real sentences; and the hashes of its
    messages by kind: with a strong phrase, with a weak one, sentences and other lines without any."""
    slim = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"), F.col(source).alias("_source"))
    schema = f"_doc {docs.schema[doc].dataType.simpleString()}, _source string, _field boolean, _real int, _filler boolean, _logs boolean, _alone boolean, _notice array<bigint>, _weak array<bigint>, _reals array<bigint>, _others array<bigint>"
    return slim.mapInPandas(_judge, schema)


def _tagged(kinds: dict[str, int], each: Callable[[str], Column] = F.col) -> Column:
    """The hashes of several array columns, exploded as ``_m`` (h, k), k being the number of their column."""

    def of(column: str, k: int) -> Column:
        return F.transform(each(column), lambda h: F.struct(h.alias("h"), F.lit(k).alias("k")))

    return F.explode(F.concat(*[of(c, k) for c, k in kinds.items()])).alias("_m")


def messages(rows: DataFrame) -> DataFrame:
    """(``_hash``, ``n`` documents, ``alone`` of them, ``sources`` (3 stands for three or more), ``phrase``: 'strong',
    'weak' or none) of :func:`judged` rows, a row a distinct message.

    Up to three sources of a message are told apart by the least, the greatest and one between; null is no source."""
    each = rows.select(
        "_source", "_alone",
        _tagged({"_notice": 2, "_weak": 1, "_reals": 0, "_others": 0}, F.array_distinct),
    ).select(F.col("_m.h").alias("_hash"), F.col("_m.k").alias("_k"), "_source", "_alone")
    counts = each.groupBy("_hash", "_source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_alone").cast("int")).alias("alone"), F.max("_k").alias("k"))
    return counts.groupBy("_hash").agg(F.sum("n").alias("n"), F.sum("alone").alias("alone"), F.count("_source").alias("sources"), F.max("k").alias("_k")).select(
        "_hash", "n", "alone", "sources", F.when(F.col("_k") == 2, "strong").when(F.col("_k") == 1, "weak").alias("phrase")
    )


def classified(found: DataFrame, recurs_rows: int = RECURS_ROWS, recurs_sources: int = RECURS_SOURCES) -> DataFrame:
    """The widely recurring ones of :func:`messages` that are residue: those with a phrase, and those that stand alone."""
    wide = (F.col("n") >= recurs_rows) & (F.col("sources") >= recurs_sources)
    by_phrase = wide & F.col("phrase").isNotNull()
    by_place = wide & (F.col("sources") > recurs_sources) & (F.col("alone") >= ALONE_SHARE * F.col("n"))
    return found.where(by_phrase | by_place).select("_hash")


def residue(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", recurs_rows: int = RECURS_ROWS, recurs_sources: int = RECURS_SOURCES) -> DataFrame:
    """(doc, ``reason``) of the rows that are residue; reasons 'field', 'recurring' (a widely recurring message), 'notice'
    or 'filler' (a rarer one with a strong phrase).

    Null and empty texts are no residue (there is nothing in them); repeated rows are listed as often as they occur."""
    rows = cut(judged(docs, doc, text, source)).withColumn("_n", F.monotonically_increasing_id())  # of stored rows, so the numbers stay
    known = cut(classified(messages(rows), recurs_rows, recurs_sources))
    # every message of every document meets the classified ones; what matches is little, and only that is shuffled
    each = rows.where(~F.col("_field")).select(
        "_n", _tagged({"_notice": 0, "_weak": 0, "_others": 0, "_reals": 1})
    ).select("_n", F.col("_m.h").alias("_hash"), F.col("_m.k").alias("_k"))
    hits = lookup_join(each, known, ["_hash"], "inner").groupBy("_n").agg(F.sum("_k").alias("_known"))
    open_ = rows.where(~F.col("_field")).select("_n", "_doc", "_real", "_filler", "_logs", (F.size("_notice") > 0).alias("_notice"))
    # without a hit, only a document of few sentences and a strong phrase matters; with one, the sentences that are hits don't count
    with_hits = open_.join(hits, "_n")
    recurring = with_hits.where((F.col("_real") - F.col("_known") <= REAL) & (~F.col("_logs") | F.col("_notice") | F.col("_filler"))).select("_n", F.col("_doc").alias(doc), F.lit("recurring").alias("reason"))
    rare = open_.where((F.col("_real") <= REAL) & (F.col("_notice") | F.col("_filler"))).join(recurring.select("_n"), "_n", "left_anti")
    rare = rare.select(F.col("_doc").alias(doc), F.when(F.col("_notice"), "notice").otherwise("filler").alias("reason"))
    fields = rows.where("_field").select(F.col("_doc").alias(doc), F.lit("field").alias("reason"))
    return fields.unionByName(recurring.drop("_n")).unionByName(rare)


def without_residue(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` without the documents whose id :func:`residue` lists."""
    return docs.join(residue(docs, doc, text, source).select(doc).distinct(), doc, "left_anti")

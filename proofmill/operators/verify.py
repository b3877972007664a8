"""Grading of quotations: exact, elided, spanning, fuzzy, or UNVERIFIED, with reasons and warnings.

The first three rungs are one join on the document with a regular expression per citation, evaluated by the engine. The expression quotes the text literally and looks at its surroundings:
no letter or digit may continue a word, no figure a number, and no negator may stand just outside, but for one that begins
the next sentence. The fuzzy rung
lines the quotation's words up with the page's, in Arrow batches: each word must be there in its place, as it is or as a
spelling variant of a longer word; numbers, polarity words and contractions must be equal. Words that have changed places
are no variants of each other.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import normal, original_span
from ..functions.text import MEANING, NEGATORS, NUMBER, POLARITY
from ..sources.shared import stored

GRADES = ("exact", "elided", "spanning", "fuzzy", "UNVERIFIED")
FUZZY_AT_LEAST = 0.92
SEAM = 600
_NOT = "|".join(NEGATORS.split())
_LEFT = rf"(?:(?<![\p{{L}}\p{{N}}])|(?![\p{{L}}\p{{N}}]))(?:(?<![0-9][.,])|(?![0-9]))(?<!(?<![\p{{L}}])(?i:{_NOT}) )(?<!n't )"
#: Where a sentence ends: a negator that follows begins the next one.
_STOP = r"[.!?]|[.!?][\"')\]]"
_RIGHT = rf"(?:(?![\p{{L}}\p{{N}}])|(?<![\p{{L}}\p{{N}}]))(?:(?![.,][0-9])|(?<![0-9]))(?:(?<={_STOP})|(?! (?i:{_NOT})(?![\p{{L}}])))"
_WITHIN_LEFT = r"(?:(?<![\p{L}\p{N}])|(?![\p{L}\p{N}]))(?:(?<![0-9][.,])|(?![0-9]))"
_WITHIN_RIGHT = r"(?:(?![\p{L}\p{N}])|(?<![\p{L}\p{N}]))(?:(?![.,][0-9])|(?<![0-9]))"
#: What "..." may leave out: part of one sentence, with no polarity word.
_GAP = rf"(?:(?!(?<![\p{{L}}])(?i:{POLARITY})(?![\p{{L}}]))[^.!?;]){{1,300}}?"
_ELLIPSIS = r" ?(?:\.\.\.|…) ?"


def _literal(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def exact_pattern(quote: Column) -> Column:
    return F.concat(F.lit(_LEFT), _literal(quote), F.lit(_RIGHT))


def elided_pattern(quote: Column) -> Column:
    """Fragments in order within one sentence; null without an ellipsis between two fragments."""
    parts = F.filter(F.split(quote, _ELLIPSIS), lambda p: F.length(F.trim(p)) > 0)
    joined = F.array_join(F.transform(parts, _literal), _WITHIN_RIGHT + _GAP + _WITHIN_LEFT)
    return F.when((F.size(parts) > 1) & F.regexp_like(quote, F.lit(_ELLIPSIS)), F.concat(F.lit(_LEFT), joined, F.lit(_RIGHT)))


def prepared(citations: DataFrame) -> DataFrame:
    return citations.withColumn("n_quote", normal(F.col("quote"))).withColumn("blank", F.coalesce(F.length(F.trim("n_quote")) == 0, F.lit(True)))


def indexed(pages: DataFrame) -> DataFrame:
    """Pages with their normal form and the two seams to the next page (words run on, or a line ends there), as written
    and in normal form; made once at ingest, not per citation."""
    after = F.lead("text").over(Window.partitionBy("doc_id").orderBy("page_no"))
    tail, head = F.substring("text", F.lit(-SEAM), F.lit(SEAM)), F.substring("after", F.lit(1), F.lit(SEAM))
    out = pages.withColumn("after", after).withColumn("norm", normal(F.col("text")))
    out = out.withColumns({"seam_on": F.concat(tail, head), "seam_line": F.concat(tail, F.lit("\n"), head)}).drop("after")
    return out.withColumns({"norm_on": normal(F.col("seam_on")), "norm_line": normal(F.col("seam_line"))})


def _best(hits: DataFrame) -> DataFrame:
    """One row per citation: its best grade, on the page that was named if it is there, else the first."""
    off = F.when(F.col("page_no") == F.col("page_hint"), 0).otherwise(1)
    place = F.struct("rank", off.alias("off"), "page_no", F.col("span.start").alias("start"), F.col("span.end").alias("end"), "ocr")
    out = hits.groupBy("answer_id", "cite_id").agg(F.min(place).alias("b"), F.sum(F.when(F.col("rank") < 3, F.col("times"))).alias("times"))
    return out.select("answer_id", "cite_id", "b.rank", "b.page_no", "b.start", "b.end", "b.ocr", "times")


_NUMERAL = re.compile(NUMBER)
_FIXED = frozenset([*POLARITY.split("|"), *MEANING])
_TURNS = ("un", "in", "im", "il", "ir", "dis", "non", "mis", "de", "anti", "over", "under", "re", "pre")


def _apart(a: str, b: str, most: int) -> int:
    """Edit distance, a swap of neighbours counting once; more than `most` may come out too small, never below it."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, rows[-2][j - 2] + 1)
            row.append(cost)
        rows.append(row)
    return rows[-1][-1]


def same_word(a: str, b: str) -> bool:
    """Whether two words are one, or spelling variants: five letters or more, one edit apart (two from nine letters on),
    and not words whose exchange changes the meaning."""
    a, b = a.lower().strip(".,;:!?()[]\"'“”‘’"), b.lower().strip(".,;:!?()[]\"'“”‘’")
    if a == b:
        return True
    if min(len(a), len(b)) < 5 or a in _FIXED or b in _FIXED or not (a.replace("-", "").isalpha() and b.replace("-", "").isalpha()):
        return False
    if any(x == turn + y or x == y + end for x, y in ((a, b), (b, a)) for turn in _TURNS for end in ("s", "less", "ed", "d")):
        return False
    most = 1 if min(len(a), len(b)) < 9 else 2
    return _apart(a, b, most) <= most


def _moved(want: list[str], window: list[tuple]) -> bool:
    """Whether a word of the quotation stands in another place of the window, where the quotation has another word."""
    other = [(x, w[0]) for x, w in zip(want, window, strict=True) if x != w[0]]
    return bool({x for x, _ in other} & {y for _, y in other})


def fuzzy_match(page: str, quote: str, at_least: float = FUZZY_AT_LEAST) -> tuple[float, int, int, str]:
    """(similarity, start, end, fault) of the window of as many words that has most of the quotation's words in their
    places; fault is empty if it may count. Windows with fewer than half of them are not looked at. A quotation that the page
    has in all but its numbers, at whatever letters it begins and ends, has the fault `number`."""
    if re.search(_ELLIPSIS, quote):
        return (0.0, -1, -1, "stitched")
    words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", page)]
    want = quote.split()
    places: dict[str, list[int]] = {}
    for i, w in enumerate(want):
        places.setdefault(w, []).append(i)
    votes = Counter(j - i for j, w in enumerate(words) for i in places.get(w[0], ()))
    best = (0.0, -1, -1, "not found")
    for s, n in sorted(votes.items()):
        if 2 * n < len(want) or s < 0 or s + len(want) > len(words):
            continue
        window = words[s : s + len(want)]
        a, b = window[0][1], window[-1][2]
        differ = [(x, w[0]) for x, w in zip(want, window, strict=True) if x != w[0] and not same_word(x, w[0])]
        similar = difflib.SequenceMatcher(None, quote, page[a:b], autojunk=False).ratio()
        fault = ""
        if any(re.search("[0-9]", x + y) for x, y in differ):
            fault = "number"
        elif any(re.fullmatch(rf"(?:{POLARITY}|.*n't)\W*", z, re.I) for x, y in differ for z in (x, y)):
            fault = "polarity"
        elif differ or similar < at_least or _moved(want, window):
            fault = "not found"
        elif re.search(rf"(?:\b(?:{_NOT})|n't) $", page[:a], re.I) or (re.match(rf" (?:{_NOT})\b", page[b:], re.I) and not re.search(rf"(?:{_STOP})\Z", page[a:b])):
            fault = "polarity"
        if (not fault, similar) > (not best[3], best[0]):
            best = (similar, a, b, fault)
    if best[3] == "not found" and re.search("[0-9]", quote) and quote not in page and _NUMERAL.sub("0", quote) in _NUMERAL.sub("0", page):
        return (1 - sum(map(len, _NUMERAL.findall(quote))) / len(quote), -1, -1, "number")
    return best


@F.pandas_udf(T.StructType([T.StructField("similar", T.DoubleType()), T.StructField("at", T.LongType()), T.StructField("size", T.LongType()), T.StructField("fault", T.StringType())]))
def _fuzzy(page: pd.Series, quote: pd.Series) -> pd.DataFrame:
    out = [fuzzy_match(p, q) if p and q else (0.0, -1, -1, "not found") for p, q in zip(page, quote, strict=True)]
    return pd.DataFrame([(s, a, b - a, f) for s, a, b, f in out], columns=["similar", "at", "size", "fault"])


def grade(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """The ledger: one row per citation (answer_id, cite_id, doc_id, page_hint, quote), with doc_id joined to pages
    (doc_id, page_no, text, ocr). Three rungs share one join; only citations that they miss reach the fuzzy one."""
    spark = citations.sparkSession
    cites = stored(spark, prepared(citations.select("answer_id", "cite_id", "doc_id", "page_hint", "quote")), "citations")
    cited = cites.select("doc_id").distinct()
    pages = stored(spark, indexed(pages.select("doc_id", "page_no", "text", "ocr").join(cited, "doc_id", "left_semi")), "pages")
    usable = cites.where("NOT blank").withColumns({"exact": exact_pattern(F.col("n_quote")), "elided": elided_pattern(F.col("n_quote"))})
    key = ["answer_id", "cite_id"]

    def holds(text: str, pattern: str, literal: bool = True) -> Column:
        like = F.coalesce(F.regexp_like(text, F.col(pattern)), F.lit(False))
        return (F.expr(f"instr({text}, n_quote) > 0") & like) if literal else (F.col(pattern).isNotNull() & like)

    rungs = ((1, "norm", "text", "exact", True), (2, "norm", "text", "elided", False), (3, "norm_on", "seam_on", "exact", True), (3, "norm_line", "seam_line", "exact", True))
    found = reduce(lambda when, r: when.when(holds(r[1], r[3], r[4]), r[0]), rungs[1:], F.when(holds(*[rungs[0][k] for k in (1, 3, 4)]), rungs[0][0]))
    hits = usable.join(pages, "doc_id").withColumn("rank", found).where("rank IS NOT NULL")
    line = (F.col("rank") == 3) & ~F.coalesce(F.regexp_like("norm_on", F.col("exact")), F.lit(False))
    choose = lambda whole, on, broken: F.when(F.col("rank") < 3, F.col(whole)).when(line, F.col(broken)).otherwise(F.col(on))
    hits = hits.withColumns({"shadow": choose("norm", "norm_on", "norm_line"), "source": choose("text", "seam_on", "seam_line"), "pattern": F.when(F.col("rank") == 2, F.col("elided")).otherwise(F.col("exact"))})
    at, size = F.regexp_instr("shadow", F.col("pattern")) - 1, F.length(F.regexp_substr("shadow", F.col("pattern")))
    times = F.when(F.col("rank") < 3, F.regexp_count("shadow", F.col("pattern"))).otherwise(1)
    hits = hits.select(*key, "rank", "page_no", "page_hint", "ocr", times.alias("times"), "text", original_span("source", at, size).alias("span"))
    back = F.when(F.col("rank") == 3, F.greatest(F.length("text") - SEAM, F.lit(0))).otherwise(0)
    hits = hits.withColumn("span", F.struct((F.col("span.start") + back).alias("start"), (F.col("span.end") + back).alias("end")))
    sure = stored(spark, _best(hits), "sure")
    tried = usable.join(sure, key, "left_anti").join(pages, "doc_id").withColumn("f", _fuzzy("norm", "n_quote"))
    fuzzy = tried.withColumns({"rank": F.lit(4), "times": F.lit(1), "span": original_span("text", F.col("f.at"), F.col("f.size"))})
    off = F.when(F.col("page_no") == F.col("page_hint"), 0).otherwise(1)
    place = F.struct("rank", off.alias("off"), "page_no", F.col("span.start").alias("start"), F.col("span.end").alias("end"), "ocr")
    rest = fuzzy.groupBy(*key).agg(F.min(F.when(F.col("f.fault") == "", place)).alias("b"), F.max_by("f.fault", F.when(F.col("f.fault") != "", F.col("f.similar"))).alias("fault"))
    rest = rest.select(*key, "b.rank", "b.page_no", "b.start", "b.end", "b.ocr", F.lit(1).cast("long").alias("times"), F.when(F.col("b").isNull(), F.col("fault")).alias("fault"))
    graded = sure.withColumn("fault", F.lit(None).cast("string")).unionByName(rest)
    known = pages.select("doc_id").distinct().withColumn("known", F.lit(True))
    out = cites.join(graded, key, "left").join(known, "doc_id", "left")
    out = out.withColumn("grade", F.when(F.col("rank").isNull(), "UNVERIFIED").otherwise(F.element_at(F.array(*map(F.lit, GRADES)), F.coalesce("rank", F.lit(1)))))
    failed = F.col("grade") == "UNVERIFIED"
    reason = F.when(F.col("blank"), "blank").when(F.col("known").isNull(), "unknown document").otherwise(F.coalesce("fault", F.lit("not found")))
    warnings = F.array_compact(
        F.array(
            F.when(F.col("page_no") != F.col("page_hint"), "wrong page"),
            F.when(F.col("times") > 1, "appears more than once"),
            F.when(F.col("grade") == "fuzzy", "not word for word"),
            F.when(F.col("ocr"), "from a scan"),
        )
    )
    return out.select("answer_id", "cite_id", "doc_id", "page_no", "start", "end", "grade", F.when(failed, F.array(reason)).otherwise(F.array().cast("array<string>")).alias("reasons"), warnings.alias("warnings"))


def uncited(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Claims without a citation."""
    return claims.join(citations, ["answer_id", "claim_id"], "left_anti")


def misplaced_anchors(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Citations whose anchor is not in their claim's sentence."""
    return citations.join(claims.select("answer_id", "claim_id", F.col("text").alias("claim")), ["answer_id", "claim_id"]).where("NOT coalesce(instr(claim, anchor) > 0 AND anchor <> '', false)")


def digest(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """(answer_id, sha256) of an answer's claims and citations in a fixed order, kept with the ledger."""
    rows = claims.select("answer_id", F.concat_ws("\x1f", F.lit("c"), "claim_id", "text").alias("line")).unionByName(
        citations.select("answer_id", F.concat_ws("\x1f", F.lit("q"), "claim_id", "cite_id", "doc_id", "quote", "anchor").alias("line"))
    )
    return rows.groupBy("answer_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\x1e"), 256).alias("sha256"))


def gate(claims: DataFrame, citations: DataFrame, ledger: DataFrame, checked: DataFrame, lenient: bool = False) -> DataFrame:
    """(answer_id, ok, failed, uncited, changed): a report may be built only where ok. checked: digests when graded."""
    answers = claims.select("answer_id").distinct()
    failed = ledger.groupBy("answer_id").agg(F.count_if(F.col("grade") == "UNVERIFIED").alias("failed"))
    bare = uncited(claims, citations).groupBy("answer_id").agg(F.count("*").alias("uncited"))
    now = digest(claims, citations).withColumnRenamed("sha256", "now")
    out = answers.join(failed, "answer_id", "left").join(bare, "answer_id", "left").join(now, "answer_id", "left").join(checked, "answer_id", "left")
    out = out.select("answer_id", F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("uncited", F.lit(0)).alias("uncited"), (~F.coalesce(F.col("now") == F.col("sha256"), F.lit(False))).alias("changed"))
    return out.withColumn("ok", ((F.col("failed") == 0) | F.lit(lenient)) & (F.col("uncited") == 0) & ~F.col("changed"))


def summary(ledger: DataFrame, docs_in_corpus: DataFrame) -> DataFrame:
    """One row per answer: citations, verified, failed, warnings, grades, documents in the corpus and cited.

    docs_in_corpus: (answer_id, documents_in_corpus)."""
    by = ledger.groupBy("answer_id").agg(
        F.count("*").alias("citations"),
        F.count_if(F.col("grade") != "UNVERIFIED").alias("verified"),
        F.count_if(F.col("grade") == "UNVERIFIED").alias("failed"),
        F.sum(F.size("warnings")).alias("warnings"),
        F.map_filter(F.create_map(*[x for g in GRADES for x in (F.lit(g), F.count_if(F.col("grade") == g))]), lambda k, v: v > 0).alias("grades"),
        F.countDistinct("doc_id").alias("documents_cited"),
    )
    return by.join(docs_in_corpus, "answer_id", "left")

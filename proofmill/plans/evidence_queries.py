"""Queries over verification, extraction, reports and scoring, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.normalize import normal
from ..operators import extract, report, scoring, triggers, verify
from ..functions.text import PAGE_CHARS
from .cases import CASES, CLAIMS, PASSAGES
from .corpus_queries import PAGES_SQL, pages_of, search_log_of, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def graded_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages_of(spark, sf).withColumn("ocr", F.lit(False))


# ---- quotations cut from the documents themselves ----

_NEG = r"(^|[^a-z])(not|no|never|nor|neither|without|cannot)([^a-z]|$)"
_BODY = r"regexp_replace(text, '[ \t\r\n]+', ' ', 'g')"
_QUOTES = {
    # eight whole words from the third on; the same with two words put in; words around the first page break
    "exact": "array_to_string(list_slice(string_split(trim(b), ' '), 3, 10), ' ')",
    "altered": "array_to_string(list_slice(string_split(trim(b), ' '), 3, 6), ' ') || ' qqqqqqqq zzzzzzzz ' || array_to_string(list_slice(string_split(trim(b), ' '), 7, 10), ' ')",
    "spanning": r"regexp_replace(regexp_replace(regexp_replace(substr(text, 1941, 120), '^\S*\s+', ''), '\s+\S*$', ''), '[ \t\r\n]+', ' ', 'g')",
}
_FROM = "FROM (SELECT doc_id, text, " + _BODY + " AS b FROM documents)"
_LONG = "len(string_split(trim(b), ' ')) > 12 AND instr(substr(b, 1, 400), '|') = 0 AND NOT regexp_matches(lower(substr(b, 1, 400)), '" + _NEG + "')"
_SPAN = "length(replace(b, " + _QUOTES["spanning"] + ", '')) + length(" + _QUOTES["spanning"] + ") = length(b) AND length(text) > 2200 AND instr(substr(text, 1800, 400), '|') = 0 AND NOT regexp_matches(lower(substr(text, 1800, 400)), '" + _NEG + "') AND substr(text, 1999, 2) SIMILAR TO '[a-zA-Z]{2}'"


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Citations (schema CITATION) of three kinds; cite_id is kind/doc_id."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.regexp_replace("text", r"[ \t\r\n]+", " ").alias("b"))
    words = F.split(F.trim("b"), " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    negated = lambda c, a, n: F.regexp_like(F.lower(F.substring(c, a, n)), F.lit(_NEG))
    usable = docs.where((F.size(words) > 12) & (F.instr(F.substring("b", 1, 400), "|") == 0) & ~negated("b", 1, 400))
    whole = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\S*\s+", ""), r"\s+\S*$", "")
    cut = F.regexp_replace(whole(F.substring("text", 1941, 120)), r"[ \t\r\n]+", " ")
    # words that repeat, or a long one, may leave nothing of the break: a page has the cut by itself. A wider one has the break
    alone = lambda c: F.instr(F.regexp_replace(c, r"[ \t\r\n]+", " "), cut) > 0
    over = F.when(alone(F.substring("text", 1, PAGE_CHARS)) | alone(F.substring("text", PAGE_CHARS + 1, PAGE_CHARS)), whole(F.substring("text", 1811, 380))).otherwise(cut)
    once = F.length(F.replace("b", cut)) + F.length(cut) == F.length("b")
    broken = docs.where(once & (F.length("text") > 2200) & (F.instr(F.substring("text", 1800, 400), "|") == 0) & ~negated("text", 1800, 400) & F.regexp_like(F.substring("text", 1999, 2), F.lit("^[a-zA-Z]{2}$")))
    kinds = (("exact", usable, part(3, 8)), ("altered", usable, F.concat_ws(" ", part(3, 4), F.lit("qqqqqqqq zzzzzzzz"), part(7, 4))), ("spanning", broken, over))
    out = None
    for kind, rows, quote in kinds:
        one = rows.select(F.lit("a").alias("answer_id"), F.lit(kind).alias("claim_id"), F.concat_ws("/", F.lit(kind), F.col("doc_id").cast("string")).alias("cite_id"), "doc_id", F.lit(1).alias("page_hint"), quote.alias("quote"), quote.alias("anchor"))
        out = one if out is None else out.unionByName(one)
    return out


_GRADES = f"""g AS (
  SELECT 'exact/' || doc_id AS cite_id, doc_id, 'exact' AS grade, 1 AS page_no {_FROM} WHERE {_LONG}
  UNION ALL SELECT 'altered/' || doc_id, doc_id, 'UNVERIFIED', NULL {_FROM} WHERE {_LONG}
  UNION ALL SELECT 'spanning/' || doc_id, doc_id, 'spanning', 1 {_FROM} WHERE {_SPAN})"""


@query(f"WITH {_GRADES} SELECT cite_id, doc_id, grade, page_no::INTEGER AS page_no FROM g")
def verify_grades(spark, sf):
    return verify.grade(quotes(spark, sf), graded_pages(spark, sf)).select("cite_id", "doc_id", "grade", "page_no")


@query(
    r"SELECT cite_id, instr(text, original) - 1 AS start, original, page_no FROM (SELECT 'exact/' || doc_id AS cite_id, text, 1::INTEGER AS page_no, "
    r"regexp_extract(text, '^[ \t\r\n]*[^ \t\r\n]+[ \t\r\n]+[^ \t\r\n]+[ \t\r\n]+([^ \t\r\n]+([ \t\r\n]+[^ \t\r\n]+){7})', 1) AS original "
    + f"{_FROM} WHERE {_LONG})"
)
def verify_exact(spark, sf):
    """The address leads back to the quotation: the original at [start, end) has the quotation's normal form."""
    cites = quotes(spark, sf).where("claim_id = 'exact'")
    pages = graded_pages(spark, sf)
    led = verify.grade(cites, pages).where("grade = 'exact'").join(cites.select("cite_id", "quote"), "cite_id").join(pages.select("doc_id", "page_no", "text"), ["doc_id", "page_no"])
    at = F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return led.where(normal(at) == normal(F.col("quote"))).select("cite_id", "start", at.alias("original"), "page_no")


@query(f"WITH {_GRADES} SELECT cite_id, page_no::INTEGER AS page_no FROM g WHERE grade = 'spanning'")
def verify_spanning(spark, sf):
    return verify.grade(quotes(spark, sf).where("claim_id = 'spanning'"), graded_pages(spark, sf)).where("grade = 'spanning'").select("cite_id", "page_no")


@query(f"WITH {_GRADES} SELECT cite_id, page_no::INTEGER AS page_no, 'wrong page' AS warning FROM g WHERE cite_id LIKE 'exact/%'")
def verify_wrong_page(spark, sf):
    led = verify.grade(quotes(spark, sf).where("claim_id = 'exact'").withColumn("page_hint", F.lit(7)), graded_pages(spark, sf))
    return led.where(F.array_contains("warnings", "wrong page")).select("cite_id", "page_no", F.lit("wrong page").alias("warning"))


@query(
    r"SELECT doc_id, 'number' AS reason FROM (SELECT doc_id, b, regexp_extract(b, '([A-Za-z]{3,} [A-Za-z]{3,} [0-9]{4,} [A-Za-z]{3,} [A-Za-z]{3,})', 1) AS q "
    + _FROM.replace("text, ", "text, ", 1)
    + ") WHERE q <> '' AND length(regexp_extract(q, '[0-9]+')) * 100 < 100000 AND instr(b, translate(q, '0123456789', '1234567890')) = 0"
)
def verify_number_changed(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"[ \t\r\n]+", " ").alias("b"))
    q = F.regexp_extract("b", r"([A-Za-z]{3,} [A-Za-z]{3,} [0-9]{4,} [A-Za-z]{3,} [A-Za-z]{3,})", 1)
    cites = docs.where(q != "").select(F.lit("a").alias("answer_id"), F.lit("c").alias("claim_id"), F.col("doc_id").cast("string").alias("cite_id"), "doc_id", F.lit(1).alias("page_hint"), F.translate(q, "0123456789", "1234567890").alias("quote"), F.lit("").alias("anchor"))
    whole = docs.select("doc_id", F.lit(1).alias("page_no"), F.col("b").alias("text"), F.lit(False).alias("ocr"))
    return verify.grade(cites, whole).where("grade = 'UNVERIFIED'").select("doc_id", F.element_at("reasons", 1).alias("reason"))


@query(
    f"WITH {_GRADES} SELECT count(*) AS citations, count(*) FILTER (grade <> 'UNVERIFIED') AS verified, count(*) FILTER (grade = 'UNVERIFIED') AS failed, count(*) FILTER (grade = 'exact') AS exact, "
    "count(*) FILTER (grade = 'spanning') AS spanning, count(DISTINCT doc_id) AS documents_cited, (SELECT count(*) FROM documents) AS documents_in_corpus FROM g"
)
def verify_summary(spark, sf):
    pages = graded_pages(spark, sf)
    size = pages.agg(F.lit("a").alias("answer_id"), F.countDistinct("doc_id").alias("documents_in_corpus"))
    s = verify.summary(verify.grade(quotes(spark, sf), pages), size)
    n = lambda g: F.coalesce(F.col("grades")[g], F.lit(0).cast("long")).alias(g)
    return s.select("citations", "verified", "failed", n("exact"), n("spanning"), "documents_cited", "documents_in_corpus")


@query(f"{'WITH ' + _GRADES} SELECT 'exact' AS claim_id, count(*) AS n FROM g WHERE cite_id LIKE 'exact/%' AND doc_id % 2 = 1")
def verify_anchor(spark, sf):
    """Anchors that are not in their claim's sentence: those of odd documents are altered."""
    cites = quotes(spark, sf).where("claim_id = 'exact'")
    claims = cites.select("answer_id", F.col("cite_id").alias("claim_id"), F.concat(F.lit("It says "), "quote").alias("text"))
    own = cites.withColumn("claim_id", F.col("cite_id")).withColumn("anchor", F.when(F.col("doc_id") % 2 == 1, F.lit("elsewhere")).otherwise(F.col("anchor")))
    return verify.misplaced_anchors(claims, own).select(F.lit("exact").alias("claim_id")).groupBy("claim_id").agg(F.count("*").alias("n"))


@query(f"WITH {_GRADES} SELECT 'claim/' || doc_id AS claim_id FROM g WHERE cite_id LIKE 'exact/%' AND doc_id % 3 = 0")
def verify_uncited(spark, sf):
    cites = quotes(spark, sf).where("claim_id = 'exact'").withColumn("claim_id", F.concat(F.lit("claim/"), "doc_id"))
    return verify.uncited(cites.select("answer_id", "claim_id"), cites.where("doc_id % 3 <> 0")).select("claim_id")


_EIGHT = "list_slice(string_split(trim(b), ' '), 3, 10)"
_MUTATED = f"""m AS (
  SELECT doc_id, b, w, list_filter(w, lambda x: regexp_matches(x, '^[a-z]{{9,}}$'))[1] AS long FROM (SELECT doc_id, b, {_EIGHT} AS w {_FROM} WHERE {_LONG})),
q AS (
  SELECT 'dropped' AS kind, doc_id, b, array_to_string(list_slice(w, 1, 3) || list_slice(w, 5, 8), ' ') AS quote FROM m
  UNION ALL SELECT 'swapped', doc_id, b, array_to_string(list_slice(w, 1, 2) || [w[4], w[3]] || list_slice(w, 5, 8), ' ') FROM m
  UNION ALL SELECT 'slip', doc_id, b, replace(array_to_string(w, ' '), long, substr(long, 1, 3) || substr(long, 5)) FROM m
    WHERE length(array_to_string(w, ' ')) - length(replace(array_to_string(w, ' '), long, '')) = length(long))"""


@query(f"WITH {_MUTATED} SELECT kind || '/' || doc_id AS cite_id, CASE WHEN kind = 'slip' THEN 'fuzzy' ELSE 'UNVERIFIED' END AS grade FROM q WHERE instr(b, quote) = 0")
def verify_mutated(spark, sf):
    """A word left out or two words swapped must not pass; a slip in a long word may."""
    docs = quotes(spark, sf).where("claim_id = 'exact'").join(table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"[ \t\r\n]+", " ").alias("b")), "doc_id")
    docs = docs.withColumn("w", F.split("quote", " "))
    part = lambda *ks: F.concat_ws(" ", *[F.element_at("w", k) for k in ks])
    long = F.get(F.filter("w", lambda x: F.regexp_like(x, F.lit("^[a-z]{9,}$"))), 0)
    slip = F.replace("quote", long, F.concat(F.substring(long, 1, 3), F.substring(long, F.lit(5), F.length(long))))
    once = F.length("quote") - F.length(F.replace("quote", long)) == F.length(long)
    texts = {"dropped": part(1, 2, 3, 5, 6, 7, 8), "swapped": part(1, 2, 4, 3, 5, 6, 7, 8), "slip": F.when(once, slip)}
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), q.alias("q")) for k, q in texts.items()])
    rows = docs.select("answer_id", "claim_id", "doc_id", "page_hint", "anchor", "b", F.inline(kinds)).where("q IS NOT NULL AND instr(b, q) = 0")
    rows = rows.withColumns({"cite_id": F.concat_ws("/", "kind", F.col("doc_id").cast("string")), "quote": F.col("q")}).drop("b", "kind", "q")
    return verify.grade(rows, graded_pages(spark, sf)).select("cite_id", "grade")


# ---- the case matrix ----


def _cases(spark: SparkSession) -> DataFrame:
    pages = spark.createDataFrame(PASSAGES, "doc_id string, page_no int, text string, ocr boolean")
    cites = spark.createDataFrame([("m", f"c{n}", n, d, hint, q, "") for n, _, d, hint, q, *_ in CASES], "answer_id string, claim_id string, cite_id int, doc_id string, page_hint int, quote string, anchor string")
    return verify.grade(cites, pages)


def _expected(topic: str | None = None) -> str:
    rows = [(n, g, "; ".join(w)) for n, t, _, _, _, g, w in CASES if topic in (None, t)]
    return "SELECT * FROM (VALUES " + ", ".join(f"({n}::INTEGER, '{g}', '{w}')" for n, g, w in rows) + ") AS v(case_no, grade, warnings)"


def _case_query(topic: str | None, name: str) -> None:
    @query(_expected(topic), name)
    def run(spark, sf):
        out = _cases(spark).select(F.col("cite_id").alias("case_no"), "grade", F.array_join("warnings", "; ").alias("warnings"))
        return out.where(F.col("case_no").isin([c[0] for c in CASES if topic in (None, c[1])]))


for _topic, _name in ((None, "verify_case_matrix"), ("swapped", "verify_number_swapped"), ("cut", "verify_number_cut"), ("negation", "verify_negation"), ("boundary", "verify_boundary"), ("stitched", "verify_stitched"), ("elided", "verify_elided"), ("harmless", "verify_harmless"), ("fuzzy", "verify_fuzzy"), ("ambiguous", "verify_ambiguous"), ("blank", "verify_blank"), ("scan", "verify_scan")):
    _case_query(_topic, _name)


@query("SELECT * FROM (VALUES ('a1', true, 0, 0, false), ('a2', false, 1, 0, false), ('a3', false, 0, 1, false), ('a4', false, 0, 0, true)) AS v(answer_id, ok, failed, uncited, changed)")
def verify_gate(spark, sf):
    """a1 is in order; a2 has a failed quotation, a3 an uncited claim, a4 was edited after it was checked."""
    claims = spark.createDataFrame([(a, 1, c, t, "document") for a, c, t in CLAIMS], schemas.CLAIM)
    cites = spark.createDataFrame([(a, c, f"{a}{c}", "D1", 1, q, "") for a, c, q in (("a1", "c1", "pay 50% of fees"), ("a2", "c1", "pay 25% of fees"), ("a3", "c1", "pay 50% of fees"), ("a4", "c1", "pay 50% of fees"))], schemas.CITATION)
    pages = spark.createDataFrame(PASSAGES, "doc_id string, page_no int, text string, ocr boolean")
    checked = verify.digest(claims, cites)
    edited = claims.withColumn("text", F.when(F.col("answer_id") == "a4", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return verify.gate(edited, cites, verify.grade(cites, pages), checked).select("answer_id", "ok", F.col("failed").cast("int").alias("failed"), F.col("uncited").cast("int").alias("uncited"), "changed")


# ---- extraction ----

_FIELDS = [("ip", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", None), ("mail", r"[A-Za-z0-9.]+@[A-Za-z0-9.]+[A-Za-z0-9]", None), ("limit", r"[0-9]{13,19}", r"(^|[^a-z])[Tt]he (in|er)[a-z]*")]
_SENT = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n+', chr(1), 'g'), '([.!?])[ \t]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 0)"
_CELLS = f"""WITH {PAGES_SQL},
l AS (SELECT doc_id, page_no, i, s[i] AS sentence FROM (SELECT doc_id, page_no, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, page_no, {_SENT} AS s FROM pages_))),
f AS (SELECT * FROM (VALUES {", ".join("('%s', '%s', %s)" % (a, b, f"'{c}'" if c else "NULL") for a, b, c in _FIELDS)}) AS v(field, vp, up)),
m AS (SELECT doc_id, field, page_no, i, sentence, coalesce(regexp_matches(sentence, up), false) AS none, regexp_extract(sentence, vp, 0) AS value FROM l, f),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY page_no, i) AS k FROM m WHERE none OR value <> '') WHERE k = 1),
c AS (SELECT d.doc_id, f.field, CASE WHEN b.none THEN 'unlimited' WHEN b.k = 1 THEN 'value' ELSE 'absent' END AS state, CASE WHEN NOT b.none THEN b.value END AS value, b.sentence, b.page_no::INTEGER AS page_no
      FROM (SELECT DISTINCT doc_id FROM pages_) d CROSS JOIN f LEFT JOIN b ON b.doc_id = d.doc_id AND b.field = f.field)"""


def _found(spark, sf):
    return extract.cells(pages_of(spark, sf), spark.createDataFrame(_FIELDS, schemas.FIELD))


@query(f"{_CELLS} SELECT * FROM c")
def extract_cells(spark, sf):
    return _found(spark, sf)


@query(f"{_CELLS} SELECT field, state, count(*) AS n FROM c GROUP BY ALL")
def extract_tristate(spark, sf):
    return _found(spark, sf).groupBy("field", "state").agg(F.count("*").alias("n"))


@query(f"{_CELLS} SELECT doc_id, " + ", ".join(f"max(CASE WHEN field = '{f}' THEN CASE WHEN state = 'unlimited' THEN 'no limit' ELSE value END END) AS {f}" for f, _, _ in _FIELDS) + " FROM c GROUP BY doc_id")
def extract_grid(spark, sf):
    return extract.grid(_found(spark, sf), [f for f, _, _ in _FIELDS])


@query(f"{_CELLS} SELECT field, count(*) AS cells, count(*) AS verified FROM c WHERE state <> 'absent' GROUP BY field")
def extract_verified(spark, sf):
    """Cells as an answer, graded like any other."""
    found = _found(spark, sf)
    _, cites = extract.as_answer(found, "grid")
    led = verify.grade(cites, graded_pages(spark, sf))
    return led.groupBy(F.substring_index("cite_id", "/", -1).alias("field")).agg(F.count("*").alias("cells"), F.count_if(F.col("grade") != "UNVERIFIED").alias("verified"))


# ---- reports ----


@query(f"WITH {_GRADES} SELECT d.doc_id, count(g.doc_id) AS citations, count(g.doc_id) > 0 AS used FROM documents d LEFT JOIN (SELECT * FROM g WHERE cite_id LIKE 'exact/%') g USING (doc_id) GROUP BY d.doc_id")
def report_sources(spark, sf):
    led = verify.grade(quotes(spark, sf).where("claim_id = 'exact'"), graded_pages(spark, sf))
    docs = table(spark, sf, "documents").select("doc_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("timestamp").alias("saved_at"))
    return report.source_list(docs, led).select("doc_id", "citations", "used")


@query(f"WITH {_GRADES}, {PAGES_SQL} SELECT doc_id, page_no, sha256(text) AS sha256 FROM pages_ WHERE (doc_id, page_no) IN (SELECT doc_id, page_no FROM g WHERE grade <> 'UNVERIFIED')")
def report_pages(spark, sf):
    pages = graded_pages(spark, sf)
    led = verify.grade(quotes(spark, sf), pages)
    return report.quoted_pages(pages, led).select("doc_id", "page_no", F.sha2("text", 256).alias("sha256"))


@query("SELECT conv_id AS report, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS question_no, text FROM conversations WHERE role = 'user'")
def report_thread(spark, sf):
    turns = table(spark, sf, "conversations").where("role = 'user'").select(F.col("conv_id").alias("report"), F.col("turn").alias("seq"), "text")
    return report.numbered(turns)


@query("SELECT conv_id AS answer_id, turn AS seq, text FROM conversations WHERE role = 'assistant' AND conv_id = 3")
def report_find(spark, sf):
    said = table(spark, sf, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("report"), F.col("turn").alias("seq"), "text")
    return report.find(said, 3).select(F.col("report").alias("answer_id"), "seq", "text")


# ---- scores ----

_RUNS = """SELECT cast(doc_id AS string) AS id, source AS domain, concat('https://q/', doc_id % 5) AS source_url, doc_id % 10 <> 0 AS has_answer, doc_id % 9 <> 0 AS has_corpus, doc_id % 8 <> 0 AS has_output,
 n_chars % 20 + 1 AS citations, CASE WHEN n_chars % 5 = 0 THEN 1 ELSE 0 END AS failed, n_chars % 3 AS warnings, CASE n_chars % 4 WHEN 0 THEN NULL WHEN 1 THEN 'yes' WHEN 2 THEN 'partial' ELSE 'no' END AS agrees,
 CASE WHEN n_chars % 7 = 0 THEN 'checked by hand' END AS notes, doc_id AS seq, substr(text, 1, 100) AS question FROM documents"""
_DOCS = """SELECT cast(d.doc_id AS string) AS answer_id, k AS doc_id, CASE WHEN (d.doc_id + k) % 13 = 0 THEN NULL ELSE concat('https://q/', (d.doc_id + k * (d.doc_id % 2)) % 5) END AS url, (d.doc_id + k) % 11 = 0 AS thin, k * 10 AS seq, (d.doc_id * k) % 3 <> 1 AS cited
 FROM documents d CROSS JOIN (VALUES (0), (1), (2)) AS v(k)
 UNION ALL SELECT cast(doc_id AS string), 0, 'https://q/late', doc_id % 4 = 0, CASE WHEN doc_id % 6 = 0 THEN 99 ELSE -1 END, false FROM documents"""
_RUNS_DUCK, _DOCS_DUCK = (s.replace("AS string", "AS VARCHAR") for s in (_RUNS, _DOCS))
_SEARCH_SQL = "s AS (SELECT conv_id AS answer_id, CASE WHEN turn % 4 = 2 THEN 'Contrary view' ELSE 'support' END AS purpose FROM conversations WHERE role = 'user')"


def _sql(spark: SparkSession, sf: str, text: str) -> DataFrame:
    return spark.sql(text.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf, "documents"))


def runs(spark, sf) -> DataFrame:
    out = _sql(spark, sf, _RUNS)
    return out.withColumn("status", scoring.status(F.col("has_answer"), F.col("has_corpus"), F.col("has_output")))


def _flags(spark, sf) -> DataFrame:
    docs = _sql(spark, sf, _DOCS)
    cites = scoring.cited(docs.where("cited").select("answer_id", "doc_id"), docs.select("answer_id", "doc_id"))
    return scoring.sources(runs(spark, sf).select("id", "source_url"), cites, docs)


_STATUS = "CASE WHEN NOT has_answer THEN 'pending' WHEN NOT has_corpus THEN 'no-corpus' WHEN NOT has_output THEN 'verify-error' ELSE 'run' END"
_FLAGS_SQL = f"""r AS (SELECT *, {_STATUS} AS status FROM ({_RUNS_DUCK})),
d0 AS ({_DOCS_DUCK}), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, doc_id ORDER BY seq DESC) AS k FROM d0) WHERE k = 1),
c0 AS (SELECT DISTINCT answer_id, doc_id FROM d0 WHERE cited),
c AS (SELECT * FROM c0 UNION ALL SELECT DISTINCT answer_id, doc_id FROM d0 WHERE answer_id NOT IN (SELECT answer_id FROM c0)),
fl AS (SELECT id AS answer_id, coalesce(bool_and(coalesce(url = source_url, false)) FILTER (d.doc_id IS NOT NULL), false) AS circular, coalesce(bool_or(thin), false) AS low_yield_cited
      FROM r LEFT JOIN c ON c.answer_id = r.id LEFT JOIN d ON d.answer_id = c.answer_id AND d.doc_id = c.doc_id GROUP BY id)"""
_ROWS_SQL = f"""{_FLAGS_SQL}, rows_ AS (SELECT id, domain, status, citations, citations - failed AS verified, failed, warnings, doc_seq % 3 <> 0 AS disconfirming, circular, low_yield_cited, agrees, notes, doc_seq AS seq, question,
  failed = 0 AND doc_seq % 3 <> 0 AND NOT circular AND coalesce(agrees, '') <> 'no' AS pass FROM (SELECT *, seq AS doc_seq FROM r) JOIN fl ON fl.answer_id = id)"""


def scored_rows(spark, sf) -> DataFrame:
    rows = runs(spark, sf).join(_flags(spark, sf), F.col("id") == F.col("answer_id"))
    rows = rows.withColumn("disconfirming", F.col("seq") % 3 != 0).withColumn("verified", F.col("citations") - F.col("failed"))
    return rows.withColumn("pass", scoring.passes(F.col("failed"), F.col("disconfirming"), F.col("circular"), F.col("agrees")))


@query(f"SELECT id, {_STATUS} AS status FROM ({_RUNS_DUCK})")
def score_status(spark, sf):
    return runs(spark, sf).select("id", "status")


@query(f"WITH {_FLAGS_SQL} SELECT answer_id, circular FROM fl")
def score_circular(spark, sf):
    return _flags(spark, sf).select("answer_id", "circular")


@query(f"WITH {_FLAGS_SQL} SELECT answer_id, low_yield_cited FROM fl")
def score_low_yield(spark, sf):
    return _flags(spark, sf).select("answer_id", "low_yield_cited")


@query(f"WITH {_SEARCH_SQL} SELECT answer_id, count(*) AS searches, bool_or(starts_with(lower(purpose), 'contra')) AS disconfirming FROM s GROUP BY answer_id")
def score_disconfirming(spark, sf):
    return scoring.search_flags(search_log_of(spark, sf))


@query(f"WITH {_ROWS_SQL} SELECT id, pass FROM rows_ WHERE status = 'run'")
def score_pass(spark, sf):
    return scored_rows(spark, sf).where("status = 'run'").select("id", "pass")


@query(f"WITH {_ROWS_SQL} SELECT count(*) AS answers, sum(citations)::BIGINT AS citations, sum(verified)::BIGINT AS verified, sum(failed)::BIGINT AS failed, count(*) FILTER (disconfirming) AS disconfirming, count(*) FILTER (circular) AS circular, count(*) FILTER (pass) AS passed FROM rows_ WHERE status = 'run'")
def score_totals(spark, sf):
    return scoring.totals(scored_rows(spark, sf))


@query(f"WITH {_ROWS_SQL} SELECT domain, count(*) AS answers, sum(citations)::BIGINT AS citations, sum(failed)::BIGINT AS failed, count(*) FILTER (pass) AS passed, grouping(domain)::INTEGER AS all_domains FROM rows_ WHERE status = 'run' GROUP BY ROLLUP (domain)")
def score_by_domain(spark, sf):
    return scoring.by_domain(scored_rows(spark, sf))


@query(
    f"WITH {_ROWS_SQL} SELECT id, domain, "
    + ", ".join(f"CASE WHEN status = 'run' THEN {c}::VARCHAR ELSE '' END AS {c}" for c in ("citations", "verified", "failed", "warnings"))
    + ", CASE WHEN status <> 'run' THEN '' WHEN disconfirming THEN 'yes' ELSE 'no' END AS disconfirming, CASE WHEN status <> 'run' THEN '' WHEN circular THEN 'YES' ELSE 'no' END AS circular, "
    "CASE WHEN status <> 'run' THEN '' ELSE coalesce(nullif(agrees, ''), '—') END AS agrees, CASE WHEN status <> 'run' THEN '*' || status || '*' WHEN pass THEN 'pass' ELSE 'FAIL' END AS pass FROM rows_"
)
def score_shown(spark, sf):
    return scoring.shown(scored_rows(spark, sf))


@query(f"WITH {_ROWS_SQL} SELECT id, notes FROM rows_ WHERE status = 'run' AND coalesce(notes, '') <> ''")
def score_notes(spark, sf):
    return scoring.notes(scored_rows(spark, sf))


@query(f"SELECT id, domain, CASE WHEN has_answer THEN 'run' ELSE 'pending' END AS state, substr(question, 1, 70) AS question FROM ({_RUNS_DUCK})")
def score_list(spark, sf):
    r = runs(spark, sf)
    return scoring.listed(r, r.where("has_answer"))


@query(f"SELECT id, CASE WHEN seq % 3 = 0 THEN '/named/' || id WHEN seq % 2 = 0 THEN '/own/' || id END AS root FROM ({_RUNS_DUCK})")
def score_corpus(spark, sf):
    r = runs(spark, sf)
    registry = r.where("seq % 3 = 0").select(F.concat(F.lit("eval-"), "id").alias("name"), F.concat(F.lit("/named/"), "id").alias("root"))
    local = r.select("id", F.concat(F.lit("/own/"), "id").alias("root"), (F.col("seq") % 2 == 0).alias("has_index"))
    return scoring.corpus_of(r, registry, local)


@query("SELECT conv_id AS answer_id, count(*) FILTER (length(text) < 200) AS gaps FROM conversations GROUP BY conv_id")
def score_gaps(spark, sf):
    by = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.length("text") < 200, F.col("text"))).alias("gaps"))
    return by.select(F.col("conv_id").alias("answer_id"), F.size(F.coalesce("gaps", F.array().cast("array<string>"))).cast("long").alias("gaps"))


# ---- triggers ----

_LOG = """SELECT user_id AS session, event_id AS seq, CASE WHEN event_type = 'error' THEN 'user' ELSE 'assistant' END AS type, CASE event_type WHEN 'view' THEN 'text' WHEN 'signup' THEN 'thinking' ELSE 'tool_use' END AS kind,
 CASE WHEN event_type = 'purchase' THEN 'Skill' WHEN event_type = 'click' THEN 'Bash' END AS name, CASE WHEN value > 10 THEN 'ready?' ELSE 'fine' END AS text, CASE WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 'checker' WHEN event_id % 5 = 0 THEN 'python notices.py take' ELSE 'ls' END AS input FROM events"""
_SESSIONS_SQL = f"""e AS ({_LOG}), s0 AS (SELECT *, kind = 'tool_use' AND coalesce((name = 'Skill' AND contains(input, 'checker')) OR contains(input, 'checker/scripts'), false) AS starts,
 kind = 'tool_use' AND contains(input, 'notices.py') AS quiet FROM e WHERE type = 'assistant' AND kind IN ('text', 'tool_use')),
s AS (SELECT * FROM s0 WHERE starts OR NOT quiet), b AS (SELECT session, min(seq) AS b FROM s WHERE starts GROUP BY session),
n AS (SELECT session, arg_min(CASE WHEN kind = 'text' AND contains(text, '?') THEN 'asked first' ELSE 'went straight to work' END, seq) AS next_step FROM s JOIN b USING (session) WHERE NOT starts AND seq > b GROUP BY session),
ses AS (SELECT session, b.b IS NOT NULL AS started, coalesce(next_step, '') AS next_step FROM (SELECT DISTINCT session FROM e) LEFT JOIN b USING (session) LEFT JOIN n USING (session))"""


def _sessions(spark, sf):
    return triggers.sessions(spark.sql(_LOG.replace("FROM events", "FROM {events}"), events=table(spark, sf, "events")))


@query(f"WITH {_SESSIONS_SQL} SELECT * FROM ses")
def trigger_started(spark, sf):
    return _sessions(spark, sf)


@query(f"WITH {_SESSIONS_SQL} SELECT session, CASE WHEN session % 2 = 0 THEN 'start' ELSE 'skip' END AS expect, started, started = (session % 2 = 0) AS ok FROM ses WHERE contains('prompt ' || session, '1')")
def trigger_check(spark, sf):
    found = _sessions(spark, sf)
    prompts = found.select("session", F.when(F.col("session") % 2 == 0, "start").otherwise("skip").alias("expect"), F.concat(F.lit("Prompt "), "session").alias("prompt"))
    return triggers.check(prompts, found, "1")

"""Queries over sources, captures and search, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PAGE_CHARS, numbers, paginate, sentences, visible
from ..operators import search
from ..sources import captures, corpus

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pages_of(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages of fixed width."""
    return paginate(table(spark, sf, "documents").select("doc_id", "text"))


PAGES_SQL = f"""pages_ AS (
  SELECT doc_id, p::INTEGER + 1 AS page_no, p * {PAGE_CHARS} AS char_start, least(p * {PAGE_CHARS} + {PAGE_CHARS}, length(text)) AS char_end,
         substr(text, p * {PAGE_CHARS} + 1, {PAGE_CHARS}) AS text
  FROM (SELECT doc_id, text, unnest(range(0, (greatest(length(text), 1) - 1) // {PAGE_CHARS} + 1)) AS p FROM documents WHERE text IS NOT NULL))"""

VISIBLE_SQL = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))"""


@query(f"WITH {PAGES_SQL} SELECT doc_id, page_no, char_start::BIGINT AS char_start, char_end::BIGINT AS char_end, sha256(text) AS sha256 FROM pages_")
def src_pages(spark, sf):
    return pages_of(spark, sf).select("doc_id", "page_no", "char_start", "char_end", F.sha2("text", 256).alias("sha256"))


@query(f"SELECT page_id, length(t)::BIGINT AS n_chars, sha256(t) AS sha256 FROM (SELECT page_id, {VISIBLE_SQL} AS t FROM pages)")
def src_html_text(spark, sf):
    seen = table(spark, sf, "pages").select("page_id", visible(F.col("html")).alias("t"))
    return seen.select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("sha256"))


@query(
    f"SELECT page_id, url, sha256(html) AS sha256, length(html)::BIGINT AS n_chars, length(t)::BIGINT AS visible_chars, length(trim(t)) < {captures.THIN_CHARS} AS thin FROM (SELECT *, {VISIBLE_SQL} AS t FROM pages)"
)
def src_capture_manifest(spark, sf):
    return captures.manifest(table(spark, sf, "pages"))


@query("SELECT a.url, sha256(a.html) AS old_sha256, sha256(a.html || '<!-- edited -->') AS new_sha256 FROM pages a WHERE a.page_id % 7 = 0")
def capture_changed(spark, sf):
    pages = table(spark, sf, "pages")
    later = pages.withColumn("html", F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("<!-- edited -->"))).otherwise(F.col("html")))
    return captures.changed(captures.manifest(pages), captures.manifest(later))


@query(f"SELECT page_id, url, length(t)::BIGINT AS visible_chars FROM (SELECT *, {VISIBLE_SQL} AS t FROM pages) WHERE length(trim(t)) < {captures.THIN_CHARS}")
def capture_thin(spark, sf):
    return captures.manifest(table(spark, sf, "pages")).where("thin").select("page_id", "url", "visible_chars")


@query(
    "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN status IN (401, 403) THEN 'login' WHEN status < 200 OR status >= 300 THEN 'error' WHEN regexp_matches(lower(body), '\\b(enable javascript|sign in to continue|log in to continue)\\b') THEN 'browser' END AS reason "
    "FROM (SELECT (ARRAY[200, 403, 500, 200])[page_id % 4 + 1] AS status, CASE WHEN page_id % 8 = 3 THEN 'Please enable JavaScript.' ELSE html END AS body FROM pages)) GROUP BY reason"
)
def capture_unfetchable(spark, sf):
    pages = table(spark, sf, "pages")
    status = F.element_at(F.array(*map(F.lit, (200, 403, 500, 200))), (F.col("page_id") % 4 + 1).cast("int"))
    body = F.when(F.col("page_id") % 8 == 3, "Please enable JavaScript.").otherwise(F.col("html"))
    return pages.select(captures.unfetchable(status, body).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def ingest_incremental(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return corpus.new_files(found, found.where("doc_id % 3 = 0"))


@query(
    f"WITH {PAGES_SQL} SELECT media_type, count(*) AS pages, count(DISTINCT id) AS documents, count(url) AS addresses FROM (SELECT 'text/plain' AS media_type, 'd' || doc_id AS id, NULL AS url FROM pages_ UNION ALL SELECT 'text/html', 'w' || page_id, url FROM pages) GROUP BY media_type"
)
def corpus_mixed(spark, sf):
    local = pages_of(spark, sf).select(F.lit("text/plain").alias("media_type"), F.concat(F.lit("d"), "doc_id").alias("id"))
    web = table(spark, sf, "pages").select(F.lit("text/html").alias("media_type"), F.concat(F.lit("w"), "page_id").alias("id"), "url")
    return corpus.mixed(local, web).groupBy("media_type").agg(F.count("*").alias("pages"), F.countDistinct("id").alias("documents"), F.count("url").alias("addresses"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS pages, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1")
def src_by_host(spark, sf):
    return table(spark, sf, "pages").groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"))


@query(
    r"SELECT doc_id, len(n)::BIGINT AS n_numbers, array_to_string(n, ' ') AS numbers FROM (SELECT doc_id, regexp_extract_all(text, '[0-9][0-9,.]*[0-9]|[0-9]') AS n FROM documents) WHERE len(n) > 0"
)
def text_numbers(spark, sf):
    got = table(spark, sf, "documents").select("doc_id", numbers(F.col("text")).alias("n")).where("size(n) > 0")
    return got.select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.array_join("n", " ").alias("numbers"))


# ---- search ----

_SEARCHES = ("the and of", "with from that", "elle les des", "und die mit")


def searches(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_SEARCHES)), "query_id int, query string")


def _bm25_sql(queries: tuple, top: int) -> str:
    rows = ", ".join(f"({k}, '{q}')" for k, q in enumerate(queries))
    return f"""WITH {PAGES_SQL},
q AS (SELECT query_id, query FROM (VALUES {rows}) AS v(query_id, query)),
t AS (SELECT DISTINCT query_id, unnest(string_split(query, ' ')) AS term FROM q),
w AS (SELECT doc_id, page_no, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 0) AS ws FROM pages_),
size AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
tf AS (SELECT term, doc_id, page_no, len, count(*) AS tf FROM (SELECT doc_id, page_no, len(ws) AS len, unnest(ws) AS term FROM w) WHERE term IN (SELECT term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, page_no, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score
      FROM t JOIN tf USING (term) JOIN df USING (term), size GROUP BY ALL)
SELECT query_id::INTEGER AS query_id, rank::INTEGER AS rank, doc_id, page_no, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page_no) AS rank FROM s) WHERE rank <= {top}"""


@query(_bm25_sql(_SEARCHES[:1], 20))
def search_bm25(spark, sf):
    return search.bm25(pages_of(spark, sf), searches(spark).where("query_id = 0"))


@query(_bm25_sql(_SEARCHES, 10))
def search_multi(spark, sf):
    return search.bm25(pages_of(spark, sf), searches(spark), 10)


@query(f"WITH {PAGES_SQL} SELECT doc_id, page_no, p::INTEGER AS at, substr(text, greatest(p - 40, 1), p + 10 + 40 - greatest(p - 40, 1)) AS snippet FROM (SELECT *, instr(lower(text), 'of the and') AS p FROM pages_) WHERE p > 0")
def search_phrase(spark, sf):
    return search.phrase(pages_of(spark, sf), "of the and")


@query(
    f"WITH r AS ({_bm25_sql(_SEARCHES[:1], 20)}), {PAGES_SQL} SELECT r.query_id, doc_id, page_no, instr(lower(text), 'the')::INTEGER AS at, "
    "substr(text, greatest(greatest(instr(lower(text), 'the'), 1) - 40, 1), greatest(instr(lower(text), 'the'), 1) + 3 + 40 - greatest(greatest(instr(lower(text), 'the'), 1) - 40, 1)) AS snippet FROM r JOIN pages_ USING (doc_id, page_no)"
)
def search_snippet(spark, sf):
    return search.passages(pages_of(spark, sf), searches(spark).where("query_id = 0"))


@query(
    "SELECT conv_id AS answer_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS seq, left(text, 60) AS query, CASE WHEN turn % 4 = 2 THEN 'Contrary view' ELSE 'support' END AS purpose FROM conversations WHERE role = 'user'"
)
def search_log(spark, sf):
    return search_log_of(spark, sf).select("answer_id", "seq", "query", "purpose")


def search_log_of(spark, sf) -> DataFrame:
    """Users' turns stand in for a search log; every second question looks for a contrary view."""
    from pyspark.sql import Window

    turns = table(spark, sf, "conversations").where("role = 'user'")
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.select(F.col("conv_id").alias("answer_id"), seq.alias("seq"), F.left("text", F.lit(60)).alias("query"), F.when(F.col("turn") % 4 == 2, "Contrary view").otherwise("support").alias("purpose"))


@query(
    r"SELECT doc_id, count(*) AS n, sum(length(s))::BIGINT AS chars FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n+', chr(1), 'g'), '([.!?])[ \t]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 0)) AS s FROM documents) GROUP BY doc_id"
)
def text_sentences(spark, sf):
    got = table(spark, sf, "documents").select("doc_id", F.explode(sentences(F.col("text"))).alias("s"))
    return got.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))

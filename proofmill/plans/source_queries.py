"""Sources and sinks over whole tables: written to the shared folder as files, read back by the engine's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import corpus, files, sinks
from ..sources.shared import shared_dir
from .corpus_queries import PAGES_SQL, pages_of, table

QUERIES: dict = {}
ORACLE: dict = {}
#: Documents in one file of several pages.
PER_FILE = 50


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _as_files(lines: DataFrame, folder: str) -> None:
    """One text file for each part of (part, seq, value), its lines by seq. A part is one row when it is written, so it
    stays in one file however the plan deals out its tasks; a file's size is its part's."""
    by = lines.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("rows"))
    by = by.select("part", F.array_join(F.transform("rows", lambda r: r["value"]), "\n", "").alias("value"))
    by.write.partitionBy("part").mode("append").text(folder)


def _part(path):
    return F.regexp_extract(path, "part=(-?[0-9]+)", 1).cast("long")


@query(
    f"""SELECT doc_id // {PER_FILE} AS part, row_number() OVER (PARTITION BY doc_id // {PER_FILE} ORDER BY doc_id)::INTEGER AS page_no, sha256(trim(coalesce(text, ''), chr(10))) AS sha256, NULL::VARCHAR AS error FROM documents
UNION ALL SELECT -1, NULL, NULL, 'ValueError: no parser for parquet'"""
)
def src_folder(spark, sf):
    """A folder of text files with form feeds between pages, and a file that no parser reads: it gives its error."""
    folder = _folder(spark, "folder")
    d = table(spark, sf, "documents").withColumn("part", F.floor(F.col("doc_id") / PER_FILE))
    first = F.min("doc_id").alias("first")
    d = d.join(d.groupBy("part").agg(first), "part")
    text = F.concat(F.when(F.col("doc_id") == F.col("first"), "").otherwise("\f"), F.coalesce("text", F.lit("")))
    _as_files(d.select("part", F.col("doc_id").alias("seq"), text.alias("value")), folder)
    table(spark, sf, "region").coalesce(1).write.parquet(f"{folder}/part=-1")
    got = files.read_folder(spark, folder)
    return got.select(_part("path").alias("part"), "page_no", F.sha2("text", 256).alias("sha256"), "error")


@query("SELECT c_nationkey::BIGINT AS part, 1 AS page_no, sha256(string_agg(k || '. ' || c_name, chr(10) || chr(10) ORDER BY c_custkey)) AS sha256 FROM (SELECT *, c_nationkey || '.' || c_custkey AS k FROM customer) GROUP BY c_nationkey")
def src_clauses(spark, sf):
    """Clauses whose numbers stand in a list at the foot of the page: each is put before its own."""
    folder = _folder(spark, "clauses")
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("part"), "c_custkey", "c_name")
    said = c.select("part", F.struct(F.lit(0), "c_custkey").alias("seq"), F.concat("c_name", F.lit("\n")).alias("value"))
    numbers = c.select("part", F.struct(F.lit(1), "c_custkey").alias("seq"), F.concat_ws("", F.col("part"), F.lit("."), "c_custkey", F.lit(".")).alias("value"))
    _as_files(said.unionByName(numbers), folder)
    return files.read_folder(spark, folder).select(_part("path").alias("part"), "page_no", F.sha2("text", 256).alias("sha256"))


@query("SELECT doc_id, scan AS ocr, sha256(CASE WHEN scan THEN substr(text, 1, 40) ELSE coalesce(text, '') END) AS sha256 FROM (SELECT *, coalesce(length(text), 0) % 2 = 1 AS scan FROM documents)")
def src_scans(spark, sf):
    """Texts of odd length come as images without a text layer; the engine given reads their first 40 characters."""
    odd = F.length("text") % 2 == 1
    d = table(spark, sf, "documents").select("doc_id", F.when(odd, F.encode("text", "UTF-8")).alias("image"), F.when(odd, F.lit("")).otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.lit(False).alias("ocr"))
    return files.recognised(d, lambda image: image.decode()[:40]).select("doc_id", "ocr", F.sha2("text", 256).alias("sha256"))


@query(f"WITH {PAGES_SQL} SELECT 'documents' AS corpus, 2 AS generation, doc_id, page_no, sha256(text) AS sha256 FROM pages_")
def corpus_store(spark, sf):
    """A named corpus, written twice: the second generation is read, from its own folder."""
    store = corpus.Store(spark, _folder(spark, "store"))
    pages = pages_of(spark, sf).select("doc_id", "page_no", "text")
    first = store.create("documents", pages.where("page_no = 1"), "first pages")
    at = store.write("documents", pages, first)
    return store.read("documents").select("corpus", F.lit(at).alias("generation"), "doc_id", "page_no", F.sha2("text", 256).alias("sha256"))


@query(f"WITH {PAGES_SQL} SELECT coalesce(source, '') AS corpus, count(*) AS pages, sum(length(p.text))::BIGINT AS chars FROM pages_ p JOIN documents d USING (doc_id) GROUP BY 1")
def sink_pages(spark, sf):
    """Pages in folders by corpus, here the documents' sources."""
    root = _folder(spark, "pages")
    of = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("c-"), F.coalesce("source", F.lit(""))).alias("corpus"))
    sinks.write_pages(pages_of(spark, sf).select("doc_id", "page_no", "text").join(of, "doc_id"), root)
    got = spark.read.schema("doc_id long, page_no int, text string, corpus string").parquet(root)
    return got.groupBy(F.substring("corpus", 3, 1 << 20).alias("corpus")).agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))


@query(
    """SELECT conv_id::VARCHAR AS answer_id, count(*) FILTER (role = 'assistant') AS claims, count(*) FILTER (role = 'assistant') AS citations, count(*) FILTER (role = 'assistant') AS ledger,
sha256(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), '')) AS gaps FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') > 0"""
)
def sink_answers(spark, sf):
    """Verified answers as JSON: turns of the assistant are claims with one citation each, turns of the user gaps."""
    t = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("answer_id"), F.col("turn").cast("int").alias("seq"), F.col("turn").cast("string").alias("claim_id"), "role", "text")
    said = t.where("role = 'assistant'").withColumns({"cite_id": F.concat_ws("-", "answer_id", "claim_id"), "doc_id": F.col("answer_id"), "quote": F.left("text", F.lit(40))})
    citations = said.select("answer_id", "claim_id", "cite_id", "doc_id", F.lit(1).alias("page_hint"), "quote", F.lit(None).cast("string").alias("anchor"))
    none = F.array().cast("array<string>")
    ledger = said.select("answer_id", "cite_id", "doc_id", F.lit(1).alias("page_no"), F.lit(0).cast("long").alias("start"), F.length("quote").cast("long").alias("end"), F.lit("exact").alias("grade"), none.alias("reasons"), none.alias("warnings"))
    path = _folder(spark, "answers")
    sinks.verified_answers(said.select("answer_id", "claim_id", "text"), citations, ledger, t.where("role = 'user'").select("answer_id", "seq", "text")).write.json(path)
    read = spark.read.schema("answer_id string, claims array<struct<claim_id: string, text: string, citations: array<struct<cite_id: string, quote: string>>>>, verification struct<ledger: array<struct<cite_id: string>>>, gaps array<string>")
    cited = F.aggregate(F.transform("claims", lambda c: F.size(c["citations"])), F.lit(0), lambda a, b: a + b)
    return read.json(path).select("answer_id", F.size("claims").cast("long").alias("claims"), cited.cast("long").alias("citations"), F.size("verification.ledger").cast("long").alias("ledger"), F.sha2(F.array_join("gaps", "\n"), 256).alias("gaps"))

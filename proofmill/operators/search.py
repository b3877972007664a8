"""Keyword search over pages: BM25, phrases, snippets, several searches at once, and the search log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snippet, terms

K1, B = 1.2, 0.75
#: Query terms are broadcast up to this many rows; a larger set is joined by shuffle.
BROADCAST_TERMS = 100_000


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) of (query_id, query): distinct words, nothing added to them."""
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))


def bm25(pages: DataFrame, queries: DataFrame, top: int = 20) -> DataFrame:
    """(query_id, rank, doc_id, page_no, score): the best `top` pages of each query (Robertson and Zaragoza 2009).

    Postings are cut to the query's terms before anything is shuffled; lengths and document frequencies come from
    aggregates of them. Scores are rounded to 6 places so that ranks do not hang on the order of additions.
    """
    wanted = query_terms(queries)
    few = wanted.select("term").distinct()
    few = F.broadcast(few) if few.count() <= BROADCAST_TERMS else few
    words = pages.select("doc_id", "page_no", terms(F.col("text")).alias("words"))
    size = words.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    hits = words.select("doc_id", "page_no", F.size("words").alias("len"), F.explode("words").alias("term")).join(few, "term")
    tf = hits.groupBy("term", "doc_id", "page_no", "len").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scored = wanted.join(tf.join(df, "term"), "term").crossJoin(F.broadcast(size)).withColumn("part", part)
    scored = scored.groupBy("query_id", "doc_id", "page_no").agg(F.round(F.sum("part"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "page_no"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "doc_id", "page_no", "score")


def phrase(pages: DataFrame, text: str) -> DataFrame:
    """(doc_id, page_no, at, snippet) of pages that hold a phrase in any case; at counts from 1."""
    at = F.instr(F.lower("text"), text.lower())
    return pages.withColumn("at", at).where("at > 0").select("doc_id", "page_no", "at", snippet(F.col("text"), F.col("at"), F.lit(len(text))).alias("snippet"))


def passages(pages: DataFrame, queries: DataFrame, around: int = 40) -> DataFrame:
    """(query_id, doc_id, page_no, at, snippet): the first place of each query's first word on its best pages."""
    ranked = bm25(pages, queries).join(queries, "query_id").withColumn("word", F.element_at(terms(F.col("query")), 1))
    found = ranked.join(pages.select("doc_id", "page_no", "text"), ["doc_id", "page_no"]).withColumn("at", F.expr("instr(lower(text), word)"))
    at = F.greatest(F.col("at"), F.lit(1))
    return found.select("query_id", "doc_id", "page_no", "at", snippet(F.col("text"), at, F.length("word"), around).alias("snippet"))


def disconfirming(purpose: Column) -> Column:
    """Whether a search looked for evidence against the answer."""
    return F.startswith(F.lower(F.coalesce(purpose, F.lit(""))), F.lit("contra"))

"""A run set from end to end: answers in run folders, graded against their corpora and scored against their questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..sources import artefacts
from . import scoring, verify

#: Parts a run's name from its documents' names while all runs are graded together.
_BETWEEN = "\x1f"


def answers(files: DataFrame) -> DataFrame:
    """(answer_id, a, error) of answer.json files; error is what could not be read, cut to its last 200 characters."""
    parsed = files.where("name = 'answer.json'").select(F.col("id").alias("answer_id"), "text", F.from_json("text", schemas.ANSWER_FILE).alias("a"))
    bad = F.col("a").isNull() | F.col("a._corrupt_record").isNotNull()
    return parsed.select("answer_id", "a", F.when(bad, F.right(F.concat(F.lit("answer.json cannot be read: "), "text"), F.lit(200))).alias("error"))


def tables(read: DataFrame) -> dict[str, DataFrame]:
    """Claims, citations, searches and gaps of answers that could be read; unnamed citations are named by their place."""
    good = read.where("error IS NULL")
    claims = good.select("answer_id", F.coalesce("a.question_no", F.lit(1)).alias("question_no"), F.explode("a.claims").alias("c"))
    claims = claims.select("answer_id", "question_no", F.col("c.id").alias("claim_id"), F.coalesce("c.text", F.lit("")).alias("text"), F.coalesce("c.kind", F.lit("document")).alias("kind"), "c.citations")
    cites = claims.select("answer_id", "claim_id", F.posexplode("citations").alias("at", "q"))
    named = F.coalesce("q.id", F.concat_ws(".", "claim_id", (F.col("at") + 1).cast("string")))
    return {
        "claims": claims.drop("citations"),
        "citations": cites.select("answer_id", "claim_id", named.alias("cite_id"), F.col("q.doc").alias("doc_id"), F.col("q.page").alias("page_hint"), "q.quote", F.coalesce("q.anchor", F.lit("")).alias("anchor")),
        "searches": good.select("answer_id", F.posexplode("a.searches").alias("seq", "s")).select("answer_id", "seq", "s.query", F.col("s.for").alias("purpose")),
        "gaps": good.select("answer_id", F.posexplode("a.gaps").alias("seq", "text")),
    }


def graded(citations: DataFrame, pages: DataFrame) -> DataFrame:
    """The ledger of all runs at once. pages: (answer_id, doc_id, page_no, text, ocr), each run with its own corpus."""
    own = F.concat_ws(_BETWEEN, "answer_id", F.coalesce("doc_id", F.lit("")))
    ledger = verify.grade(citations.withColumn("doc_id", own), pages.withColumn("doc_id", own).drop("answer_id"))
    return ledger.withColumn("doc_id", F.substring_index("doc_id", _BETWEEN, -1))


def scored(questions: DataFrame, files: DataFrame, pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per question: status, error, counts, flags, judgment and whether it passes.

    files: (id, name, text) of the run folders; pages as in `graded`; docs: (answer_id, doc_id, url, thin, seq).
    Questions without an answer, without a corpus or with an answer that cannot be read have nulls for what was not
    counted. Without questions there are no rows.
    """
    read = answers(files)
    t = tables(read)
    ledger = graded(t["citations"], pages)
    corpora = pages.groupBy("answer_id").agg(F.countDistinct("doc_id").alias("documents_in_corpus"))
    counts = verify.summary(ledger, corpora.select("answer_id", F.col("documents_in_corpus").alias("docs_in_corpus"))).drop("docs_in_corpus")
    state = read.select("answer_id", "error", F.lit(True).alias("answered"), F.coalesce(F.size("a.gaps"), F.lit(0)).cast("long").alias("gaps"))
    out = questions.select("seq", "id", "domain", F.col("id").alias("answer_id"))
    for part in (state, corpora, counts, scoring.sources(questions, ledger.select("answer_id", "doc_id").distinct(), docs), scoring.search_flags(t["searches"])):
        out = out.join(part, "answer_id", "left")
    out = out.join(artefacts.judgments(files), "id", "left")
    status = scoring.status(F.col("answered").isNotNull(), F.col("documents_in_corpus").isNotNull(), F.col("error").isNull())
    out = out.withColumn("status", status).withColumn("disconfirming", F.coalesce("disconfirming", F.lit(False)))
    ran = lambda c, none: F.when(F.col("status") == "run", F.coalesce(c, none)).alias(c)
    zero = F.lit(0).cast("long")
    passed = scoring.passes(F.coalesce("failed", zero), F.col("disconfirming"), F.col("circular"), F.col("agrees"))
    return out.select(
        "seq", "id", "domain", "status",
        F.when(F.col("status") == "verify-error", F.col("error")).alias("error"),
        *[ran(c, zero) for c in ("citations", "verified", "failed", "warnings")],
        ran("grades", F.create_map().cast("map<string,bigint>")),
        ran("searches", zero), ran("disconfirming", F.lit(False)),
        ran("documents_in_corpus", zero), ran("documents_cited", zero),
        ran("circular", F.lit(False)), ran("low_yield_cited", F.lit(False)), ran("gaps", zero),
        F.when(F.col("status") == "run", F.col("agrees")).alias("agrees"),
        F.when(F.col("status") == "run", F.coalesce("notes", F.lit(""))).alias("notes"),
        F.when(F.col("status") == "run", passed).alias("pass"),
    )


def corpora(spark: SparkSession, store, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pages and documents of the registered corpora eval-<id>, one read for each; a corpus has few questions."""
    pages = spark.createDataFrame([], "answer_id string, doc_id string, page_no int, text string, ocr boolean, url string, thin boolean")
    for name in ids:
        if store.generation(f"eval-{name}"):
            pages = pages.unionByName(store.read(f"eval-{name}").withColumn("answer_id", F.lit(name)), allowMissingColumns=True)
    docs = pages.groupBy("answer_id", "doc_id").agg(F.max("url").alias("url"), F.bool_or("thin").alias("thin"), F.lit(0).alias("seq"))
    return pages.select("answer_id", "doc_id", "page_no", "text", "ocr"), docs

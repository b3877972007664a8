"""Scores of a set of answers: status, circularity, low-yield sources, recorded counter-evidence, pass or fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import disconfirming


def status(has_answer: Column, has_corpus: Column, has_output: Column) -> Column:
    """The first thing that is missing."""
    return F.when(~has_answer, "pending").when(~has_corpus, "no-corpus").when(~has_output, "verify-error").otherwise("run")


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with one key, the last."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("pm_place", place).where("pm_place = 1").drop("pm_place")


def corpus_of(questions: DataFrame, registry: DataFrame, local: DataFrame) -> DataFrame:
    """(id, root): the registered corpus eval-<id>, else the run's own folder if it has an index, else null."""
    named = registry.select(F.col("name"), F.col("root").alias("registered"))
    own = local.where("has_index").select("id", F.col("root").alias("own"))
    out = questions.select("id").join(named, F.concat(F.lit("eval-"), F.col("id")) == F.col("name"), "left").join(own, "id", "left")
    return out.select("id", F.coalesce("registered", "own").alias("root"))


def cited(ledger: DataFrame, fallback: DataFrame) -> DataFrame:
    """(answer_id, doc_id) distinct, failed rows included; answers without ledger rows take the fallback's."""
    first = ledger.select("answer_id", "doc_id").distinct()
    rest = fallback.select("answer_id", "doc_id").distinct().join(first.select("answer_id").distinct(), "answer_id", "left_anti")
    return first.unionByName(rest)


def sources(questions: DataFrame, cites: DataFrame, docs: DataFrame) -> DataFrame:
    """(answer_id, circular, low_yield_cited). docs: (answer_id, doc_id, url, thin, seq).

    Circular: at least one cited document is in the index and all of those have exactly the question's address. A null
    address counts as another one, ids not in the index are left out, and of repeated ids the last holds.
    """
    index = last_by(docs, ["answer_id", "doc_id"], "seq")
    by = cites.join(index, ["answer_id", "doc_id"]).join(questions.select(F.col("id").alias("answer_id"), F.coalesce("source_url", F.lit("")).alias("source_url")), "answer_id")
    flags = by.groupBy("answer_id").agg(
        F.every(F.coalesce(F.col("url") == F.col("source_url"), F.lit(False))).alias("circular"), F.bool_or(F.coalesce("thin", F.lit(False))).alias("low_yield_cited")
    )
    out = questions.select(F.col("id").alias("answer_id")).join(flags, "answer_id", "left")
    return out.select("answer_id", F.coalesce("circular", F.lit(False)).alias("circular"), F.coalesce("low_yield_cited", F.lit(False)).alias("low_yield_cited"))


def search_flags(searches: DataFrame) -> DataFrame:
    """(answer_id, searches, disconfirming) of (answer_id, purpose)."""
    return searches.groupBy("answer_id").agg(F.count("*").alias("searches"), F.bool_or(disconfirming(F.col("purpose"))).alias("disconfirming"))


def passes(failed: Column, contra: Column, circular: Column, agrees: Column, citations: Column | None = None) -> Column:
    """A null judgment passes. With `citations`, an answer that cites nothing does not."""
    ok = (failed == 0) & contra & ~circular & (F.coalesce(agrees, F.lit("")) != "no")
    return ok if citations is None else ok & (citations > 0)


def totals(rows: DataFrame) -> DataFrame:
    """Sums over the rows that ran."""
    return rows.where("status = 'run'").agg(
        F.count("*").alias("answers"),
        F.sum("citations").alias("citations"),
        F.sum("verified").alias("verified"),
        F.sum("failed").alias("failed"),
        F.count_if("disconfirming").alias("disconfirming"),
        F.count_if("circular").alias("circular"),
        F.count_if("pass").alias("passed"),
    )


def chosen(questions: DataFrame, ids: list[str]) -> DataFrame:
    """The questions of that name in the order of the set; unknown names are ignored, none means all. Has column seq."""
    return (questions.where(F.col("id").isin(ids)) if ids else questions).orderBy("seq")


def shown(rows: DataFrame) -> DataFrame:
    """The cells of the table as text."""
    ran = F.col("status") == "run"
    text = lambda c: F.when(ran, F.col(c).cast("string")).otherwise("")
    return rows.select(
        "id",
        "domain",
        *[text(c).alias(c) for c in ("citations", "verified", "failed", "warnings")],
        F.when(ran, F.when(F.col("disconfirming"), "yes").otherwise("no")).otherwise("").alias("disconfirming"),
        F.when(ran, F.when(F.col("circular"), "YES").otherwise("no")).otherwise("").alias("circular"),
        F.when(ran, F.coalesce(F.nullif("agrees", F.lit("")), F.lit("—"))).otherwise("").alias("agrees"),
        F.when(~ran, F.concat(F.lit("*"), F.col("status"), F.lit("*"))).otherwise(F.when(F.col("pass"), "pass").otherwise("FAIL")).alias("pass"),
    )


def notes(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'run' AND coalesce(notes, '') <> ''").select("id", "notes")


def listed(questions: DataFrame, answered: DataFrame) -> DataFrame:
    """(id, domain, state, question cut to 70 characters)."""
    done = answered.select("id").distinct().withColumn("done", F.lit(True))
    out = questions.join(done, "id", "left")
    return out.select("id", "domain", F.when(F.col("done"), "run").otherwise("pending").alias("state"), F.substring("question", 1, 70).alias("question"))


def by_domain(rows: DataFrame) -> DataFrame:
    """Totals by domain and over all (domain null)."""
    return rows.where("status = 'run'").rollup("domain").agg(
        F.count("*").alias("answers"), F.sum("citations").alias("citations"), F.sum("failed").alias("failed"), F.count_if("pass").alias("passed"), F.grouping("domain").cast("int").alias("all_domains")
    )

"""One row per document, one column per question, each cell with the sentence that carries it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences

#: Fields are few by nature; more than this is refused.
MOST_FIELDS = 1000


def cells(pages: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, field, state, value, sentence, page_no): the first sentence that states a value or that there is no limit.

    state is `value`, `unlimited`, or `absent` where no sentence speaks of it. Of two kinds in one sentence, `unlimited`
    counts. Fields are broadcast to the sentences; a document and a field meet in one aggregate.
    """
    n = fields.count()
    if n > MOST_FIELDS:
        raise ValueError(f"{n} fields; at most {MOST_FIELDS}")
    lines = pages.select("doc_id", "page_no", F.posexplode(sentences(F.col("text"))).alias("place", "sentence"))
    tried = lines.crossJoin(F.broadcast(fields))
    none = F.coalesce(F.regexp_like("sentence", F.col("unlimited_pattern")), F.lit(False))
    value = F.coalesce(F.regexp_substr("sentence", F.col("value_pattern")), F.lit(""))
    found = tried.withColumns({"none": none, "value": value}).where("none OR value <> ''")
    first = F.min(F.struct("page_no", "place", F.when(F.col("none"), "unlimited").otherwise("value").alias("state"), F.when(~F.col("none"), F.col("value")).alias("value"), "sentence"))
    best = found.groupBy("doc_id", "field").agg(first.alias("c"))
    every = pages.select("doc_id").distinct().crossJoin(F.broadcast(fields.select("field")))
    out = every.join(best, ["doc_id", "field"], "left")
    return out.select("doc_id", "field", F.coalesce("c.state", F.lit("absent")).alias("state"), "c.value", "c.sentence", "c.page_no")


def grid(found: DataFrame, names: list[str]) -> DataFrame:
    """Wide form: a column per field with its value, `no limit`, or null."""
    shown = F.when(F.col("state") == "unlimited", F.lit("no limit")).otherwise(F.col("value"))
    return found.withColumn("shown", shown).groupBy("doc_id").pivot("field", names).agg(F.first("shown"))


def as_answer(found: DataFrame, answer_id: str) -> tuple[DataFrame, DataFrame]:
    """Claims and citations of the filled cells, to be graded like any answer."""
    filled = found.where("state <> 'absent'").withColumn("claim_id", F.concat_ws("/", F.col("doc_id").cast("string"), "field"))
    said = F.concat_ws(" ", F.concat(F.col("field"), F.lit(":")), F.coalesce("value", F.lit("no limit")))
    claims = filled.select(F.lit(answer_id).alias("answer_id"), F.lit(1).alias("question_no"), "claim_id", said.alias("text"), F.lit("document").alias("kind"))
    cites = filled.select(F.lit(answer_id).alias("answer_id"), "claim_id", F.col("claim_id").alias("cite_id"), "doc_id", F.col("page_no").alias("page_hint"), F.col("sentence").alias("quote"), F.coalesce("value", F.lit("no limit")).alias("anchor"))
    return claims, cites

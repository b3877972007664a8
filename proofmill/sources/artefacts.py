"""JSON files of question sets, runs and event logs, read with fixed schemas; what is missing becomes null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def questions(spark: SparkSession, path: str) -> DataFrame:
    """One row per question, with its place in the set (seq)."""
    q = spark.read.schema(schemas.QUESTION_FILE).option("multiLine", "true").json(path)
    out = q.select(F.posexplode("questions").alias("seq", "q")).select("seq", "q.*")
    return out.withColumn("retrieved", F.to_date("retrieved"))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    p = spark.read.schema(schemas.TRIGGER_FILE).option("multiLine", "true").json(path)
    return p.select(F.posexplode("prompts").alias("session", "p")).select("session", "p.expect", "p.prompt")


def run_files(spark: SparkSession, root: str) -> DataFrame:
    """(id, name, text) of the JSON files in folders root/<id>/."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("id"), F.element_at(parts, -1).alias("name"), F.col("content").cast("string").alias("text"))


def _parsed(files: DataFrame, name: str, schema) -> DataFrame:
    return files.where(F.col("name") == name).select("id", F.from_json("text", schema).alias("j"))


def judgments(files: DataFrame) -> DataFrame:
    """(id, agrees, notes) of judgment.json; notes are never null."""
    j = _parsed(files, "judgment.json", schemas.JUDGMENT_FILE)
    return j.select("id", F.col("j.agrees_with_reference").alias("agrees"), F.coalesce("j.notes", F.lit("")).alias("notes"))


def index_docs(files: DataFrame) -> DataFrame:
    """(answer_id, doc_id, url, thin, seq) of index.json."""
    i = _parsed(files, "index.json", schemas.INDEX_FILE)
    return i.select(F.col("id").alias("answer_id"), F.posexplode("j.docs").alias("seq", "d")).select("answer_id", F.col("d.id").alias("doc_id"), F.col("d.source.url").alias("url"), F.col("d.thin").alias("thin"), "seq")


def verified(files: DataFrame) -> DataFrame:
    """(id, gaps, cited) of answer.verified.json; cited are the ids its own ledger names."""
    v = _parsed(files, "answer.verified.json", schemas.VERIFIED_FILE)
    gaps = F.size(F.coalesce("j.gaps", F.array().cast("array<string>")))
    return v.select("id", gaps.cast("long").alias("gaps"), F.coalesce("j.verification.ledger.doc", F.array().cast("array<string>")).alias("cited"))


def verifier_output(text: Column) -> Column:
    """The verifier's report, or null where it is not JSON."""
    return F.from_json(text, schemas.VERIFIER_OUT)


def presence(ids: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """(id, there) for every id."""
    have = files.where(F.col("name") == name).select("id").distinct().withColumn("there", F.lit(True))
    return ids.select("id").join(have, "id", "left").withColumn("there", F.coalesce("there", F.lit(False)))


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """(session, seq, type, kind, name, text, input) of JSON-lines logs, one session per file; bad lines are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("session"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    e = raw.withColumn("e", F.from_json("value", schemas.EVENT_LINE)).where("e IS NOT NULL AND e.type IS NOT NULL")
    out = e.select("session", "line", F.col("e.type").alias("type"), F.posexplode_outer("e.message.content").alias("part", "c"))
    seq = F.col("line") * 10_000 + F.coalesce("part", F.lit(0))
    return out.select("session", seq.alias("seq"), "type", F.col("c.type").alias("kind"), F.col("c.name").alias("name"), F.col("c.text").alias("text"), F.col("c.input").alias("input"))

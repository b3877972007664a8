"""What leaves the engine: verified answers, worksheets, scorecards and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(Exception):
    """The write would replace something that should stay."""


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """One small file, through the file system that the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(p, overwrite)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def verified_answers(claims: DataFrame, citations: DataFrame, ledger: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row per answer: claims with their citations, the verification ledger and the gaps, ready for write.json."""
    cites = citations.groupBy("answer_id", "claim_id").agg(F.sort_array(F.collect_list(F.struct("cite_id", "doc_id", "page_hint", "quote", "anchor"))).alias("citations"))
    said = claims.join(cites, ["answer_id", "claim_id"], "left").groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("claim_id", "text", "citations"))).alias("claims"))
    led = ledger.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("cite_id", F.col("doc_id").alias("doc"), "page_no", "start", "end", "grade", "reasons", "warnings"))).alias("ledger"))
    open_ = gaps.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("g"))
    out = said.join(led, "answer_id", "left").join(open_, "answer_id", "left")
    return out.select("answer_id", "claims", F.struct("ledger").alias("verification"), F.transform(F.coalesce("g", F.array().cast("array<struct<seq:int,text:string>>")), lambda x: x["text"]).alias("gaps"))


def write_scorecard(spark: SparkSession, shown: list, totals, rows: DataFrame, scored: str, md: str, js: str, subset: bool = False, force: bool = False) -> None:
    """Markdown and JSON scorecards. With nothing scored, or a subset, an old scorecard stays unless forced."""
    from ..operators.report import scorecard

    if not force and exists(spark, md) and (totals["answers"] == 0 or subset):
        raise Refused("no run was scored" if totals["answers"] == 0 else "a subset would replace the whole scorecard")
    write_text(spark, md, scorecard(shown, totals, scored))
    body = [json.loads(r[0]) for r in rows.orderBy("seq").select(F.to_json(F.struct("*"))).collect()]
    write_text(spark, js, json.dumps({"scored": scored, "rows": body}, indent=1))


def write_grid(cells: DataFrame, wide: DataFrame, worksheet: str, answer: str) -> None:
    """The worksheet (one row per cell) and the answer grid (one row per document), as JSON lines."""
    cells.write.mode("overwrite").json(worksheet)
    wide.write.mode("overwrite").json(answer)


def write_pages(pages: DataFrame, root: str) -> None:
    """Pages by corpus; readers of one corpus read its folder alone."""
    pages.write.partitionBy("corpus").mode("append").parquet(root)

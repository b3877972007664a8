"""Did a session start the checker when it should have: an ordered fold over its event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def steps(events: DataFrame, skill: str, notices: str) -> DataFrame:
    """(session, seq, kind, text, starts) of log lines (session, seq, type, kind, name, text, input).

    Only an assistant's tool uses and texts are steps. A use of the skill, or of one of its programs, starts; the
    notices program otherwise is no step.
    """
    own = (F.col("name") == "Skill") & F.contains("input", F.lit(skill))
    program = F.contains("input", F.lit(skill + "/scripts"))
    starts = (F.col("kind") == "tool_use") & F.coalesce(own | program, F.lit(False))
    quiet = (F.col("kind") == "tool_use") & F.coalesce(F.contains("input", F.lit(notices)), F.lit(False))
    out = events.where("type = 'assistant' AND kind IN ('text', 'tool_use')").withColumn("starts", starts)
    return out.where(F.col("starts") | ~quiet).select("session", "seq", "kind", "text", "starts")


def sessions(events: DataFrame, skill: str = "checker", notices: str = "notices.py") -> DataFrame:
    """(session, started, next_step): the first step after the start that is not itself a start."""
    s = steps(events, skill, notices)
    begin = s.where("starts").groupBy("session").agg(F.min("seq").alias("begin"))
    asked = F.when((F.col("kind") == "text") & F.contains(F.coalesce("text", F.lit("")), F.lit("?")), "asked first").otherwise("went straight to work")
    after = s.where("NOT starts").join(begin, "session").where("seq > begin").groupBy("session").agg(F.min_by(asked, "seq").alias("next_step"))
    out = events.select("session").distinct().join(begin, "session", "left").join(after, "session", "left")
    return out.select("session", F.col("begin").isNotNull().alias("started"), F.coalesce("next_step", F.lit("")).alias("next_step"))


def check(prompts: DataFrame, found: DataFrame, containing: str | None = None) -> DataFrame:
    """(session, expect, started, ok) of prompts (session, expect, prompt)."""
    if containing:
        prompts = prompts.where(F.contains(F.lower("prompt"), F.lit(containing.lower())))
    out = prompts.join(found, "session", "left").withColumn("started", F.coalesce("started", F.lit(False)))
    return out.select("session", "expect", "started", (F.col("started") == (F.col("expect") == "start")).alias("ok"))

"""Streams over the operation log: windowed counts and sessions with watermarks, and incremental ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import paginate

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """A stream of the log's files. The time becomes a timestamp with zone, as watermarks need."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(log: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n) by windows; works on streams and tables."""
    log = log.withWatermark("ts", late) if log.isStreaming else log
    return log.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(log: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    log = log.withWatermark("ts", late) if log.isStreaming else log
    return log.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no pause of `gap`."""
    log = log.withWatermark("ts", late) if log.isStreaming else log
    by = log.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return by.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drained(spark: SparkSession, df: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its rows as a table, through Parquet beside the checkpoint."""
    out = f"{checkpoint}/out-{uuid.uuid4().hex}"
    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{checkpoint}/state-{uuid.uuid4().hex}").trigger(availableNow=True)
    if mode == "append":
        query = query.format("parquet").start(out)
    else:
        query = query.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def ingest(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, name: str) -> None:
    """Append the pages of documents that arrived since the last run; each file is read once."""
    docs = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    pages = paginate(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    pages.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()

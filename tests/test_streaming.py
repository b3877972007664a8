import uuid

from proofmill import streaming
from proofmill.streaming import drained, events, sessions, tumbling

SF = "/root/testdata/sf0.001"


def test_append_windows_are_a_part_of_the_tables(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value", "props")
    got = drained(spark, tumbling(events(spark, SF)), f"file://{tmp_path}").collect()
    every = set(map(tuple, tumbling(table).collect()))
    assert got and set(map(tuple, got)) <= every


def test_sessions_stream(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet").selectExpr("cast(ts as timestamp) ts", "user_id")
    got = drained(spark, sessions(events(spark, SF)), f"file://{tmp_path}").collect()
    assert set(map(tuple, got)) <= set(map(tuple, sessions(table).collect()))


def test_ingest_reads_a_file_once(spark, tmp_path):
    src, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    add = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(src)
    run = lambda: streaming.ingest(spark, src, "doc_id long, text string", out, state, "*.parquet")
    add([(1, "x" * 4500)])
    run()
    run()
    assert spark.read.parquet(out).count() == 3
    add([(2, "y")])
    run()
    assert spark.read.parquet(out).count() == 4 and uuid is not None

"""Relational operations that the engine's operators are made of, over the star schema, and streams over the log."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import streaming
from ..sources.shared import shared_dir
from .corpus_queries import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def rel_aggregate(spark, sf):
    li = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count("*").alias("n")
    )


@query("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
def rel_join(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_acctbal > 5000")
def rel_semi(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 5000").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def rel_anti(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_custkey, o_orderkey, k::INTEGER AS k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 2")
def rel_top_per_group(spark, sf):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf, "orders").withColumn("k", k).where("k <= 2").select("o_custkey", "o_orderkey", "k")


@query("SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS change FROM orders")
def rel_lag(spark, sf):
    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") - before, 2).alias("change"))


@query("SELECT o_orderpriority, o_orderstatus, grouping(o_orderpriority)::INTEGER AS g1, grouping(o_orderstatus)::INTEGER AS g2, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rel_rollup(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.grouping("o_orderpriority").cast("int").alias("g1"), F.grouping("o_orderstatus").cast("int").alias("g2"), F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def rel_intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000")
def rel_except(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, sf, "supplier").where("s_acctbal > 3000").select("s_nationkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def rel_top(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT event_type, (json_extract_string(props, '$.k'))::INTEGER % 5 AS k, count(*) AS n FROM events GROUP BY ALL")
def rel_json(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") % 5
    return table(spark, sf, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


# ---- streams ----

_AT = "yyyy-MM-dd HH:mm:ss"


def _read_out(spark, df):
    """The rows of a stream read to its end; complete windows equal those of the table."""
    return streaming.drained(spark, df, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", "complete")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    return _read_out(spark, streaming.tumbling(streaming.events(spark, sf))).select(F.date_format("start", _AT).alias("start"), "event_type", "n")


@query(
    "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY ALL"
)
def stream_sliding(spark, sf):
    return _read_out(spark, streaming.sliding(streaming.events(spark, sf))).select(F.date_format("start", _AT).alias("start"), "n")


@query(
    "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, g"
)
def stream_sessions(spark, sf):
    return _read_out(spark, streaming.sessions(streaming.events(spark, sf))).select("user_id", F.date_format("start", _AT).alias("start"), "n")

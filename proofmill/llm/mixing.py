"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: The table of sources is broadcast up to this many rows (about 100 bytes each); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from the seed and the document's id (from its text where the id is null)."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size): weights repeat over sources by code point, null last.

    A target stops at `most` times its source's size and the excess is shared anew by weight until none is above;
    that fixed point is found in one ordered pass by filling sources in order of capacity per weight. The windows
    run over one row per source, made by a partial aggregation first.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(1))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns(
        {
            "left": F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "weights_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "rank": F.row_number().over(order),
        }
    ).withColumn("full", F.col("left") * F.col("weight") >= F.col("cap") * F.col("weights_left"))
    open_first = F.min(F.when(~F.col("full"), F.struct("rank", "left", "weights_left"))).over(everything)
    s = s.withColumn("open", open_first)
    level = F.col("weight") * F.col("open.left") / F.col("open.weights_left")
    return s.select("source", "source_size", F.when(F.col("open").isNull() | (F.col("rank") < F.col("open.rank")), F.col("cap")).otherwise(level).alias("target"))


def mixing_plan(spark: SparkSession, docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies beside its own columns, one row per row.

    copies is floor(rate) plus a Bernoulli copy with probability equal to the fraction, from a hash of the id:
    reruns agree, and repeated rows draw alike. Null text has size 0; a source of size 0 has rate 0; an empty
    table gives none. Columns of docs that have the names used here are hidden behind the `mix_` prefix.
    """
    inner = docs.select(F.col("source"), words(F.col("text")).alias("size"))
    table = stored(spark, source_targets(inner, weights, share, most), "sources").select(
        F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")
    )
    side = F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table
    out = docs.withColumn("mix_size", words(F.col("text"))).join(side, F.col("source").eqNullSafe(F.col("mix_source"))).drop("mix_source")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    extra = (uniform(F.col("doc_id"), F.col("text"), seed) < rate - F.floor(rate)).cast("long")
    return out.withColumn("mix_copies", F.floor(rate).cast("long") + extra)


def mixed(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of docs as often as its copies say, with its own columns."""
    plan = mixing_plan(spark, docs, **options).where("mix_copies > 0")
    return plan.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select(*[plan[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: size, source_size, target and words taken of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixing_plan(spark, docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s0),
s2 AS (
  SELECT *, (SELECT sum(source_size)::BIGINT FROM s1) * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0) AS rest,
         (SELECT sum(weight) FROM s1) - coalesce(sum(weight) OVER w, 0) AS weights_left, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS rank
  FROM s1 WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT rank, rest, weights_left FROM s2 WHERE NOT rest * weight >= cap * weights_left ORDER BY rank LIMIT 1),
t AS (SELECT s2.source, s2.source_size, CASE WHEN o.rank IS NULL OR s2.rank < o.rank THEN s2.cap ELSE s2.weight * o.rest / o.weights_left END AS target FROM s2 LEFT JOIN o ON true),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM r
"""

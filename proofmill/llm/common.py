"""Shared pieces: the shared folder for intermediate tables, word and shingle hashing, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Word characters are all but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may go without the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="proofmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps survive the loss of any executor.

    The driver collects its garbage after it: Spark removes a shuffle only when the driver has collected what made it, and
    the plans and task results of many short jobs otherwise fill the driver's whole heap."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
            folder.getFileSystem(conf).delete(folder, True)


def small_batches(spark: SparkSession) -> None:
    """Texts are long, so Arrow batches get a bound in bytes that leaves room in an executor; a user's own is kept."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("64MB", "67108864b", "67108864"):
        spark.conf.set(name, "8MB")


def crc_mod(doc_id, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Alternating large-star and small-star: every round is a fixed number of group-bys and equi-joins, and
    each round's edges are written to the shared folder. Self-loops and repeated edges are harmless.
    """
    e = stored(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # dealt by u once, for what is distinct, for the least and for the join
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, stored(spark, small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(spark, last)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges (u, v) are stars: each u has one v, and no v is a u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("end")).select("end.*")
    ends = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return ends.where("ups > 1 OR ups = 1 AND least = 0").agg(F.count("*")).first()[0] == 0


def _random_words(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _random_words(256, 11)
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 16
_POW = np.ones(_BLOCK, np.uint64)
_INV = np.ones(_BLOCK, np.uint64)
with np.errstate(over="ignore"):
    np.multiply.accumulate(np.r_[np.uint64(1), np.full(_BLOCK - 1, _BASE, np.uint64)], out=_POW)
    np.multiply.accumulate(np.r_[np.uint64(1), np.full(_BLOCK - 1, pow(_BASE, -1, 2**64), np.uint64)], out=_INV)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each white-space separated word, in order, in bounded memory for any length."""
    out: list[np.ndarray] = []
    start, n = 0, len(text)
    while start < n:
        end = min(n, start + _BLOCK)
        if end < n:  # cut at white space; a longer word is hashed alone
            cut = max(text.rfind(c, start, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut < start:
                ends = [p for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := text.find(c, end)) >= 0]
                cut = min(ends, default=n)
                out.append(np.array([_long_word(text[start:cut])], np.uint64))
                start = cut + 1
                continue
            end = cut + 1
        out.append(_block_hashes(np.frombuffer(text, np.uint8, end - start, start)))
        start = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _block_hashes(b: np.ndarray) -> np.ndarray:
    gap = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.r_[True, gap, True].view(np.int8)))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.empty(0, np.uint64)
    total = np.empty(len(b) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[b] * _POW[: len(b)], out=total[1:])
    return mix64((total[last] - total[first]) * _INV[first] + (last - first).astype(np.uint64))


def _long_word(word: bytes) -> int:
    total, scale = 0, 1
    for i in range(0, len(word), _BLOCK):
        part = np.frombuffer(word, np.uint8, min(_BLOCK, len(word) - i), i)
        total = (total + scale * int((_BYTE[part] * _POW[: len(part)]).sum(dtype=np.uint64))) % 2**64
        scale = scale * pow(_BASE, len(part), 2**64) % 2**64
    return int(mix64(np.array([(total + len(word)) % 2**64], np.uint64))[0])


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; null is empty. A lone surrogate is kept as three bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


_STEP = _random_words(64, 12)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of each run of k words, in order; with fewer words one hash of them all; none without words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < k:
        return mix64((words * _STEP[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = words[: n - k + 1] * _STEP[0]
    for i in range(1, k):
        total = total + words[i : n - k + 1 + i] * _STEP[i]
    return mix64(total)


def distinct_sorted(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h


def scored(docs: DataFrame, keep: list[str], extra: str, score: Callable[[list], list]) -> DataFrame:
    """keep columns of docs (unchanged, any type) and the columns `extra` that score(texts) gives, row by row."""
    small_batches(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [extra])
    target = to_arrow_schema(StructType.fromDDL(extra))

    def run(batches):
        for b in batches:
            made = score(b.column(0).to_pylist())
            columns = [pa.array(x, kind) for x, kind in zip(made, target.types, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *columns], [*keep, *target.names])

    return docs.select(F.col("text").alias("pm_input"), *keep).mapInArrow(run, schema)

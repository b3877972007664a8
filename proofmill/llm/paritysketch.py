"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct shingles. Each shingle toggles one bit of a sketch, so the Hamming distance
of two sketches is at most the size of the sets' symmetric difference. Two documents link only if that difference
is at most D = (|A| + |B|) / 7 (for 0.75), so of the blocks that a sketch is cut into at most D differ.

* Sizes fall into bands (a factor of 4); a document near the upper end of its band is entered in the next too.
  A band has one block for every two shingles of its largest document. The blocks are wide (2^32 bits) and sparse,
  so a block is kept as the XOR of its set bits' hashes, which is 0 only if it is empty.
* Pigeonhole: of the u blocks of A that are not empty at least u - D agree with B's. Under any common order the
  first D + 1 of A and of B then share one. Blocks with more bits from shingles that are not common come first.
* A document whose first D + 1 blocks take in some of common shingles alone, or which has no more than D, enters in
  their place the first n - ceil(3 n / 4) + 1 of its shingles, common ones last: two such documents that link share
  one of those. If only one of two is of this kind, the block they share is of the other kind. Which shingles count
  as common is read off a bounded sample and decides the order alone, so it affects speed and never the result.
* Documents that share a block are candidates. A narrow dense sketch of each, folded to the same width, drops those
  whose Hamming distance is above D; the others are verified on their shingles.

Only components are asked for, so a group that shares a block is not expanded into its pairs: each member is first
paired with the group's first and previous members, components are formed from the pairs that link, and only then
members of one group that still are in different components are compared, sketch against sketch in blocks of arrays;
what comes out is the pairs whose sketches allow a link, each under the first key they share. Each link either is in
a component already or is verified, so none is lost. Copies with equal sets are one node from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, distinct_sorted, lowered, mix64, scored, shingle_hashes, small_batches, stored, word_hashes

K = 5
#: Members that one text is compared with in one group of the verification.
CHUNK = 256
#: Addresses of texts to verify are broadcast up to this many rows (40 bytes each); beyond, they are joined by shuffle.
BROADCAST_ROWS = 400_000
_ROWS = 1 << 17
#: Groups of up to FEW members are paired by a join; larger ones are compared as arrays, in blocks of BLOCK members.
FEW, BLOCK = 32, 2048
#: Sample of sets that tells common shingles: their expected number, and what counts as common there.
SAMPLE, COMMON_IN, COMMON_MOST = 4000, 4, 200_000


def shingles(text: str | None, k: int = K) -> np.ndarray:
    """Sorted distinct shingle hashes of the whole text."""
    return distinct_sorted(shingle_hashes(word_hashes(lowered(text)), k))


def node_of(h: np.ndarray) -> int:
    """A 64-bit digest of the set: equal sets are one node."""
    return int(mix64(np.array([mix64(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64)).view(np.int64)[0])


def dense(h: np.ndarray) -> bytes:
    """The parity sketch of at least 2 n bits, a power of two."""
    width = max(64, 1 << (2 * len(h) - 1).bit_length())
    at = (h & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def block_keys(h: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The keys under which a set is entered; two sets that link share one. common: sorted hashes, in any number."""
    n = len(h)
    if not n:
        return h
    at = np.searchsorted(common, h)
    rare = common[np.minimum(at, len(common) - 1)] != h if len(common) else np.ones(n, bool)
    most = (n + 4 * n // 3) // 7
    band = (n.bit_length() - 1) // 2
    out, instead = [], False
    for b in (band, band + 1) if 4 * n // 3 >= 4 ** (band + 1) else (band,):
        m = mix64(h + np.uint64(b + 1))
        block = ((m >> np.uint64(32)) % np.uint64(max(1, 4 ** (b + 1) // 2))).astype(np.int64)
        order = np.argsort(block, kind="stable")
        block = block[order]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        parity = np.bitwise_xor.reduceat(mix64(m[order]), first)
        bits = np.add.reduceat(rare[order].astype(np.int64), first)
        keys = mix64(parity + block[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b))
        pick = np.lexsort((keys, -bits))[: most + 1]
        whole = bits[pick] > 0
        instead |= len(pick) <= most or not whole.all()
        out.append(keys[pick[whole]])
    if instead:
        out.append(mix64(h[np.lexsort((h, ~rare))[: n - (3 * n + 3) // 4 + 1]] ^ np.uint64(0xD6E8FEB86659FD93)))
    return np.concatenate(out)


def _entries(batches, common: np.ndarray):
    """(key, node) of (text): each set once in a run of rows."""
    for batch in batches:
        seen: set[int] = set()
        keys, nodes, total = [], [], 0
        for text in batch.column("text").to_pylist():
            h = shingles(text)
            node = node_of(h)
            if len(h) and node not in seen:
                seen.add(node)
                keys.append(block_keys(h, common).view(np.int64))
                nodes.append(np.full(len(keys[-1]), node, np.int64))
                total += len(keys[-1])
                if total >= _ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], ["key", "node"])
                    keys, nodes, total = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], ["key", "node"])


def _groups(batches):
    """Of rows sorted by (key, node): those of keys with two nodes or more, with the group's first and previous node.

    A batch's last row is held back until the next shows whether its key goes on; nothing else is kept.
    """
    names = ["key", "node", "first", "previous"]
    held = np.empty((2, 0), np.int64)
    group_first, open_key = 0, None

    def out(rows: np.ndarray, more_key):
        nonlocal group_first, open_key
        key, node = rows
        start = np.r_[True, key[1:] != key[:-1]]
        going = open_key is not None and len(key) > 0 and key[0] == open_key[0]
        if going:
            start[0] = False
        at = np.maximum.accumulate(np.where(start, np.arange(len(key)), -1))
        first = np.where(at >= 0, node[np.maximum(at, 0)], group_first)
        previous = np.r_[node[:1], node[:-1]]
        if going:
            previous[0] = open_key[1]
        end = np.r_[key[1:] != key[:-1], True if more_key is None else key[-1] != more_key]
        keep = ~(start & end)
        previous = np.where(start, node, previous)
        open_key, group_first = (key[-1], node[-1]), first[-1]
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, node, first, previous)], names)

    for b in batches:
        rows = np.concatenate([held, np.array([b.column("key").to_numpy(zero_copy_only=False), b.column("node").to_numpy(zero_copy_only=False)], np.int64).reshape(2, -1)], 1)
        if rows.shape[1]:
            rows = rows[:, np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(0)]]
        if rows.shape[1] < 2:
            held = rows
            continue
        held = rows[:, -1:]
        yield out(rows[:, :-1], held[0, 0])
    if held.shape[1]:
        yield out(held, None)


def _close(batches):
    """Pairs whose sizes and sketches allow a link."""
    for b in batches:
        keep = [
            100 * min(n, m) >= 75 * max(n, m) and hamming(s, t) <= (n + m) // 7
            for n, m, s, t in zip(*(b.column(c).to_pylist() for c in ("n", "m", "s", "t")), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all at the least width among them."""
    width = min(map(len, sketches))
    out = np.empty((len(sketches), width // 8), np.uint64)
    for k, s in enumerate(sketches):
        x = np.frombuffer(s, np.uint64)
        while len(x) > width // 8:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[k] = x
    return out


def _compare(batches):
    """Rows sorted by (key, i, j): members of blocks i and j of a group. Pairs in different components whose sizes and
    sketches allow a link, where this is the first key that both have."""
    names = ("key", "i", "j", "block", "node", "c", "n", "sketch", "keys")
    held: list[tuple] = []

    def pairs(rows: list[tuple]):
        key, bi, bj = rows[0][:3]
        block, node, c, n = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5, 6))
        sketch = _folded([r[7] for r in rows])
        keys = [frozenset(r[8]) for r in rows]
        found = []
        for a in np.flatnonzero(block == bi):
            rest = np.arange(a + 1, len(rows)) if bi == bj else np.flatnonzero(block == bj)
            rest = rest[(c[rest] != c[a]) & (100 * np.minimum(n[rest], n[a]) >= 75 * np.maximum(n[rest], n[a]))]
            far = np.bitwise_count(sketch[rest] ^ sketch[a]).sum(1, dtype=np.int64)
            for b in rest[far <= (n[rest] + n[a]) // 7]:
                if min(keys[a] & keys[b]) == key:
                    found.append((min(node[a], node[b]), max(node[a], node[b])))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for row in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
            if held and row[:3] != held[0][:3]:
                if len(held) > 1:
                    yield pairs(held)
                held = []
            held.append(row)
    if len(held) > 1:
        yield pairs(held)


def _unsettled(spark: SparkSession, member: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) within groups of (key, node, c) that are in different components and may link.

    A join pairs the members of small groups, at most FEW - 1 rows for a member. Members of large groups travel with
    their sketches and the large groups they are in, and only pairs whose sketches allow a link come out.
    """
    sizes = member.groupBy("key").agg(F.count("*").alias("g"))
    member = stored(spark, member.join(sizes, "key"), "sized")
    few = member.where(F.col("g") <= FEW).join(nodes.select("node", "n"), "node").select("key", "node", "c", "n")
    other = few.select("key", *[F.col(c).alias(c + "2") for c in ("node", "c", "n")])
    pairs = few.join(other, "key").where("c < c2 AND 100 * least(n, n2) >= 75 * greatest(n, n2)")
    pairs = pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
    many = member.where(F.col("g") > FEW)
    keys = many.groupBy("node").agg(F.collect_list("key").alias("keys"))
    blocks = F.ceil(F.col("g") / BLOCK)
    # by a hash of the node: about BLOCK members each, and no task ranks a whole group
    rows = many.withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "c")
    rows = rows.join(nodes.select("node", "n", "sketch").join(keys, "node"), "node")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare, "a long, b long")
    return pairs.unionByName(rows).distinct()


def _verify(batches):
    """Rows sorted by (a, chunk, place): the text of a first, then those it is compared with."""
    at, mine = None, None
    for batch in batches:
        found = []
        for a, node, text in zip(*(batch.column(c).to_pylist() for c in ("a", "node", "text")), strict=True):
            h = shingles(text)
            if node_of(h) != node:
                continue  # another row with the id of the one that is meant
            if node == a:
                at, mine = a, h
            elif at == a:
                common = len(np.intersect1d(mine, h, assume_unique=True))
                if 100 * common >= 75 * (len(mine) + len(h) - common):
                    found.append((a, node))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _linked(spark: SparkSession, docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b) of nodes those that link."""
    x = nodes.select(F.col("node").alias("a"), "n", F.col("sketch").alias("s"))
    y = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("t"))
    near = pairs.join(x, "a").join(y, "b").where("100 * least(n, m) >= 75 * greatest(n, m)").select("a", "b", "n", "m", "s", "t").mapInArrow(_close, "a long, b long")
    near = stored(spark, near, "pairs")
    place = F.row_number().over(Window.partitionBy("a").orderBy("b"))
    members = near.select("a", "b", F.floor((place - 1) / CHUNK).cast("int").alias("chunk"))
    rows = members.select("a", "chunk", F.col("b").alias("node")).unionByName(members.select("a", "chunk", F.col("a").alias("node")).distinct())
    rows = stored(spark, rows.join(nodes.select("node", F.col("doc").alias("doc_id")), "node"), "texts")
    side = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    texts = docs.join(side, "doc_id").select("a", "chunk", F.when(F.col("node") == F.col("a"), 0).otherwise(1).alias("place"), "node", "text")
    texts = texts.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "place")
    return stored(spark, texts.mapInArrow(_verify, "a long, b long"), "links")


def _common(docs: DataFrame, nodes: DataFrame) -> np.ndarray:
    """Shingles that COMMON_IN or more of a bounded sample of sets hold, the most frequent COMMON_MOST of them."""
    share = min(1.0, SAMPLE / max(1, nodes.count()))
    picked = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < share * (1 << 30)).select(F.col("doc").alias("doc_id"))
    rows = scored(docs.join(F.broadcast(picked), "doc_id"), [], "h array<long>", lambda texts: [[shingles(t).view(np.int64) for t in texts]])
    counts = rows.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_IN)
    top = counts.orderBy(F.desc("n"), "h").limit(COMMON_MOST).select("h").toPandas()
    return np.sort(top["h"].to_numpy(np.int64).view(np.uint64))


def jaccard_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs (doc_id, text).

    component_id is the smallest doc_id reachable by links of similarity 0.75 or more. Null and blank texts have the
    empty set and are linked with nothing; rows without doc_id have a null component_id; repeated rows and equal
    texts are in one component; an empty table gives none. Other columns are not read.
    """
    small_batches(spark)
    docs = docs.select("doc_id", "text")

    def measure(texts):
        made = [shingles(t) for t in texts]
        return [len(h) for h in made], [node_of(h) for h in made], [dense(h) if len(h) else b"" for h in made]

    sizes = stored(spark, scored(docs, ["doc_id"], "n long, node long, sketch binary", measure), "sizes")
    docs = docs.where("doc_id IS NOT NULL")
    nodes = sizes.where("doc_id IS NOT NULL AND n > 0").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = stored(spark, nodes, "nodes")
    held = spark.sparkContext.broadcast(_common(docs, nodes))
    entries = docs.mapInArrow(lambda batches: _entries(batches, held.value), "key long, node long").repartition("key").sortWithinPartitions("key", "node")
    groups = stored(spark, entries.mapInArrow(_groups, "key long, node long, first long, previous long"), "groups")
    ends = groups.select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b"))
    ends = ends.unionByName(groups.select(F.least("previous", "node").alias("a"), F.greatest("previous", "node").alias("b"))).where("a <> b").distinct()
    ends = stored(spark, ends, "ends")
    links = _linked(spark, docs, nodes, ends)
    comp = stored(spark, components(spark, links), "components")
    member = groups.select("key", "node").join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    mixed = member.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    member = stored(spark, member.join(mixed, "key"), "members")
    rest = _unsettled(spark, member, nodes).join(ends, ["a", "b"], "left_anti")
    more = _linked(spark, docs, nodes, rest)
    comp = components(spark, links.unionByName(more))
    named = nodes.select("node", "doc").join(comp, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("c"))
    least = named.groupBy("c").agg(F.min("doc").alias("component_id"))
    named = stored(spark, named.join(least, "c").select("node", "component_id"), "named")
    out = sizes.join(named, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: set size and component of every document."""
    return jaccard_components(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component (the smallest id), with its own columns; rows without doc_id stay."""
    gone = stored(spark, jaccard_components(spark, docs).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    out = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti").select(*docs.columns)
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return out
    return out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(out.where("doc_id IS NULL"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, h FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS h FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r)::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY 1, 2
"""

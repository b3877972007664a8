"""Removal of repeated 100-byte strings with a distributed suffix sort.

Window = 100 bytes. Each window picks the least hash among its 24-byte grams (the leftmost on ties): equal windows
pick the same gram at the same offset, so windows need comparing only within one gram's group. Consecutive windows
that pick one place form a run, whose text is the union of those windows.

1. Every run is entered as (gram, digest of its text and offset, document, start). Runs with equal text are one class;
   all but the first of a class are repeated throughout. A gram with one class only has nothing more to compare.
   Tasks combine equal runs before they are dealt by gram, so a text that is everywhere sends few rows to one task.
2. For grams with several classes the first run of each class sends its text. The suffixes that begin at the gram,
   and the reversed prefixes that end there, are sorted by deep-shallow sorting: multikey quicksort on 8-byte words
   to a shallow depth, then blind tries for groups that still tie. Their common prefixes give, for each offset of a
   window from its gram, the classes of equal windows; all but the first window of a class are repeated.
3. Each document unites its repeated windows and digests the bytes that remain.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTE, _INV, mix64, _POW, small_batches, stored

SIZE, GRAM = 100, 24
REACH = SIZE - GRAM  # the gram lies 0 to REACH bytes after the start of its window
SHALLOW = 48
_BLOCK = (1 << 16) - 2 * SIZE
_ROWS = 1 << 15
#: Runs that a task combines before the exchange: of equal ones among them only the first needs comparing with others.
_COMBINE = 1 << 18
#: A gram with more classes than this is split: its windows are entered one by one under their own hashes.
MOST_CLASSES = 50_000


def _runs(text: bytes):
    """Arrays (gram hash, digest, first start, last start, place of the gram) of the runs of a text, block by block."""
    for base in range(0, max(0, len(text) - SIZE + 1), _BLOCK):
        b = np.frombuffer(text, np.uint8, min(len(text) - base, _BLOCK + SIZE - 1), base)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * _POW[: len(b)], out=total[1:])
        m = len(b) - GRAM + 1
        gram = mix64((total[GRAM:] - total[:m]) * _INV[:m])
        key = (gram & ~np.uint64(0xFFFF)) | np.arange(m, dtype=np.uint64)
        span, low = 1, key
        while span * 2 <= REACH + 1:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        rest = REACH + 1 - span
        low = np.minimum(low[: len(low) - rest], low[rest:])
        at = (low & np.uint64(0xFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:] - 1, len(at) - 1]
        at = at[first]
        digest = mix64((total[last + SIZE] - total[first]) * _INV[first] + ((last - first) * SIZE + at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        yield gram[at], digest, first + base, last + base, at + base


def _enter(batches):
    """The runs of all texts; `whole` for those that equal an earlier run of the same task, as far as it is combined."""
    names = ["gram", "digest", "doc_id", "first", "last", "place", "whole"]
    got: list[tuple] = []

    def flush():
        x = [np.concatenate(c) for c in zip(*got, strict=True)]
        order = np.lexsort((x[3], x[2], x[1], x[0]))
        gram, digest, doc, *places = (c[order] for c in x)
        whole = np.r_[False, (gram[1:] == gram[:-1]) & (digest[1:] == digest[:-1])]
        return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(doc), *(pa.array(c.astype(np.int32)) for c in places), pa.array(whole)], names)

    total = 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for r in _runs((text or "").encode("utf-8", "surrogatepass")):
                got.append((r[0], r[1], np.full(len(r[0]), doc, np.int64), *r[2:]))
                total += len(r[0])
                if total >= _COMBINE:
                    yield flush()
                    got, total = [], 0
    if got:
        yield flush()


def _classes(batches):
    """Rows sorted by (gram, digest, doc_id, first): `whole` for runs repeated throughout, else the first run of a
    class whose gram has other classes. Rows that are `whole` already go through, wherever they stand. Held back between
    batches: one row, and a class not yet known to have others."""
    names = ["gram", "doc_id", "first", "last", "place", "whole"]
    held = np.empty((6, 0), np.int64)  # the first row of the open gram while it has one class
    tail = None  # gram and digest of the last row, and whether its gram has several classes
    for batch in batches:
        rows = np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "digest", "doc_id", "first", "last", "place")], np.int64)
        done = batch.column("whole").to_numpy(zero_copy_only=False).astype(bool)
        if done.any():
            yield _class_batch(rows[:, done], done[done], names)
            rows = rows[:, ~done]
        if not rows.shape[1]:
            continue
        gram, digest = rows[0], rows[1]
        before_gram = np.r_[gram[:1] if tail and tail[0] == gram[0] else ~gram[:1], gram[:-1]]
        before_digest = np.r_[np.array([tail[1]]) if tail else ~digest[:1], digest[:-1]]
        new_gram = gram != before_gram
        whole = ~new_gram & (digest == before_digest)
        lead = ~whole
        other = lead & ~new_gram  # another class of an open gram
        part = np.cumsum(new_gram)  # 0: goes on from the last batch
        several = np.zeros(part[-1] + 1, bool)
        several[part[other]] = True
        several[0] |= bool(tail and tail[2] and part[0] == 0)
        keep = lead & several[part]
        if held.shape[1] and (several[0] or part[0] != 0):
            if several[0] and part[0] == 0:
                yield _class_batch(held, np.zeros(1, bool), names)
            held = held[:, :0]
        elif held.shape[1] and part[-1] > 0:
            held = held[:, :0]
        last_lead = np.flatnonzero(new_gram)
        if part[-1] > 0 and not several[-1]:
            held = rows[:, last_lead[-1:]]
        tail = (gram[-1], digest[-1], bool(several[-1]))
        pick = keep | whole
        yield _class_batch(rows[:, pick], whole[pick], names)


def _class_batch(rows: np.ndarray, whole: np.ndarray, names: list[str]):
    return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[2]), *(pa.array(x.astype(np.int32)) for x in rows[3:]), pa.array(whole)], names)


def _segments(batches):
    """The texts of runs: from rows (z, wanted) of a packed text and its runs, one row for each."""
    names = ["gram", "doc_id", "first", "last", "place", "text"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for doc, z, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "z", "wanted")), strict=True):
            text = zlib.decompress(z)
            for w in wanted:
                a, b, p = w["first"], w["last"], w["place"]
                parts = [(w["gram"], a, b, p)]
                if w["split"]:
                    parts = [(int.from_bytes(hashlib.blake2b(text[x : x + SIZE] + bytes([p - x]), digest_size=8).digest(), "big", signed=True), x, x, p) for x in range(a, b + 1)]
                for g, x, y, p in parts:
                    for c, v in zip(out, (g, doc, x, y, p, text[x : y + SIZE]), strict=True):
                        c.append(v)
            if len(out[0]) >= _ROWS:
                yield _segment_batch(out, names)
                out = [[] for _ in names]
        yield _segment_batch(out, names)


def _segment_batch(out, names):
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)


def blind_trie(strings: list[bytes], ids: list[int]) -> list[int]:
    """ids by the order of their strings (of one length): inner nodes keep only a depth and their branches."""
    root: list = [None, strings[0], [ids[0]]]
    for s, i in zip(strings[1:], ids[1:], strict=True):
        node = root
        while node[0] is not None:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        t = node[1]
        if s == t:
            node[2].append(i)
            continue
        at = len(s) - ((int.from_bytes(s, "big") ^ int.from_bytes(t, "big")).bit_length() + 7) // 8
        above, node = None, root
        while node[0] is not None and node[0] < at:
            above, node = node, node[1][s[node[0]]]
        leaf = [None, s, [i]]
        if node[0] == at:
            node[1][s[at]] = leaf
        else:
            inner = [at, {t[at]: node, s[at]: leaf}]
            if above is None:
                root = inner
            else:
                above[1][s[above[0]]] = inner
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            out += node[2]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The order of rows (bytes, a multiple of 8 wide) within groups that are already in order.

    Multikey quicksort: rows that tie so far are sorted on their next word, until SHALLOW; then blind tries.
    """
    order = np.arange(len(rows))
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    tie = np.cumsum(np.r_[False, group[1:] != group[:-1]])
    for d in range(min(SHALLOW // 8, words.shape[1])):
        same = np.r_[tie[1:] == tie[:-1], False]
        open_ = np.flatnonzero(same | np.r_[False, same[:-1]])
        if not len(open_):
            return order
        w = words[order[open_], d]
        o = np.lexsort((w, tie[open_]))
        order[open_] = order[open_][o]
        value = np.zeros(len(order), np.uint64)
        value[open_] = w[o]
        tie = np.cumsum(np.r_[False, (tie[1:] != tie[:-1]) | (value[1:] != value[:-1])])
    edge = np.flatnonzero(np.r_[True, tie[1:] != tie[:-1], True])
    deep = np.ascontiguousarray(rows[:, SHALLOW:])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a > 1:
            ids = order[a:b].tolist()
            order[a:b] = blind_trie([deep[i].tobytes() for i in ids], ids)
    return order


def _common(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Bytes that neighbours share; -1 across groups."""
    if len(rows) < 2:
        return np.full(len(rows), -1)
    differ = rows[1:] != rows[:-1]
    n = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.r_[-1, np.where(group[1:] == group[:-1], n, -1)]


def _repeats(gram, doc, first, last, place, texts):
    """(doc_id, first, last) of repeated windows, of runs in the order of (gram, doc_id, first)."""
    n = len(gram)
    right, left = np.zeros((n, SIZE + 4), np.uint8), np.zeros((n, REACH + 4), np.uint8)
    for i, (t, cut) in enumerate(zip(texts, (place - first).tolist(), strict=True)):
        r = t[cut : cut + SIZE]
        right[i, : len(r)] = np.frombuffer(r, np.uint8)
        if cut:
            left[i, :cut] = np.frombuffer(t[:cut], np.uint8)[::-1]
    ro, lo = deep_shallow(gram, right), deep_shallow(gram, left)
    rc, lc = _common(gram[ro], right[ro]), _common(gram[lo], left[lo])
    repeated = np.zeros((n, REACH + 2), bool)  # by place - start
    least, most = place - last, place - first
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(REACH + 1):
        at = np.flatnonzero((least <= o) & (o <= most))
        if len(at) > 1:
            right_class[ro] = np.cumsum(rc < SIZE - o)
            left_class[lo] = np.cumsum(lc < o)
            _, head = np.unique(right_class[at] * (n + 1) + left_class[at], return_index=True)
            again = np.ones(len(at), bool)
            again[head] = False
            repeated[at[again], o] = True
    flat = np.zeros((n, REACH + 3), np.int8)
    flat[:, 1:] = repeated
    step = np.diff(flat.ravel())
    a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    i = a // (REACH + 3)
    return doc[i], place[i] - (b - 1 - i * (REACH + 3)), place[i] - (a - i * (REACH + 3))


def _compare(batches):
    """Rows sorted by (gram, doc_id, first) with texts: repeated windows. A gram's rows are taken together; their number
    is bounded by MOST_CLASSES, or all have one text, of which the first alone is kept."""
    held: list[list] = [[] for _ in range(6)]

    def out(part):
        gram, doc, first, last, place = (np.array(x, np.int64) for x in part[:5])
        d, a, b = _repeats(gram, doc, first, last, place, part[5])
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["doc_id", "first", "last"])

    for batch in batches:
        for h, c in zip(held, ("gram", "doc_id", "first", "last", "place", "text"), strict=True):
            h += batch.column(c).to_pylist()
        n = len(held[0])
        cut = n
        while cut and held[0][cut - 1] == held[0][-1]:
            cut -= 1
        if cut >= 4096:
            yield out([h[:cut] for h in held])
            held = [h[cut:] for h in held]
        elif not cut and n > 2 * MOST_CLASSES:
            yield out(held)
            held = [h[:1] for h in held]
    if held[0]:
        yield out(held)


def _united(first: list[int], last: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    out: list[list[int]] = []
    for a, b in sorted(zip(first, last, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + SIZE)
        else:
            out.append([a, b + SIZE])
    return [tuple(x) for x in out]


def _finish(batches):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for doc, z, removed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "z", "removed")), strict=True):
            text = zlib.decompress(z)
            spans = _united([x["first"] for x in removed or ()], [x["last"] for x in removed or ()])
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            row = (doc, len(text), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"start": a, "stop": b} for a, b in spans])
            for c, v in zip(out, row, strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)


def _pack(batches):
    for batch in batches:
        z = [zlib.compress((t or "").encode("utf-8", "surrogatepass"), 2) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(z, pa.binary())], ["doc_id", "z"])


def repeated_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), one row per row of docs (doc_id, text).

    A byte is removed if a 100-byte string that covers it also starts earlier, in a document of smaller doc_id or
    at an earlier start of the same one; all are judged on the input. Null text is empty; texts under 100 bytes
    lose nothing. doc_id must tell documents apart: rows without one, and all but the least text of a repeated id,
    are left out of the comparison and returned whole. An empty table gives none.
    """
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    known = docs.where("doc_id IS NOT NULL")
    double = known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    aside = docs.where("doc_id IS NULL")
    if not double.isEmpty():
        least = known.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), (F.count("*") - 1).alias("more"))
        extra = known.join(double, "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
        counts = extra.groupBy("doc_id", "text").agg(F.count("*").alias("n")).join(least.select("doc_id", F.col("text").alias("least")), "doc_id")
        counts = counts.withColumn("n", F.col("n") - (F.col("text") == F.col("least")).cast("long")).where("n > 0")
        aside = aside.unionByName(counts.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("doc_id", "text"))
        known = stored(spark, least.select("doc_id", "text"), "documents")
    entered = known.mapInArrow(_enter, "gram long, digest long, doc_id long, first int, last int, place int, whole boolean")
    entered = entered.repartition(F.when(F.col("whole"), F.xxhash64("doc_id", "first")).otherwise(F.col("gram"))).sortWithinPartitions("gram", "digest", "doc_id", "first")
    found = stored(spark, entered.mapInArrow(_classes, "gram long, doc_id long, first int, last int, place int, whole boolean"), "runs")
    packed = known.mapInArrow(_pack, "doc_id long, z binary")
    wanted = found.where("NOT whole")
    hot = stored(spark, wanted.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > MOST_CLASSES).select("gram"), "hot")
    wanted = wanted.withColumn("split", F.lit(False)) if hot.isEmpty() else wanted.join(hot.withColumn("split", F.lit(True)), "gram", "left").fillna({"split": False})
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "first", "last", "place", "split")).alias("wanted"))
    texts = packed.join(wanted, "doc_id").mapInArrow(_segments, "gram long, doc_id long, first int, last int, place int, text binary")
    texts = texts.repartition("gram").sortWithinPartitions("gram", "doc_id", "first")
    compared = stored(spark, texts.mapInArrow(_compare, "doc_id long, first int, last int"), "repeats")
    removed = found.where("whole").select("doc_id", "first", "last").unionByName(compared)
    removed = removed.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("removed"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>"
    done = packed.join(removed, "doc_id", "left").mapInArrow(_finish, out)
    rest = aside.mapInArrow(_pack, "doc_id long, z binary").withColumn("removed", F.lit(None).cast("array<struct<first: int, last: int>>"))
    return done.unionByName(rest.mapInArrow(_finish, out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: bytes removed from every document, and the digest of those that remain."""
    return repeated_spans(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")

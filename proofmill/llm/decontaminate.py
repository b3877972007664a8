"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Similarity is weighted Jaccard over shingles of five words, a shingle weighing the bytes of its words. A window that
reaches the threshold shares a shingle with its item, and the window of an item may begin anywhere between the starts
that two shared shingles put it at (words may be inserted or missing between them): those windows are looked up, and
no window that shares no shingle can match. Each window's 256-bit SimHash comes from prefix sums of its weighted bits.
Items are indexed by BLOCKS blocks of their fingerprints: of two fingerprints within RADIUS one block at least is
within RADIUS // BLOCKS, so the lookup misses none, and about 1 % of unrelated items pass it. Candidates are verified
exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowered, mix64, scored, shingle_hashes, word_hashes

K, SIMILAR = 5, 0.75
#: Of 256 bits; at similarity 0.75 the expected distance is about 44 with a deviation of 6.
RADIUS, BLOCKS = 63, 8
#: Items held in memory at once (about 2 kB each); more items are taken in blocks of this many.
ITEMS_AT_ONCE = 50_000
#: Words of a text over which weighted bits are summed at once, beside a window.
_WINDOWS = 4096
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_SMALL = 1 << 22


def _weights(text: bytes) -> np.ndarray:
    """The weight of each shingle in order: the number of bytes of its words."""
    lengths = np.fromiter(map(len, text.split()), np.int64)
    return np.convolve(lengths, np.ones(min(K, len(lengths)), np.int64), "valid")


def _signs(h: np.ndarray) -> np.ndarray:
    """256 signs of each hash."""
    rows = [mix64(h + np.uint64(k))[:, None] & _BITS for k in range(1, 5)]
    return np.where(np.concatenate(rows, 1) if len(h) else np.empty((0, 256)), 1, -1).astype(np.int8)


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    """BLOCKS words of 32 bits for each row of 256 weighted sums."""
    return np.packbits(sums > 0, axis=-1).view(np.uint32)


def _window_prints(h: np.ndarray, w: np.ndarray, first: np.ndarray, many: int) -> np.ndarray:
    """Fingerprints of the windows of `many` shingles that begin at `first` (in order), by prefix sums."""
    low = int(first[0])
    part, weight = h[low : first[-1] + many], w[low : first[-1] + many]
    total = np.zeros((len(part) + 1, 256), np.int64)
    np.cumsum(_signs(part) * weight[:, None], 0, out=total[1:])
    at = first - low
    return _fingerprints(total[np.minimum(at + many, len(part))] - total[at])


class Index:
    """Items by fingerprint blocks, and the places of each of their shingles."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.items, self.lengths = [], [], []
        places: dict[tuple[int, int], None] = {}
        prints = []
        for i, t in zip(ids, texts, strict=True):
            low = lowered(t)
            words = word_hashes(low)
            h = shingle_hashes(words, K)
            if len(h):
                w = _weights(low)
                prints.append(_fingerprints((_signs(h) * w[:, None]).sum(0)[None])[0])
                self.ids.append(i)
                self.items.append(self._bag(h, w))
                self.lengths.append(len(words))
                for at, x in enumerate(h.tolist()):
                    places[x, at, len(words)] = None
        self.prints = np.array(prints, np.uint32).reshape(-1, BLOCKS)
        self.columns = np.ascontiguousarray(self.prints.T)
        keys = sorted(places)
        self.shingle = np.array([k[0] for k in keys], np.uint64)
        self.start = [k[1:] for k in keys]
        self.small = np.zeros(_SMALL, bool)
        self.small[(self.shingle & np.uint64(_SMALL - 1)).astype(np.int64)] = True

    @staticmethod
    def _bag(h: np.ndarray, w: np.ndarray) -> dict[int, int]:
        bag: dict[int, int] = {}
        for x, y in zip(h.tolist(), w.tolist(), strict=True):
            bag[x] = bag.get(x, 0) + y
        return bag

    def near_blocks(self, p: np.ndarray) -> np.ndarray:
        """Items that have a block within RADIUS // BLOCKS of the fingerprint's."""
        near = np.zeros(len(self.prints), bool)
        for column, block in zip(self.columns, p, strict=True):
            near |= np.bitwise_count(column ^ block) <= RADIUS // BLOCKS
        return np.flatnonzero(near)

    def lookup(self, p: np.ndarray) -> np.ndarray:
        """Items whose fingerprint is within RADIUS."""
        near = self.near_blocks(p)
        return near[np.bitwise_count(self.prints[near] ^ p).sum(1, dtype=np.int64) <= RADIUS]

    def _starts(self, h: np.ndarray, words: int) -> dict[int, np.ndarray]:
        """Where windows of each length begin: where a shared shingle puts an item's start, and all places between two
        of those that are no further apart than half an item."""
        hits = np.flatnonzero(self.small[(h & np.uint64(_SMALL - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(self.shingle, h[hits]), np.searchsorted(self.shingle, h[hits], side="right")
        at: dict[int, set[int]] = {}
        for p, a, b in zip(hits.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for place, length in self.start[a:b]:
                at.setdefault(length, set()).add(max(0, min(p - place, words - length)))
        out = {}
        for length, starts in at.items():
            x = np.array(sorted(starts))
            gap = np.diff(x, append=x[-1] + 1)
            gap[gap > max(1, length // 2)] = 1
            out[length] = np.repeat(x, gap) + np.arange(gap.sum()) - np.repeat(np.cumsum(gap) - gap, gap)
        return out

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, float]]:
        """(item, first word, words, distance, similarity) of the best window of each item that is in the text."""
        low = lowered(text)
        words = word_hashes(low)
        h = shingle_hashes(words, K)
        windows = self._starts(h, len(words))
        best: dict[int, tuple] = {}
        weights = _weights(low) if windows else None
        for length, starts in windows.items():
            many = max(1, length - K + 1)
            # sums are taken over windows that are near each other, over a bounded part of the text at a time
            cuts = np.flatnonzero((np.diff(starts) > many) | (np.diff(starts // _WINDOWS) > 0)) + 1
            for group in np.split(starts, cuts):
                for first, p in zip(group.tolist(), _window_prints(h, weights, group, many), strict=True):
                    self._keep_best(best, h[first : first + many], weights[first : first + many], first, len(words), p)
        return [best[k] for k in sorted(best)]

    def _keep_best(self, best: dict, part: np.ndarray, w: np.ndarray, first: int, words: int, p: np.ndarray) -> None:
        bag = None
        for k in self.lookup(p).tolist():
            bag = bag or self._bag(part, w)
            both = sum(min(y, bag.get(x, 0)) for x, y in self.items[k].items())
            similar = both / (sum(bag.values()) + sum(self.items[k].values()) - both)
            if similar >= SIMILAR and (k not in best or similar > best[k][4]):
                best[k] = (self.ids[k], first, len(part) + K - 1 if words >= K else words, int(np.bitwise_count(self.prints[k] ^ p).sum()), similar)


MATCHES = "array<struct<item_id: long, first_word: long, n_words: long, distance: int, similarity: double>>"


def _indexes(spark: SparkSession, benchmark: DataFrame):
    """The benchmark in blocks of bounded size, each as a broadcast index."""
    b = benchmark.select("item_id", "text").dropna()
    blocks = max(1, -(-b.count() // ITEMS_AT_ONCE))
    for k in range(blocks):
        rows = b.where(F.pmod(F.xxhash64("item_id", F.lit("items")), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Index([r["item_id"] for r in rows], [r["text"] for r in rows]))


def _found(docs: DataFrame, keep: list[str], held) -> DataFrame:
    fields = ("item_id", "first_word", "n_words", "distance", "similarity")

    def find(texts):
        return [[[dict(zip(fields, m, strict=True)) for m in held.value.matches(t)] for t in texts]]

    return scored(docs, keep, f"pm_matches {MATCHES}", find)


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance, similarity): one row per document row and item found in it.

    Null and empty texts and items match nothing; repeated rows are reported each; an empty benchmark or table gives
    no rows. Whole texts are read, whatever their length.
    """
    out = None
    for held in _indexes(spark, benchmark):
        part = _found(docs.select("doc_id", "text"), ["doc_id"], held).select("doc_id", F.inline("pm_matches"))
        out = part if out is None else out.unionByName(part)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every benchmark item found in any document."""
    return contaminated(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with their own columns. Rows with null or empty text and rows without
    doc_id stay; repeated rows stay or go together; an empty table or benchmark drops nothing."""
    for held in _indexes(spark, spark.read.parquet(f"{sf_dir}/benchmark.parquet")):
        docs = _found(docs, docs.columns, held).where("size(pm_matches) = 0").select(*docs.columns)
    return docs

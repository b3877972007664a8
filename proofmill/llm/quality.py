"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins; a feature's effect is a lookup table over its bins, and a pair's effect a table
over the bins of both. Shallow trees, boosted in a cycle over the features and then over the strongest pairs of
the residual, add up to those tables, so that scoring is one table lookup and addition per feature and pair.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, scored

#: Labelled documents that the model learns from (expected number, chosen by a hash of the id).
TRAIN_ROWS = 20_000
FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "distinct_words", "top_word", "repeated_next", "lines", "distinct_lines",
    "letters", "upper", "digits", "space", "common_marks", "odd_marks", "bars", "bangs", "non_ascii", "byte_entropy", "sentences",
)
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 24, 80, 40, 6, 0.15
_KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n\x0b\x0c", b".,;:'\"-()?", b"|", b"!"), 1):
    _KIND[list(_chars)] = _k
_KIND[128:] = 8


def features(text: str | None) -> list[float]:
    """Measures of the whole text; null and empty text give the same row of zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kind = np.bincount(_KIND, weights=hist, minlength=9)
    share = hist[hist > 0] / n
    words, lines = raw.split(), raw.split(b"\n")
    many = max(1, len(words))
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    freq = Counter(words)
    letters = max(1.0, kind[1] + kind[2])
    return [
        np.log1p(n), np.log1p(len(words)), lengths.mean(), lengths.std(), len(freq) / many, max(freq.values(), default=0) / many,
        sum(map(bytes.__eq__, words[1:], words)) / many, len(lines) / many, len(set(lines)) / len(lines),
        (kind[1] + kind[2]) / n, kind[2] / letters, kind[3] / n, kind[4] / n, kind[5] / n, kind[0] / n, kind[6] / n, kind[7] / n,
        kind[8] / n, float(-(share * np.log2(share)).sum()), raw.count(b". ") / many,
    ]


def _leaves(g: np.ndarray, h: np.ndarray, cuts: int) -> list[tuple[int, int, float]]:
    """Best-first cuts of a histogram of gradients into at most cuts + 1 runs of bins, with the step of each."""
    G, H = np.r_[0.0, np.cumsum(g)], np.r_[0.0, np.cumsum(h)]
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1.0)
    runs = [(0, len(g))]
    for _ in range(cuts):
        best = (1e-9, None, 0)
        for a, b in runs:
            if b - a > 1:
                k = np.arange(a + 1, b)
                better = gain(a, k) + gain(k, b) - gain(a, b)
                if better.max() > best[0]:
                    best = (better.max(), (a, b), int(k[better.argmax()]))
        if best[1] is None:
            break
        runs.remove(best[1])
        runs += [(best[1][0], best[2]), (best[2], best[1][1])]
    return [(a, b, (G[b] - G[a]) / (H[b] - H[a] + 1.0)) for a, b in runs]


def _first_cut(G: np.ndarray, H: np.ndarray) -> int:
    """The cut of the first axis whose parts gain most from one cut each of the second: an interaction need not show
    in either axis alone."""
    if len(G) < 2:
        return len(G)
    total = 0.0
    for g, h in ((np.cumsum(G, 0)[:-1], np.cumsum(H, 0)[:-1]), (np.cumsum(G[::-1], 0)[-2::-1], np.cumsum(H[::-1], 0)[-2::-1])):
        left, left_h = np.cumsum(g, 1), np.cumsum(h, 1)
        right, right_h = left[:, -1:] - left, left_h[:, -1:] - left_h
        total = total + (left**2 / (left_h + 1.0) + right**2 / (right_h + 1.0)).max(1)
    return int(total.argmax()) + 1


class Model:
    """Bin edges and tables of every feature, tables of the chosen pairs, and the intercept."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        q = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(c, q)) for c in x.T] if len(x) else [np.zeros(0)] * len(FEATURES)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        rate = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(rate / (1 - rate)))
        if 0 < y.sum() < len(y):
            self._fit(self.bins(x), y.astype(float))

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)]

    def _fit(self, b: list[np.ndarray], y: np.ndarray) -> None:
        f = np.full(len(y), self.base)
        slope = lambda: (lambda p: (y - p, p * (1 - p)))(1 / (1 + np.exp(-f)))
        for _ in range(ROUNDS):
            for k, t in enumerate(self.tables):
                g, h = slope()
                step = np.zeros(len(t))
                for lo, hi, v in _leaves(np.bincount(b[k], g, len(t)), np.bincount(b[k], h, len(t)), 3):
                    step[lo:hi] = RATE * v
                t += step
                f += step[b[k]]
        g, h = slope()
        strength = []
        for i in range(len(b)):
            for j in range(i):
                shape = (len(self.tables[i]), len(self.tables[j]))
                at = b[i] * shape[1] + b[j]
                G, H = (np.bincount(at, v, shape[0] * shape[1]) for v in (g, h))
                strength.append(((G**2 / (H + 1.0)).sum(), i, j))
        self.pairs = [(i, j, np.zeros((len(self.tables[i]), len(self.tables[j])))) for _, i, j in sorted(strength, reverse=True)[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for i, j, t in self.pairs:
                g, h = slope()
                G, H = (np.bincount(b[i] * t.shape[1] + b[j], v, t.size).reshape(t.shape) for v in (g, h))
                step = np.zeros(t.shape)
                cut = _first_cut(G, H)
                for lo, hi in ((0, cut), (cut, len(G))):  # one cut on i, then two on j in each part
                    for lo2, hi2, v in _leaves(G[lo:hi].sum(0), H[lo:hi].sum(0), 2):
                        step[lo:hi, lo2:hi2] = RATE * v
                t += step
                f += step[b[i], b[j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        f = np.full(len(x), self.base)
        for t, at in zip(self.tables, b, strict=True):
            f += t[at]
        for i, j, t in self.pairs:
            f += t[b[i], b[j]]
        return 1 / (1 + np.exp(-f))


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled documents of a bounded hash sample of labels (doc_id, quality).

    The sample has a bound, so it may be broadcast to the documents; the driver gathers its features alone. Of labels
    that contradict each other the more frequent counts, and 1 where they are even; rows with a null are left out.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna()
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    n = known.count()
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) < min(1.0, most / max(1, n)) * (1 << 30))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    got = scored(rows, ["doc_id", "quality"], "f array<double>", lambda texts: [list(map(features, texts))]).toPandas()
    got = got.sort_values("doc_id", kind="stable")
    return Model(np.array(got["f"].tolist(), float).reshape(-1, len(FEATURES)), got["quality"].to_numpy(int))


def predict(spark: SparkSession, docs: DataFrame, model: Model, keep: list[str], extra: str = "score double, predicted int") -> DataFrame:
    """keep columns and score, predicted of every row."""
    held = spark.sparkContext.broadcast(model)

    def score(texts):
        p = held.value.score(_matrix(texts))
        return p, (p >= 0.5).astype(np.int32)

    return scored(docs, keep, extra, score)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may be learned from: crc32 of the id mod 3 is not 1."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod(F.col("doc_id"), 3) != 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: score of every document, learned from labels whose crc32 mod 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, labels_of(spark, sf_dir))
    return predict(spark, docs.withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))), model, ["doc_id", "held_out"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, with their own columns. It learns from the documents given. Null and empty
    texts score alike; repeated rows stay or go together; without labels all have the same score; an empty table
    gives none."""
    model = train(docs, labels_of(spark, sf_dir))
    return predict(spark, docs, model, docs.columns, "pm_score double, pm_predicted int").where("pm_predicted = 1").select(*docs.columns)

"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, scored

#: Documents of each language that the model learns from, chosen by a hash of the id (expected number).
TRAIN_DOCS_PER_LANG = 4000
BITS = 16
ORDERS = (1, 2, 3)
ALPHA = 0.5
_CHUNK = 1 << 19
#: Weights are whole multiples of this part of 1, so that sums are exact in any order.
_UNIT = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _buckets(pieces: list[tuple[str, bool]]):
    """For each order the buckets at all places of the joined pieces, and where those of each piece begin and end:
    n-grams that reach into the next piece are outside."""
    codes = np.frombuffer("".join(p for p, _ in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, np.uint32(32))
    size = np.array([len(p) for p, _ in pieces])
    first = np.cumsum(size) - size
    most = np.array([len(p) if last else _CHUNK for p, last in pieces])
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] * np.uint32(0x85EBCA6B) + np.uint32(n)
        if n in ORDERS:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield x >> np.uint32(32 - BITS), first, first + np.minimum(most, size - n + 1)


def _pieces(texts: list[str]):
    """(indices, pieces) with bounded total length; a piece is (characters, whether the text ends with it). A text
    has a blank before it and enough behind it for every order; each piece of a long one reaches into the next as far
    as the n-grams that begin in it."""
    over = max(ORDERS) - 1
    ids, got, total = [], [], 0
    for i, t in enumerate(texts):
        low = " " + t.lower() + " " * over
        for at in range(0, len(low) - over, _CHUNK):
            last = at + _CHUNK >= len(low) - over
            piece = low[at:] if last else low[at : at + _CHUNK + over]
            if got and total + len(piece) > _CHUNK:
                yield ids, got
                ids, got, total = [], [], 0
            ids.append(i)
            got.append((piece, last))
            total += len(piece)
    if got:
        yield ids, got


def counts(frames):
    """(lang, bucket, n) of the n-grams of (lang, text)."""
    sums: dict[str, np.ndarray] = {}
    for f in frames:
        for lang, part in f.groupby("lang"):
            n = sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
            for _, pieces in _pieces(part["text"].tolist()):
                for b, first, end in _buckets(pieces):
                    inside = np.zeros(len(b) + 1, np.int32)
                    np.add.at(inside, first, 1)
                    np.add.at(inside, end, -1)
                    n += np.bincount(b[np.cumsum(inside[:-1]) > 0], minlength=1 << BITS)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})


class Model:
    """langs, prior (log) and a matrix of log-probabilities by language and bucket, centred over languages."""

    def __init__(self, langs: list[str], docs: np.ndarray, table: np.ndarray):
        p = np.log(table + ALPHA) - np.log((table + ALPHA).sum(1, keepdims=True))
        self.langs, self.prior = langs, np.log(docs / docs.sum())
        self.weights = np.ascontiguousarray(np.round((p - p.mean(0)) * _UNIT), np.int32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [t or "" for t in texts]
        total = np.zeros((len(known), len(self.langs)), np.int64)
        for ids, pieces in _pieces(known):
            for b, first, end in _buckets(pieces):
                edge = np.stack([first, end], 1).ravel()
                for k in range(len(self.langs)):
                    sums = np.add.reduceat(np.r_[self.weights[k][b], np.int32(0)], edge, dtype=np.int64)[::2]
                    np.add.at(total[:, k], ids, sums)
        odds = total / _UNIT + self.prior
        e = np.exp(odds - odds.max(1, keepdims=True))
        best = odds.argmax(1)
        score = e[np.arange(len(best)), best] / e.sum(1)
        none = np.array([not any(map(str.isalpha, t)) for t in known], bool)
        return ["und" if x else self.langs[k] for x, k in zip(none, best, strict=True)], np.where(none, 0.0, score)


def train(docs: DataFrame, per_lang: int = TRAIN_DOCS_PER_LANG) -> Model | None:
    """Fit on (doc_id, text, lang) rows without nulls; per_lang bounds the documents of each language.

    Every language keeps the rows whose hashed id falls under its own share, so the sample does not depend on
    order or partitioning. What the driver gathers is one row per language and bucket.
    """
    langs = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not langs:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in langs.items() for x in (lang, min(1.0, per_lang / n))])
    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    rows = picked.select("lang", "text").mapInPandas(counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    order = sorted(langs)
    table = np.zeros((len(order), 1 << BITS))
    table[pd.Categorical(rows["lang"], order).codes, rows["bucket"]] = rows["n"]
    return Model(order, np.array([langs[x] for x in order], float), table)


def predict(spark: SparkSession, docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """keep columns, lang_pred and score of every row; `und` and 0 without a letter, for null text or no model."""
    held = spark.sparkContext.broadcast(model)

    def score(texts):
        return held.value.predict(texts) if held.value else (["und"] * len(texts), np.zeros(len(texts)))

    return scored(docs, keep, "lang_pred string, score double", score)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: learn where crc32 mod 4 is not 2, predict every document from its text alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(crc_mod(F.col("doc_id"), 4) != 2).dropna())
    out = docs.select("doc_id", "text", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"))
    return predict(spark, out, model, ["doc_id", "held_out"])

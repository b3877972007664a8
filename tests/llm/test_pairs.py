"""Operators that compare documents: line dedup, suffix dedup, fingerprints, the parity-sketch join, the pipeline."""

import hashlib
import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from proofmill.llm import common, linededup, paritysketch, quality, spotsigs, suffixdedup
from proofmill.llm.common import components

SF = "/root/testdata/sf0.001"


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or x in got} and len(got) > 200
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


# ---- parity sketches ----


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32 - 1), st.integers(0, 30), st.booleans())
def test_linked_sets_share_a_key(n, seed, hot, grow):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**63, 3 * n + 64, dtype=np.uint64))
    rng.shuffle(pool)
    a = pool[:n]
    worst = n // 4 if grow else n // 7
    b = np.concatenate([a, pool[n : n + n // 3]]) if grow else np.concatenate([a[: n - worst], pool[n : n + worst]])
    common = len(np.intersect1d(a, b))
    if 100 * common < 75 * (len(a) + len(b) - common):
        return
    hot_set = np.sort(rng.permutation(a)[: hot * n // 30])
    keys = [set(paritysketch.block_keys(np.sort(x), hot_set).tolist()) for x in (a, b)]
    assert keys[0] & keys[1]
    assert paritysketch.hamming(paritysketch.dense(a), paritysketch.dense(b)) <= len(a) + len(b) - 2 * common


def _brute_components(rows):
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x20\x09-\x0d]+", w)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        c = len(sets[a] & sets[b])
        if c and 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("few", "block"), [(32, 2048), (2, 3)])
def test_jaccard_components_are_exact(spark, small, monkeypatch, few, block):
    monkeypatch.setattr(paritysketch, "FEW", few)
    monkeypatch.setattr(paritysketch, "BLOCK", block)
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    base = [w for _, t in rows for w in t.split()][:4000]
    shared = base[:40]
    for k in range(120):  # families of edits around the threshold, and short texts that are mostly one common passage
        words = base[100 * (k % 12) : 100 * (k % 12) + 30 + 7 * (k % 9)]
        words = list(words)
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(50)}"
        rows.append((1000 + k, " ".join(words)))
        rows.append((2000 + k, " ".join(shared + [f"own{rng.randrange(30)}" for _ in range(rng.randrange(0, 14))])))
    got = paritysketch.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == _brute_components(rows)


def test_jaccard_odd(spark, odd, empty):
    got = [tuple(r) for r in paritysketch.jaccard_components(spark, odd).collect()]
    assert len(got) == odd.count()
    assert {x for x in got if x[0] in (1, 6)} == {(1, 12, 1), (6, 12, 1)}
    assert {x for x in got if x[0] in (2, 3, 4)} == {(2, 0, 2), (3, 0, 3), (4, 0, 4)}
    assert {x[2] for x in got if x[0] is None} == {None}
    assert paritysketch.jaccard_components(spark, empty).count() == 0
    kept = paritysketch.stage(spark, odd, SF)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 4, 5, 7, 8, 9]


def test_sketch_blocks_find_each_close_pair_once(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.sort(np.r_[base[: 60 - k], rng.integers(0, 2**63, k, dtype=np.uint64)]) for k in rng.integers(0, 14, 30)]
    keys = [[7, 9] if k % 3 else [9] for k in range(30)]
    want = {(a, b) for a, b in itertools.combinations(range(30), 2) if a % 4 != b % 4 and paritysketch.hamming(paritysketch.dense(sets[a]), paritysketch.dense(sets[b])) <= 120 // 7}
    for size in (30, 7):
        rows = []
        for key in (7, 9):
            own = [k for k in range(30) if key in keys[k]]
            last = (len(own) - 1) // size
            rows += [(key, min(p // size, o), max(p // size, o), p // size, k, k % 4, 60, paritysketch.dense(sets[k]), keys[k]) for p, k in enumerate(own) for o in range(last + 1)]
        names = ("key", "i", "j", "block", "node", "c", "n", "sketch", "keys")
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in sorted(rows, key=lambda r: r[:3])[i : i + 11]]) for i in range(0, len(rows), 11)]
        got = [(r["a"], r["b"]) for b in paritysketch._compare(batches) for r in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want


def test_groups_across_batches():
    import pyarrow as pa

    rows = np.array(sorted((k, n) for k, many in ((1, 1), (2, 5), (3, 1), (4, 2), (5, 1), (6, 9)) for n in range(many)) + [(7, 0), (7, 0)])
    for size in (1, 2, 3, 7, 100):
        parts = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + size, 0]), pa.array(rows[i : i + size, 1])], ["key", "node"]) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in paritysketch._groups(parts) for r in b.to_pylist()]
        assert got == [(k, n, 0, max(0, n - 1)) for k, many in ((2, 5), (4, 2), (6, 9)) for n in range(many)], size


# ---- suffixes ----


def _brute_spans(rows):
    seen, out = set(), {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        gone = bytearray(len(t))
        for s in range(len(t) - 99):
            if t[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(t[s : s + 100])
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(bool(gone[k]) and (k == 0 or not gone[k - 1]) for k in range(len(gone)))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_is_exact(spark, small):
    rng = random.Random(7)
    rows = [(r["doc_id"], r["text"]) for r in small.where("doc_id < 80").select("doc_id", "text").collect()]
    text = "".join(t for _, t in rows)
    for k in range(60):
        a = rng.randrange(len(text) - 500)
        part = text[a : a + rng.choice((99, 100, 101, 130, 400))]
        rows.append((500 + k, f"{k} " + part + f" {k * k} " + part[: rng.randrange(len(part))] + "é" * rng.randrange(4)))
    rows += [(700, "ab" * 400), (701, "z" * 350), (702, "z" * 99), (703, "\0" * 250 + "q"), (704, "\0" * 120)]
    got = suffixdedup.repeated_spans(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == _brute_spans(rows)
    for r in got:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_suffix_dedup_of_hot_grams(spark, small, monkeypatch):
    monkeypatch.setattr(suffixdedup, "MOST_CLASSES", 3)
    rows = [(r["doc_id"], "The same opening line of every document, long enough to hold a window of a hundred bytes and more. " + r["text"][:150]) for r in small.where("doc_id < 30").collect()]
    got = suffixdedup.repeated_spans(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == _brute_spans(rows)


@pytest.mark.parametrize("combine", [1, 40, 1 << 18])
def test_suffix_runs_combined_before_the_exchange(monkeypatch, combine):
    """A text that is everywhere: the classes are the same however many runs a task combines."""
    rng = random.Random(combine)
    passage = "".join(rng.choices("abcdefgh ", k=260))
    texts = [passage * (k % 3) + f" own {k} " + "".join(rng.choices("abcdefgh ", k=90)) + "ab " * (k % 5) * 40 + passage for k in range(60)]
    monkeypatch.setattr(suffixdedup, "_COMBINE", combine)
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": texts})
    entered = [r for b in suffixdedup._enter([docs.slice(0, 25), docs.slice(25)]) for r in b.to_pylist()]
    assert combine == 1 or any(r["whole"] for r in entered)
    entered.sort(key=lambda r: (r["gram"], r["digest"], r["doc_id"], r["first"]))
    parts = [pa.RecordBatch.from_pylist(entered[k : k + 7]) for k in range(0, len(entered), 7)]
    got = sorted((r["doc_id"], r["first"], r["whole"]) for b in suffixdedup._classes(parts) for r in b.to_pylist())
    grams, want, seen = {}, [], set()
    for r in entered:
        grams.setdefault(r["gram"], set()).add(r["digest"])
    for r in entered:
        whole = (r["gram"], r["digest"]) in seen
        seen.add((r["gram"], r["digest"]))
        if whole or len(grams[r["gram"]]) > 1:
            want.append((r["doc_id"], r["first"], whole))
    assert got == sorted(want) and len(got) > 100


def test_suffix_dedup_odd(spark, odd, empty):
    got = suffixdedup.repeated_spans(spark, odd).collect()
    assert len(got) == odd.count()
    assert sorted(r["n_removed"] for r in got if r["doc_id"] in (1, 2, 3, 6)) == [0, 0, 0, 0, 0]
    assert next(r["n_removed"] for r in got if r["doc_id"] == 9) == 100000 - 1
    assert suffixdedup.repeated_spans(spark, empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.binary(min_size=0, max_size=9)), min_size=1, max_size=40), st.integers(0, 60))
def test_deep_shallow_sorts(items, common):
    items = sorted((g, (b"x" * common + t).ljust(72, b"\0")) for g, t in items)
    random.Random(0).shuffle(items)
    items.sort(key=lambda x: x[0])
    rows = np.array([list(t) for _, t in items], np.uint8)
    order = suffixdedup.deep_shallow(np.array([g for g, _ in items]), rows)
    assert [items[i] for i in order] == sorted(items)


# ---- fingerprints ----


def test_fingerprints(spark, small):
    rows = {r["doc_id"]: r["text"] for r in small.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in spotsigs.edited_fingerprints(spark, small.repartition(7)).collect()}
    ids = sorted(rows)
    for k, i in enumerate(ids):
        t, ahead = rows[i], rows[ids[k - 1]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + ahead[:cut]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
        assert (got[i]["near_edited"] == 1.0) == (got[i]["fingerprint"] == got[i]["edited_fingerprint"])
    long = [i for i in ids if len(rows[i].split()) > 60]
    assert np.mean([got[i]["near_edited"] > got[i]["near_next"] for i in long]) > 0.95
    by_text = {}
    for i in ids:
        assert by_text.setdefault(rows[i], got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_signatures_by_hand(spark):
    df = spark.createDataFrame([("the red fox, of a great house ran", "A" * 3)], "t string, u string")
    chains = spark.sql("SELECT array(xxhash64('red fox great'), xxhash64('great house ran')) AS c").first()["c"]
    assert sorted(spotsigs.with_signatures(df, "t", "s").first()["s"]) == sorted(chains)
    assert len(spotsigs.with_signatures(df, "u", "s").first()["s"]) == 1


def _brute_spots(text):
    words = [w for w in re.sub("[ \t\n\x0b\f\r!-/:-@\\[-`{-~\x01]+", " ", (text or "").lower()).split(" ") if w]
    common, found = set(spotsigs.ANCHORS), set()
    for i, w in enumerate(words):
        chain = [x for x in words[i + 1 :] if x not in common][: spotsigs.CHAIN]
        if w in common and len(chain) == spotsigs.CHAIN:
            found.add(" ".join(chain))
    return found


def test_likeness_against_brute_force(spark, small):
    """near_next is the Jaccard similarity of the sets of chains, 0 where the lengths put it under FLOOR."""
    rows = sorted((r["doc_id"], r["text"]) for r in small.where("doc_id < 100").select("doc_id", "text").collect())
    rows += [(500 + k, " ".join(t.split()[: len(t.split()) * 9 // 10])) for k, t in rows[:40]]
    rows = [(k // 500 + 2 * (k % 500), t) for k, t in rows]  # each shortened copy beside its original
    got = {r["doc_id"]: r["near_next"] for r in spotsigs.edited_fingerprints(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rows.sort()
    close = 0
    for at, (k, t) in enumerate(rows):
        a, b = _brute_spots(t), _brute_spots(rows[at - 1][1])
        if len(a) > 1 and len(b) > 1:
            want = len(a & b) / len(a | b)
            want = 0.0 if min(len(a), len(b)) < spotsigs.FLOOR * max(len(a), len(b)) else want
            assert abs(got[k] - want) < 1e-9, (k, got[k], want)
            close += want > 0.7
    assert close >= 25


@pytest.mark.parametrize("similar,block", [(0.75, 2048), (0.4, 3)])
def test_matches_against_brute_force(spark, small, monkeypatch, similar, block):
    """Every pair of unlike sets at the threshold and no other, with buckets whole and split into blocks."""
    monkeypatch.setattr(spotsigs, "BLOCK", block)
    rows = [(r["doc_id"], r["text"]) for r in small.where("doc_id < 120").select("doc_id", "text").collect()]
    rows += [(1000 + 10 * k + cut, " ".join(t.split()[: len(t.split()) * cut // 10])) for k, t in rows[:40] for cut in (5, 7, 8, 9)]
    made, links = spotsigs.matches(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), similar)
    node = {r["doc_id"]: r["node"] for r in made.collect()}
    assert len(node) == len(rows)
    sets = {node[k]: _brute_spots(t) for k, t in rows if len(_brute_spots(t)) > 1}
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        like = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if like >= similar:
            want[a, b] = like
    got = {(r["a"], r["b"]): r["likeness"] for r in links.collect()}
    got = {k: v for k, v in got.items() if set(k) <= set(sets)}
    assert set(got) == set(want) and len(want) >= 40
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_matches_odd(spark, odd, empty):
    made, links = (df.collect() for df in spotsigs.matches(spark, odd))
    assert len(made) == odd.count() and not links
    assert len({r["node"] for r in made if r["doc_id"] in (1, 6)}) == 1
    assert len({r["node"] for r in made if r["doc_id"] in (2, 3, 4)}) == 1
    assert [df.count() for df in spotsigs.matches(spark, empty)] == [0, 0]


def test_fingerprints_odd(spark, odd, empty):
    got = spotsigs.edited_fingerprints(spark, odd).collect()
    assert len(got) == odd.count()
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 6)}) == 1
    assert spotsigs.edited_fingerprints(spark, empty).count() == 0
    alone = spotsigs.edited_fingerprints(spark, odd.where("doc_id = 5")).first()
    assert alone["near_next"] == 1.0
    hot = spark.createDataFrame([(1, "the " * 20000 + "end of it")], "doc_id long, text string")
    assert spotsigs.edited_fingerprints(spark, hot).count() == 1


# ---- lines ----


def _grams(line):
    u = line.encode("utf-16-be")
    n = len(u) // 2
    return {u[2 * i : 2 * i + 20] for i in range(max(1, n - 9))}


def test_line_dedup(spark, small):
    docs = small.where("doc_id < 120").select("doc_id", "text")
    places = [(r["doc_id"], k, line) for r in docs.collect() for k, line in enumerate(r["text"].split("\n")) if len(line.strip(" ")) >= linededup.MIN_CHARS]
    lines = sorted({x[2] for x in places})
    sets = [_grams(x) for x in lines]
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(lines)), 2):
        if min(len(sets[a]), len(sets[b])) >= 0.75 * max(len(sets[a]), len(sets[b])):
            c = len(sets[a] & sets[b])
            if c >= 0.75 * (len(sets[a]) + len(sets[b]) - c):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    first, want = {}, set()
    at = {x: k for k, x in enumerate(lines)}
    for d, k, line in sorted(places):
        root = find(at[line])
        if root in first:
            want.add((d, k))
        first.setdefault(root, (d, k))
    got = {(r["doc_id"], r["line_no"]) for r in linededup.duplicate_lines(spark, docs).collect()}
    assert got <= want and len(want - got) <= 0.02 * len(want) and len(want) > 20


def test_line_dedup_compares_all_members_of_a_bucket(spark):
    """Lines that share a long passage share buckets; each has one near copy there, which is seldom the bucket's first."""
    r = random.Random(5)
    own = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage = own(150)
    lines = [(k, passage + own(100)) for k in range(400)]
    copies = [(1000 + k, line[:-8] + own(8)) for k, line in lines]
    docs = spark.createDataFrame([*lines, *copies], "doc_id long, text string")
    assert all(len(_grams(a) & _grams(b)) >= 0.75 * len(_grams(a) | _grams(b)) for (_, a), (_, b) in zip(lines, copies, strict=True))
    got = {x["doc_id"] for x in linededup.duplicate_lines(spark, docs).collect()}
    assert got <= {k for k, _ in copies} and len(got) >= 396


def test_line_dedup_signatures_of_short_lines_are_independent(spark):
    """Pairs just at the threshold, 12 shingles against 9 of them: they share a band as often as stated."""
    r = random.Random(6)
    pairs = [(line, line[:18]) for line in ("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=21)) for _ in range(2000))]
    signed = linededup._signatures(spark.createDataFrame([(x,) for p in pairs for x in p], "line string"))
    named = spark.createDataFrame([(k, x) for k, p in enumerate(pairs) for x in p], "pair long, line string")
    got: dict[int, list] = {}
    for row in named.select("pair", F.xxhash64("line").alias("node")).join(signed, "node").collect():
        got.setdefault(row["pair"], []).append([row[f"v{k}"] for k in range(linededup.BANDS * linededup.ROWS)])
    step = linededup.ROWS
    lost = sum(not any(a[k : k + step] == b[k : k + step] for k in range(0, len(a), step)) for a, b in got.values())
    assert len(got) == 2000 and lost <= 12  # 2.6 expected


def _near_pair(r, n):
    """A line of n shingles and a copy just above the threshold: edited in the middle, as far as 0.75 allows."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    line = "".join(r.choices(letters, k=n + 9))
    a = _grams(line)
    for width in range(n, 0, -1):
        at = (len(line) - width) // 2
        other = line[:at] + "".join(r.choices(letters, k=width)) + line[at + width :]
        b = _grams(other)
        if len(a & b) >= 0.75 * len(a | b):
            return line, other
    return line, line[1:]


def test_line_dedup_recall_by_length(spark):
    """Pairs just above 0.75 of each length, uniform lines, and families around one centre."""
    r = random.Random(8)
    sizes = (20, 40, 60, 90, 150, 300, 800)
    rows, group = [], 0
    for n in sizes:
        for _ in range(150):
            rows += [(group, n, x) for x in _near_pair(r, n)]
            group += 1
    for k in range(26):  # one letter each; lengths differ, the sets do not
        rows += [(group, 0, chr(97 + k) * m) for m in (40, 120, 5000)]
        group += 1
    for _ in range(60):
        line = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=200))
        rows += [(group, 1, line)]
        for _ in range(5):
            at = r.randrange(170)
            rows.append((group, 1, line[:at] + "".join(r.choices("0123456789", k=12)) + line[at + 12 :]))
        group += 1
    docs = spark.createDataFrame([(k, x) for k, (_, _, x) in enumerate(rows)], "doc_id long, text string")
    gone = {x["doc_id"] for x in linededup.duplicate_lines(spark, docs).collect()}
    for n in (0, 1, *sizes):
        mine = [k for k, x in enumerate(rows) if x[1] == n]
        groups = {}
        for k in mine:
            groups.setdefault(rows[k][0], []).append(k)
        want = sum(len(g) - 1 for g in groups.values())
        assert sum(k in gone for k in mine) >= (want if n == 0 else 0.98 * want), n
    for g in {x[0] for x in rows}:
        own = [k for k, x in enumerate(rows) if x[0] == g]
        assert any(k not in gone for k in own)


def test_line_dedup_catches_one_changed_character(spark):
    """A character changed in the middle of a line of 80 or more."""
    r = random.Random(9)
    lines = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=r.randrange(80, 200))) for _ in range(300)]
    rows = [(k, x) for k, x in enumerate(lines)] + [(1000 + k, x[: len(x) // 2] + "#" + x[len(x) // 2 + 1 :]) for k, x in enumerate(lines)]
    got = {x["doc_id"] for x in linededup.duplicate_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) >= 297 and min(got) >= 1000


def test_line_dedup_odd(spark, odd, empty):
    assert {(r["doc_id"], r["line_no"]) for r in linededup.duplicate_lines(spark, odd).collect()} == {(6, 0)}
    assert linededup.duplicate_lines(spark, empty).count() == 0
    out = linededup.stage(spark, odd, SF)
    assert out.columns == odd.columns and sorted(r["doc_id"] for r in out.where("doc_id IS NOT NULL").collect()) == [1, 1, 2, 3, 4, 5, 7, 8, 9]
    two = spark.createDataFrame([(1, "One line that is long enough.\nAnd a second one here, too.", 55), (2, "Own words stand in this line.\nAnd a second one here, too.", 55)], "doc_id long, text string, n_chars long")
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in linededup.stage(spark, two, SF).collect()}[2] == ("Own words stand in this line.", 29)


# ---- the pipeline ----


def test_pipeline(spark, small):
    docs, before = small, small
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, SF).toPandas(), small.schema)
        assert docs.columns == small.columns, name
        if name != "mixing":
            assert 0.7 * before.count() < docs.count() <= before.count(), name
            assert docs.select("doc_id").distinct().count() == docs.count()
        else:
            copies = [r["count"] for r in docs.groupBy("doc_id").count().collect()]
            assert max(copies) == 2
        if name == "ngram_join":
            found = paritysketch.jaccard_components(spark, docs)
            assert found.select("component_id").distinct().count() == docs.count()


def test_pipeline_keeps_good_documents(spark, small):
    kept = quality.stage(spark, small, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "right").where("quality = 1")
    assert kept.where(F.col("text").isNull()).count() <= 2
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_line_dedup_compares_whole_buckets_of_any_size(spark):
    """Each two members of different components meet once, in a bucket that one task compares and in larger ones."""
    few = linededup.FEW
    sizes = {1: (few, 0), 2: (3 * few, 2 * few), 3: (2 * few + 9, 0), 4: (few + 50, few + 50)}
    members = [(key, 100_000 * key + i, g) for key, (g, _) in sizes.items() for i in range(g)]
    component = {100_000 * key + i: 100_000 * key for key, (_, inner) in sizes.items() for i in range(inner)}
    none = ", ".join(f"0L as o{k}" for k in range(linededup.MAPS))
    rows = spark.createDataFrame(members, "key long, node long, g long")
    outlines = rows.selectExpr("node", "0L as sketch", "9 as n", *none.split(", "))
    comp = spark.createDataFrame(list(component.items()), "node long, component long")
    got = [(r["a"], r["b"]) for r in linededup._rest_pairs(spark, rows, outlines, comp).collect()]
    want = set()
    for key, (g, _) in sizes.items():
        nodes = [100_000 * key + i for i in range(g)]
        want |= {(a, b) for a, b in itertools.combinations(nodes, 2) if component.get(a, a) != component.get(b, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_line_dedup_makes_no_rows_of_near_misses(spark, monkeypatch):
    """Lines just under 0.75 in one large bucket: rows are made for similar pairs alone, and for each of those."""
    monkeypatch.setattr(linededup, "FEW", 16)
    r = random.Random(10)
    own = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage = own(400)
    lines = [passage + own(100) for _ in range(300)]
    copies = [line[:-8] + own(8) for line in lines[:20]]
    docs = spark.createDataFrame([(x,) for x in lines + copies], "line string")
    texts = docs.withColumn("node", F.xxhash64("line"))
    signed = linededup._signed(linededup._signatures(docs)).localCheckpoint()
    outlines = linededup._outlines(docs).join(signed.select("node", "sketch"), "node").localCheckpoint()
    members, split = linededup._buckets(spark, signed)
    firsts = {(x["a"], x["b"]) for x in linededup._first_pairs(members.unionByName(split)).collect()}
    assert members.agg(F.max("g")).first()[0] > linededup.FEW
    comp = spark.createDataFrame([], "node long, component long")
    whole = texts.join(signed.select("node", "bands"), "node")
    got = {(x["a"], x["b"]) for x in linededup._rest_pairs(spark, members, outlines, comp, whole).collect()}
    node = {x["line"]: x["node"] for x in texts.collect()}
    want = {tuple(sorted((node[a], node[b]))) for a, b in zip(lines, copies)}
    assert want <= got | firsts and len(got) < 2000 < linededup._rest_pairs(spark, members, outlines, comp).count()


def test_line_dedup_halves_lose_no_link(spark):
    """Halves of hashes allow every link that the sets give, and little else."""
    r = random.Random(11)
    own = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    pairs = [_near_pair(r, n) for n in (8, 20, 60, 150, 400) for _ in range(20)]
    pairs += [(line, line[: len(line) * 2 // 3] + own(len(line) // 3)) for line, _ in pairs] + [("ab" * 40, "ab" * 90)]
    halves = [linededup._halves(F.col(c)).alias(c) for c in "xy"]
    rows = spark.createDataFrame(pairs, "x string, y string").select(linededup._similar(F.col("x"), F.col("y")).alias("similar"), *halves)
    near = linededup._halves_near(F.col("x.half"), F.col("y.half"), F.col("x.size") + F.col("y.size"))
    got = [tuple(t) for t in rows.select("similar", near).collect()]
    assert all(near for similar, near in got if similar) and sum(similar for similar, _ in got) > 90
    assert sum(near and not similar for similar, near in got) == 0


def test_line_dedup_deals_members_once(spark):
    """The ends of buckets and the join with them read one exchange by key."""
    out = linededup._members(spark.range(20_000).selectExpr("id % 5000 as key", "id as node"))
    assert {(x["lo"], x["hi"], x["g"]) for x in out.where("key = 7").collect()} == {(7, 15007, 4)}
    plan = out._jdf.queryExecution().executedPlan()
    out.collect()
    plan = plan.toString().split("== Initial Plan")[0]
    assert len(re.findall(r"(?<!\], )Exchange hashpartitioning\(key", plan)) <= 1


def test_line_dedup_sends_members_to_few_cells(spark, monkeypatch):
    """A member of a bucket of CELL goes to one cell, without the sets' hashes in full."""
    seen = []
    whole = linededup.stored
    monkeypatch.setattr(linededup, "stored", lambda s, df, name: (seen.append((name, df.columns, dict(df.dtypes))), whole(s, df, name))[1])
    r = random.Random(12)
    passage = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=300))
    lines = [passage + "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=120)) for _ in range(600)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    linededup.duplicate_lines(spark, rows).count()
    large = [kinds for name, _, kinds in seen if name == "large" and "half" in kinds]
    assert large and all(kinds["half"] == "array<int>" and "set" not in kinds for kinds in large)
    assert linededup.CELL >= 4 * linededup.FEW


def test_components_end_when_edges_are_stars(spark, monkeypatch):
    """Edges that are stars already are written once; no round is run to see that nothing changes."""
    whole, seen = common.stored, []
    monkeypatch.setattr(common, "stored", lambda s, df, name: (seen.append(name), whole(s, df, name))[1])
    got = components(spark, spark.createDataFrame([(0, k) for k in range(1, 50)] + [(100, 101)], "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {**dict.fromkeys(range(50), 0), 100: 100, 101: 100}
    assert seen == ["edges"]


def test_stored_collects_the_drivers_garbage(spark):
    """Spark removes a shuffle once the driver has collected what made it; until then the driver's heap only grows."""
    beans = list(spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    full = lambda: sum(b.getCollectionCount() for b in beans if re.search("Old|MarkSweep", b.getName()))
    before = full()
    for _ in range(3):
        common.stored(spark, spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert full() >= before + 3


def test_line_dedup_deletes_what_nothing_reads_any_more(spark, small):
    """Signatures, texts, outlines and links go once they are used; the result is still read from what stays."""
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    out = linededup.duplicate_lines(spark, small.where("doc_id < 60"))
    names = {x.rpartition("-")[0] for x in set(os.listdir(folder)) - before}
    assert not names & {"signed", "texts", "outlines", "links", "buckets", "firsts", "pairs", "rest"} and {"places", "kept"} <= names
    assert out.count() == len(out.collect())

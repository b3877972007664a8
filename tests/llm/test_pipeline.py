"""The pipeline against plain Python: every stage by brute force, on its own predecessor's rows."""

import hashlib
import itertools
import math
import re
import shutil
from bisect import bisect_right
from collections import Counter

import corpus_pipeline
from proofmill.llm import linededup, quality
from test_maps import _brute_matches
from test_pairs import _brute_components, _grams

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _quality(rows, model):
    """Rows whose score, summed table by table, is not under a half."""
    kept = []
    for r in rows:
        x = quality.features(r[1])
        b = [bisect_right(list(e), v) for e, v in zip(model.edges, x, strict=True)]
        f = model.base + sum(t[k] for t, k in zip(model.tables, b, strict=True)) + sum(t[b[i]][b[j]] for i, j, t in model.pairs)
        if 1 / (1 + math.exp(-f)) >= 0.5:
            kept.append(r)
    return kept


def _line_dedup(rows):
    places = sorted((r[0], k, x) for r in rows for k, x in enumerate((r[1] or "").split("\n")) if len(x.strip(" ")) >= linededup.MIN_CHARS)
    lines = sorted({x for _, _, x in places})
    sets = {x: _grams(x) for x in lines}
    parent = {x: x for x in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_size = sorted(lines, key=lambda x: len(sets[x]))
    for k, a in enumerate(by_size):
        for b in by_size[k + 1 :]:
            if len(sets[a]) < 0.75 * len(sets[b]):
                break
            c = len(sets[a] & sets[b])
            if c >= 0.75 * (len(sets[a]) + len(sets[b]) - c):
                parent[find(a)] = find(b)
    gone, seen = set(), set()
    for d, k, x in places:
        if find(x) in seen:
            gone.add((d, k))
        seen.add(find(x))
    out = []
    for r in rows:
        all_lines = (r[1] or "").split("\n")
        kept = [x for k, x in enumerate(all_lines) if (r[0], k) not in gone]
        if len(kept) == len(all_lines):
            out.append(r)
        elif "".join(kept).strip(" "):
            text = "\n".join(kept)
            out.append((r[0], text, *r[2:4], len(text)))
    return out


def _ngram_join(rows):
    found = _brute_components([r[:2] for r in rows])
    return [r for r in rows if found[r[0]][1] == r[0]]


def _mixing(rows):
    """Targets by repeated resharing, until no source is above its double."""
    size = lambda r: len(re.findall("[^\x20\x09-\x0d]+", r[1] or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r)
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(sources, itertools.cycle((5, 2, 1))))
    target, left, open_ = {}, 1.5 * sum(sizes.values()), list(sources)
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total >= 2 * sizes[s]]
        if not above:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in above:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in above)
        open_ = [s for s in open_ if s not in target]
    out = []
    for r in rows:
        rate = target[r[3]] / sizes[r[3]] if sizes[r[3]] else 0.0
        u = int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        out += [r] * (int(rate) + (u < rate - int(rate)))
    return out


def _corpus(spark):
    """Documents of under 4,000 characters, and planted ones: an edited line, a text in other lines, benchmark passages."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 4000").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    base = [r for r in rows if r[0] in good and 500 < r[4] < 3000][:12]
    add = lambda k, text, like, source: rows.append((k, text, like[2], source, len(text)))
    for k, r in enumerate(base):
        words = r[1].split()
        add(5000 + k, r[1].replace(words[len(words) // 2], "other", 1), r, r[3])
        add(5100 + k, "\n".join(" ".join(words[i : i + 9 + k]) for i in range(0, len(words), 9 + k)), r, None)
        mixed = words[1::2] + words[::2]
        add(5200 + k, " ".join([*mixed[: len(mixed) // 2], items[k], *mixed[len(mixed) // 2 :]]), r, "src1")
    rows.append((5300, None, None, None, 0))
    return rows


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    rows = _corpus(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    model = quality.train(docs, quality.labels_of(spark, SF))
    steps = [rows]
    for stage in (lambda x: _quality(x, model), _line_dedup, _ngram_join, lambda x: [r for r in x if not _brute_matches(r[1], items)], _mixing):
        steps.append(stage(steps[-1]))
    for name, before, after in zip(("quality", "line_dedup", "ngram_join", "decontamination"), steps, steps[1:], strict=False):
        assert len(after) < len(before), name
    assert any(r not in steps[1] for r in steps[2]) and max(Counter(steps[-1]).values()) == 2  # lines taken out, copies made
    got = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter(steps[-1]) and len(steps[-1]) > 100

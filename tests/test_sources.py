import hashlib
import io
import json
import os
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from proofmill.plans import source_queries
from proofmill.sources import artefacts, captures, corpus, files, sinks


def _docx(text: str) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>{text}</w:t></w:r><w:r><w:br w:type="page"/><w:t>Second</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.txt").write_text("One page.\n12.1.\n\fThe clause.")
    (tmp_path / "b.html").write_text("<html><script>x</script><p>Fish &amp; chips</p></html>")
    (tmp_path / "c.rtf").write_text(r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}Plain \b bold\b0  caf\'e9\par next\page two}")
    (tmp_path / "d.docx").write_bytes(_docx("Word text"))
    (tmp_path / "e.md").write_text("# Title\nSome **bold** [link](http://x)")
    (tmp_path / "f.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "g.docx").write_bytes(b"broken")
    (tmp_path / "h.txt").write_text("\n")
    return tmp_path


def test_folder(spark, folder):
    rows = files.read_folder(spark, str(folder)).collect()
    text = {(r["path"].rsplit("/", 1)[-1], r["page_no"]): r["text"] for r in rows if not r["error"]}
    assert text["a.txt", 1] == "One page." and text["a.txt", 2] == "12.1. The clause."
    assert text["b.html", 1] == "Fish & chips"
    assert text["c.rtf", 1].replace("  ", " ") == "Plain bold café\nnext" and text["c.rtf", 2] == "two"
    assert text["d.docx", 1] == "Word text" and text["d.docx", 2] == "Second"
    assert text["e.md", 1] == "Title\nSome bold link"
    assert {r["path"].rsplit("/", 1)[-1] for r in rows if r["error"]} == {"f.pdf", "g.docx", "h.txt"}


def test_known_files_are_skipped_and_parsers_can_be_given(spark, folder):
    first = files.read_folder(spark, str(folder))
    again = files.read_folder(spark, str(folder), parsers={"pdf": lambda data: ["from a pdf"]}, known=first.where("error IS NULL").select("sha256"))
    assert {r["path"].rsplit("/", 1)[-1]: r["text"] for r in again.collect() if not r["error"]} == {"f.pdf": "from a pdf"}


@pytest.mark.parametrize(
    ("pages", "want"),
    [
        (["First clause.\n\nSecond one.\n1.1.\n1.2."], ["1.1. First clause.\n\n1.2. Second one."]),
        (["1. Has one.\n\nFirst clause.\n\nSecond one,\nof two lines.\n\n 2.\n 3.\n"], ["1. Has one.\n\n2. First clause.\n\n3. Second one,\nof two lines."]),
        (["First clause.\n1.\n2.", "Second one."], ["1. First clause.", "2. Second one."]),
        (["First clause.\n\nSecond.\n\nThird.\n1.\n2."], ["First clause.\n\nSecond.\n\nThird.\n1.\n2."]),
        (["Text.\n12.1.", "The clause."], ["Text.", "12.1. The clause."]),
        (["Text.\n12.1."], ["Text.\n12.1."]),
        (["In 2019.", ""], ["In 2019.", ""]),
    ],
)
def test_clause_numbers_at_the_foot(pages, want):
    assert files.stranded_numbers(pages) == want


def test_scans(spark):
    pages = spark.createDataFrame([("x", "", bytearray(b"img"), None), ("y", "a long text layer of words", bytearray(b"img"), None), ("z", "", None, None)], "id string, text string, image binary, ocr boolean")
    got = {r["id"]: (r["text"], r["ocr"]) for r in files.recognised(pages, lambda image: "read " + image.decode()).collect()}
    assert got == {"x": ("read img", True), "y": ("a long text layer of words", False), "z": ("", False)}


def test_store(spark, tmp_path):
    store = corpus.Store(spark, f"file://{tmp_path}/store")
    pages = spark.createDataFrame([("d", 1, "text")], "doc_id string, page_no int, text string")
    assert store.create("one", pages, "first") == 1
    with pytest.raises(corpus.Conflict):
        store.create("one", pages)
    seen = store.generation("one")
    assert store.write("one", pages.union(pages), seen) == 2
    with pytest.raises(corpus.Conflict):
        store.write("one", pages, seen)  # another session read generation 1 and writes late
    assert store.read("one").count() == 2
    assert store.create("one", pages, force=True) == 3 and store.read("one").count() == 1
    assert [(r["name"], r["generation"]) for r in store.registry().collect()] == [("one", 3)]
    with pytest.raises(KeyError):
        store.read("none")


def test_two_writers_of_one_generation(spark, tmp_path):
    """Both pass every check before the pointer is named; one gets it, and the other's pointer is gone."""
    store = corpus.Store(spark, f"file://{tmp_path}")
    done = []

    def write(k):
        try:
            store._publish("one", 1, {"name": "one", "root": f"r{k}", "description": ""})
            done.append(k)
        except corpus.Conflict:
            pass

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(done) == 1 and store.entry("one")["root"] == f"r{done[0]}"
    assert [f for f in os.listdir(tmp_path / "registry" / "one") if not f.startswith(".")] == ["1.json"]


def test_a_pointer_is_named_once_by_rename_too(spark, tmp_path, monkeypatch):
    store = corpus.Store(spark, f"file://{tmp_path}")

    class Elsewhere:
        def __getattr__(self, name):
            return (lambda: "other") if name == "getScheme" else getattr(fs, name)

    fs = store._fs
    monkeypatch.setattr(store, "_fs", Elsewhere())
    store._publish("one", 1, {"name": "one", "root": "a", "description": ""})
    with pytest.raises(corpus.Conflict):
        store._publish("one", 1, {"name": "one", "root": "b", "description": ""})
    assert store.entry("one")["root"] == "a"


def test_replay(spark, tmp_path):
    spark.dataSource.register(captures.ReplaySource)
    (tmp_path / "a.jsonl").write_text(json.dumps({"url": "u1", "status": 200, "content": "h\u00e9llo", "user_agent": "own"}) + "\n\n" + json.dumps({"url": "u2", "status": 403, "content": ""}) + "\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.jsonl").write_text(json.dumps({"url": "u3", "content": None}))
    (tmp_path / "_SUCCESS").write_text("")
    read = lambda path: spark.read.format("replay").option("user_agent", "x").load(path)
    got = read(f"file://{tmp_path}")
    assert got.rdd.getNumPartitions() == 2
    assert {r["url"]: r["reason"] for r in got.select("url", captures.unfetchable(F.col("status"), F.col("content")).alias("reason")).collect()} == {"u1": None, "u2": "login", "u3": None}
    assert {(r["url"], r["content"], r["user_agent"]) for r in got.collect()} == {("u1", "h\u00e9llo", "own"), ("u2", "", "x"), ("u3", None, "x")}
    assert read(str(tmp_path / "sub" / "b.jsonl")).count() == 1
    (tmp_path / "none").mkdir()
    assert read(str(tmp_path / "none")).count() == 0


def test_artefacts(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"about": "x", "questions": [{"id": "b", "domain": "d", "question": "?", "source_url": "u", "retrieved": "2026-01-02"}, {"id": "a"}]}))
    q = artefacts.questions(spark, str(tmp_path / "q.json")).orderBy("seq").collect()
    assert [r["id"] for r in q] == ["b", "a"] and str(q[0]["retrieved"]) == "2026-01-02" and q[1]["reference"] is None
    run = tmp_path / "runs" / "b"
    run.mkdir(parents=True)
    (run / "judgment.json").write_text('{"agrees_with_reference": "yes"}')
    (run / "index.json").write_text('{"docs": [{"id": "x", "source": {"url": "u"}, "thin": true}, {"id": "y"}]}')
    (run / "answer.verified.json").write_text('{"verification": {"ledger": [{"doc": "x"}]}, "gaps": ["g"]}')
    got = artefacts.run_files(spark, str(tmp_path / "runs"))
    assert artefacts.judgments(got).collect() == [("b", "yes", "")]
    assert sorted(map(tuple, artefacts.index_docs(got).collect())) == [("b", "x", "u", True, 0), ("b", "y", None, None, 1)]
    assert artefacts.verified(got).collect() == [("b", 1, ["x"])]
    assert {r["id"]: r["there"] for r in artefacts.presence(artefacts.questions(spark, str(tmp_path / "q.json")), got, "answer.json").collect()} == {"a": False, "b": False}


def test_event_lines(spark, tmp_path):
    line = json.dumps({"type": "assistant", "message": {"content": [{"type": "thinking"}, {"type": "tool_use", "name": "Skill", "input": {"skill": "checker"}}]}})
    (tmp_path / "s.jsonl").write_text(line + "\nnot json\n" + json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": "Which?"}]}}) + "\n")
    from proofmill.operators import triggers

    got = triggers.sessions(artefacts.event_lines(spark, str(tmp_path / "s.jsonl"))).first()
    assert got["started"] and got["next_step"] == "asked first"


def test_rebuild_urls(spark):
    df = spark.createDataFrame([([{"url": "u"}, {"url": None}, {"url": ""}, {"url": "u"}],)], "documents array<struct<url: string>>")
    assert [r["url"] for r in corpus.rebuild_urls(df).collect()] == ["u"]


def test_scorecard_guard(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a")], "seq int, id string")
    md, js = f"file://{tmp_path}/r.md", f"file://{tmp_path}/r.json"
    t = dict.fromkeys(("answers", "passed", "verified", "citations", "failed", "disconfirming", "circular"), 1)
    sinks.write_scorecard(spark, [], t, rows, "2026-01-01", md, js)
    with pytest.raises(sinks.Refused):
        sinks.write_scorecard(spark, [], t | {"answers": 0}, rows, "2026-01-01", md, js)
    assert json.loads((tmp_path / "r.json").read_text())["rows"] == [{"seq": 0, "id": "a"}]


def test_pages_of_one_address_are_not_changes_of_each_other(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b"), (3, None, "c")], "page_id long, url string, html string")
    later = pages.withColumn("html", F.when(F.col("page_id") > 1, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    got = captures.changed(captures.manifest(pages), captures.manifest(later)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((r["url"] or "", r["old_sha256"], r["new_sha256"]) for r in got) == [("", sha("c"), sha("c!")), ("u", sha("b"), sha("b!"))]


def test_a_part_is_one_file(spark, tmp_path):
    lines = spark.range(0, 4000, 1, 8).select(F.floor(F.col("id") / 300).alias("part"), F.col("id").alias("seq"), F.concat("id", F.lit(" x")).alias("value"))
    lines = lines.join(F.broadcast(lines.groupBy("part").agg(F.min("seq").alias("first"))), "part")
    source_queries._as_files(lines, str(tmp_path / "out"))
    found = sorted((int(p.parent.name[5:]), p.read_text()) for p in (tmp_path / "out").glob("*/*.txt"))
    assert found == [(k, "".join(f"{i} x\n" for i in range(300 * k, min(4000, 300 * k + 300)))) for k in range(14)]

import json

from proofmill.__main__ import run


def test_a_whole_round(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "lease.txt").write_text("The tenant may not assign this lease. Notice is 60 days.")
    (docs / "broken.docx").write_bytes(b"no")
    said: list[str] = []
    go = lambda *a: run(spark, ["--store", f"file://{tmp_path}/store", *a], said.append)
    assert go("ingest", str(docs), "leases") == 0 and "broken.docx" in said[0]
    (docs / "more.md").write_text("# Amendment\nNotice is 120 days. There is no limit on notices.")
    assert go("ingest", str(docs), "leases", "--describe", "two") == 0
    said.clear()
    assert go("list") == 0 and said == ["leases\t2\ttwo"]
    said.clear()
    assert go("search", "notice", "leases") == 0 and [s.split("\t")[0] for s in said] == ["lease.txt:1", "more.md:1"]
    answer = {"claims": [{"id": "c1", "text": "Sixty days.", "citations": [{"doc": "lease.txt", "page": 1, "quote": "Notice is 60 days", "anchor": "Sixty"}]}], "gaps": ["rent"]}
    path = tmp_path / "a.json"
    path.write_text(json.dumps(answer))
    assert go("verify", str(path), "leases", "-o", f"{tmp_path}/v") == 0
    assert go("render", str(path), "leases", "-o", f"file://{tmp_path}/r.html") == 0 and "<mark>Notice is 60 days</mark>" in (tmp_path / "r.html").read_text()
    answer["claims"][0]["citations"][0]["quote"] = "tenant may assign this lease"
    path.write_text(json.dumps(answer))
    assert go("verify", str(path), "leases") == 1 and go("verify", str(path), "leases", "--lenient") == 0
    assert go("render", str(path), "leases", "-o", f"file://{tmp_path}/no.html") == 1
    fields = tmp_path / "f.json"
    fields.write_text(json.dumps([{"field": "notice", "value_pattern": "[0-9]+ days", "unlimited_pattern": "no limit"}]))
    assert go("extract", str(fields), "leases", "--out", f"{tmp_path}/w", "--answer", f"{tmp_path}/g") == 0
    assert {r["doc_id"]: r["notice"] for r in spark.read.json(f"{tmp_path}/g").collect()} == {"lease.txt": "60 days", "more.md": "120 days"}
    assert go("nonsense") == 2


def test_a_run_set(spark, tmp_path):
    """Questions, captures and run folders to a scorecard: every status, both verdicts, and the exits."""
    said: list[str] = []
    go = lambda *a: run(spark, ["--store", f"file://{tmp_path}/store", *a], said.append)
    ids = ["good", "wrong", "circular", "bare", "broken", "todo"]
    questions, runs = tmp_path / "q.json", tmp_path / "runs"
    questions.write_text(json.dumps({"questions": [{"id": i, "domain": "law", "question": "Q " + "x" * 90, "source_url": "http://faq"} for i in ids]}))
    page = "<html><body><p>" + "Notice of sixty days is due. The tenant may not assign. " * 20 + "</p></body></html>"
    saved = tmp_path / "captures.jsonl"
    saved.write_text("\n".join(json.dumps({"url": u, "status": s, "saved_at": "2026-01-01", "content": page}) for u, s in (("http://law", 200), ("http://faq", 200), ("http://gone", 404))))

    def answer(name, doc, quote, purpose="contrary rulings"):
        folder = runs / name
        folder.mkdir(parents=True)
        cite = {"doc": doc, "page": 1, "quote": quote}
        (folder / "answer.json").write_text(json.dumps({"claims": [{"id": "c", "text": "t", "citations": [cite]}], "searches": [{"query": "q", "for": purpose}], "gaps": ["rent"]}))
        (folder / "sources.json").write_text(json.dumps({"documents": [{"url": u} for u in ("http://law", "http://faq", "http://gone")]}))

    assert go("score", str(questions), str(runs), "--out", f"{tmp_path}/none.md") == 0 and "0 of 6 run" in said[-1]
    answer("good", "http://law", "The tenant may not assign")
    answer("wrong", "http://law", "The tenant may always assign")
    answer("circular", "http://faq", "The tenant may not assign")
    answer("bare", "http://law", "The tenant may not assign")
    answer("broken", "http://law", "x")
    (runs / "broken" / "answer.json").write_text("{not json")
    (runs / "good" / "judgment.json").write_text(json.dumps({"agrees_with_reference": "yes", "notes": "same"}))
    for name in ("good", "wrong", "circular", "broken"):
        assert go("rebuild", str(runs), name, "--captures", str(saved)) == 0 and said[-1] == "no usable capture of http://gone"
    assert go("rebuild", str(runs), "todo", "--captures", str(saved)) == 2 and go("rebuild", str(runs), "good") == 2
    said.clear()
    assert go("questions", str(questions), str(runs)) == 0
    assert said[0] == "6 questions" and [s.split("\t")[2] for s in said[1:]] == ["run"] * 5 + ["pending"] and len(said[1].split("\t")[3]) == 70
    assert go("score", str(questions), str(runs)) == 0
    rows = {r["id"]: r for r in json.loads((runs / "RESULTS.json").read_text())["rows"]}
    assert [rows[i]["status"] for i in ids] == ["run", "run", "run", "no-corpus", "verify-error", "pending"]
    assert [rows[i].get("pass") for i in ids] == [True, False, False, None, None, None]
    assert rows["good"]["grades"] == {"exact": 1} and rows["good"]["documents_in_corpus"] == 2 and rows["good"]["gaps"] == 1 and rows["good"]["notes"] == "same"
    assert rows["wrong"]["failed"] == 1 and rows["circular"]["circular"] and not rows["good"]["circular"]
    assert rows["broken"]["error"].endswith("{not json")
    before = (runs / "RESULTS.md").read_text()
    assert "| good | law | 1 | 1 | 0 |" in before and "3 of 6 run, 1 pass" in before
    assert go("score", str(questions), str(runs), "good") == 1 and (runs / "RESULTS.md").read_text() == before
    assert go("score", str(questions), str(runs), "good", "nobody", "--out", f"{tmp_path}/one.md") == 0 and "1 of 1 run, 1 pass" in (tmp_path / "one.md").read_text()


def test_triggers(spark, tmp_path):
    said: list[str] = []
    go = lambda *a: run(spark, ["--store", f"file://{tmp_path}/store", "triggers", *a], said.append)
    prompts, logs = tmp_path / "p.json", tmp_path / "logs"
    logs.mkdir()
    prompts.write_text(json.dumps({"prompts": [{"expect": "start", "prompt": "Check this lease"}, {"expect": "none", "prompt": "What is a lease"}, {"expect": "start", "prompt": "Cite it"}]}))
    line = lambda *content: json.dumps({"type": "assistant", "message": {"content": list(content)}}) + "\n"
    (logs / "0.jsonl").write_text(line({"type": "tool_use", "name": "Skill", "input": '{"skill": "checker"}'}) + "not json\n" + line({"type": "text", "text": "Which one?"}))
    (logs / "1.jsonl").write_text(line({"type": "text", "text": "A contract."}))
    assert go(str(prompts), str(logs)) == 1
    assert [s.split("\t")[:3] for s in said[:3]] == [["pass", "start", "started, asked first"], ["pass", "none", "answered"], ["FAIL", "start", "answered"]] and said[3] == "2 of 3 as expected"
    assert go(str(prompts), str(logs), "-k", "LEASE") == 0 and said[-1] == "2 of 2 as expected"

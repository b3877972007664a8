import duckdb
import pytest
from pyspark.sql import functions as F

from proofmill import schemas
from proofmill.operators import extract, report, scoring, search, triggers, verify
from proofmill.plans import evidence_queries
from proofmill.plans.cases import PASSAGES
from proofmill.sources import sinks


def test_scoring_edges(spark):
    q = spark.createDataFrame([("a", "u"), ("b", "u"), ("c", None), ("d", "u")], "id string, source_url string")
    docs = spark.createDataFrame(
        [("a", "1", "u", False, 0), ("a", "2", None, True, 1), ("b", "1", "x", False, 0), ("b", "1", "u", None, 1), ("c", "1", "", False, 0)], "answer_id string, doc_id string, url string, thin boolean, seq int"
    )
    ledger = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "1"), ("d", "9")], "answer_id string, doc_id string")
    got = {r["answer_id"]: (r["circular"], r["low_yield_cited"]) for r in scoring.sources(q, scoring.cited(ledger, ledger), docs).collect()}
    # a null address is another one; of repeated ids the last holds; a missing source_url is ""; unknown ids are left out
    assert got == {"a": (False, True), "b": (True, False), "c": (True, False), "d": (False, False)}


def test_passes(spark):
    rows = spark.createDataFrame([(0, True, False, None, 0), (0, True, False, "no", 5), (1, True, False, "yes", 5), (0, False, False, "yes", 5), (0, True, True, "yes", 5), (0, True, False, "partial", 5)], "f int, c boolean, u boolean, g string, n int")
    at = [F.col(x) for x in "fcug"]
    assert [r[0] for r in rows.select(scoring.passes(*at)).collect()] == [True, False, False, False, False, True]
    assert rows.select(scoring.passes(*at, F.col("n"))).first()[0] is False


def test_chosen_keeps_the_sets_order(spark):
    q = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "id string, seq int")
    assert [r["id"] for r in scoring.chosen(q, ["c", "b", "zzz"]).collect()] == ["b", "c"]
    assert scoring.chosen(q, []).count() == 3


def test_search_has_no_synonyms(spark):
    pages = spark.createDataFrame([("d", 1, "A lease may end."), ("e", 1, "A rental stops.")], "doc_id string, page_no int, text string")
    q = spark.createDataFrame([(0, "lease"), (1, "tenancy")], "query_id int, query string")
    assert [(r["query_id"], r["doc_id"]) for r in search.bm25(pages, q).collect()] == [(0, "d")]
    assert search.phrase(pages, "MAY END").first()["snippet"] == "A lease may end."


def test_extraction_states(spark):
    pages = spark.createDataFrame([("x", 1, "The cap is $5,000. Fine."), ("y", 1, "There is no limit on liability."), ("z", 1, "Nothing here.")], "doc_id string, page_no int, text string")
    fields = spark.createDataFrame([("cap", r"\$[0-9,]+[0-9]", r"no limit")], schemas.FIELD)
    cells = extract.cells(pages, fields)
    assert {r["doc_id"]: (r["state"], r["value"]) for r in cells.collect()} == {"x": ("value", "$5,000"), "y": ("unlimited", None), "z": ("absent", None)}
    assert {r["doc_id"]: r["cap"] for r in extract.grid(cells, ["cap"]).collect()} == {"x": "$5,000", "y": "no limit", "z": None}
    _, cites = extract.as_answer(cells, "g")
    assert {r["grade"] for r in verify.grade(cites, pages.withColumn("ocr", F.lit(False))).collect()} == {"exact"}


def test_trigger_fold(spark):
    log = [(1, 1, "assistant", "text", None, "hi", None), (1, 2, "assistant", "tool_use", "Bash", None, "python checker/scripts/x"), (1, 3, "assistant", "tool_use", "Bash", None, "notices.py take"), (1, 4, "assistant", "thinking", None, None, None), (1, 5, "assistant", "tool_use", "Read", None, "f"),
           (2, 1, "user", "text", None, "checker?", None), (2, 2, "assistant", "text", None, "No.", None)]
    df = spark.createDataFrame(log, "session int, seq int, type string, kind string, name string, text string, input string")
    assert sorted(map(tuple, triggers.sessions(df).collect())) == [(1, True, "went straight to work"), (2, False, "")]


def test_report(spark):
    pages = spark.createDataFrame(PASSAGES, "doc_id string, page_no int, text string, ocr boolean")
    claims = spark.createDataFrame([("a", 1, "c", "Half <is> paid.", "document"), ("a", 1, "d", "So it follows.", "reasoning")], schemas.CLAIM)
    cites = spark.createDataFrame([("a", "c", "1", "D1", 1, "pay 50% of fees", "Half"), ("a", "d", "2", "D10", 1, "read from a scanned page", "")], schemas.CITATION)
    led = verify.grade(cites, pages)
    checked = verify.digest(claims, cites)
    docs = spark.createDataFrame([("D1", "http://a", None), ("D2", None, None)], "doc_id string, url string, saved_at timestamp")
    parts = (cites, report.highlighted(pages, led), report.source_list(docs, led), spark.createDataFrame([("a", 1, "fees", "contra")], schemas.SEARCH), spark.createDataFrame([("a", 1, "When?")], schemas.GAP))
    page = report.render("R", verify.gate(claims, cites, led, checked), claims, *parts)
    for bit in ("<u>Half</u> &lt;is&gt;", "<mark>pay 50% of fees</mark>", "(from a scan)", "not used", "When?", "contra", "the author's reasoning"):
        assert bit in page
    edited = claims.withColumn("text", F.lit("Other."))
    with pytest.raises(ValueError, match="changed True"):
        report.render("R", verify.gate(edited, cites, led, checked), edited, *parts)
    row = sinks.verified_answers(claims, cites, led, parts[-1]).first()
    assert len(row["claims"]) == 2 and row["gaps"] == ["When?"] and {x["grade"] for x in row["verification"]["ledger"]} == {"exact"}


def test_quotes_over_a_page_break(spark, tmp_path):
    """Words that repeat about the break, a run of them to either side, and a long word over it; and plain words."""
    plain = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(670))
    mid = lambda before, run, after: (plain[:before] + " " + run + " " + plain[:after])
    runs = [mid(1901, "oush " * 42, 600), mid(1850, "the " * 40, 600), mid(1950, "x" * 120, 600), plain[:1990] + " " + "y" * 90 + " " + plain[:600], plain + " " + plain[:200]]
    spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(evidence_queries.ORACLE["verify_spanning"]).fetchall()
    got = [tuple(r) for r in evidence_queries.QUERIES["verify_spanning"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(want) >= 3

"""Command line: ingest, search, verify, render, extract and list, over corpora in a store; questions, score and
rebuild, over run folders; triggers, over session logs.

Exit codes: 0 in order, 1 a quotation, claim or trigger fails (or nothing was done), 2 wrong use.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import extract, report, runs, scoring, search, triggers, verify
from .sources import artefacts, captures, corpus, files, sinks


def answer_tables(spark: SparkSession, text: str, answer_id: str = "answer") -> dict[str, DataFrame]:
    """Claims, citations, searches and gaps of an answer file: claims [{id, text, kind, citations [{id, doc, page, quote, anchor}]}], searches [{query, for}], gaps."""
    a = json.loads(text)
    claims = [(answer_id, a.get("question_no", 1), str(c["id"]), c.get("text", ""), c.get("kind", "document")) for c in a.get("claims") or []]
    cites = [
        (answer_id, str(c["id"]), str(q.get("id", f"{c['id']}.{k}")), q.get("doc"), q.get("page"), q.get("quote"), q.get("anchor", ""))
        for c in a.get("claims") or []
        for k, q in enumerate(c.get("citations") or [], 1)
    ]
    searches = [(answer_id, k, s.get("query"), s.get("for")) for k, s in enumerate(a.get("searches") or [])]
    gaps = [(answer_id, k, str(g)) for k, g in enumerate(a.get("gaps") or [])]
    make = spark.createDataFrame
    return {"claims": make(claims, schemas.CLAIM), "citations": make(cites, schemas.CITATION), "searches": make(searches, schemas.SEARCH), "gaps": make(gaps, schemas.GAP)}


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def _checked(spark: SparkSession, store: corpus.Store, args) -> tuple[dict, DataFrame, DataFrame, DataFrame]:
    pages = store.read(args.name)
    t = answer_tables(spark, _text(spark, args.answer))
    ledger = verify.grade(t["citations"], pages)
    return t, pages, ledger, verify.gate(t["claims"], t["citations"], ledger, verify.digest(t["claims"], t["citations"]), getattr(args, "lenient", False))


def _run_files(spark: SparkSession, folder: str) -> DataFrame:
    return artefacts.run_files(spark, folder) if sinks.exists(spark, folder) else spark.createDataFrame([], "id string, name string, text string")


def _questions(spark: SparkSession, args, out) -> int:
    """Lists the set with the state of each run."""
    asked, files_ = artefacts.questions(spark, args.questions), _run_files(spark, args.runs)
    rows = scoring.listed(asked, files_.where("name = 'answer.json'")).join(asked.select("id", "seq"), "id").orderBy("seq").collect()
    out(f"{len(rows)} questions")
    for r in rows:
        out(f"{r['id']}\t{r['domain']}\t{r['state']}\t{r['question']}")
    return 0


def _score(spark: SparkSession, store: corpus.Store, args, out) -> int:
    """Scores the runs named, or all. Only a scorecard named by --out is replaced when nothing was scored."""
    asked = scoring.chosen(artefacts.questions(spark, args.questions), args.ids)
    pages, docs = runs.corpora(spark, store, [r["id"] for r in asked.select("id").collect()])
    rows = runs.scored(asked, _run_files(spark, args.runs), pages, docs).persist()
    try:
        sums = scoring.totals(rows).first()
        shown = scoring.shown(rows).join(rows.select("id", "seq"), "id").orderBy("seq").collect()
        md = args.out or f"{args.runs.rstrip('/')}/RESULTS.md"
        js = (md[:-3] if md.endswith(".md") else md) + ".json"
        sinks.write_scorecard(spark, shown, sums, rows, date.today().isoformat(), md, js, subset=bool(args.ids), force=bool(args.out))
        out(report.scorecard(shown, sums, date.today().isoformat()))
    except sinks.Refused as e:
        out(f"{e}; the old scorecard stays")
        return 1
    finally:
        rows.unpersist()
    return 0


def _rebuild(spark: SparkSession, store: corpus.Store, args, out) -> int:
    """Makes a run's corpus again from the addresses that it recorded and captures saved of them."""
    mine = _run_files(spark, args.runs).where((F.col("id") == args.id) & (F.col("name") == "sources.json"))
    listed = mine.select(F.from_json("text", schemas.SOURCES_FILE).alias("j")).select("j.documents")
    if listed.isEmpty():
        out(f"no sources.json for {args.id}")
        return 2
    urls = corpus.rebuild_urls(listed)
    if urls.isEmpty():
        out(f"{args.id}: sources.json lists no addresses; nothing to rebuild")
        return 2
    if not args.captures:
        out(f"{args.id}: nothing is fetched here; name saved captures with --captures")
        return 2
    pages = captures.as_pages(captures.saved(spark, args.captures).join(urls, "url", "left_semi"))
    if pages.isEmpty():
        out(f"{args.id}: none of its addresses has a usable capture")
        return 1
    for r in urls.join(pages, "url", "left_anti").orderBy("url").limit(1000).collect():
        out(f"no usable capture of {r['url']}")
    store.create(f"eval-{args.id}", pages, f"eval run: {args.id} (rebuilt)", force=True)
    return 0


def _triggers(spark: SparkSession, args, out) -> int:
    """Whether sessions started the checker as expected; the log of the prompt at place n is named n.jsonl."""
    asked = artefacts.prompts(spark, args.prompts)
    events = artefacts.event_lines(spark, args.logs).withColumn("session", F.regexp_extract("session", r"([0-9]+)\.[^/]*$", 1).try_cast("int")).where("session IS NOT NULL")
    found = triggers.sessions(events, args.skill or "checker", args.notices or "notices.py")
    rows = triggers.check(asked, found, args.k).join(asked.select("session", "prompt"), "session").join(found.select("session", "next_step"), "session", "left").orderBy("session").collect()
    for r in rows:
        how = f", {r['next_step']}" if r["next_step"] else ""
        out(f"{'pass' if r['ok'] else 'FAIL'}\t{r['expect']}\t{'started' if r['started'] else 'answered'}{how}\t{r['prompt'][:70]}")
    passed = sum(r["ok"] for r in rows)
    out(f"{passed} of {len(rows)} as expected")
    return 0 if passed == len(rows) else 1


def run(spark: SparkSession, argv: list[str], out=print) -> int:
    p = argparse.ArgumentParser(prog="proofmill", description=__doc__)
    p.add_argument("--store", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    for name, words in (("ingest", "folder name --describe= --force"), ("search", "query name"), ("verify", "answer name --lenient -o="), ("render", "answer name -o="), ("extract", "fields name --out= --answer="), ("list", ""), ("questions", "questions runs"), ("score", "questions runs ids* --out="), ("rebuild", "runs id --captures="), ("triggers", "prompts logs -k= --skill= --notices=")):
        c = sub.add_parser(name)
        for w in words.split():
            c.add_argument(w.rstrip("=*"), **({"nargs": "*"} if w.endswith("*") else {"default": None} if w.endswith("=") else {"action": "store_true"} if w[0] == "-" else {}))
    try:
        args = p.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    store = corpus.Store(spark, args.store)
    if args.command == "questions":
        return _questions(spark, args, out)
    if args.command == "score":
        return _score(spark, store, args, out)
    if args.command == "rebuild":
        return _rebuild(spark, store, args, out)
    if args.command == "triggers":
        return _triggers(spark, args, out)
    if args.command == "list":
        for r in store.registry().orderBy("name").collect():
            out(f"{r['name']}\t{r['generation']}\t{r['description']}")
        return 0
    if args.command == "ingest":
        known = store.generation(args.name)
        old = store.read(args.name).drop("corpus") if known else None
        read = files.read_folder(spark, args.folder, known=old.select("sha256").distinct() if known and not args.force else None).persist()
        for r in read.where("error IS NOT NULL").select("path", "error").limit(1000).collect():
            out(f"skipped {r['path']}: {r['error']}")
        pages = read.where("error IS NULL").select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), "page_no", "text", "ocr", "sha256")
        pages = old.unionByName(pages) if known and not args.force else pages
        store.write(args.name, pages, known, args.describe or "")
        return 0
    if args.command == "search":
        pages = store.read(args.name)
        asked = spark.createDataFrame([(0, args.query)], "query_id int, query string")
        for r in search.passages(pages, asked).orderBy("doc_id", "page_no").collect():
            out(f"{r['doc_id']}:{r['page_no']}\t{r['snippet']}")
        return 0
    if args.command == "extract":
        rows = [(f["field"], f["value_pattern"], f.get("unlimited_pattern")) for f in json.loads(_text(spark, args.fields))]
        found = extract.cells(store.read(args.name), spark.createDataFrame(rows, schemas.FIELD))
        sinks.write_grid(found, extract.grid(found, [r[0] for r in rows]), args.out, args.answer)
        return 0
    t, pages, ledger, gate = _checked(spark, store, args)
    if args.command == "verify":
        for r in ledger.orderBy("cite_id").collect():
            out(json.dumps({"cite": r["cite_id"], "doc": r["doc_id"], "page": r["page_no"], "grade": r["grade"], "reasons": r["reasons"], "warnings": r["warnings"]}))
        if args.o:
            sinks.verified_answers(t["claims"], t["citations"], ledger, t["gaps"]).write.mode("overwrite").json(args.o)
        return 0 if gate.where("NOT ok").isEmpty() else 1
    docs = pages.select("doc_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("timestamp").alias("saved_at")).distinct()
    try:
        page = report.render(args.name, gate, t["claims"], t["citations"], report.highlighted(pages, ledger), report.source_list(docs, ledger), t["searches"], t["gaps"])
    except ValueError as e:
        out(str(e))
        return 1
    sinks.write_text(spark, args.o, page)
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("proofmill").config("spark.sql.session.timeZone", "UTC").getOrCreate(), sys.argv[1:]))

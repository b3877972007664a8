"""What a report shows, as tables, and its rendering from them."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(thread: DataFrame) -> DataFrame:
    """(report, question_no, ...): follow-ups are numbered in the order they came (seq)."""
    return thread.withColumn("question_no", F.row_number().over(Window.partitionBy("report").orderBy("seq")))


def source_list(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every collected document, also those not used: (doc_id, url, saved_at, citations, used)."""
    used = ledger.groupBy("doc_id").agg(F.count("*").alias("citations"))
    out = docs.join(used, "doc_id", "left")
    return out.select("doc_id", "url", "saved_at", F.coalesce("citations", F.lit(0)).alias("citations"), F.col("citations").isNotNull().alias("used"))


def quoted_pages(pages: DataFrame, ledger: DataFrame) -> DataFrame:
    """The pages that verified quotations are on."""
    return pages.join(ledger.where("grade <> 'UNVERIFIED'").select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_semi")


def highlighted(pages: DataFrame, ledger: DataFrame) -> DataFrame:
    """(cite_id, doc_id, page_no, before, quote, after, scan): a page's text around a quotation's place."""
    at = ledger.where("grade <> 'UNVERIFIED' AND start IS NOT NULL").select("cite_id", "doc_id", "page_no", "start", "end")
    out = pages.join(at, ["doc_id", "page_no"])
    return out.select(
        "cite_id", "doc_id", "page_no",
        F.substring("text", F.lit(1), F.col("start").cast("int")).alias("before"),
        F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("quote"),
        F.substring("text", (F.col("end") + 1).cast("int"), F.length("text")).alias("after"),
        F.coalesce("ocr", F.lit(False)).alias("scan"),
    )


def search_list(searches: DataFrame) -> DataFrame:
    return searches.orderBy("answer_id", "seq")


def find(reports: DataFrame, name: str) -> DataFrame:
    return reports.where(F.col("report") == name)


#: Rows of one report that are gathered for rendering; a report is read by a person and has fewer.
MOST_ROWS = 100_000


def render(name: str, gate: DataFrame, claims: DataFrame, citations: DataFrame, marked: DataFrame, sources: DataFrame, searches: DataFrame, gaps: DataFrame) -> str:
    """HTML of a report whose answers all pass the gate; else ValueError with what is wrong."""
    bad = gate.where("NOT ok").limit(20).collect()
    if bad:
        raise ValueError("no report: " + "; ".join(f"{r['answer_id']}: {r['failed']} failed, {r['uncited']} uncited, changed {r['changed']}" for r in bad))

    def rows(df: DataFrame) -> list:
        got = df.limit(MOST_ROWS + 1).collect()
        if len(got) > MOST_ROWS:
            raise ValueError("too many rows for one report")
        return got

    e = lambda x: html.escape("" if x is None else str(x))
    by_claim: dict = {}
    for c in sorted(rows(citations), key=lambda r: r["cite_id"]):
        by_claim.setdefault((c["answer_id"], c["claim_id"]), []).append(c)
    out = [f"<!DOCTYPE html><meta charset='utf-8'><title>{e(name)}</title><h1>{e(name)}</h1>"]
    for c in sorted(rows(claims), key=lambda r: (r["question_no"], r["claim_id"])):
        text = e(c["text"])
        links = []
        for q in by_claim.get((c["answer_id"], c["claim_id"]), []):
            if q["anchor"] and e(q["anchor"]) in text:
                text = text.replace(e(q["anchor"]), f"<u>{e(q['anchor'])}</u>", 1)
            links.append(f"<a href='#{e(q['cite_id'])}'>[{e(q['cite_id'])}]</a>")
        note = " (the author's reasoning, not verified)" if c["kind"] == "reasoning" else ""
        out.append(f"<p>{text}{note} {' '.join(links)}</p>")
    for m in sorted(rows(marked), key=lambda r: r["cite_id"]):
        scan = " (from a scan)" if m["scan"] else ""
        out.append(f"<section id='{e(m['cite_id'])}'><h3>{e(m['doc_id'])}, page {m['page_no']}{scan}</h3><p>{e(m['before'])}<mark>{e(m['quote'])}</mark>{e(m['after'])}</p></section>")
    for title, df, show in (
        ("Sources", sources, lambda r: f"{e(r['doc_id'])} <a href='{e(r['url'])}'>{e(r['url'])}</a> {e(r['saved_at'])} {'used' if r['used'] else 'not used'}"),
        ("Searches", searches, lambda r: f"{e(r['query'])} ({e(r['purpose'])})"),
        ("Not answered", gaps, lambda r: e(r["text"])),
    ):
        out.append(f"<h2>{title}</h2><ul>" + "".join(f"<li>{show(r)}</li>" for r in rows(df)) + "</ul>")
    return "\n".join(out)


def scorecard(rows: list, totals, scored: str) -> str:
    """Markdown of shown rows, in the order given."""
    head = ("id", "domain", "citations", "verified", "failed", "warnings", "disconfirming", "circular", "agrees", "pass")
    out = [f"# Scores of {scored}", "", f"{totals['answers']} of {len(rows)} run, {totals['passed']} pass", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    out += ["| " + " | ".join(str(r[c]) for c in head) + " |" for r in rows]
    out += ["", f"{totals['verified']} of {totals['citations']} quotations found, {totals['failed']} not; {totals['disconfirming']} looked for evidence against themselves, {totals['circular']} only cited the question's own page."]
    return "\n".join(out) + "\n"

"""Folders of files as pages: plain text, Markdown, HTML, RTF and Word; PDF through a parser that the caller gives."""

from __future__ import annotations

import hashlib
import html
import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "path string, sha256 string, page_no int, text string, error string, ocr boolean"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def from_html(data: bytes) -> list[str]:
    text = data.decode("utf-8", "replace")
    text = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ", text)
    text = re.sub(r"(?i)<(br|/p|/div|/h[1-6]|/li|/tr)[^>]*>", "\n", text)
    return [html.unescape(re.sub(r"<[^>]*>", " ", text)).strip()]


def from_rtf(data: bytes) -> list[str]:
    """Text of RTF: groups that hold tables and pictures are left out; page breaks part pages."""
    text = data.decode("latin-1")
    if not text.lstrip().startswith("{\\rtf"):
        raise ValueError("not RTF")
    out, skip, stack, k = [], False, [], 0
    token = re.compile(r"\\([a-z]+)(-?[0-9]+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
    hidden = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "generator"}
    for m in token.finditer(text):
        word, number, code, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif word in hidden or sign == "*":
            skip = True
        elif skip:
            continue
        elif k:
            k -= 1
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            k = 1
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif word in ("page", "sect"):
            out.append("\f")
        elif code:
            out.append(bytes.fromhex(code).decode("cp1252", "replace"))
        elif sign in ("\\", "{", "}"):
            out.append(sign)
        elif sign == "~":
            out.append(" ")
        elif plain:
            out.append(plain)
    return [p.strip() for p in "".join(out).split("\f")]


def from_docx(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in body.iter(_WORD + "p"):
        for node in p.iter():
            if node.tag == _WORD + "t":
                out.append(node.text or "")
            elif node.tag == _WORD + "tab":
                out.append("\t")
            elif node.tag == _WORD + "br":
                out.append("\f" if node.get(_WORD + "type") == "page" else "\n")
        out.append("\n")
    return [p.strip() for p in "".join(out).split("\f")]


def from_text(data: bytes) -> list[str]:
    return [p.strip("\n") for p in data.decode("utf-8-sig", "replace").split("\f")]


def from_markdown(data: bytes) -> list[str]:
    pages = from_text(data)
    return [re.sub(r"(?m)^#{1,6} +|(?<!\w)[*_]{1,3}(?=\S)|(?<=\S)[*_]{1,3}(?!\w)|!?\[([^\]]*)\]\([^)]*\)", lambda m: m.group(1) or "", p) for p in pages]


_NUMBER = r"[0-9]+(?:\.[0-9]+)*\."


def stranded_numbers(pages: list[str]) -> list[str]:
    """Clause numbers at the foot of a page go back before their clauses.

    One alone belongs to the clause that begins the next page. A list of several belongs to the paragraphs of its page
    that have no number, in order, if there are as many (the last number to the next page, if there is one paragraph
    less); otherwise nothing tells whose they are, and the page stays as it is.
    """
    pages = list(pages)
    for k in range(len(pages)):
        m = re.search(rf"(?:\n[ \t]*{_NUMBER}[ \t]*)+\n*\Z", pages[k])
        if not m:
            continue
        found, parts = m.group().split(), re.split(r"(\n(?:[ \t]*\n)+)", pages[k][: m.start()].rstrip())
        bare = [i for i in range(0, len(parts), 2) if parts[i].strip() and not re.match(rf"\s*{_NUMBER}(?:\s|\Z)", parts[i])]
        more = k + 1 < len(pages)
        if len(found) > 1 and len(bare) == len(found):
            last = None
        elif more and (len(found) == 1 or len(bare) == len(found) - 1):
            last = found.pop()
        else:
            continue
        for i, number in zip(bare, found, strict=False):
            parts[i] = f"{number} {parts[i].lstrip()}"
        pages[k] = "".join(parts) if found else pages[k][: m.start()]
        if last:
            pages[k + 1] = f"{last} {pages[k + 1].lstrip()}"
    return pages


PARSERS: dict[str, Callable[[bytes], list[str]]] = {
    "txt": from_text, "md": from_markdown, "markdown": from_markdown, "html": from_html, "htm": from_html, "rtf": from_rtf, "docx": from_docx,
}


def is_scan(text, image):
    """A page with an image and no text layer to speak of."""
    return (F.length(F.trim(F.coalesce(text, F.lit("")))) < 20) & image.isNotNull()


def parse(path: str, data: bytes, parsers: dict[str, Callable[[bytes], list[str]]]) -> list[tuple]:
    """Rows of PAGES; an unreadable file gives one row with its error, and never an exception."""
    sha = hashlib.sha256(data).hexdigest()
    kind = path.rsplit(".", 1)[-1].lower()
    try:
        if kind not in parsers:
            raise ValueError(f"no parser for {kind}")
        pages = stranded_numbers(parsers[kind](data))
        if not any(p.strip() for p in pages):
            raise ValueError("no text")
        return [(path, sha, k, p, None, False) for k, p in enumerate(pages, 1)]
    except Exception as e:  # one bad file does not stop a folder: it is reported as a row
        return [(path, sha, None, None, f"{type(e).__name__}: {e}", False)]


def read_folder(spark: SparkSession, path: str, parsers: dict | None = None, known: DataFrame | None = None) -> DataFrame:
    """PAGES of every file under path. Files whose fingerprint is in known (sha256) were read before and are skipped."""
    parsers = PARSERS | (parsers or {})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    if known is not None:
        files = files.withColumn("sha256", F.sha2("content", 256)).join(known.select("sha256"), "sha256", "left_anti").select("path", "content")

    def run(frames):
        for f in frames:
            yield pd.DataFrame([r for p, c in zip(f["path"], f["content"], strict=True) for r in parse(p, bytes(c), parsers)], columns=[x.split()[0] for x in PAGES.split(", ")]).astype({"page_no": "Int32"})

    return files.mapInPandas(run, PAGES)


def recognised(pages: DataFrame, engine: Callable[[bytes], str]) -> DataFrame:
    """Pages with an image and no text, read by an engine for scans and marked as such."""

    @F.pandas_udf("string")
    def read(image: pd.Series) -> pd.Series:
        return image.map(lambda b: None if b is None else engine(bytes(b)))

    scan = is_scan(F.col("text"), F.col("image"))
    return pages.withColumns({"text": F.when(scan, read("image")).otherwise(F.col("text")), "ocr": scan | F.coalesce("ocr", F.lit(False))})

"""Personal data: detection on the text and on a deobfuscated copy whose spans are mapped back.

Transducers rewrite homoglyphs, spelled digits and at/dot disguises; each output character remembers the source
span it came from, so whatever is detected in the rewritten text is reported in code points of the original.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession

from .common import scored

KINDS = ("email", "ip", "card", "phone")

# Look-alikes of ASCII characters (Cyrillic, Greek, others), and characters without width.
_ALIKE = dict(
    zip(
        "авекмнорстухіјѕԁһӏԛԝАВЕКМНОРСТУХІЈЅαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɑɡ․。∙＠﹫‐‑‒–—−",
        "abekmhopctyxijsdhlqwABEKMHOPCTYXIJSaeikvoptuxABEZHIKMNOPTYXiag...@@------",
        strict=True,
    )
)
_ALIKE |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)} | {chr(d + i): chr(48 + i) for d in (0x0660, 0x06F0, 0x0966) for i in range(10)}
_ALIKE |= {c: "" for c in "­​‌‍⁠﻿"}
_ODD = re.compile("[" + re.escape("".join(_ALIKE)) + "]")
_DIGITS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_NAMES = "|".join(_DIGITS)
_SPELLED = re.compile(rf"(?<![A-Za-z])(?:{_NAMES})(?:[ -](?:{_NAMES}))+(?![A-Za-z])", re.I)
_ONE = re.compile(_NAMES, re.I)
_BRACKET = re.compile(r"[ ]?[\[({<][ ]?(at|dot|@|\.)[ ]?[\])}>][ ]?", re.I)
_SIGNS = tuple(a + x + b for a, b in ("[]", "()", "{}", "<>") for x in "@.")
#: Plain words only as a whole address: name at host dot host.
_PLAIN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+( at )[A-Za-z0-9-]+(?:(?: dot |\.)[A-Za-z0-9-]+)*?(?: dot )[A-Za-z0-9-]+(?:(?: dot |\.)[A-Za-z0-9-]+)*", re.I)
#: The same where only one of at and dot is a plain word; a plain at needs a dot that was rewritten.
_PLAIN_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+( at )[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.I)
_PLAIN_DOT = re.compile(r"(?<=[A-Za-z0-9._%+-])@[A-Za-z0-9-]+(?:(?: dot |\.)[A-Za-z0-9-]+)+", re.I)
_DOT = re.compile(r" dot ", re.I)
_NUMBER_DOT = re.compile(r"(?<=[0-9]) dot (?=[0-9])", re.I)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns: leftmost, not overlapping within a kind, in linear time."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        first = at
        while first > free and _LOCAL.match(text, first - 1):
            first -= 1
        if first < at and (m := _HOST.match(text, at + 1)):
            found.append((first, 0, m.end()))
            free = m.end()
        elif first < at:
            free = at  # each character before is looked at once
        at = text.find("@", max(at + 1, free))
    if re.search("[0-9]", text):
        for m in _CHAIN.finditer(text):
            if m.group().count(".") > 2:
                parts = [(p.start(), p.end()) for p in _PART.finditer(text, m.start(), m.end())]
                for k in range(0, len(parts) - 3, 4):
                    if all(_small(text[a:b]) for a, b in parts[k : k + 4]):
                        found.append((parts[k][0], 1, parts[k + 3][1]))
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


class Rewritten:
    """A text under edits, with the source span of each part that is no longer as it was."""

    def __init__(self, text: str):
        self.text = text
        self.edits: list[tuple[int, int, int, int]] = []  # start and end here, start and end in the source; in order

    def source(self, at: int, end: bool) -> int:
        """Where a position lies in the source; inside an edit, its start, or its end."""
        k = (bisect_left if end else bisect_right)(self.edits, at, key=lambda e: e[0]) - 1
        if k < 0:
            return at
        a, b, s, t = self.edits[k]
        return (t if end else s) if a <= at < b or (end and a < at <= b) else t + at - b

    def touched(self, start: int, end: int) -> bool:
        k = bisect_left(self.edits, start, key=lambda e: e[0])
        return (k < len(self.edits) and self.edits[k][0] < end) or (k > 0 and self.edits[k - 1][1] > start)

    def apply(self, changes: list[tuple[int, int, str]]) -> None:
        """Replace spans of the present text (in order, apart); their source spans are worked out first."""
        if not changes:
            return
        out, edits, last, size, k = [], [], 0, 0, 0

        def carry(upto: int) -> None:
            nonlocal k
            while k < len(self.edits) and self.edits[k][1] <= upto:
                a, b, s, t = self.edits[k]
                if a >= last:
                    edits.append((a - last + size, b - last + size, s, t))
                k += 1

        for a, b, new in changes:
            carry(a)
            out.append(self.text[last:a])
            size += a - last
            edits.append((size, size + len(new), self.source(a, False), self.source(b, True) if b > a else self.source(a, False)))
            out.append(new)
            size, last = size + len(new), b
            while k < len(self.edits) and self.edits[k][0] < b:
                k += 1
        carry(len(self.text))
        out.append(self.text[last:])
        self.text, self.edits = "".join(out), edits


def deobfuscate(text: str) -> Rewritten:
    """The text after the transducers: look-alikes, then spelled digits, then at and dot."""
    r = Rewritten(text)
    if not text.isascii():
        r.apply([(m.start(), m.end(), _ALIKE[m.group()]) for m in _ODD.finditer(text)])
    low = r.text.lower()
    if sum(name in low for name in _DIGITS) > 0:
        digits = []
        for m in _SPELLED.finditer(r.text):
            last = m.start()
            for one in _ONE.finditer(r.text, m.start(), m.end()):
                digits.append((last, one.end(), _DIGITS[one.group().lower()]))
                last = one.end()
        r.apply(digits)
        low = r.text.lower()
    if any(x in low for x in _SIGNS) or "dot" in low or "at)" in low or "at]" in low or "at}" in low or "at>" in low or "at )" in low or "at ]" in low:
        r.apply([(m.start(), m.end(), "@" if m.group(1).lower() in ("at", "@") else ".") for m in _BRACKET.finditer(r.text)])
        if " dot " in r.text.lower():
            plain = []
            for m in _PLAIN.finditer(r.text):
                plain.append((m.start(1), m.end(1), "@"))
                plain += [(d.start(), d.end(), ".") for d in _DOT.finditer(r.text, m.end(1), m.end())]
            r.apply(plain)
            r.apply([(d.start(), d.end(), ".") for m in _PLAIN_DOT.finditer(r.text) for d in _DOT.finditer(r.text, m.start(), m.end())])
            r.apply([(m.start(), m.end(), ".") for m in _NUMBER_DOT.finditer(r.text)])
    if r.edits and " at " in r.text.lower():
        r.apply([(m.start(1), m.end(1), "@") for m in _PLAIN_AT.finditer(r.text) if any(r.text[k] == "." and r.touched(k, k + 1) for k in range(m.end(1), m.end()))])
    return r


def spans(text: str | None) -> tuple[list, list]:
    """Base spans and all spans, as (start, kind, end). Null text is empty. An added span overlaps base
    spans only where it strictly contains them and is of their kind; they stay beside it."""
    text = text or ""
    base = detect(text)
    r = deobfuscate(text)
    if not r.edits:
        return base, base
    more = set()
    for a, kind, b in detect(r.text):
        if r.touched(a, b):
            s, t = r.source(a, False), r.source(b, True)
            if all(y <= s or t <= x or (k == kind and s <= x and y <= t and (x, y) != (s, t)) for x, k, y in base):
                more.add((s, kind, t))
    return base, sorted([*base, *more])


def written(found: list) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in found)


def _columns(texts: list[str | None]) -> list[list]:
    out: list[list] = [[] for _ in range(6)]
    for t in texts:
        base, every = spans(t)
        for k in range(4):
            out[k].append(sum(x[1] == k for x in base))
        out[4].append(hashlib.sha256(written(base).encode()).hexdigest())
        out[5].append(written(every))
    return out


def find_pii(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns, counts of base spans by kind, their digest and all spans of every row's whole text."""
    return scored(docs, keep, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", _columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: personal data in every document."""
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])

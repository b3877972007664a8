"""The harmless differences that a quotation may show, as one normal form.

Line breaks, curly quotes, ligatures, footnote marks, words hyphenated across lines and section numbers broken across
lines are made alike. `normal` is the form as a column expression; `normal_map` is the same form in Python with the
place in the original of each of its characters, for the few pages where an address is needed. Compatibility folding
is not used: it would turn 1½ into another number.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Quotation marks and ligatures.
DOUBLE, SINGLE = "“”„‟", "‘’‚‛"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_BLANK = r"[\t\n\x0B\f\r \u0085   -     　]"
_WORD_END = r"[a-zA-ZÀ-ɏ.,;:!?)\"”’]"
_LETTER = r"[a-zA-ZÀ-ɏ]"
#: (pattern, replacement), read alike by Java and Python.
_RULES = (
    (rf"(?<={_LETTER})-[ \t]*\r?\n[ \t]*(?={_LETTER})", ""),
    (r"(?<=[Ss]ection [0-9]\.)[ \t]*\r?\n[ \t]*(?=[0-9])", ""),
    (r"(?<=[Ss]ection [0-9][0-9]\.)[ \t]*\r?\n[ \t]*(?=[0-9])", ""),
    (r"(?<=[Cc]lause [0-9]\.)[ \t]*\r?\n[ \t]*(?=[0-9])", ""),
    (r"(?<=[Cc]lause [0-9][0-9]\.)[ \t]*\r?\n[ \t]*(?=[0-9])", ""),
    (rf"(?<={_WORD_END})[⁰¹²³⁴-⁹]+", ""),
    (rf"(?<={_WORD_END})\[[0-9]{{1,3}}\]", ""),
)


def normal(text: Column) -> Column:
    """The normal form; null stays null."""
    for pattern, new in _RULES:
        text = F.regexp_replace(text, pattern, new)
    text = F.translate(text, DOUBLE + SINGLE, '"' * len(DOUBLE) + "'" * len(SINGLE))
    for old, new in LIGATURES.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(text, _BLANK + "+", " "))


def normal_map(text: str) -> tuple[str, list[int]]:
    """The normal form and, for each of its characters, the place of the original one; then the original's length."""
    places = list(range(len(text)))

    def replaced(text: str, places: list[int], pattern: str, new) -> tuple[str, list[int]]:
        out, at, kept = [], [], 0
        for m in re.finditer(pattern, text):
            put = new(m.group()) if callable(new) else new
            out += [text[kept : m.start()], put]
            at += places[kept : m.start()]
            at += [places[m.start()]] * len(put)
            kept = m.end()
        return "".join([*out, text[kept:]]), at + places[kept:]

    for pattern, new in _RULES:
        text, places = replaced(text, places, pattern, new)
    text = text.translate(str.maketrans(DOUBLE + SINGLE, '"' * len(DOUBLE) + "'" * len(SINGLE)))
    text, places = replaced(text, places, "[" + "".join(LIGATURES) + "]", LIGATURES.get)
    text, places = replaced(text, places, _BLANK + "+", " ")
    first = len(text) - len(text.lstrip(" "))
    last = len(text.rstrip(" "))
    return text[first:last], places[first:last]


@F.pandas_udf(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
def original_span(text: pd.Series, start: pd.Series, length: pd.Series) -> pd.DataFrame:
    """Where `length` characters from `start` of the normal form lie in the original: half-open, in code points."""
    out = []
    for t, s, n in zip(text, start, length, strict=True):
        if t is None or pd.isna(s) or n <= 0:
            out.append((None, None))
            continue
        places = normal_map(t)[1]
        s, e = int(s), int(s + n) - 1
        out.append((places[s], places[e] + 1) if 0 <= s <= e < len(places) else (None, None))
    return pd.DataFrame(out, columns=["start", "end"]).astype("Int64")

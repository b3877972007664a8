"""Column expressions over text: pages, visible text of HTML, sentences, snippets, numbers and polarity words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_CHARS = 2000

# Words that turn a statement round, and words that compare.
NEGATORS = "not no never nor neither without cannot"
COMPARATORS = "less more fewer greater least most below above under over before after minimum maximum"
POLARITY = "|".join((NEGATORS + " " + COMPARATORS).split())
# Further words whose exchange changes what a sentence says (number words, modals, determiners, links).
MEANING = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty "
    "fifty sixty seventy eighty ninety hundred thousand million billion first second third fourth fifth sixth seventh eighth ninth tenth half twice "
    "hardly barely scarcely rarely seldom could would should might shall there their these those where which while whether although through though "
    "unless until every other either since"
).split()
NUMBER = r"[0-9][0-9,.]*[0-9]|[0-9]"


def paginate(docs: DataFrame, size: int = PAGE_CHARS) -> DataFrame:
    """(..., page_no, char_start, char_end, text) of docs with text: slices of `size` code points, pages from 1."""
    n = F.greatest(F.length("text"), F.lit(1))
    page = F.explode(F.sequence(F.lit(1), F.ceil(n / size).cast("int"))).alias("page_no")
    out = docs.where("text IS NOT NULL").select("*", page).withColumn("char_start", ((F.col("page_no") - 1) * size).cast("long"))
    out = out.withColumn("char_end", F.least(F.col("char_start") + size, F.length("text").cast("long")))
    return out.withColumn("text", F.substring("text", (F.col("char_start") + 1).cast("int"), F.lit(size)))


def visible(html: Column) -> Column:
    """Text a reader sees: without scripts, styles, comments and tags, common entities decoded, blanks collapsed."""
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    for old, new in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        html = F.replace(html, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(html, r"[ \t\r\n]+", " "))


def sentences(text: Column) -> Column:
    """Sentences as written: up to a full stop, question or exclamation mark before a blank, or a line's end."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])[ \t]+|\n+"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def snippet(text: Column, at: Column, length: Column, around: int = 40) -> Column:
    """The passage as written, `around` characters to each side of a hit that begins at `at` (from 1)."""
    first = F.greatest(at - around, F.lit(1))
    return F.substring(text, first.cast("int"), (at + length + around - first).cast("int"))


def numbers(text: Column) -> Column:
    """Number tokens in order."""
    return F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))


def polarity(text: Column) -> Column:
    """Negators and comparators in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"\b({POLARITY})\b"), F.lit(1))


def terms(text: Column) -> Column:
    """Words of a search, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0)

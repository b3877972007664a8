"""Document fingerprints by SpotSigs, with DataFrame functions only.

A spot is a common word; its signature is the chain of the next three content words, common words between them
skipped. A document is its set of signatures. Sets are compared by Jaccard similarity, pruned by their lengths: the
smaller length over the larger is an upper bound, and sets whose length partitions are too far apart are not
compared. `matches` joins all documents in this way through an inverted index of each length partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

# Common words of English, French, German and Spanish, in that order.
ANCHORS = (
    "the of and a to in is it that was for on are as with his they at be this have from or had by not but what all were we when your can there an "
    "le la les un une des du de et en que qui dans pour par sur au aux avec est ce il elle ne pas "
    "der die das den dem ein eine und zu von mit sich auf für ist im nicht auch als bei nach "
    "el los las y del se lo con su para como más pero sus al una por no si"
).split()
CHAIN = 3
#: Where this is not 0, a text with fewer than one spot in so many words lets every word begin a chain.
SPARSE = 0
#: Likeness below this is reported as 0 where the lengths alone show it.
FLOOR = 0.05
SIMILAR = 0.75
#: A signature with at least one in COMMON of all entries counts as common; there are at most COMMON such.
COMMON = 1_000_000
#: Members of a bucket that meet in one task; larger buckets are compared block by block.
BLOCK = 2048
#: Large buckets are broadcast up to this many (24 bytes each); beyond, they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Words of 64 bits in the bit map of a set.
MAPS = 4
_MARK = "\x01"


def _prefix_tree(words: list[str]) -> str:
    """One regular expression for the words that shares their beginnings, so that few branches are tried."""
    heads = sorted({w[0] for w in words if w})
    parts = [h + _prefix_tree([w[1:] for w in words if w[:1] == h]) for h in heads]
    body = "|".join(parts)
    return f"(?:{body}){'?' if '' in words else ''}" if len(parts) > 1 or ("" in words and parts) else body


_ANY = _prefix_tree(sorted(set(ANCHORS)))


def plain(text: Column) -> Column:
    """Lower case, runs of white space and ASCII punctuation as one blank; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}\x01]++", " "))


def with_signatures(df: DataFrame, text: str, name: str, sparse: int = SPARSE) -> DataFrame:
    """df with a column of the set of signatures of a text column, as 64-bit hashes.

    Equal texts have equal sets; a text without a chain has one signature. Each step is a column of its own, so that
    none is evaluated twice.
    """
    df = df.withColumn("pm_low", plain(F.col(text)))
    df = df.withColumn("pm_marked", F.regexp_replace("pm_low", rf"(?<![^ ])(?:{_ANY})(?: (?=[^ ])|$)", _MARK))
    df = df.withColumn("pm_spots", F.regexp_extract_all("pm_marked", F.lit(rf"\x01(?=([^ \x01]++(?: \x01*+[^ \x01]++){{{CHAIN - 1}}}))"), F.lit(1)))
    df = df.withColumn("pm_some", F.col("pm_spots"))
    if sparse:
        chains = F.regexp_extract_all("pm_low", F.lit(rf"(?<![^ ])(?=([^ ]++(?: [^ ]++){{{CHAIN - 1}}}))"), F.lit(1))
        words = F.length("pm_low") - F.length(F.replace("pm_low", F.lit(" "), F.lit(""))) + 1
        df = df.withColumn("pm_some", F.when(F.size("pm_spots") * sparse < words, F.concat("pm_spots", chains)).otherwise(F.col("pm_spots")))
    df = df.withColumn("pm_some", F.when(F.size("pm_some") == 0, F.array("pm_low")).otherwise(F.col("pm_some")))
    made = F.array_distinct(F.transform("pm_some", lambda x: F.xxhash64(F.replace(x, F.lit(_MARK), F.lit("")))))
    return df.withColumn(name, made).drop("pm_low", "pm_marked", "pm_spots", "pm_some")


def fingerprint(sigs: Column) -> Column:
    """The set's length and a 128-bit digest of it."""
    s = F.sort_array(sigs)
    return F.concat(F.size(sigs).cast("string"), F.lit(":"), F.lower(F.hex(F.xxhash64(s))), F.lit("-"), F.lower(F.hex(F.xxhash64(s, F.lit(1)))))


def partition_of(length: Column, floor: float) -> Column:
    """Length partition: sets of similarity `floor` or more are in the same or in neighbouring partitions."""
    return F.floor(F.log(length.cast("double")) / F.lit(-math.log(floor)) + F.lit(1e-9))


def likeness(a: Column, b: Column, floor: float = FLOOR) -> Column:
    """Jaccard similarity of two sets, 0 where their lengths rule `floor` out; null where one is missing."""
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    far = (F.abs(partition_of(n, floor) - partition_of(m, floor)) > 1) | (F.least(n, m) < F.greatest(n, m) * F.lit(floor))
    return F.when(a.isNull() | b.isNull(), None).when(far, F.lit(0.0)).otherwise(both / (n + m - both).cast("double"))


def _bit_map(sigs: Column) -> Column:
    """The set as MAPS words of 64 bits, one bit for each signature."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 8).bitwiseAND(63).cast("int"))
    word = lambda k: F.aggregate(F.filter(sigs, lambda h: h.bitwiseAND(MAPS - 1) == k), F.lit(0).cast("long"), lambda acc, h: acc.bitwiseOR(bit(h)))
    return F.array(*[word(k) for k in range(MAPS)])


def _entries(spark: SparkSession, sets: DataFrame, similar: float) -> DataFrame:
    """(cell, sig, home, node, n, bits) of (node, sigs): each set under its rarest signatures, in its own length
    partition (home) and the one below.

    Two sets at `similar` share at least ceil(similar * n) signatures of either, so they share one of the first
    n - ceil(similar * n) + 1 in any order of all signatures; the order here is common ones last.
    """
    each = sets.select("node", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    counts = stored(spark, each.groupBy("sig").agg(F.count("*").alias("c")), "counts")
    total = counts.agg(F.sum("c")).first()[0] or 0
    common = counts.where(F.col("c") * COMMON >= total)
    ranked = each.join(F.broadcast(common), "sig", "left").withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("c", F.lit(0)), "sig")))
    first = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * similar - F.lit(1e-9)) + 1).select("node", "n", "sig")
    first = first.join(sets.select("node", _bit_map(F.col("sigs")).alias("bits")), "node").withColumn("part", partition_of(F.col("n"), similar))
    cells = F.array(F.struct(F.col("part").alias("cell"), F.lit(True).alias("home")), F.struct((F.col("part") - 1).alias("cell"), F.lit(False).alias("home")))
    return first.select("sig", "node", "n", "bits", F.inline(cells))


def _met(spark: SparkSession, entries: DataFrame, similar: float) -> DataFrame:
    """Distinct pairs (a, b) of sets that share an entry and whose lengths and bit maps allow `similar`."""
    key = ["sig", "cell"]
    large = stored(spark, entries.groupBy(key).agg(F.count("*").alias("g")).where(F.col("g") > BLOCK), "large")
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    dealt = entries.join(large, key, "left").withColumn("blocks", F.ceil(F.coalesce("g", F.lit(1)) / BLOCK).cast("int"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = lambda df, p, mine, other: df.select(*key, F.col("mine").alias(mine), F.col("other").alias(other), *[F.col(c).alias(p + c) for c in ("node", "n", "bits", "home")])
    both = side(dealt.where("home"), "x_", "r", "s").join(side(dealt, "y_", "s", "r"), [*key, "r", "s"]).where("x_node <> y_node AND (NOT y_home OR x_node < y_node)")
    near = F.least("x_n", "y_n") >= F.greatest("x_n", "y_n") * F.lit(similar) - F.lit(1e-9)
    differ = sum((F.bit_count(F.col("x_bits")[k].bitwiseXOR(F.col("y_bits")[k])) for k in range(1, MAPS)), F.bit_count(F.col("x_bits")[0].bitwiseXOR(F.col("y_bits")[0])))
    close = differ <= (F.col("x_n") + F.col("y_n")) * F.lit((1 - similar) / (1 + similar)) + F.lit(1e-9)
    return both.where(near & close).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def matches(spark: SparkSession, docs: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every row of docs (doc_id, text), and all links (a, b, likeness) of nodes at `similar` or more.

    Rows with equal sets of signatures are one node, so copies are never paired. Null text is empty, and empty texts
    are one node; rows that repeat a doc_id or lack one are rows like others. An empty table gives none of either.
    The work on documents that share rare signatures and are unlike still grows with the square of such a group,
    block by block and with no row for a pair that lengths or bit maps rule out.
    """
    signed = with_signatures(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sigs").select("doc_id", "sigs")
    signed = stored(spark, signed.withColumn("node", F.xxhash64(F.sort_array("sigs"))), "signed")
    sets = stored(spark, signed.groupBy("node").agg(F.first("sigs").alias("sigs")), "sets")
    pairs = stored(spark, _met(spark, stored(spark, _entries(spark, sets, similar), "entries"), similar), "pairs")
    x, y = (sets.select(F.col("node").alias(n), F.col("sigs").alias(s)) for n, s in (("a", "x"), ("b", "y")))
    # stored, so that the likeness is neither pushed below the joins nor made twice
    links = stored(spark, pairs.join(x, "a").join(y, "b").select("a", "b", likeness(F.col("x"), F.col("y"), similar).alias("likeness")), "links")
    return signed.select("doc_id", "node"), links.where(F.col("likeness") >= similar)


def following(spark: SparkSession, ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) of (doc_id): the next in descending order, and after the last the first.

    Ids are ranged over partitions; the neighbour within a partition comes from a window there, across partitions
    from the table of their ends, which has one row per partition.
    """
    parts = stored(spark, ids.where("doc_id IS NOT NULL").distinct().repartitionByRange("doc_id").select("doc_id", F.spark_partition_id().alias("part")), "ids")
    ends = parts.groupBy("part").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    every = Window.partitionBy(F.lit(1))
    below = F.lag("high").over(Window.partitionBy(F.lit(1)).orderBy("part"))
    ends = ends.select("part", F.coalesce(below, F.max("high").over(every)).alias("below"))
    inside = F.lag("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    near = parts.withColumn("inside", inside)
    return near.join(F.broadcast(ends), "part").select("doc_id", F.coalesce("inside", "below").alias("next_id"))


def edited_fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): its fingerprint, that of its edited text, and two likenesses.

    The edited text ends with the beginning of the next document in place of its last third. Null text is empty. Of
    rows that repeat a doc_id the least text is the next document; a row without doc_id is followed by nothing, so its
    edited text only loses its end. Alone in the table, a document follows itself. An empty table gives none.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = F.floor(F.length("text") / 3).cast("int")
    lengths = base.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(cut).alias("cut"))
    links = following(spark, lengths.select("doc_id")).join(lengths, "doc_id")
    links = stored(spark, links.select(F.col("doc_id").alias("for_id"), F.col("next_id").alias("doc_id"), "cut"), "following")
    known = base.where("doc_id IS NOT NULL")
    ahead = with_signatures(known.join(links, "doc_id"), "text", "next_sigs").select("for_id", F.substring("text", F.lit(1), F.col("cut")).alias("head"), "next_sigs")
    ahead = ahead.groupBy("for_id").agg(F.min_by(F.struct("head", "next_sigs"), F.col("head")).alias("ahead"))
    got = known.join(ahead, known["doc_id"] == ahead["for_id"], "left").select("doc_id", "text", "ahead")
    got = got.unionByName(base.where("doc_id IS NULL").withColumn("ahead", F.lit(None).cast(got.schema["ahead"].dataType)))
    tail = F.coalesce(F.substring(F.col("ahead.head"), F.lit(1), cut), F.lit(""))
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), tail)
    got = got.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), F.col("ahead.next_sigs").alias("next_sigs"))
    got = with_signatures(with_signatures(got, "text", "sigs"), "edited", "edited_sigs")
    return got.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: fingerprints of every document and of its edited text."""
    return edited_fingerprints(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))

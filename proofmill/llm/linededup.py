"""Fuzzy line dedup by MinHash, with DataFrame functions only.

Lines of MIN_CHARS or more are compared on their shingles of K characters (a shorter line is one shingle); 0.75 or
more is a duplicate. Equal lines are one node, known by a 64-bit hash. MinHash signatures of 16 values, each
the least over all shingles, are cut into 8 bands of 2: a pair at 0.75 shares a band with probability 0.9987. Each
member of a band's bucket is first paired with the bucket's least and greatest node (a partial aggregate, so no task
holds a bucket); what the sketches allow is verified by exact Jaccard similarity and joined by distributed
union-find. Buckets of more than FEW are also split by each further band, which gives them more such ends. Members of a
bucket, however large, that are then in different components are all compared: in buckets of more than FEW those outside
the largest component against all, in cells that are dealt out to tasks. Of a component the line that stands first (by
doc_id, then line number) is kept.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, stored

K, SIMILAR, BANDS, ROWS = 10, 0.75, 8, 2
MIN_CHARS = 16
#: A sketch is the lowest 4 bits of each signature value; pairs that differ in more than FAR of the 16 are not
#: verified. A pair at 0.75 differs in more with probability 0.0003.
FAR = 10
#: Words of 64 bits in the bit map of a line's shingles.
MAPS = 16
#: Words of 64 bits in the bit map that cells of large buckets compare before the sets.
FINE = 64
#: Members of a bucket that one task compares; the pairs of a larger bucket are dealt out in cells of about CELL by CELL.
#: A member is sent to one cell in each CELL others, so smaller cells would write more.
FEW, CELL = 256, 1024
_STEP = 4096
#: Places of candidate lines (40 bytes each) and members of large buckets (100 bytes) are broadcast up to this many rows;
#: beyond, they are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _units(line: Column) -> Column:
    return F.encode(line, "UTF-16BE")


def _shingle(units: Column, i: Column) -> Column:
    return F.xxhash64(F.substring(units, i * 2 + 1, 2 * K))


def _count(units: Column) -> Column:
    return F.greatest(F.lit(1), F.length(units).cast("int") / 2 - (K - 1)).cast("int")


def _shingles(lines: DataFrame) -> DataFrame:
    """(node, n, h): one row for each shingle of (line), n being how many there are."""
    x = lines.select(F.xxhash64("line").alias("node"), _units(F.col("line")).alias("units"))
    x = x.withColumn("n", _count(F.col("units")))
    x = x.withColumn("from", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(_STEP))))
    x = x.withColumn("i", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + (_STEP - 1), F.col("n") - 1))))
    return x.select("node", "n", _shingle(F.col("units"), F.col("i")).alias("h"))


def _signatures(lines: DataFrame) -> DataFrame:
    """(node, v0, v1, ...) of (line)."""
    x = _shingles(lines).select("node", *[F.xxhash64("h", F.lit(k)).alias(f"h{k}") for k in range(-(-BANDS * ROWS // 3))])
    # three values of each hash: orders by its 1st, 22nd and 43rd bit and those that follow
    value = lambda k: F.shiftleft(F.col(f"h{k // 3}"), 21 * (k % 3))
    return x.groupBy("node").agg(*[F.min(value(k)).alias(f"v{k}") for k in range(BANDS * ROWS)])


def _outlines(texts: DataFrame) -> DataFrame:
    """(node, n, o0, o1, ...) of distinct (line): the shingles' count with repeats, and a bit map of their hashes."""
    return _mapped(_shingles(texts).select("node", "n", "h"), "o", MAPS, F.first("n").alias("n"))


def _mapped(shingles: DataFrame, name: str, words: int, *more: Column) -> DataFrame:
    """(node, more, name0, name1, ...) of (node, h): a bit map of the hashes."""
    x = shingles.withColumn("bit", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int"))).withColumn("at", F.shiftright("h", 6).bitwiseAND(words - 1))
    return x.groupBy("node").agg(*more, *[F.bit_or(F.when(F.col("at") == k, F.col("bit")).otherwise(0)).alias(f"{name}{k}") for k in range(words)])


def _signed(signatures: DataFrame) -> DataFrame:
    """(node, sketch, bands): the key of each band."""
    sketch = F.lit(0).cast("long")
    for k in range(BANDS * ROWS):
        low = F.shiftrightunsigned(F.col(f"v{k}"), 21 * (k % 3)).bitwiseAND(15)
        sketch = sketch.bitwiseOR(F.shiftleft(low, 4 * k))
    bands = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"v{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)])
    return signatures.select("node", sketch.alias("sketch"), bands.alias("bands"))


def _members(entered: DataFrame) -> DataFrame:
    """(key, node, lo, hi, g) of (key, node): buckets of two or more nodes, with their least, greatest and number. Rows are
    dealt by key once, for the ends and for the join."""
    entered = entered.repartition("key")
    ends = entered.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("g")).where("lo <> hi")
    return entered.join(ends, "key")


def _hinted(rows: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _crowded(spark: SparkSession, members: DataFrame, signed: DataFrame) -> DataFrame:
    """(node, bands) of the members of buckets of more than FEW."""
    nodes = stored(spark, members.where(F.col("g") > FEW).select("node").distinct(), "crowded")
    return stored(spark, signed.select("node", "bands").join(_hinted(nodes), "node", "left_semi"), "crowded")


def _buckets(spark: SparkSession, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of the buckets of each band, which hold all pairs, and where a bucket has more than FEW, those of each
    two bands, which give first pairs alone."""
    return _split(spark, signed)[:2]


def _split(spark: SparkSession, signed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """_buckets, and (node, bands) of the members of large ones."""
    one = stored(spark, _members(signed.select(F.explode("bands").alias("key"), "node")), "buckets")
    crowded = _crowded(spark, one, signed)
    many = one.where(F.col("g") > FEW).select("key", "node").join(crowded, "node")
    many = many.select("key", "node", F.explode("bands").alias("band")).where("key <> band")
    two = many.select(F.xxhash64(F.least("key", "band"), F.greatest("key", "band")).alias("key"), "node").distinct()
    return one, stored(spark, _members(two), "buckets"), crowded


def _near(a: str, b: str) -> Column:
    """Whether two sketches differ in at most FAR of their values."""
    x = F.col(a).bitwiseXOR(F.col(b))
    for by in (1, 2):
        x = x.bitwiseOR(F.shiftrightunsigned(x, by))
    return F.bit_count(x.bitwiseAND(0x1111111111111111)) <= FAR


def _close(a: str, b: str) -> Column:
    """Whether the bit maps allow a link: each bit that one alone has is a shingle that one alone has, and sets A and B
    at 0.75 differ in at most (|A| + |B|) / 7. The prefixes tell the sides."""
    return _apart(f"{a}o", f"{b}o", MAPS) * 7 <= F.col(f"{a}n") + F.col(f"{b}n")


def _apart(a: str, b: str, words: int) -> Column:
    """Bits that one of two maps alone has."""
    return functools.reduce(Column.__add__, [F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(words)])


def _side(outlines: DataFrame, prefix: str) -> DataFrame:
    return outlines.select(*[F.col(c).alias(prefix + c) for c in outlines.columns])


def _allowed(pairs: DataFrame, outlines: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose sketches and bit maps allow a link."""
    both = pairs.join(_side(outlines, "x_"), F.col("a") == F.col("x_node")).join(_side(outlines, "y_"), F.col("b") == F.col("y_node"))
    return both.where(_near("x_sketch", "y_sketch")).where(_close("x_", "y_")).select("a", "b")


def _first_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of each member and its bucket's least and greatest node."""
    pairs = members.select("node", F.explode(F.array("lo", "hi")).alias("end")).where("node <> end")
    return pairs.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct()


def _rest_pairs(spark: SparkSession, members: DataFrame, outlines: DataFrame, comp: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a, b) of members of buckets that are in different components and whose sketches and bit maps
    allow a link. A member gives FEW - 1 rows at most for each bucket of at most FEW. With texts (node, bands, line),
    larger buckets compare the sets' halves in their cells and give next to similar pairs alone, each in the first band it
    shares."""
    member = members.where("g > 2").join(comp, "node", "left").select("key", "node", "g", F.coalesce("component", "node").alias("c"))
    large = _large_pairs(spark, member.where(F.col("g") > FEW), outlines, texts)
    member = member.where(F.col("g") <= FEW).drop("g")
    mixed = member.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    rows = stored(spark, member.join(mixed.select("key"), "key"), "members").join(outlines, "node")
    x, y = (rows.select("key", *[F.col(k).alias(p + k) for k in ("c", *outlines.columns)]) for p in ("x_", "y_"))
    both = x.join(y, "key").where("x_c <> y_c AND x_node < y_node").where(_near("x_sketch", "y_sketch")).where(_close("x_", "y_"))
    pairs = both.select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))
    return pairs.unionByName(large).distinct()


def _large_pairs(spark: SparkSession, member: DataFrame, outlines: DataFrame, texts: DataFrame | None) -> DataFrame:
    """Distinct pairs (a, b) of members (key, node, g, c) of large buckets that are in different components c and whose
    sketches and bit maps allow a link: each member outside the largest component of its bucket meets each other one in
    one cell. With texts a pair's sets must be as near as halves of their hashes tell, so near misses make no row."""
    sizes = member.groupBy("key", "c").agg(F.count("*").alias("n"), F.first("g").alias("g"))
    by = sizes.groupBy("key").agg(F.max(F.struct("n", "c")).alias("most"), F.first("g").alias("g")).where("most.n < g")
    by = by.select("key", F.col("most.c").alias("main"), F.ceil(F.col("g") / CELL).alias("n_all"), F.ceil((F.col("g") - F.col("most.n")) / CELL).alias("n_out"))
    mixed = stored(spark, member.drop("g").join(by, "key"), "large")
    if texts is not None:
        nodes = stored(spark, mixed.select("node").distinct(), "nodes")
        sets = texts.join(_hinted(nodes), "node", "left_semi").select("node", "bands", _halves(F.col("line")).alias("set"))
        sets = stored(spark, sets.select("node", "bands", "set.*"), "sets")
        fine = _mapped(sets.select("node", F.explode("half").alias("h")), "f", FINE)
        outlines = outlines.join(sets, "node").join(stored(spark, fine, "fine"), "node")
    rows = stored(spark, mixed.join(outlines, "node"), "large")
    block = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    side = lambda p: [F.col(k).alias(p + k) for k in ("c", *outlines.columns)]
    x = rows.where("c <> main").select("key", block(1, "n_out").alias("i"), each("n_all").alias("j"), *side("x_"))
    y = rows.select("key", each("n_out").alias("i"), block(2, "n_all").alias("j"), *side("y_"), (F.col("c") == F.col("main")).alias("inner"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number: cells are small, but much work
    x, y = (t.repartition(parts, "key", "i", "j") for t in (x, y))
    both = x.join(y, ["key", "i", "j"]).where("x_c <> y_c AND (inner OR x_node < y_node)").where(_near("x_sketch", "y_sketch")).where(_close("x_", "y_"))
    if texts is not None:
        shared = F.element_at(F.array_intersect("x_bands", "y_bands"), 1)
        most = F.col("x_size") + F.col("y_size")
        both = both.where(_apart("x_f", "y_f", FINE) * 7 <= most).where(shared == F.col("key")).where(_halves_near(F.col("x_half"), F.col("y_half"), most))
    return both.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def _hashes(line: Column) -> Column:
    """The hash of each shingle, repeats included. The encoded line is bound to a name, or each shingle would encode it again."""
    each = lambda u: F.transform(F.sequence(F.lit(1), _count(u) * 2 - 1, F.lit(2)), lambda at: F.xxhash64(F.substring(u, at, 2 * K)))
    return F.element_at(F.transform(F.array(_units(line)), each), 1)


def _set(line: Column) -> Column:
    """Distinct shingles."""
    return F.array_distinct(_hashes(line))


def _halves(line: Column) -> Column:
    """(size, half): the number of distinct shingles, and the distinct upper halves of their hashes. Sets differ in as many
    shingles as their halves at least, so no link is lost by them; what they let by is verified like any pair."""
    half = lambda s: F.array_distinct(F.transform(s, lambda h: F.shiftright(h, 32).cast("int")))
    return F.element_at(F.transform(F.array(_set(line)), lambda s: F.struct(F.size(s).alias("size"), half(s).alias("half"))), 1)


def _halves_near(x: Column, y: Column, most: Column) -> Column:
    """Whether the halves allow a link. The transform keeps a join that has this condition out of whole-stage code, whose one
    method would be more than the JIT compiles."""
    apart = lambda c: F.size(x) + F.size(y) - c * 2
    return F.element_at(F.transform(F.array(F.size(F.array_intersect(x, y))), lambda c: apart(c) * 7 <= most), 1)


def _alike(x: Column, y: Column) -> Column:
    """Exact Jaccard similarity of two sets, each as an array that may repeat members, against the threshold. Repeats only
    make the arrays' sizes larger, so where those already allow a link the union is not made."""
    linked = lambda c: (c >= (F.size(x) + F.size(y) - c) * F.lit(SIMILAR)) | (c >= F.size(F.array_union(x, y)) * F.lit(SIMILAR))
    return F.element_at(F.transform(F.array(F.size(F.array_intersect(x, y))), linked), 1)


def _similar(a: Column, b: Column) -> Column:
    """Exact Jaccard similarity of two lines' shingles against the threshold. The hashes are bound to names by a
    one-element transform: a filter on columns made from them would be pushed below and make them again at each use."""
    return F.element_at(F.transform(F.array(F.struct(_hashes(a).alias("x"), _hashes(b).alias("y"))), lambda s: _alike(s["x"], s["y"])), 1)


def _texts(spark: SparkSession, lines: DataFrame, firsts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, line) of the nodes given, each read once at its first place."""
    wanted = stored(spark, firsts.join(nodes, "node", "left_semi").select("node", "place.doc_id", "place.line_no"), "wanted")
    found = lines.join(_hinted(wanted), ["doc_id", "line_no"]).where(F.xxhash64("line") == F.col("node")).select("node", "line")
    return stored(spark, found.dropDuplicates(["node"]), "texts")


def _linked(spark: SparkSession, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b) of nodes those whose lines are similar."""
    x, y = (texts.select(F.col("node").alias(n), F.col("line").alias(t)) for n, t in (("a", "x"), ("b", "y")))
    return stored(spark, pairs.join(x, "a").join(y, "b").where(_similar(F.col("x"), F.col("y"))).select("a", "b"), "links")


def duplicate_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, line_no) of every line that is not the first of its component.

    docs has doc_id and text. Blank lines and lines under MIN_CHARS are never reported; null and empty texts have
    none. Rows without doc_id are not compared. Lines of a repeated doc_id share their places, so a repeated row
    loses the same lines as the first. An empty table gives none.
    """
    lines = _lines(docs.where("doc_id IS NOT NULL").select("doc_id", "text")).where(F.length(F.trim("line")) >= MIN_CHARS)
    places = stored(spark, lines.select("doc_id", "line_no", F.xxhash64("line").alias("node")), "places")
    firsts = stored(spark, places.groupBy("node").agg(F.min(F.struct("doc_id", "line_no")).alias("place"), F.count("*").alias("copies")), "firsts")
    signed = stored(spark, _signed(_signatures(lines)), "signed")
    members, split, crowded = _split(spark, signed)
    texts = _texts(spark, lines, firsts, members.select("node").distinct())
    outlines = stored(spark, _outlines(texts).join(signed.select("node", "sketch"), "node"), "outlines")
    discard(spark, signed)
    pairs = stored(spark, _allowed(_first_pairs(members.unionByName(split)), outlines), "pairs")
    links = _linked(spark, texts, pairs)
    comp = stored(spark, components(spark, links), "components")
    whole = texts.join(_hinted(crowded), "node")
    rest = stored(spark, _rest_pairs(spark, members, outlines, comp, whole).join(pairs, ["a", "b"], "left_anti"), "rest")
    discard(spark, members, split, crowded, outlines, pairs)
    if not rest.isEmpty():
        comp = components(spark, links.unionByName(_linked(spark, texts, rest)))
    held = firsts.join(comp, "node", "left").where("copies > 1 OR component IS NOT NULL")
    held = held.select("node", "place", "copies", F.coalesce("component", "node").alias("c"))
    kept = held.groupBy("c").agg(F.min("place").alias("kept"), F.sum("copies").alias("n")).where("n > 1")
    kept = stored(spark, held.join(kept, "c").select("node", "kept"), "kept")
    discard(spark, firsts, texts, links, rest)
    return places.join(kept, "node").where("NOT (doc_id = kept.doc_id AND line_no = kept.line_no)").select("doc_id", "line_no").distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: lines and removed line numbers of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = duplicate_lines(spark, docs).groupBy("doc_id").agg(F.sort_array(F.collect_list("line_no")).alias("removed_lines"))
    out = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines")).join(gone, "doc_id", "left")
    removed = F.coalesce("removed_lines", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; one that keeps no line of its own goes. n_chars follows the text."""
    gone = stored(spark, duplicate_lines(spark, docs), "gone").groupBy(F.col("doc_id").alias("pm_id")).agg(F.collect_set("line_no").alias("pm_gone"))
    out = docs.join(gone, docs["doc_id"] == gone["pm_id"], "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("pm_gone", i))
    out = out.withColumn("pm_text", F.when(F.col("pm_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    out = out.where(F.col("pm_gone").isNull() | (F.length(F.trim(F.translate("pm_text", "\n", " "))) > 0)).withColumn("text", F.col("pm_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("pm_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)

"""Document fingerprints by I-Match, in DataFrame functions only.

A term is kept when its inverse document frequency lies in a band: its document frequency is
between `low` and `high` of the documents, and at least two. Terms of frequency `low` or more
number at most the mean count of distinct terms of a document over `low`, whatever the size of
the corpus, so the band's terms fit a bit table of fixed size (hashed; a term outside the band
whose slot is taken is kept alike in every text). A document's distinct kept terms are sorted
and hashed once for each of several randomised subsets of the lexicon. Subsets come in scales
that keep all, half, a quarter ... of the terms, so long and short texts have subsets with few
terms, whose hashes survive edits. The likeness of two fingerprints is the share of equal
hashes among the subsets that aren't empty in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterloom.llm.common import cut

SLOT_BITS = 23
#: (power of two of which one in so many terms is kept, subsets, first hash bit used)
SCALES = [(0, 1, 0), (1, 2, 24), (2, 4, 25), (3, 8, 27), (4, 8, 30), (5, 8, 34), (6, 8, 39), (7, 8, 45), (8, 8, 52), (10, 8, 12)]
GAPS = "[\\x20\\x09-\\x0D]+"


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    return F.transform(F.array_distinct(F.array_remove(F.split(F.lower(text), GAPS), "")), lambda t: F.xxhash64(t))


def lexicon(docs: DataFrame, low: float = 0.0002, high: float = 0.1) -> Column:
    """The band's bit table as an array literal, from document frequencies over all documents."""
    n = docs.count()
    per_term = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    band = per_term.where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= max(2.0, high * n)))
    slot = F.col("h").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    cells = band.select(F.shiftright(slot, 6).alias("cell"), F.expr(f"shiftleft(1L, cast((h & {(1 << SLOT_BITS) - 1}L) & 63 as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    table = [0] * (1 << (SLOT_BITS - 6))
    for cell, bits in cells.collect():  # at most one row for each cell of the fixed table
        table[cell] = bits
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")


def with_fingerprint(df: DataFrame, text: str, out: str, lex: Column) -> DataFrame:
    """df with `out`: for each subset the hash of its terms in sorted order, -1 if there are none."""

    def kept(t: Column) -> Column:
        slot = F.xxhash64(t).bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
        cell = F.element_at(lex, (F.shiftright(slot, 6) + 1).cast("int"))
        return F.call_function("shiftright", cell, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    columns = df.columns
    df = df.select(*columns, F.array_distinct(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), GAPS)).alias("_t"))
    df = df.select(*columns, F.transform(F.sort_array(F.filter("_t", lambda t: (t != "") & kept(t))), lambda t: F.xxhash64(t)).alias("_h"))

    def field(h: Column, s: int, first: int) -> Column:
        return F.shiftrightunsigned(h, first).bitwiseAND(F.lit((1 << s) - 1))

    def some(s: int, n: int, first: int) -> Column:
        return F.filter("_h", lambda h: field(h, s, first) < n) if n < 1 << s else F.col("_h")

    def subset(s: int, i: int, first: int) -> Column:
        return F.filter(f"_h{s}", lambda h: field(h, s, first) == i) if s else F.col("_h0")

    df = df.select(*columns, *(some(*scale).alias(f"_h{scale[0]}") for scale in SCALES))
    subsets = [subset(s, i, first) for s, n, first in SCALES for i in range(n)]
    df = df.select(*columns, F.array(*subsets).alias("_s"))
    return df.select(*columns, F.transform("_s", lambda a: F.when(F.size(a) > 0, F.xxhash64(a).bitwiseAND(F.lit(0xFFFFFF))).otherwise(F.lit(-1)).cast("int")).alias(out))


def as_text(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.when(x < 0, F.lit("------")).otherwise(F.lpad(F.lower(F.hex(x)), 6, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Equal hashes over subsets not empty in both; two fingerprints without terms have 1."""
    both = F.zip_with(a, b, lambda x, y: F.when((x < 0) & (y < 0), 0).when(x == y, 0x10001).otherwise(1))
    total = F.aggregate(both, F.lit(0), lambda s, x: s + x)
    return F.when(total == 0, 1.0).otherwise(F.shiftright(total, 16) / total.bitwiseAND(F.lit(0xFFFF)).cast("double"))


def split_points(docs: DataFrame, rows: int = 2000, most: int = 1 << 16) -> list[int]:
    """doc_ids that cut the table into ranges of about `rows` rows, at most `most` points."""
    n = docs.count()
    parts = min(most, n // rows)
    if parts < 2:
        return []
    got = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10_000, 20 * parts)).alias("p")).first()["p"]
    return sorted(set(got or []))


def block_of(points: list[int]) -> Column:
    """How many split points are at or below doc_id, by binary search in a literal; null ids count as lowest."""
    if not points:
        return F.lit(0)
    steps = len(points).bit_length()
    size = len(points)
    lit = F.split(F.lit(",".join(map(str, points))), ",").cast("array<bigint>")
    jumps = F.array(*[F.lit(1 << i) for i in reversed(range(steps))])
    found = F.aggregate(jumps, F.lit(0), lambda at, j: F.when(at + j > size, at).when(F.element_at(lit, F.least(at + j, F.lit(size))) <= F.col("doc_id"), at + j).otherwise(at))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(found)


def fingerprints_with_next(docs: DataFrame, low: float = 0.0002, high: float = 0.1) -> DataFrame:
    """Fingerprints of each text (null: empty), of its edited text, and likenesses.

    The edited text has its last floor(n_chars/3) code points replaced by the first as many (or
    all) of the next document's text, in the order of descending doc_id (null last, ties by a hash
    of the text), the first after the last. One row per row of docs: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lex = lexicon(docs, low, high)
    block = block_of(split_points(docs))
    keyed = docs.withColumn("tie", F.xxhash64("text")).withColumn("block", block)
    # The first row of each block also follows the last row of the block before it. There are at most 65,536 blocks.
    firsts = keyed.groupBy("block").agg(F.max(F.struct("doc_id", "tie")).alias("first"))
    around = Window.partitionBy(F.lit(0)).orderBy(F.col("block").asc())
    before = F.coalesce(F.lead("block").over(around), F.min("block").over(Window.partitionBy(F.lit(0))))
    firsts = cut(firsts.select(F.col("first.doc_id").alias("fid"), F.col("first.tie").alias("ftie"), before.alias("to")))
    marked = keyed.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("fid")) & (F.col("tie") == F.col("ftie")), "left").drop("fid", "ftie")
    marked = with_fingerprint(marked, "text", "own", lex)
    places = F.when(F.col("to").isNull(), F.array(F.struct(F.col("block").alias("at"), F.lit(0).alias("extra")))).otherwise(F.array(F.struct(F.col("block").alias("at"), F.lit(0).alias("extra")), F.struct(F.col("to").alias("at"), F.lit(1).alias("extra"))))
    rows = marked.withColumn("place", F.explode(places)).select("doc_id", "tie", "text", "own", "place.at", "place.extra")
    order = Window.partitionBy("at").orderBy(F.col("extra").asc(), F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_own", F.lead("own").over(order)).where("extra = 0")
    n, cut_at = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    rows = rows.select("doc_id", "own", "next_own", n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - cut_at), F.substring(F.col("next_text"), F.lit(1), cut_at)).alias("edited"))
    rows = with_fingerprint(rows, "edited", "changed", lex)
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("own").alias("fingerprint"), as_text("changed").alias("edited_fingerprint"), likeness("own", "changed").alias("near_edited"), likeness("own", "next_own").alias("near_next"))

"""Exact deduplication with a Bloom filter over two passes.

The first pass sets bits for every text, and remembers those that were set more than once. In the second, a text all
of whose bits were set more than once may be repeated; only such rows are shuffled to be compared. All others pass
straight through, as nothing else has their text.

The filter is cut into words of 64 bits, and each text has all its bits in one word, so that one look-up tests it. It
has at least ``BITS_PER_ROW`` bits per row, so its size follows the data. It is packed into slices, and slices of 16 MB
together are broadcast one lot after the other to the ids and digests, which stay where they are at any size.

Defined results: null text counts as empty. Of equal texts the row with the largest id stays; a null id is the
smallest, and rows that share the largest id are the same document listed twice, so all of them are marked as kept. ``drop_copies`` keeps one row of a text held without ids only.
An empty table gives an empty result. Other columns, whatever their names, are carried along or left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burnish.llm.common import attach, col, fresh, is_small, query, row_hash, settle, table

BITS_PER_ROW = 16
#: Bits per text; more would fill the filter, fewer would let more single rows through.
BITS_PER_TEXT = 3
#: Words of a slice of the filter, and slices that are sent to the rows together: 16 MB.
SLICE_WORDS, SLICES_AT_ONCE = 1 << 14, 128


def text_digest(text: str) -> Column:
    """SHA-256 of the text, 32 bytes; of nothing for null."""
    return F.unhex(F.sha2(F.coalesce(col(text).cast("string"), F.lit("")), 256))


def _word(words: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(words))


def _mask() -> Column:
    """The bits of a digest within its word."""
    bits = F.xxhash64("digest", F.lit(1))
    mask = F.lit(0).cast("long")
    for i in range(BITS_PER_TEXT):
        place = F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def _bits(mask: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", mask, i) == 1)


def repeated_bits(digests: DataFrame, words: int) -> DataFrame:
    """First pass: per word of the filter, the bits that were set more than once (columns word, repeated)."""
    per_mask = digests.select(_word(words).alias("word"), _mask().alias("mask")).groupBy("word", "mask").agg(F.count(F.lit(1)).alias("n"))
    per_bit = per_mask.select("word", "n", F.explode(_bits(F.col("mask"))).alias("bit")).groupBy("word", "bit").agg(F.sum("n").alias("n"))
    one = F.expr("shiftleft(1L, bit)")
    return per_bit.where("n > 1").groupBy("word").agg(F.bit_or(one).alias("repeated"))


def packed(bloom: DataFrame, words: int) -> DataFrame:
    """The filter as one row per slice of SLICE_WORDS words, 0 where no bit was set twice: (slice, packed)."""
    blank = bloom.sparkSession.range(words).select("id", F.lit(0).cast("long"))
    whole = bloom.select("word", "repeated").union(blank).groupBy("word").agg(F.bit_or("repeated").alias("repeated"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "repeated")))
    return whole.groupBy(F.expr(f"word div {min(words, SLICE_WORDS)}").alias("slice")).agg(ordered.alias("p")).select("slice", F.col("p.repeated").alias("packed"))


def maybe_repeated(rows: DataFrame, bloom: DataFrame, words: int) -> DataFrame:
    """Second pass: ``rows`` with ``maybe``, false only where no other row has the digest.

    The filter goes to the rows, SLICES_AT_ONCE slices at a time, and each time the rows of these slices are tested; no
    row moves, however large the filter is.
    """
    size = min(words, SLICE_WORDS)
    slices = settle(packed(bloom, words))
    placed = rows.withColumns({"word": _word(words), "mask": _mask()}).withColumn("of_slice", F.expr(f"word div {size}"))
    tested = []
    for first in range(0, words // size, SLICES_AT_ONCE):
        last = first + SLICES_AT_ONCE - 1
        some = F.broadcast(slices.where(F.col("slice").between(first, last)))
        part = placed.where(F.col("of_slice").between(first, last)).join(some, F.col("of_slice") == F.col("slice"))
        held = F.get("packed", (F.col("word") % size).cast("int"))
        tested.append(part.select(*rows.columns, (held.bitwiseAND(F.col("mask")) == F.col("mask")).alias("maybe")))
    return reduce(DataFrame.unionByName, tested)


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, digest (32 bytes), keep_id, group_size, kept."""
    rows = settle(docs.select(col(id_col).alias("doc_id"), text_digest(text_col).alias("digest")))
    total = rows.count()
    words = max(16, 1 << ((total * BITS_PER_ROW) // 64).bit_length())
    tested = settle(maybe_repeated(rows, settle(repeated_bits(rows, words)), words))
    single = tested.where(~F.col("maybe")).select(
        "doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    again = tested.where("maybe").drop("maybe")
    groups = settle(again.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    both = single.unionByName(attach(again, groups, "digest", "group_size", total))
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each text, all columns as they were; of a text that has no ids one row."""
    lost, digest = fresh(docs, "lost_id"), fresh(docs, "lost_digest")
    copies = settle(mark_copies(docs, id_col, text_col).where("group_size > 1").where("NOT kept OR doc_id IS NULL"))
    marks = copies.where("NOT kept").select(F.col("doc_id").alias(lost), F.col("digest").alias(digest))
    side = F.broadcast(marks) if is_small(marks) else marks
    out = docs.join(side, col(id_col).eqNullSafe(F.col(lost)) & (text_digest(text_col) == F.col(digest)), "left_anti")
    nameless = settle(copies.where("kept").select(F.col("digest").alias(digest)).distinct())
    if nameless.isEmpty():
        return out
    side, key, place = F.broadcast(nameless) if is_small(nameless) else nameless, fresh(out, "own_digest"), fresh(out, "place")
    rest = out.join(side, text_digest(text_col) == F.col(digest), "left_anti")
    tied = out.withColumn(key, text_digest(text_col)).join(side, F.col(key) == F.col(digest), "left_semi")
    one = tied.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(row_hash(docs)))).where(F.col(place) == 1)
    return rest.unionByName(one.select(*[col(c) for c in docs.columns]))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(text) AS text_sha256
FROM t JOIN g USING (text)
"""


@query("op5_exact_dedup", ORACLE)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = mark_copies(table(spark, sf_dir, "documents"))
    return marks.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))

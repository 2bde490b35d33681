"""A packed filter of keys that lets rows pass, or stop, where they are.

A filter has a bit array cut into slices of ``SLICE_WORDS`` words of 64 bits; each key sets a few bits of one word. It is
broadcast as one row per slice, never more than ``MAX_SLICES`` of them (16 MB), however many keys there are. A row whose
key is not in the filter is certain to have none of the keys. Other rows have one, or a few of them seem to: only these
have to be compared with the keys themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.operators.scratch import settle

SLICE_WORDS, MAX_SLICES = 1 << 14, 128
# Bits of the filter per key, as far as there is room, and bits that each key sets.
BITS_PER_KEY, BITS_SET = 16, 4

_SLICE, _WORDS = "__slice", "__words"


def hash_of(cells: Sequence[Column]) -> Column:
    """The hash by which keys are found in a filter. Both sides must have the same types."""
    return F.xxhash64(*cells, F.lit(29))


def packed_filter(hashes: DataFrame) -> DataFrame:
    """The filter of the hashes in the only column of ``hashes``: rows (__slice, __words), one for each slice."""
    hashes = hashes.toDF("__h")
    wanted = hashes.count() * BITS_PER_KEY // 64
    slices = min(MAX_SLICES, 1 << max(0, (wanted // SLICE_WORDS).bit_length()))
    size = min(SLICE_WORDS, 1 << wanted.bit_length()) if slices == 1 else SLICE_WORDS
    set_bits = hashes.select(_word("__h", slices * size).alias("word"), _mask("__h").alias("mask"))
    blank = hashes.sparkSession.range(slices * size).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    words = set_bits.unionByName(blank).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "mask")))
    return settle(words.groupBy(F.expr(f"word div {size}").alias(_SLICE)).agg(ordered.alias("w")).select(_SLICE, F.col("w.mask").alias(_WORDS)))


def marked(df: DataFrame, cells: Sequence[Column], filter_: DataFrame, mark: str) -> DataFrame:
    """``df`` with ``mark``: false where the filter is certain not to hold the key. No row moves."""
    slices = filter_.count()
    size = filter_.select(F.size(_WORDS)).first()[0]
    keyed = df.withColumn("__h", hash_of(cells)).withColumn("__word", _word("__h", slices * size))
    met = keyed.withColumn("__of", F.expr(f"__word div {size}")).join(F.broadcast(filter_), F.col("__of") == F.col(_SLICE))
    mask = _mask("__h")
    held = F.get(F.col(_WORDS), (F.col("__word") % size).cast("int")).bitwiseAND(mask) == mask
    return met.withColumn(mark, held).drop("__h", "__word", "__of", _SLICE, _WORDS)


def _word(name: str, words: int) -> Column:
    return F.pmod(F.shiftright(F.col(name), 24), F.lit(words).cast("long"))


def _mask(name: str) -> Column:
    mask = F.lit(0).cast("long")
    for i in range(BITS_SET):
        place = F.shiftrightunsigned(F.col(name), 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask

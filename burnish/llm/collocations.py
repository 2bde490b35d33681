"""Phrases that occur more often than their parts by chance, mined by Toivonen's method.

Words are lower-cased (A-Z); phrases are 2 to ``LONGEST`` neighbouring words within a piece of text between punctuation.

* Sample: one document in ``SHARE``, by a hash, is counted alone. Phrases frequent there, at a threshold lowered so that
  few are missed, are proposed. Both phrases that are left when a proposed phrase loses its first or last word are
  proposed, too.
* Full pass: all documents are counted exactly, the proposals together with their negative border, the phrases that are
  not proposed while both their parts without the first or last word are. The border is not listed: a phrase met in the
  text is counted if its two parts are proposed, and what never occurs needs no counting.
* Expansion: a frequent phrase of the border is a failure of the sample, since nothing that extends it was counted. All
  failures join the proposals, and another full pass counts, among what was not counted yet, the phrases whose two parts
  are each proposed now or counted in this very pass. So it follows each failure through all lengths at once, and what
  it finds is closed: the parts of a frequent phrase are frequent, hence proposed by now or counted in this pass, and
  so the phrase itself was counted in one of the two. A pass per length would read all texts up to four times more.

Proposals go to the tasks as a Bloom filter of ``FILTER_WORDS`` words at most (16 MB). What it takes for a proposal by
mistake only makes more phrases be counted, so counts are whole and exact at any size; past its capacity it merely saves
less. A task counts portions of text at a time, and Spark adds up (language, phrase, n).

Phrases are told apart by 64-bit hashes within a portion (a chance of one in 10^8 per portion to confuse any two), by
their text across them. Scores are whole numbers of up to 38 digits until they are divided.

Defined results: null text has no words; a null language is ``und``, and joins the rows that have that name. An empty
table gives no rows. Rows may repeat and ids may be null: they only decide on the sample. Ties in score and count go by
the bytes of the phrase. A text is cut between pieces where it is very long; a piece is not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burnish.llm.common import attach, col, in_python, query, row_hash, settle, table
from burnish.llm.shingles import mix, powers

LONGEST, LEAST, TOP = 5, 100, 2000
#: A candidate inside a longer one that occurs this share (in hundredths) as often is left out.
COVER = 100
#: One document in so many is in the sample, in which a phrase is proposed from this share of the expected count on.
SHARE, LOWERED = 8, 0.3
FILTER_WORDS = 1 << 21
#: Bytes of text counted at a time, and bytes of words hashed at a time; texts are cut after the former.
PORTION, CHUNK = 4 << 20, 1 << 19
ROWS_PER_BATCH = 100_000

_PIECE_END = re.compile(rb"[.,;:!?\x0a-\x0d]")
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C55, 0xD1342543DE82EF95


class Portion(NamedTuple):
    """The words of several texts, as bytes joined by single spaces, and what is needed to cut phrases out of them."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    #: a number per piece of text, and a hash and a number of the language, per word
    pieces: np.ndarray
    tongues: np.ndarray
    languages: np.ndarray


def _prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash per word, the same wherever the word stands."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        first = starts[i]
        j = int(np.searchsorted(ends, first + CHUNK, "right"))
        if j <= i:  # a word longer than a chunk
            out[i] = int.from_bytes(hashlib.blake2b(raw[first : ends[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        sums = _prefix_sums(raw[first : ends[j - 1]].astype(np.uint64) + np.uint64(1), _BYTE_BASE)
        s, e = starts[i:j] - first, ends[i:j] - first
        out[i:j] = mix((sums[e] - sums[s]) * powers(_BYTE_BASE, len(sums))[1][s] + (e - s).astype(np.uint64))
        i = j
    return out


def read_portion(texts: Sequence[bytes], languages: Sequence[int], tongues: np.ndarray) -> Portion:
    """The words of lower-cased texts; each text has the number of its language, each language a hash."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _KIND[raw]
    edges = np.flatnonzero(np.diff(kind == 0, prepend=False))
    starts, ends = edges[0::2], edges[1::2]
    pieces = np.cumsum(kind == 2, dtype=np.int32)[starts]
    offsets = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    of = np.repeat(np.asarray(languages, np.int64), np.diff(offsets, prepend=0))
    sizes = ends - starts
    spaces = np.cumsum(sizes + 1) - 1
    data = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    inside = np.ones(len(data), bool)
    inside[spaces] = False
    data[inside] = raw[kind == 0]
    return Portion(data, spaces - sizes, spaces, _word_hashes(raw, starts, ends), pieces, tongues[of], of)


class Filter(NamedTuple):
    """A Bloom filter: 64-bit words, each phrase having all its bits in one of them."""

    words: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - (len(self.words).bit_length() - 1))
        mask = np.zeros(len(hashes), np.uint64)
        for shift in (0, 6, 12, 18):
            mask |= np.uint64(1) << ((hashes >> np.uint64(shift)) & np.uint64(63))
        return (self.words[place] & mask) == mask


def places(portion: Portion, size: int) -> np.ndarray:
    """The words at which a phrase of ``size`` words starts."""
    n = len(portion.hashes)
    return np.flatnonzero(portion.pieces[: max(0, n - size + 1)] == portion.pieces[size - 1 :])


def window_hashes(portion: Portion, at: np.ndarray, size: int, sums: np.ndarray) -> np.ndarray:
    """The hashes of the phrases of ``size`` words that start at some words, and their language."""
    plain = (sums[at + size] - sums[at]) * powers(_WORD_BASE, len(sums))[1][at] + np.uint64(size)
    return mix(mix(plain) ^ portion.tongues[at])


def counted(portion: Portion, proposed: Filter | None, before: Filter | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per size of phrases: the size, and of each different phrase a place, its hash and how often it occurs.

    Words are counted, and phrases whose parts without the first and last word are both proposed. With ``before``, the
    proposals of an earlier pass, it is what that pass did not count, and a part that is counted here is as good as a
    proposed one. Without a filter all phrases are counted.
    """
    n = len(portion.hashes)
    sums = _prefix_sums(portion.hashes, _WORD_BASE)
    now = then = np.ones(n + 1, bool)
    for size in range(1, LONGEST + 1):
        at = places(portion, size)
        if proposed is None:
            wanted = None
        elif size == 1:
            wanted = np.full(len(at), before is None)
        else:
            wanted = now[at] & now[at + 1]
            if before is not None:
                wanted &= ~(then[at] & then[at + 1])
        hashes = window_hashes(portion, at, size, sums)
        firsts, found = (at, hashes) if wanted is None else (at[wanted], hashes[wanted])
        keys, index, times = np.unique(found, return_index=True, return_counts=True)
        yield size, firsts[index], keys, times
        if proposed is not None and size < LONGEST:
            held = proposed.has(hashes)
            if before is None:
                now = _marks(n, at, held)
            else:
                now, then = _marks(n, at, held | wanted), _marks(n, at, before.has(hashes))


def _marks(n: int, at: np.ndarray, held: np.ndarray) -> np.ndarray:
    out = np.zeros(n + 1, bool)
    out[at[held]] = True
    return out


def phrases(portion: Portion, firsts: np.ndarray, size: int) -> pa.Array:
    """The texts of the phrases of ``size`` words that start at some words."""
    starts, ends = portion.starts[firsts], portion.ends[firsts + size - 1]
    offsets = np.zeros(len(firsts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    places = np.repeat(starts - offsets[:-1], ends - starts) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(firsts), [None, pa.py_buffer(offsets), pa.py_buffer(portion.data[places])])


def _slices(text: bytes) -> Iterator[bytes]:
    """The text, cut between pieces where it is longer than a portion."""
    start = 0
    while len(text) - start > PORTION and (end := _PIECE_END.search(text, start + PORTION)):
        yield text[start : end.end()]
        start = end.end()
    yield text[start:]


def _tongue(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def read_portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Portion, list[str]]]:
    """The texts of batches (text, lang) in portions, each with the names of its languages."""
    texts: list[bytes] = []
    languages: list[int] = []
    names: dict[str, int] = {}
    size = 0

    def read() -> tuple[Portion, list[str]]:
        return read_portion(texts, languages, np.array([_tongue(n) for n in names], np.uint64)), list(names)

    for batch in batches:
        for text, name in zip(batch.column("text").cast(pa.large_binary()), batch.column("lang"), strict=True):
            for part in _slices((text.as_py() or b"").lower()):
                if texts and size + len(part) > PORTION:
                    yield read()
                    texts, languages, names, size = [], [], {}, 0
                texts.append(part)
                languages.append(names.setdefault(name.as_py(), len(names)))
                size += len(part)
    if texts:
        yield read()


def _in_batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, ROWS_PER_BATCH):
        yield batch.slice(start, ROWS_PER_BATCH)


def propose(texts: DataFrame, share: int, least: int) -> DataFrame:
    """The hashes of what occurs often enough in the sample, one document in ``share``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion, _ in read_portions(batches):
            for _, _, keys, times in counted(portion, None, None):
                yield from _in_batches(pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times)], ["key", "n"]))

    drawn = texts.where(F.pmod(F.col("draw"), F.lit(share)) == 0).select("text", "lang")
    found = in_python(drawn, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return settle(found.where(F.col("n") >= max(2, int(LOWERED * least / share))).select("key"))


def with_keys(filter_: Filter, keys: DataFrame) -> Filter:
    """The filter with the hashes in ``keys`` added; not more than FILTER_WORDS words come to the driver."""
    bits = len(filter_.words).bit_length() - 1
    mask = F.lit(0).cast("long")
    for shift in (0, 6, 12, 18):
        place = F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    word = F.shiftrightunsigned("key", 64 - bits).cast("int")
    found = keys.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    words = filter_.words.copy()
    words[found["word"].to_numpy()] |= found["mask"].to_numpy(np.int64).view(np.uint64)
    return Filter(words)


def count(texts: DataFrame, proposed: Filter, before: Filter | None, least: int) -> DataFrame:
    """Rows (lang, phrase, n) of what is counted in a full pass and occurs often enough.

    The first pass also gives the number of all words of a language, phrase being null.
    """
    shared = texts.sparkSession.sparkContext.broadcast((proposed, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, then = shared.value
        for portion, names in read_portions(batches):
            known = pa.array(names, pa.string())
            if then is None:
                words = np.bincount(portion.languages, minlength=len(names))
                yield pa.RecordBatch.from_arrays([known, pa.nulls(len(names), pa.string()), pa.array(words)], ["lang", "phrase", "n"])
            for size, firsts, _, times in counted(portion, now, then):
                for i in range(0, len(firsts), ROWS_PER_BATCH):
                    some = firsts[i : i + ROWS_PER_BATCH]
                    found = phrases(portion, some, size).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([known.take(pa.array(portion.languages[some])), found, pa.array(times[i : i + ROWS_PER_BATCH])], ["lang", "phrase", "n"])

    rows = in_python(texts.select("text", "lang"), run, "lang string, phrase string, n long")
    return settle(rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("phrase").isNull()))


def unproposed(frequent: DataFrame, proposed: Filter) -> DataFrame:
    """The hashes of the phrases in (lang, phrase) that are not proposed."""
    shared = frequent.sparkSession.sparkContext.broadcast(proposed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion, _ in read_portions(batches):
            n, whole = len(portion.hashes), []
            sums = _prefix_sums(portion.hashes, _WORD_BASE)
            last = np.append(portion.pieces[1:] != portion.pieces[:-1], True)
            first = np.append(True, last[:-1])
            for size in range(1, min(LONGEST, n) + 1):
                at = places(portion, size)
                at = at[first[at] & last[at + size - 1]]
                whole.append(window_hashes(portion, at, size, sums))
            keys = np.concatenate(whole) if whole else np.zeros(0, np.uint64)
            missed = keys[~shared.value.has(keys)]
            yield from _in_batches(pa.RecordBatch.from_arrays([pa.array(missed.view(np.int64))], ["key"]))

    return settle(in_python(frequent.select(F.col("phrase").alias("text"), "lang"), run, "key long"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, phrase, n): all phrases of 1 to LONGEST words that occur ``least`` times in a language.

    A row with a null phrase holds the number of all words of each language.
    """
    texts = docs.select(
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.xxhash64(col(id_col), row_hash(docs)).alias("draw"),
    )
    proposals = propose(texts, share, least)
    wanted = min(FILTER_WORDS, max(1 << 10, 1 << (proposals.count() // 4).bit_length()))
    proposed = with_keys(Filter(np.zeros(wanted, np.uint64)), proposals)
    found = count(texts, proposed, None, least)
    failures = unproposed(found.where("phrase IS NOT NULL"), proposed)
    if failures.isEmpty():
        return found
    return found.unionByName(count(texts, with_keys(proposed, failures), proposed, least))


def _with_counts(rows: DataFrame, key: str, frequent: DataFrame, name: str) -> DataFrame:
    """``rows`` with the count of the phrase in ``key`` as ``name``; rows of a very common part stay where they are."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).join(frequent.select(F.col("key").alias(key), F.col("n").alias(name)), key)
    sizes = settle(sizes)
    return attach(rows, sizes, key, "rows", rows.count()).drop("rows")


def score_phrases(found: DataFrame, cover: int = COVER) -> DataFrame:
    """Rows (lang, phrase, a, l, r, n, score) of the candidates in ``found`` that no longer one covers."""
    frequent = found.where("phrase IS NOT NULL").select(F.struct("lang", "phrase").alias("key"), "n")
    words = F.split(F.col("key.phrase"), " ")
    parts = settle(frequent.withColumn("words", words).where(F.size("words") > 1))
    part = lambda first, size: F.struct(F.col("key.lang").alias("lang"), F.array_join(F.slice("words", first, size), " ").alias("phrase"))
    cuts = parts.select("key", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = settle(cuts.select("key", "a", "k", part(F.lit(1), F.col("k")).alias("one"), part(F.col("k") + 1, F.size("words") - F.col("k")).alias("two")))
    cuts = settle(_with_counts(cuts, "one", frequent, "l"))
    cuts = settle(_with_counts(cuts, "two", frequent, "r").withColumn("lang", F.col("key.lang")))
    totals = found.where("phrase IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    sizes = settle(cuts.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).join(totals, "lang"))
    cuts = attach(cuts, sizes, "lang", "rows", cuts.count())
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "n", "l", "r")}
    score = F.call_function("div", wide["a"] * F.lit(1000).cast("decimal(4,0)") * wide["n"], wide["l"] * wide["r"])
    best = cuts.withColumn("score", score).groupBy("key", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # What a phrase two words longer covers, the phrase one word longer covers as well: it occurs at least as often.
    shorter = parts.where(F.size("words") > 2).select(F.explode(F.array(part(F.lit(1), F.size("words") - 1), part(F.lit(2), F.size("words") - 1))).alias("key"), "n")
    covers = shorter.groupBy("key").agg(F.max("n").alias("most"))
    kept = best.join(covers, "key", "left").where(F.coalesce(100 * F.col("most") < cover * F.col("a"), F.lit(True)))
    return kept.select("key.lang", "key.phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    scored = score_phrases(frequent_phrases(docs, least, share, id_col, text_col, lang_col))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    ranked = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS words
  FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t)),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM p, range(1, {LONGEST + 1}) s(size) WHERE len(words) >= size)
  GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, phrase, a, size, string_split(phrase, ' ') AS words FROM f WHERE size > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, k, one.a AS l, two.a AS r, n.n, (1000::HUGEINT * c.a * n.n) // (one.a::HUGEINT * two.a) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c JOIN n USING (lang)
  JOIN f one ON one.lang = c.lang AND one.phrase = array_to_string(words[1:k], ' ')
  JOIN f two ON two.lang = c.lang AND two.phrase = array_to_string(words[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(words[i:i + s - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest(range(1, size - s + 2)) AS i FROM c, range(2, {LONGEST}) u(s) WHERE s < size) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM best b LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < {COVER} * a
QUALIFY rank <= {TOP}
"""


@query("op11_phrase_collocations", ORACLE)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))

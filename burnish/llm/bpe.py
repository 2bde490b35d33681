"""Byte-level BPE by recursive queries of an in-process DuckDB in each task.

Spark deals out the documents; each task splits its texts into pre-tokens, and gives the different ones it does not
remember to DuckDB. There a word is a set of rows (word, position, token). Each step of the recursive query joins
neighbouring rows with the merge table, takes each word's pair of the smallest rank, the leftmost of these, and
contracts it; words without a pair drop out, until none is left. Decoding takes each id's bytes from the vocabulary, an
Arrow column, in which the ids of a portion follow each other, and cuts the result at the ends of the documents.

A step keeps its word's rows, so the work on a word grows with the square of its length. Words of more than
``LONG_WORD`` bytes are contracted table by table instead, and all places of the smallest pair at once where no merge
with the new token could come before: then the order makes no difference.

Memory is bounded: words that a worker remembers (``REMEMBERED`` of them, with ``REMEMBERED_CHARACTERS``), bytes of text
taken at a time (``BATCH_BYTES``, or one document), rows that a recursive query makes (``CONTRACTED``) and DuckDB's own
limit; it runs in one thread, without files unless it must spill.

Defined results: null text counts as empty, and empty text has no tokens. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.llm.common import SMALL_BATCH_BYTES, col, in_python, query, table

RANKS = "byte_bpe_multi_50k.tiktoken"
LONG_WORD = 256
REMEMBERED = 160_000
REMEMBERED_CHARACTERS = 4 << 20
BATCH_BYTES = 3 << 18
#: Words of a portion that are Python's strings at once (or those of one text).
STRINGS = 1 << 14
#: Squares of the lengths of words that are contracted at once: their query makes at most half as many rows.
CONTRACTED = 750_000
MEMORY = "160MB"

#: A row is a cell: word, place (9 bits) and token (22 bits) in one number, and DONE once its word has no pair left. The
#: smallest rank, the place of its pair's left token, and that of the right one are packed likewise.
DONE = "(1::BIGINT << 62)"
TOKEN = (1 << 22) - 1
CONTRACT = f"""
WITH RECURSIVE state AS (
    SELECT cell FROM start
    UNION ALL
    SELECT CASE WHEN best IS NULL THEN cell + {DONE} WHEN cell >> 22 = spot THEN (spot << 22) | (best >> 18) ELSE cell END
    FROM (SELECT cell FROM state WHERE cell < {DONE}) s
    LEFT JOIN (
        SELECT word, best, (word << 9) | ((best >> 9) & 511) AS spot, (word << 9) | (best & 511) AS gone
        FROM (
            SELECT cell >> 31 AS word, min((id::BIGINT << 18) | (((cell >> 22) & 511) << 9) | ((after >> 22) & 511)) AS best
            FROM (SELECT cell, lead(cell) OVER (ORDER BY cell) AS after FROM state WHERE cell < {DONE}) p
            JOIN pairs m ON m.pair = ((cell & {TOKEN}) << 22) | (after & {TOKEN})
            WHERE after >> 31 = cell >> 31
            GROUP BY cell >> 31
        )
    ) ON cell >> 31 = word
    WHERE gone IS NULL OR cell >> 22 <> gone
)
SELECT cell - {DONE} AS cell FROM state WHERE cell >= {DONE} ORDER BY cell
"""

#: One step on a single long word: the places of the smallest pair, every second one of a run that overlaps itself.
LONG_STEP = """
CREATE OR REPLACE TEMP TABLE chosen AS
WITH pairs AS (
    SELECT p.n, p.place, m.id, m.a = m.b AS same, m.early
    FROM (SELECT row_number() OVER (ORDER BY place) AS n, place, token, lead(token) OVER (ORDER BY place) AS next FROM long_state) p
    JOIN merges m ON m.a = p.token AND m.b = p.next
),
least AS (SELECT * FROM pairs WHERE id = (SELECT min(id) FROM pairs)),
runs AS (SELECT *, n - row_number() OVER (ORDER BY n) AS run FROM least),
numbered AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY n) AS k, row_number() OVER (ORDER BY n) AS overall FROM runs)
SELECT n, place, id FROM numbered WHERE (NOT early OR overall = 1) AND (NOT same OR k % 2 = 1)
"""
LONG_APPLY = """
CREATE OR REPLACE TEMP TABLE long_state AS
SELECT s.place, coalesce(c.id, s.token) AS token
FROM (SELECT row_number() OVER (ORDER BY place) AS n, place, token FROM long_state) s
LEFT JOIN chosen c ON c.n = s.n
WHERE s.n - 1 NOT IN (SELECT n FROM chosen)
"""


class Remembered:
    """Numbered words with their tokens. Beyond the limits, those stay that most portions of text held, of these the newest.

    A worker holds this for as long as it lives, also while it works for other stages: words are an Arrow column, not
    Python's strings, which take some ten times as much.
    """

    def __init__(self):
        self.words = pa.array([], pa.large_string())
        #: All tokens one after the other, where each word's begin and end, and in how many portions it was (255: or more).
        self.tokens = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)
        self.met = np.zeros(0, np.uint8)
        self.characters = 0

    @property
    def number(self) -> dict[str, int]:
        """The number of each word."""
        return {word: n for n, word in enumerate(self.words.to_pylist())}

    def find(self, words: pa.LargeStringArray) -> np.ndarray:
        """The number of each of these words, -1 for those that are not in."""
        return np.array(pc.index_in(words, value_set=self.words).fill_null(-1), np.int64)

    def add(self, words: pa.LargeStringArray, tokens: list[bytes]) -> None:
        """Take words that are not in yet, with their tokens as the bytes of 32-bit integers."""
        self.words = pa.concat_arrays([self.words, words])
        self.tokens = np.concatenate([self.tokens, np.frombuffer(b"".join(tokens), np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(t) // 4 for t in tokens], dtype=np.int64)])
        self.met = np.concatenate([self.met, np.zeros(len(words), np.uint8)])
        self.characters += pc.sum(pc.utf8_length(words)).as_py() or 0

    def meet(self, numbers: np.ndarray) -> None:
        """Note that a portion holds these words, which are different."""
        self.met[numbers] += self.met[numbers] < 255

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of these words one after the other, and the ends of the words, from 0 on."""
        starts = self.ends[numbers]
        lengths = self.ends[numbers + 1] - starts
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.tokens[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)], ends

    def forget(self) -> None:
        """Beyond the limits, go down to half of them."""
        if len(self.words) <= REMEMBERED and self.characters <= REMEMBERED_CHARACTERS:
            return
        sizes = pc.utf8_length(self.words).to_numpy()
        order = np.lexsort((-np.arange(len(sizes)), -self.met.astype(np.int64)))[: REMEMBERED // 2]
        stay = np.sort(order[np.cumsum(sizes[order]) <= REMEMBERED_CHARACTERS // 2])
        lengths = np.diff(self.ends)[stay]
        self.tokens = self.gather(stay)[0]
        self.ends = np.concatenate([[0], np.cumsum(lengths)])
        self.met = self.met[stay] >> 1
        self.words = self.words.take(pa.array(stay))
        self.characters = int(sizes[stay].sum())


class Vocabulary:
    """What a rank file says, in the forms that a codec needs; kept by a worker."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.split = regex.compile(pattern).findall
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        a, b, made = array("i"), array("i"), array("i")
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                if (left := ranks.get(piece[:i])) is not None and (right := ranks.get(piece[i:])) is not None:
                    a.append(left), b.append(right), made.append(rank)
        a, b, made = (np.array(x, np.int32) for x in (a, b, made))
        early = np.isin(made, np.concatenate([a[made < a], b[made < b]]))
        self.merges = pa.table({"a": a, "b": b, "id": made, "early": early})
        #: By id: its bytes, empty if no token has it, and itself in decimal with a comma. The last is for unknown ids.
        pieces = [b""] * (max(ranks.values()) + 2)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.pieces = pa.array(pieces, pa.large_binary())
        self.decimals = pa.array([b"%d," % i for i in range(len(pieces))], pa.large_binary())
        self.remembered = Remembered()


class Codec:
    """Encoder and decoder of one vocabulary, with its DuckDB; made for a task."""

    def __init__(self, vocabulary: Vocabulary):
        import duckdb

        self.split, self.single, self.pieces, self.decimals = (getattr(vocabulary, n) for n in ("split", "single", "pieces", "decimals"))
        self.remembered = vocabulary.remembered
        self.db = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": MEMORY})
        self._load("merges", vocabulary.merges)
        self.db.execute("CREATE TEMP TABLE pairs AS SELECT (a::BIGINT << 22) | b AS pair, id FROM merges")

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """The tokens of each word."""
        lengths = np.array([len(w) for w in words], np.int64)
        places = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        cells = ((np.repeat(np.arange(len(words)) << 9, lengths) + places) << 22) | self.single[np.frombuffer(b"".join(words), np.uint8)]
        self._load("start", pa.table({"cell": cells}))
        cells = self.db.sql(CONTRACT).to_arrow_table().column("cell").to_numpy()
        flat = (cells & TOKEN).astype(np.int32).tobytes()
        ends = [0, *(np.cumsum(np.bincount(cells >> 31, minlength=len(words))) * 4).tolist()]
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _contract_long(self, word: bytes) -> bytes:
        self._load("long_state", pa.table({"place": np.arange(len(word)), "token": self.single[np.frombuffer(word, np.uint8)]}))
        while True:
            self.db.execute(LONG_STEP)
            if not self.db.execute("SELECT count(*) FROM chosen").fetchall()[0][0]:
                tokens = self.db.execute("SELECT token FROM long_state ORDER BY place").fetchall()
                return np.array(tokens, np.int32).tobytes()
            self.db.execute(LONG_APPLY)

    def _learn(self, words: pa.LargeStringArray) -> None:
        """Remember the tokens of ``words``, which are different and new."""
        raws = words.cast(pa.large_binary())
        whole = pc.index_in(raws, value_set=self.pieces).fill_null(-1).to_numpy()
        lengths = pc.binary_length(raws).to_numpy()
        tokens = [whole[i : i + 1].tobytes() for i in range(len(words))]
        short = np.flatnonzero((whole < 0) & (lengths <= LONG_WORD))
        for a, b in ranges((lengths[short] ** 2).tolist(), CONTRACTED):
            for i, found in zip(short[a:b].tolist(), self._contract(raws.take(pa.array(short[a:b])).to_pylist()), strict=True):
                tokens[i] = found
        for i in np.flatnonzero((whole < 0) & (lengths > LONG_WORD)).tolist():
            tokens[i] = self._contract_long(raws[i].as_py())
        self.remembered.add(words, tokens)

    def _words(self, texts: list[str]) -> tuple[pa.LargeStringArray, list[int]]:
        """The words of all texts, and the ends of the texts, from 0 on; few of them at a time are Python's strings."""
        done, words, ends, before = [], [], [0], 0
        for text in texts:
            words += self.split(text)
            ends.append(before + len(words))
            if len(words) >= STRINGS:
                done.append(pa.array(words, pa.large_string()))
                words, before = [], ends[-1]
        return pa.concat_arrays([*done, pa.array(words, pa.large_string())]), ends

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the ends of the texts, from 0 on."""
        words, ends = self._words(texts)
        coded = words.dictionary_encode()
        numbers = self.remembered.find(coded.dictionary)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            known = len(self.remembered.words)
            self._learn(coded.dictionary.take(pa.array(missing)))
            numbers[missing] = np.arange(known, known + len(missing))
        self.remembered.meet(numbers)
        ids, upto = self.remembered.gather(numbers[coded.indices.to_numpy()])
        self.remembered.forget()
        return ids, upto[ends]

    def _taken(self, values: pa.LargeBinaryArray, ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, list[int]]:
        """The values of all ids, joined, and where each list's end, from 0 on."""
        if not len(ids):
            return memoryview(b""), [0] * len(ends)
        found = values.take(pa.array(ids))
        offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset :]
        return memoryview(found.buffers()[2] or b""), offsets[ends].tolist()

    def listed(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Per list its ids in decimal, joined by commas."""
        data, ends = self._taken(self.decimals, ids, ends)
        return [bytes(data[a : max(a, b - 1)]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Per list the bytes of its ids; ids without a token have none."""
        last = len(self.pieces) - 1
        data, ends = self._taken(self.pieces, np.where((ids >= 0) & (ids < last), ids, last), ends)
        return [bytes(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


_vocabularies: dict[tuple[str, str], Vocabulary] = {}


@contextmanager
def codec_of(path: str, pattern: str) -> Iterator[Codec]:
    """A codec for one task. Workers outlive tasks: they keep the vocabulary and its words, and give back the rest."""
    if (path, pattern) not in _vocabularies:
        _vocabularies[path, pattern] = Vocabulary(path, pattern)
    codec = Codec(_vocabularies[path, pattern])
    try:
        yield codec
    finally:
        codec.db.close()


class Tokenizer:
    """A rank file and the pattern that cuts text before the merges; by default the public multilingual one."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        self._path, self._pattern = path, pattern

    @cached_property
    def parts(self) -> tuple[str, str]:
        if self._path and self._pattern:
            return self._path, self._pattern
        import public_tokenizers

        return self._path or public_tokenizers.path(RANKS), self._pattern or public_tokenizers.PATTERN


def ranges(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of things of these sizes that have about ``most`` together, with at least one thing in each."""
    start = at = size = 0
    for at, own in enumerate(sizes, 1):
        if at - 1 > start and size + own > most:
            yield start, at - 1
            start, size = at - 1, 0
        size += own
    if start < at:
        yield start, at


def portions(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters, with at least one text in each."""
    return ranges(map(len, texts), most)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of about BATCH_BYTES of text: only one part at a time is made Python's strings."""
    for a, b in ranges(pc.binary_length(batch.column("text")).to_pylist(), BATCH_BYTES):
        yield batch.slice(a, b - a)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text: Column = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return docs.select(col(id_col).alias("doc_id"), text.alias("text"))


def encode(docs: DataFrame, tokenizer: Tokenizer | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and its token ids."""
    path, pattern = (tokenizer or Tokenizer()).parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec_of(path, pattern) as codec:
            for batch in batches:
                yield from encoded(batch, codec)

    def encoded(batch: pa.RecordBatch, codec: Codec) -> Iterator[pa.RecordBatch]:
        for part in _parts(batch):
            ids, ends = codec.encode(part.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    rows = _texts(docs, id_col, text_col)
    return in_python(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>", SMALL_BATCH_BYTES)


def decode(coded: DataFrame, tokenizer: Tokenizer | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id and the decoded bytes as ``data``. Null ids count as none."""
    path, pattern = (tokenizer or Tokenizer()).parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec_of(path, pattern) as codec:
            for batch in batches:
                yield decoded(batch, codec)

    def decoded(batch: pa.RecordBatch, codec: Codec) -> pa.RecordBatch:
        lists = [np.array(x or [], np.int32) for x in batch.column("ids").to_pylist()]
        ends = np.cumsum([0, *map(len, lists)])
        data = pa.array(codec.decode(np.concatenate([*lists, np.zeros(0, np.int32)]), ends), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), data], ["doc_id", "data"])

    rows = coded.select(col(id_col).alias("doc_id"), col(ids_col).cast("array<int>").alias("ids"))
    return in_python(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, data binary", SMALL_BATCH_BYTES)


def round_trip(docs: DataFrame, tokenizer: Tokenizer | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path, pattern = (tokenizer or Tokenizer()).parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec_of(path, pattern) as codec:
            for batch in batches:
                yield from both_ways(batch, codec)

    def both_ways(batch: pa.RecordBatch, codec: Codec) -> Iterator[pa.RecordBatch]:
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for part in _parts(batch):
            ids, ends = codec.encode(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array([sha(x) for x in codec.listed(ids, ends)], pa.string()),
                    pa.array([sha(x) for x in codec.decode(ids, ends)], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = _texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_python(rows, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", SMALL_BATCH_BYTES)


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))

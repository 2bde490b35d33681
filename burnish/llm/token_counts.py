"""Token counts of a SentencePiece model, mostly by looking words up.

A pre-token is a run of spaces and what follows up to the next space. No piece of the vocabulary holds a space after
another character (checked when the model is loaded), so no merge crosses the start of a pre-token: a text's count is
the sum over its pre-tokens. Two things are proven offline, once per worker, by running the encoder on the vocabulary:
which pieces, taken as a text, come out as one token. A pre-token that is such a piece counts one without merging;
only the others go through the encoder, each different one once per portion of text, and are remembered.

What the proof needs of the model is checked too: normalisation leaves text alone but for the leading space, and no
piece is user-defined. Otherwise (another model) whole texts are encoded.

Defined results: null counts as empty, and empty text has no tokens. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.llm.bpe import portions
from burnish.llm.common import col, in_python, query, table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
REMEMBERED = 500_000
BATCH_CHARACTERS = 8 << 20
SPACE = "▁"
#: Texts whose normal form shows what a model's normaliser does: white space, compatibility forms, accents, controls.
PROBES = ("a", " a", "  a  b ", "a\tb\nc", "ﬁ ½", "é é", "a b", "\x00a\x01", "　a​", "Aİ", "▁a▁")


class PieceCounter:
    """Counts tokens of one model; made once per Python worker."""

    made: dict[str, PieceCounter] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        plain = [
            p for i, p in enumerate(pieces) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))
        ]
        self.by_word = self._separable(plain, path)
        alone = self.prove(plain) if self.by_word else {}
        #: A space at the end of a text; as a text of its own it would be empty, so it is measured behind a letter.
        self.last_space = {SPACE: len(self.model.encode("a ")) - len(self.model.encode("a"))}
        self.known = alone | self.last_space
        self.proven = len(alone)

    def _separable(self, plain: list[str], path: str) -> bool:
        """Whether pre-tokens can be encoded on their own, by the vocabulary and the normaliser."""
        import sentencepiece

        crossing = any(a != SPACE and b == SPACE for p in plain for a, b in zip(p, p[1:], strict=False))
        form = sentencepiece.SentencePieceNormalizer(model_file=path, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=False)
        kept = all(form.normalize(t) == SPACE + t.replace(" ", SPACE) for t in PROBES)
        # A text of its own gets one leading space: encoding a pre-token without its first space gives it back.
        lead = self.model.encode("a", out_type=str) == [SPACE + "a"] and self.model.encode(" a b", out_type=str)[-1] == SPACE + "b"
        return kept and lead and not crossing

    def prove(self, plain: list[str]) -> dict[str, int]:
        """The pieces that begin with a space and come out of the encoder as one token when they are a whole text."""
        words = [p for p in plain if p[0] == SPACE and len(p) > 1]
        return {p: 1 for p, ids in zip(words, self.model.encode([p[1:] for p in words], num_threads=1), strict=True) if len(ids) == 1}

    @staticmethod
    def pre_tokens(text: str) -> list[str]:
        """Runs of spaces, each with what follows; the first begins with the space that every text is given."""
        marked = SPACE + text.replace(" ", SPACE)
        parts = marked.split(SPACE)
        if "" not in parts[1:]:
            return [SPACE + p for p in parts[1:]]
        out, spaces = [], 0
        for p in parts[1:]:
            spaces += 1
            if p:
                out.append(SPACE * spaces + p)
                spaces = 0
        return [*out, SPACE * spaces] if spaces else out

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        counted = [Counter(self.pre_tokens(t)) if t else {} for t in texts]
        used = set().union(*counted)
        new = [w for w in used if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {w: n for w, n in self.known.items() if w in used or n == 1} | self.last_space
            if len(self.known) > REMEMBERED:
                self.known = {w: self.known[w] for w in used if w in self.known} | self.last_space
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            self.known.update(zip(part, map(len, self.model.encode([w[1:] for w in part], num_threads=1)), strict=True))
        known = self.known
        return [sum([known[w] * n for w, n in words.items()]) for words in counted]

    @classmethod
    def get(cls, path: str) -> PieceCounter:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter.get(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in portions(texts, BATCH_CHARACTERS):
                counts = pa.array(counter.count(texts[a:b]), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("n_bytes")[a:b], counts], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = in_python(rows, run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))

"""Token counts and byte-level BPE against the libraries that define them."""

from __future__ import annotations

import base64
import hashlib

import pytest

P = pytest.importorskip("public_tokenizers")

from llm.texts import AWKWARD, random_texts  # noqa: E402

from burnish.llm.bpe import Codec, Vocabulary, decode, encode, round_trip  # noqa: E402
from burnish.llm.token_counts import MODEL, PieceCounter, count_tokens  # noqa: E402

TEXTS = [*AWKWARD, *random_texts(200)]


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path(MODEL))


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "no id", "x", "y"), (3, "twice", "x", "y"), (3, "twice", "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids string")


def expected(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_counts_are_the_librarys(docs, pieces):
    got = sorted(map(repr, map(tuple, count_tokens(docs, limit=40).collect())))
    want = [(i, len(t.encode()), len(pieces.encode(t)), len(pieces.encode(t)) > 40) for i, t in expected(docs)]
    assert got == sorted(map(repr, want))


def test_words_are_looked_up_and_forgotten(pieces, monkeypatch):
    monkeypatch.setattr("burnish.llm.token_counts.REMEMBERED", 5)
    counter = PieceCounter(P.path(MODEL))
    assert counter.by_word and counter.proven > 10_000
    texts = [t for t in random_texts(300, seed=5)]
    for i in range(0, 300, 20):
        assert counter.count(texts[i : i + 20]) == [len(pieces.encode(t)) for t in texts[i : i + 20]]


def test_whole_texts_are_encoded_where_the_proof_fails(pieces):
    counter = PieceCounter(P.path(MODEL))
    counter.by_word = False
    assert counter.count(["a b", ""]) == [len(pieces.encode("a b")), 0]


def test_ids_are_the_librarys_and_decode_to_the_text(docs, library):
    got = sorted(map(repr, map(tuple, round_trip(docs).collect())))
    want = []
    for i, t in expected(docs):
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(map(repr, want))


def test_encode_and_decode_on_their_own(docs, library):
    coded = encode(docs)
    assert sorted((repr(r.doc_id), r.ids) for r in coded.collect()) == sorted((repr(i), library.encode_ordinary(t)) for i, t in expected(docs))
    back = sorted((repr(r.doc_id), bytes(r.data)) for r in decode(coded).collect())
    assert back == sorted((repr(i), t.encode()) for i, t in expected(docs))


def test_long_words_step_by_step(library):
    codec = Codec(Vocabulary(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN))
    words = [t.replace(" ", "") for t in random_texts(15, seed=3, most=150)] + ["aaaa" * 9, "ababab" * 7 + "a", "the" * 30, "éé" * 9]
    for w in filter(None, words):
        assert codec._contract_long(w.encode()) == codec._contract([w.encode()])[0]


def codec():
    return Codec(Vocabulary(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN))


LETTERED = str.maketrans("0123456789", "ghijklmnop")


def test_few_words_are_contracted_at_once_if_they_are_long(monkeypatch):
    most = []
    monkeypatch.setattr(Codec, "_contract", lambda self, words: most.append(sum(len(w) ** 2 for w in words)) or [bytes(8) for _ in words])
    codec().encode([" ".join(f"{n:x}".translate(LETTERED) * 40 for n in range(70_000, 71_000))])
    assert sum(most) > 3_000_000 and max(most) < 1_000_000


def test_words_are_forgotten_by_number_and_size_and_the_ids_stay_right(library, monkeypatch):
    monkeypatch.setattr("burnish.llm.bpe.REMEMBERED", 40)
    monkeypatch.setattr("burnish.llm.bpe.REMEMBERED_CHARACTERS", 300)
    own, texts = codec(), [*filter(None, random_texts(300, seed=6)), "x" * 400]
    for i in range(0, len(texts), 7):
        ids, ends = own.encode(texts[i : i + 7])
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [library.encode_ordinary(t) for t in texts[i : i + 7]]
        assert own.decode(ids, ends) == [t.encode() for t in texts[i : i + 7]]
        assert len(own.remembered.number) <= 40 and own.remembered.characters == sum(map(len, own.remembered.number)) <= 300


def test_frequent_words_outlast_others(monkeypatch):
    monkeypatch.setattr("burnish.llm.bpe.REMEMBERED", 40)
    own, asked = codec(), []
    plain = Codec._contract
    monkeypatch.setattr(Codec, "_contract", lambda self, words: asked.extend(words) or plain(self, words))
    for i in range(20):
        own.encode([f" Qzxqoften Qzxqalways{''.join(f' Qz{n}xq'.translate(LETTERED) for n in range(i * 15, i * 15 + 15))}"])
    assert asked.count(b" Qzxqoften") == asked.count(b" Qzxqalways") == 1 and len(asked) == 302


def test_remembered_words_take_little_memory():
    import gc
    import tracemalloc

    import pyarrow as pa

    own, text = codec(), " ".join(f"{n:x}".translate(LETTERED) for n in range(65_536, 95_536))
    own.encode(["warm up"])
    gc.collect()
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    ids, ends = own.encode([text])
    assert own.decode(ids, ends) == [text.encode()]
    del ids, ends
    gc.collect()
    taken = tracemalloc.get_traced_memory()[0] + max(0, pa.total_allocated_bytes() - before)
    tracemalloc.stop()
    assert len(own.remembered.number) > 25_000 and taken < 2_500_000


def test_decoding_asks_no_database(spark, library):
    own, texts = codec(), ["", "ab cd", "", "éé\n"]
    ids, ends = own.encode(texts)
    own.db.close()
    assert own.decode(ids, ends) == [t.encode() for t in texts]
    assert own.listed(ids, ends) == [",".join(map(str, library.encode_ordinary(t))).encode() for t in texts]
    odd = spark.createDataFrame([(1, [-1, 10**6, *library.encode_ordinary("ab"), 50_256]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, bytes(r.data)) for r in decode(odd).collect()) == [(1, b"ab"), (2, b""), (3, b"")]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(none).count() == round_trip(none).count() == encode(none).count() == 0


def test_queries_over_a_whole_table(spark, pieces, library):
    import os

    from burnish.llm.bpe import op9_byte_bpe
    from burnish.llm.token_counts import op1_token_counts

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op1_token_counts(spark, sf).collect():
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), len(pieces.encode(texts[r.doc_id])))
        assert r.over_limit == (r.n_tokens > 4096)
    coded = op9_byte_bpe(spark, sf).collect()
    assert len(coded) == len(texts)
    for r in coded:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()

"""The pipeline against a plain version of what each stage must do, on the smallest table."""

from __future__ import annotations

import base64
import hashlib
import os
from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from llm.test_jaccard_join import brute  # noqa: E402

from burnish.llm import mixing, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_and_run_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "byte_bpe"]
    grammar = toxicity.train(toxicity.learning_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")))

    rows = docs.collect()
    civil = [r for r in rows if grammar.score(grammar.features(r.text)) < toxicity.THRESHOLD]
    last = {}
    for r in civil:
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", -1))
    single = [r for r in civil if last[r.text or ""] == r.doc_id]
    heads = {i for i, _, head in brute([(r.doc_id, r.text) for r in single]) if i == head}
    kept = [r for r in single if r.doc_id in heads]
    assert len(rows) > len(civil) > len(single) > len(kept)

    at, names = docs, docs.columns
    for name, want in (("toxicity", civil), ("exact_dedup", single), ("jaccard_join", kept)):
        at = stages[name](spark, at, SF)
        assert at.columns == names
        assert sorted(r.doc_id for r in at.collect()) == sorted(r.doc_id for r in want)

    copies = Counter(r.doc_id for r in mixing.mix(spark.createDataFrame(kept, docs.schema)).collect())
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in kept:
        ids = library.encode_ordinary(r.text or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (r.text or "").encode())]
        want += [(r.doc_id, len(ids), *digests)] * copies[r.doc_id]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)


def test_empty_documents(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0

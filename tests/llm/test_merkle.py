"""The Merkle manifest against a plain version, versions by copied nodes, and awkward rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from burnish.llm import merkle
from burnish.llm.language import remainder

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp int, `a.b` double"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = (row[0], row[1], row[2], row[3], text)
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def plain(rows):
    """All result rows, each version grown anew from its leaves."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    null_first = lambda v: (v is not None, v if v is not None else 0)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (null_first(r[0]), leaf(r, r[4])))
    trees = {s: levels([leaf(r, r[4]) for r in groups[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for rank, s in enumerate(names):
        for place, row in enumerate(groups[s]):
            siblings = []
            for tree, i in ((trees[s], place), (top, rank)):
                for below in tree[:-1]:
                    first = i // 16 * 16
                    siblings += [d for j, d in enumerate(below[first : first + 16], first) if j != i]
                    i //= 16
            own = trees[s][0][place]
            if zlib.crc32(str("" if row[0] is None else row[0]).encode()) % 5 == 0:
                text = None if row[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
                own = leaf(row, text)
            subroot = levels([own if j == place else d for j, d in enumerate(trees[s][0])])[-1][0]
            folded = levels([subroot if j == rank else d for j, d in enumerate(top[0])])[-1][0]
            root = top[-1][0]
            out.append((row[0], trees[s][0][place], trees[s][-1][0], root, digest("".join(siblings)), folded, folded == root))
    return sorted(out, key=repr)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA)
    return merkle.manifest(docs, remainder("doc_id", 5) == 0, merkle.lowered(F.col("text")))


def results(found):
    return sorted(((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found.collect()), key=repr)


TEXTS = ["Hello World", "É A", "lower", "", None, "Z" * 50_000]
AWKWARD = [(i, s, lang, n, t) for i, (s, lang, n, t) in enumerate((s, lang, n, t) for s in (None, "", "a", "B", "é") for lang, n in (("en", 3), (None, None)) for t in TEXTS)]


@pytest.mark.parametrize(
    "rows",
    [
        AWKWARD + AWKWARD[:7] + [(None, "a", "en", 1, "X"), (None, None, None, None, None), (3, "a", "en", 2, "Y"), (3, "a", "en", 2, "Z")],
        [(5, "only", "en", 1, "One")],
        [(i, "s", "en", 1, f"Text {i}") for i in range(16)] + [(i, "t", "en", 1, "same") for i in range(17)],
        [(7, "s", "en", 1, "Same row")] * 40,
    ],
    ids=["awkward", "one leaf", "full run", "equal rows"],
)
def test_like_the_plain_version(spark, rows):
    assert results(run(spark, rows)) == plain(rows)


def test_several_rounds_of_blocks(spark, monkeypatch):
    """More than 256 leaves to a group and 256 groups, so that both trees are grown and descended in rounds."""
    rows = [(i, "hot" if i % 3 else f"s{i}", "en", i, f"Text {i}") for i in range(1200)]
    assert results(run(spark, rows)) == plain(rows)


def test_versions_share_all_but_the_copied_nodes(spark):
    rows = [(i, "a" if i % 2 else "b", "en", i, f"Text {i}") for i in range(600)]
    found = run(spark, rows).collect()
    for r in found:
        if r.copies is None:
            assert r.verified and r.folded_root == r.root
            continue
        trees = [(c["tree"], c["level"], c["index"]) for c in r.copies]
        assert trees == [("group", n, r.place // 16**n) for n in (1, 2, 3)] + [("manifest", 1, 0)]
        assert r.copies[-1].digest == r.folded_root and not r.verified
    base = {(r.grp, r.place): r.leaf for r in found}
    one = next(r for r in found if r.copies)
    first = one.place // 16 * 16
    altered = leaf((one.id, one.grp, "en", one.id), f"text {one.id}")
    children = [altered if p == one.place else base[one.grp, p] for p in range(first, min(first + 16, 300))]
    assert one.copies[0].digest == digest("".join(children))


def test_empty_table(spark):
    assert run(spark, [(1, "a", "en", 1, "x")]).limit(0).count() == 0
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(docs, remainder("doc_id", 5) == 0, merkle.lowered(F.col("text"))).count() == 0

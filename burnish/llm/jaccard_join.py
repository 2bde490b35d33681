"""Similarity join of documents by the Jaccard measure of their word shingles, with adaptive multi-match prefixes.

Order the shingles of every document alike. Two documents of similarity ``t`` or more share ``k`` shingles at least
among the first ``n - ceil(t * n) + k`` of each, for any ``k``: a longer prefix asks for more matches. The join goes

1. over *sets*: documents with the same set are one node from here on (their set's hash), so copies meet only there;
2. a document filter: prefixes in hash order of the length for ``k = n / 8``. A node stays if enough of the shingles in
   its prefix occur in other nodes too. That costs one shuffle of three eighths of the shingles, and leaves the nodes
   that may have a partner, with their whole sets;
3. the join proper, among those: shingles ordered by how rare they are; each node takes the ``k`` of the smallest
   estimated cost, which is the rows it will meet (the frequencies in its prefix), and the candidates to verify (at
   most these rows divided by ``k``, as each needs ``k`` matches), times its size. Two nodes are candidates if they
   share as many prefix shingles as the smaller of their two ``k``. Of two nodes, the smaller has at least
   ``2t / (1 + t)`` of its shingles in common with the other, so a shorter prefix will do for it (``heads``).

Large groups of near copies would be all pairs. So the join runs twice: first every node is compared with one other
only, and what is verified is contracted to components; then only nodes of different components are paired, all of them. No link between components can be missed by that, and links within one change nothing.

Frequent shingles (in ``FREQUENT`` of the documents) are found by counts per block of documents; they are at most
shingles per document divided by FREQUENT, so they are broadcast, counted on the spot and never gathered in a task.

Defined results: null and empty texts have no shingles and no links. Rows that share an id are documents of their own,
which may be in components of their own; a null id is no component's name unless all its ids are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.llm.common import SMALL_BATCH_BYTES, attach, col, fresh, in_python, is_small, query, row_hash, settle, table, without
from burnish.llm.components import components
from burnish.llm.shingles import forget_powers, portions, shingle_sets

WORDS = 5
#: Similarity, as a fraction of whole numbers so that no rounding decides.
PART, WHOLE = 75, 100
FREQUENT = 0.005
#: Documents per block that frequent shingles are looked for in.
BLOCK = 2000
#: Nodes per row of the second join: larger groups go in several rows.
CHUNK = 400
#: Pairs of components that one shingle may give as rows; with more, its nodes are compared in blocks.
CROWD = 64


def least_overlap(n):
    """Shingles that a document of ``n`` shares with any similar one, at least."""
    return -(-n * PART // WHOLE)


def least_overlap_of_smaller(n):
    """The same, with documents that are no smaller."""
    return -(-n * 2 * PART // (WHOLE + PART))


def filter_matches(n):
    """Matches that the document filter's prefix allows for."""
    return np.maximum(1, n // 8)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.Array, list[np.ndarray], list[bytes]]]:
    """Per portion of documents: their ids, shingles, and the 16 bytes that stand for each set."""
    try:
        for batch in batches:
            texts = [t.as_py().encode() for t in batch.column("text")]
            for a, b in portions(texts):
                sets = shingle_sets(texts[a:b], words)
                yield batch.column("doc_id")[a:b], sets, [hashlib.md5(s.tobytes()).digest() for s in sets]
    finally:
        forget_powers()


def _node(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True)


def survey(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, n, node) of the documents, and rows (shingle, seen) of shingles frequent in a block of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[int, np.ndarray] = {}

        def frequent():
            found, seen = np.unique(np.concatenate([*block.values(), np.zeros(0, np.uint64)]), return_counts=True)
            often = seen >= max(4, FREQUENT * len(block))
            return rows(shingle=found[often].view(np.int64), seen=seen[often])

        def rows(doc_id=(), n=(), node=(), shingle=(), seen=()):
            size = max(len(doc_id), len(shingle))
            fill = lambda x: pa.array(x, pa.int64()) if len(x) else pa.nulls(size, pa.int64())
            columns = [fill(x) for x in (doc_id, n, node, shingle, seen)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "node", "shingle", "seen"])

        for ids, sets, keys in _sets(batches, words):
            nodes = [_node(k) for k in keys]
            yield rows(ids.to_pylist(), [len(s) for s in sets], nodes)
            block.update(zip(nodes, sets, strict=True))
            if len(block) >= BLOCK:
                yield frequent()
                block.clear()
        yield frequent()

    return settle(in_python(docs, run, "doc_id long, n long, node long, shingle long, seen long", SMALL_BATCH_BYTES))


def shingle_rows(docs: DataFrame, words: int, frequent, prefix: bool) -> DataFrame:
    """Per document with shingles: node, n, its shingles, without the frequent ones, and how many of these it has.

    ``prefix`` keeps the first in hash order only, as the document filter needs them; otherwise all are given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for _, sets, keys in _sets(batches, words):
            out = [(s, _node(k)) for s, k in zip(sets, keys, strict=True) if len(s)]
            sizes = [len(s) for s, _ in out]
            if prefix:
                out = [(s[: n - least_overlap(n) + int(filter_matches(n))], k) for (s, k), n in zip(out, sizes, strict=True)]
            common = [0] * len(out)
            if prefix and len(known):
                at = [np.isin(s, known) for s, _ in out]
                common, out = [int(a.sum()) for a in at], [(s[~a], k) for (s, k), a in zip(out, at, strict=True)]
            columns = [pa.array([k for _, k in out], pa.int64()), pa.array(sizes, pa.int64()), pa.array(common, pa.int64())]
            lists = pa.array([s.view(np.int64) for s, _ in out], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, lists], ["node", "n", "common", "shingles"])

    return in_python(docs, run, "node long, n long, common long, shingles array<long>", SMALL_BATCH_BYTES)


def may_have_partner(docs: DataFrame, words: int, frequent) -> DataFrame:
    """The document filter: nodes of whose prefix enough shingles occur in other nodes."""
    prefixes = shingle_rows(docs, words, frequent, prefix=True)
    rows = prefixes.select("node", "n", "common", F.explode_outer("shingles").alias("shingle"))
    shared = F.expr("count(1) OVER (PARTITION BY shingle)") > 1
    met = rows.where("shingle IS NOT NULL").withColumn("met", shared.cast("long")).where("met = 1").select("node", "n", "met")
    # Frequent shingles stayed with their document: they count without being gathered.
    common = prefixes.where("common > 0").select("node", "n", F.col("common").alias("met"))
    partner = F.ceil(F.col("n") * PART / WHOLE).cast("long")
    enough = F.greatest(F.lit(1), F.floor(partner / 8)).cast("long")
    counted = met.unionByName(common).groupBy("node", "n").agg(F.sum("met").alias("met"))
    return counted.where(F.col("met") >= enough).select("node")


def prefixes(sets: DataFrame) -> DataFrame:
    """Of the nodes' sets (node, n, shingles): rows (shingle, node, n, k, head) of the prefixes, without shingles of one
    node. ``head`` tells those in the shorter prefix, where the smaller node of a pair has its matches."""
    rows = sets.select("node", F.explode("shingles").alias("shingle"))
    frequency = settle(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    met = attach(rows, frequency, "shingle", "df", sets.agg(F.sum("n")).first()[0] or 0).where("df IS NOT NULL")
    grouped = met.groupBy("node").agg(F.collect_list(F.struct("df", "shingle")).alias("shared"))
    whole = grouped.join(sets.select("node", "n"), "node").select("node", "n", F.col("shared.df").alias("df"), F.col("shared.shingle").alias("shingles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, n, df, shingles in zip(*(batch.column(i) for i in range(4)), strict=True):
                node, n = node.as_py(), n.as_py()
                df, shingles = df.values.to_numpy(), shingles.values.to_numpy()
                order = np.lexsort((shingles, df))
                take, k = choose(n, df[order])
                head = least_overlap(n) - least_overlap_of_smaller(n) + take
                middle = int(1000 * np.log2(df).sum() / n)
                out.append((shingles[order][:take], node, n, k, np.arange(take) < head, middle))
            lengths = [len(o[0]) for o in out]
            flat = lambda i, out=out, lengths=lengths: np.repeat(np.array([o[i] for o in out], np.int64), lengths)
            both = [np.concatenate([*(o[i] for o in out), np.zeros(0, np.int64)]).astype(np.int64) for i in (0, 4)]
            columns = [both[0], flat(1), flat(2), flat(3), both[1] == 1, flat(5)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "node", "n", "k", "head", "middle"])

    return in_python(whole, run, "shingle long, node long, n long, k long, head boolean, middle long", SMALL_BATCH_BYTES)


def choose(n: int, df: np.ndarray) -> tuple[int, int]:
    """How many of a node's shared shingles, rarest first, make its prefix, and the matches it asks for.

    ``df`` has the frequencies of the shared ones, ascending; the other ``n - len(df)`` come before them in the order.
    """
    k = np.unique(np.minimum(2 ** np.arange(12), max(1, least_overlap(n))))
    take = np.maximum(0, n - least_overlap(n) + k - (n - len(df)))
    take = np.minimum(take, len(df))
    rows = np.concatenate([[0], np.cumsum(df - 1)])[take]
    cost = rows + rows / k * n
    best = int(np.argmin(cost))
    return int(take[best]), int(k[best])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes that are similar, judged by their whole sets."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("shingles").alias(f"set_{name}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return met.where(WHOLE * both >= PART * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def _close(a: str, b: str) -> F.Column:
    """Whether two sizes allow the similarity."""
    return (F.least(a, b) * WHOLE >= F.greatest(a, b) * PART)


def _smaller(a: str, b: str) -> F.Column:
    """Whether node ``a`` (struct of n, node) comes before ``b`` by size."""
    return (F.col(f"{a}.n") < F.col(f"{b}.n")) | ((F.col(f"{a}.n") == F.col(f"{b}.n")) & (F.col(f"{a}.node") < F.col(f"{b}.node")))


def star_pairs(prefix: DataFrame) -> DataFrame:
    """Each node with one that has many shingles in common with it: the candidates (a, b) of the first join.

    For every shingle only the smallest node with it in its head is looked at, so there are no more rows than shingles.
    """
    hub = F.max(F.struct("middle", "n", "node")).alias("hub")
    hubs = settle(prefix.groupBy("shingle").agg(hub, F.count(F.lit(1)).alias("size")).where("size > 1"))
    met = attach(prefix, hubs, "shingle", "size", prefix.count()).where("hub.node <> node")
    pairs = met.select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.n").alias("n_a"), "n")
    near = pairs.where(_close("n_a", "n")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("matches"))
    return near.groupBy("b").agg(F.max_by("a", F.struct("matches", "a")).alias("a")).select("a", "b")


def cross_links(prefix: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between different components: all of them, or of many between the same components one at least."""
    labelled = prefix.join(F.broadcast(labels) if is_small(labels) else labels, "node", "left")
    labelled = settle(labelled.withColumn("label", F.coalesce("label", "node")))
    by_label = labelled.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("rows"), F.max("head").cast("long").alias("head"))
    mixed = by_label.groupBy("shingle").agg(F.sum("rows").alias("size"), F.count(F.lit(1)).alias("groups"), F.sum("head").alias("heads"))
    mixed = settle(mixed.where("groups > 1 AND heads > 0").withColumn("crowded", F.col("groups") * F.col("heads") > CROWD))
    rows = settle(attach(labelled, mixed, "shingle", "size", prefix.count()).where("size IS NOT NULL"))
    return verify(cross_pairs(rows.where("NOT crowded")), sets).unionByName(crowd_links(rows.where("crowded"), sets))


def cross_pairs(rows: DataFrame) -> DataFrame:
    """All candidates (a, b) of different components, the smaller node first."""
    part = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("size") / CHUNK)).cast("long")).alias("part")
    side = lambda df, s: df.groupBy("shingle", F.col("label").alias(f"label_{s}"), part).agg(F.collect_list(F.struct("n", "node", "k")).alias(f"nodes_{s}"))
    one, two = side(rows.where("head"), "a").drop("part"), side(rows, "b").drop("part")
    met = one.join(two, "shingle").where("label_a <> label_b").select(F.explode("nodes_a").alias("x"), "nodes_b")
    pairs = met.select("x", F.explode("nodes_b").alias("y")).where(_smaller("x", "y") & _close("x.n", "y.n"))
    named = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.least("x.k", "y.k").alias("k"))
    return named.groupBy("a", "b", "k").agg(F.count(F.lit(1)).alias("matches")).where("matches >= k").select("a", "b")


def crowd_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the nodes of shingles that too many components share to pair them row by row.

    Such nodes are compared in blocks: all that hang together by these shingles make a crowd, which is dealt to blocks of
    some CHUNK nodes; two blocks are compared at once by multiplying their incidence matrices, and give a link for each
    two components that have one, as a forest. So rows grow with the blocks, not with the pairs.
    """
    rows = settle(rows.select("shingle", "node", "label", "n"))
    if rows.isEmpty():
        # Of the empty rows, as a table made in Python would start a second set of Python workers in every executor.
        return rows.select(F.col("node").alias("a"), F.col("label").alias("b"))
    hubs = rows.groupBy("shingle").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("size"))
    joined = attach(rows, settle(hubs), "shingle", "size", rows.count()).select("a", F.col("node").alias("b")).distinct()
    crowds = components(joined).withColumnRenamed("label", "crowd")
    crowds = settle(crowds.join(rows.select("node", "label").distinct(), "node"))
    sizes = settle(crowds.groupBy("crowd").agg(F.count(F.lit(1)).alias("size")))
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / CHUNK).cast("long"))
    dealt = attach(crowds, sizes, "crowd", "size", crowds.count()).withColumn("block", block)
    whole = dealt.join(sets, "node").select("crowd", "block", F.struct("node", "label", "n", "shingles").alias("member"))
    blocks = settle(whole.groupBy("crowd", "block").agg(F.collect_list("member").alias("members")))
    one = blocks.select("crowd", F.col("block").alias("block_a"), F.col("members").alias("members_a"))
    two = blocks.select("crowd", F.col("block").alias("block_b"), F.col("members").alias("members_b"))
    pairs = one.join(two, "crowd").where("block_a <= block_b").select("members_a", "members_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = block_links(_members(batch.column(0)[i]), _members(batch.column(1)[i]))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return in_python(pairs, run, "a long, b long")


def _members(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, labels, sizes, shingles one after the other, and the row of each shingle."""
    members = block.values
    node, label, n = (members.field(c).to_numpy() for c in ("node", "label", "n"))
    lists = members.field("shingles")
    return node, label, n, lists.flatten().to_numpy(), np.repeat(np.arange(len(node)), lists.value_lengths().to_numpy())


def block_links(left, right, columns: int = 4096) -> tuple[list[int], list[int]]:
    """Links between nodes of two blocks that connect all components that any of their similar pairs does."""
    both = np.intersect1d(left[3], right[3])
    overlap = np.zeros((len(left[0]), len(right[0])), np.float32)
    for i in range(0, len(both), columns):
        part = both[i : i + columns]
        matrices = []
        for _, _, n, shingles, row in (left, right):
            at = np.searchsorted(part, shingles)
            hit = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == shingles)
            m = np.zeros((len(n), len(part)), np.float32)
            m[row[hit], at[hit]] = 1
            matrices.append(m)
        overlap += matrices[0] @ matrices[1].T
    overlap = overlap.astype(np.int64)
    similar = WHOLE * overlap >= PART * (left[2][:, None] + right[2][None] - overlap)
    similar &= left[1][:, None] != right[1][None]
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    a, b = [], []
    for x, y in zip(*np.nonzero(similar), strict=True):
        p, q = find(int(left[1][x])), find(int(right[1][y]))
        if p != q:
            parent[p] = q
            a.append(int(left[0][x]))
            b.append(int(right[0][y]))
    return a, b


def link(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, n, node), and the components of the linked nodes (node, label)."""
    texts = _texts(docs, id_col, text_col)
    spark = docs.sparkSession
    surveyed = survey(texts, words)
    rows = surveyed.where("node IS NOT NULL").select("doc_id", "n", "node")
    nodes = settle(rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size")))
    often = surveyed.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("seen").alias("seen"))
    often = often.where(F.col("seen") >= max(4, FREQUENT * nodes.count()))
    frequent = spark.sparkContext.broadcast(np.array([r[0] for r in often.select("shingle").toLocalIterator()], np.int64).view(np.uint64))
    # One document of each node is enough; ids that name a node elsewhere stay, which only repeats it.
    copies = rows.where("n > 0").join(nodes.select(F.col("first_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")
    distinct = without(texts, settle(copies.where("doc_id IS NOT NULL").distinct()), "doc_id")
    partners = settle(may_have_partner(distinct, words, frequent).distinct())
    ids = settle(nodes.join(partners, "node", "left_semi").select(F.col("first_id").alias("partner_id")))
    side = F.broadcast(ids) if is_small(ids) else ids
    chosen = distinct.join(side, F.col("doc_id").eqNullSafe(F.col("partner_id")), "left_semi")
    sets = settle(shingle_rows(chosen, words, frequent, prefix=False).join(F.broadcast(partners) if is_small(partners) else partners, "node", "left_semi").dropDuplicates(["node"]).drop("common"))
    prefix = settle(prefixes(sets))
    links = settle(verify(star_pairs(prefix), sets))
    labels = components(links)
    more = settle(cross_links(prefix, labels, sets))
    return rows, components(links.unionByName(more))


def near_duplicates(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    rows, labels = link(docs, words, id_col, text_col)
    nodes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size"))
    named = settle(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    heads = named.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("nodes"), F.sum("size").alias("members"))
    heads = settle(heads.where("members > 1").select("label", "component_id", "nodes"))
    total = rows.count()
    of_node = settle(attach(named, heads, "label", "nodes", total).where("component_id IS NOT NULL").select("node", "component_id", "size"))
    met = attach(rows, of_node, "node", "size", total)
    return met.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the document of the smallest id of each component; all columns as they were.

    Where ids are null or repeated, rows are numbered in their order, null ids last, and judged by these numbers.
    """
    odd = docs.groupBy(col(id_col).alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("doc_id IS NULL OR n > 1")
    if not odd.isEmpty():
        number = fresh(docs, "row_number")
        ordered = docs.orderBy(col(id_col).asc_nulls_last(), row_hash(docs))
        docs = settle(ordered.withColumn(number, F.monotonically_increasing_id()))
        found = settle(near_duplicates(docs, id_col=number, text_col=text_col).where("component_id <> doc_id").select("doc_id"))
        return without(docs, found, number).drop(number)
    found = settle(near_duplicates(docs, id_col=id_col, text_col=text_col).where("component_id <> doc_id").select("doc_id"))
    return without(docs, found, id_col)


ORACLE = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
s AS (
    SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM d WHERE len(words) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
    SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id
FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""


@query("op6_jaccard_join", ORACLE)
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

"""A Merkle manifest of a dataset, and versions of it that share all nodes but one path.

Every row is a leaf: the SHA-256 of its fields. The leaves of a group, in order, form a tree whose nodes hash up to
``FANOUT`` children; the roots of the groups form the tree of the manifest in the same way.

* Places: rows are sorted by range over the whole table, so that a group, however large, lies in many tasks. What is
  counted is one row per group and task, and gives each row its place in its group.
* Blocks: a tree is cut into aligned blocks of ``BLOCK`` leaves, the rows of one table. A task grows one block at a time;
  the blocks' roots are the leaves of the next round, which is cut likewise, until each group has one root.
* Versions: a tampered leaf makes a version of the tree. Its block is not rebuilt: only the ancestors of the leaf are
  copied, each from its children with one of them replaced, and everything else is shared with the original. Above the
  block the version goes on with the children along the way up, which descend from the root to the blocks, one row a
  block. So every version is made where its leaf is, and no task meets the versions of a whole tree.

A node's digest is the SHA-256 in lower-case hex of its children's digests, concatenated as hex text.

Defined results: a null field is ``-``. Rows ascend by id, null first, and then by leaf; rows that are equal in all fields
are leaves beside each other. A null group is a group of its own and comes first. A null id counts as empty text where
tampering is decided. An empty table has no leaves, and gives no rows. Columns that are no fields play no part, whatever
their names.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from burnish.llm.common import col, in_python, query, settle, table
from burnish.llm.language import remainder

FANOUT = 16
#: Levels of a block, and the leaves that make it: a row of some 20 KB.
BLOCK_LEVELS = 2
BLOCK = FANOUT**BLOCK_LEVELS

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "array<struct<before: string, after: string>>"


def _arrow(spelled: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(spelled))


def joined_digest(parts: Sequence[str]) -> str:
    """The digest of a node: of its children's digests as hex text."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(values: Sequence[Column]) -> Column:
    """The digest of a row, 32 bytes: each value is its length in bytes, a colon and itself, or a dash for null."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case, all else as it is."""
    return F.translate(text.cast("string"), string.ascii_uppercase, string.ascii_lowercase)


def placed(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place``, counted from 0 in the order within the group (nulls first), and ``size`` of the group."""
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    sort = [F.col(c).asc_nulls_first() for c in (group, *order, "tie")]
    # A number that rises through the sorted table and names the task it was given by.
    ranged = tied.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("tie")
    numbered = settle(ranged.withColumn("row", F.monotonically_increasing_id())).withColumn("part", F.shiftright("row", 33))
    runs = settle(numbered.groupBy(F.col(group).alias("of"), F.col("part").alias("at")).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")))
    whole, before = Window.partitionBy("of"), Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        "of", "at", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size")
    )
    met = numbered.join(starts, F.col(group).eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    return met.withColumn("place", F.col("row") + F.col("shift")).drop("of", "at", "part", "row", "shift")


def grown(digests: list[str], whole: bool) -> list[list[str]]:
    """All levels over the digests of a block: up to one node if the tree has no other block, else BLOCK_LEVELS."""
    levels = [digests]
    while len(levels[-1]) > 1 if whole else len(levels) <= BLOCK_LEVELS:
        below = levels[-1]
        levels.append([joined_digest(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return levels


def way_up(levels: list[list[str]], place: int) -> list[tuple[str, str]]:
    """Per level, from below, what stands before and after the node on the way from a leaf to the root of the block."""
    way = []
    for below in levels[:-1]:
        first = place // FANOUT * FANOUT
        way.append(("".join(below[first:place]), "".join(below[place + 1 : first + FANOUT])))
        place //= FANOUT
    return way


def copied_path(leaf: str, way: Sequence[tuple[str, str]]) -> list[str]:
    """The copies of a leaf's ancestors in the version in which the leaf is as given; the last one is its root."""
    copies = []
    for before, after in way:
        leaf = joined_digest((before, leaf, after))
        copies.append(leaf)
    return copies


def _blocks(members: DataFrame) -> DataFrame:
    """Rows (grp, block, size, digests, ids, altered), one per BLOCK members (grp, place, size, digest, id, altered)."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "digest", "id", "altered")))
    gathered = members.groupBy("grp", "size", F.expr(f"place div {BLOCK}").alias("block")).agg(ordered.alias("m"))
    return settle(gathered.select("grp", "block", "size", *[F.col(f"m.{c}").alias(n) for c, n in (("digest", "digests"), ("id", "ids"), ("altered", "altered"))]))


def _roots(blocks: DataFrame) -> DataFrame:
    """Rows (grp, block, size, digest): the root of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("digests").to_pylist(), batch.column("size").to_pylist(), strict=True)
            found = [bytes.fromhex(grown([d.hex() for d in digests], size <= BLOCK)[-1][0]) for digests, size in rows]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("grp", "block", "size")), pa.array(found, pa.binary())], ["grp", "block", "size", "digest"])

    kind = blocks.schema["grp"].dataType.simpleString()
    return settle(in_python(blocks.select("grp", "block", "size", "digests"), run, f"grp {kind}, block long, size long, digest binary"))


@dataclass
class Trees:
    """One tree per group: its blocks in rounds from the leaves up, and rows (grp, digest) with the roots."""

    rounds: list[DataFrame]
    roots: DataFrame

    @classmethod
    def over(cls, members: DataFrame) -> Trees:
        """The trees over rows (grp, place, size, digest, id, altered); id and altered are carried along."""
        rounds, roots = [_blocks(members)], None
        while True:
            found = _roots(rounds[-1])
            done = found.where(F.col("size") <= BLOCK).select("grp", "digest")
            roots = done if roots is None else roots.unionByName(done)
            rest = found.where(F.col("size") > BLOCK)
            if rest.isEmpty():
                return cls(rounds, roots)
            size = F.expr(f"(size + {BLOCK - 1}) div {BLOCK}")
            rounds.append(_blocks(rest.select("grp", F.col("block").alias("place"), size.alias("size"), "digest", F.lit(None).cast("int").alias("id"), F.lit(None).cast("binary").alias("altered"))))

    def met(self, tops: DataFrame) -> DataFrame:
        """The blocks of the leaves with ``upper``, the way from their root to the very top, and all columns of ``tops``.

        ``tops`` has a row (grp, upper, ...) per group. It descends round by round: one row goes to each block.
        """
        for blocks in reversed(self.rounds):
            single = blocks.where(F.col("size") <= BLOCK).select("grp", "block")
            to_single = single.join(tops.withColumnRenamed("grp", "of"), F.col("grp").eqNullSafe(F.col("of"))).drop("of")
            ways = to_single if blocks is self.rounds[-1] else to_single.unionByName(below)  # noqa: F821
            ways = ways.withColumnsRenamed({"grp": "of", "block": "at"})
            met = blocks.join(ways, F.col("grp").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))).drop("of", "at")
            if blocks is self.rounds[0]:
                return met
            below = self._descended(met, tops)

    @staticmethod
    def _descended(met: DataFrame, tops: DataFrame) -> DataFrame:
        """The way up of every member of the blocks, each of which is the root of a block a round further down."""
        carried = [c for c in tops.columns if c not in ("grp", "upper")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    levels = grown([d.hex() for d in row["digests"]], row["size"] <= BLOCK)
                    above = [(s["before"], s["after"]) for s in row["upper"]]
                    places = range(len(row["digests"]))
                    ways = [[{"before": b, "after": a} for b, a in way_up(levels, i) + above] for i in places]
                    columns = {
                        "grp": [row["grp"]] * len(places),
                        "block": [row["block"] * BLOCK + i for i in places],
                        "upper": ways,
                        **{c: [row[c]] * len(places) for c in carried},
                    }
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

        kind = {f.name: f.dataType.simpleString() for f in met.schema}
        fields = {"grp": kind["grp"], "block": "bigint", "upper": _UPPER, **{c: kind[c] for c in carried}}
        spelled = ", ".join(f"{n} {t}" for n, t in fields.items())
        schema = _arrow(spelled)
        return settle(in_python(met.select("grp", "block", "size", "digests", "upper", *carried), run, spelled))


def manifest(docs: DataFrame, tampered: Column, altered: Column, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, grp, place, leaf, subroot, root, proof_sha256, folded_root, verified and copies.

    Where ``tampered`` holds, the text is replaced by ``altered`` in a version of its own. ``proof_sha256`` is the digest
    of the siblings on the way from the untampered leaf to the root. ``folded_root`` is the root of the row's version (or,
    untampered, what its leaf and siblings give), ``verified`` whether that is the root. ``copies`` are the nodes copied
    for the version, null where there is none: (tree, level, index, digest), tree being ``group`` or ``manifest``.
    """
    values = [col(f) for f in fields]
    changed = [altered if f == text_col else v for f, v in zip(fields, values, strict=True)]
    rows = docs.select(
        col(group_col).alias("grp"), col(id_col).alias("id"), leaf_digest(values).alias("digest"), F.when(tampered, leaf_digest(changed)).alias("altered")
    )
    trees = Trees.over(placed(rows, "grp", ["id", "digest"]))
    nothing = F.lit(None).cast("binary")
    subroots = trees.roots.select(F.lit(0).alias("one"), F.col("grp").alias("id"), "digest", nothing.alias("altered"))
    above = Trees.over(placed(subroots, "one", ["id"]).withColumnRenamed("one", "grp"))
    top = above.roots.select("grp", F.array().cast(_UPPER).alias("upper"), "digest").withColumnRenamed("digest", "root")
    tops = _tops(above.met(top), rows.schema["grp"].dataType.simpleString())
    return _proved(trees.met(tops))


def _tops(met: DataFrame, kind: str) -> DataFrame:
    """Rows (grp, upper, subroot, root, rank) per group, from the blocks of the tree of the manifest."""
    spelled = f"grp {kind}, upper {_UPPER}, subroot binary, root binary, rank bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = grown([d.hex() for d in row["digests"]], row["size"] <= BLOCK)
                above = [(s["before"], s["after"]) for s in row["upper"]]
                found = [
                    {"grp": g, "subroot": d, "root": row["root"], "rank": row["block"] * BLOCK + i, "upper": [{"before": b, "after": a} for b, a in way_up(levels, i) + above]}
                    for i, (g, d) in enumerate(zip(row["ids"], row["digests"], strict=True))
                ]
                yield pa.RecordBatch.from_pylist(found, schema)

    schema = _arrow(spelled)
    return settle(in_python(met, run, spelled))


def _proved(met: DataFrame) -> DataFrame:
    """The rows of all blocks with their proofs and versions."""
    kinds = {f.name: f.dataType.simpleString() for f in met.schema}
    copies = "array<struct<tree: string, level: int, index: bigint, digest: string>>"
    id_kind = kinds["ids"].removeprefix("array<").removesuffix(">")
    spelled = (
        f"id {id_kind}, grp {kinds['grp']}, place bigint, leaf string, subroot string, root string, proof_sha256 string, "
        f"folded_root string, verified boolean, copies {copies}"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = grown([d.hex() for d in row["digests"]], row["size"] <= BLOCK)
                above = [(s["before"], s["after"]) for s in row["upper"]]
                height = sum(1 for _ in _heights(row["size"]))
                root, subroot, out = row["root"].hex(), row["subroot"].hex(), []
                for i, (name, altered) in enumerate(zip(row["ids"], row["altered"], strict=True)):
                    leaf, way, place = levels[0][i], way_up(levels, i) + above, row["block"] * BLOCK + i
                    path = copied_path(leaf if altered is None else altered.hex(), way)
                    folded = path[-1] if path else (leaf if altered is None else altered.hex())
                    versioned = None if altered is None else [_node(d, n + 1, height, place, row["rank"]) for n, d in enumerate(path)]
                    proof = joined_digest([s for pair in way for s in pair])
                    out.append((name, row["grp"], place, leaf, subroot, root, proof, folded, folded == root, versioned))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    schema = _arrow(spelled)
    return in_python(met, run, spelled)


def _heights(size: int) -> Iterator[int]:
    """The sizes of the levels above a level of ``size`` nodes."""
    while size > 1:
        size = -(-size // FANOUT)
        yield size


def _node(digest: str, level: int, height: int, place: int, rank: int) -> dict[str, object]:
    """A copied node by its address: in the tree of its group, or above that in the manifest's."""
    inside = level <= height
    level, start = (level, place) if inside else (level - height, rank)
    return {"tree": "group" if inside else "manifest", "level": level, "index": start // FANOUT**level, "digest": digest}


_CRC32 = """xor(list_reduce(list_transform(range(length({0})), lambda i: ascii({0}[CAST(i + 1 AS BIGINT)])::BIGINT), lambda acc, b:
  list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(acc, b)), 4294967295), 4294967295)"""
_FIELDS_SQL = " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in FIELDS)
_LOWERED_SQL = _FIELDS_SQL.replace("CAST(text AS VARCHAR)", f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")

ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, sha256({_FIELDS_SQL}) AS leaf,
    CASE WHEN {_CRC32.format("coalesce(CAST(doc_id AS VARCHAR), '')")} % 5 = 0 THEN sha256({_LOWERED_SQL}) END AS altered
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS n FROM d),
nodes AS (
  SELECT source, 0 AS level, idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY source, level, n, idx // 16),
subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, idx, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, n, idx // 16),
up AS (
  SELECT row, source, 0 AS level, idx, n, coalesce(altered, leaf) AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT w.row, w.source, w.level + 1, w.idx // 16, (w.n + 15) // 16,
    sha256(string_agg(CASE WHEN s.idx = w.idx THEN w.folded ELSE s.digest END, '' ORDER BY s.idx)),
    w.proof || coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (WHERE s.idx <> w.idx), '')
  FROM up w JOIN nodes s ON s.source IS NOT DISTINCT FROM w.source AND s.level = w.level AND s.idx // 16 = w.idx // 16
  WHERE w.n > 1 GROUP BY w.row, w.source, w.level, w.idx, w.n, w.folded, w.proof),
on_top AS (
  SELECT w.row, 0 AS level, s.idx, s.n, w.folded, w.proof FROM up w JOIN subroots s ON s.source IS NOT DISTINCT FROM w.source WHERE w.n = 1
  UNION ALL
  SELECT w.row, w.level + 1, w.idx // 16, (w.n + 15) // 16,
    sha256(string_agg(CASE WHEN s.idx = w.idx THEN w.folded ELSE s.digest END, '' ORDER BY s.idx)),
    w.proof || coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (WHERE s.idx <> w.idx), '')
  FROM on_top w JOIN tops s ON s.level = w.level AND s.idx // 16 = w.idx // 16
  WHERE w.n > 1 GROUP BY w.row, w.level, w.idx, w.n, w.folded, w.proof)
SELECT l.doc_id, l.leaf, s.subroot, t.digest AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = t.digest AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN on_top w ON w.row = l.row AND w.n = 1, tops t WHERE t.n = 1
"""


@query("op13_merkle_manifest", ORACLE)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = manifest(docs, remainder("doc_id", 5) == 0, lowered(F.col("text")))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")

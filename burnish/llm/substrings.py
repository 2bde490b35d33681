"""Removal of repeated word sequences by the repeated edges of a De Bruijn graph of the corpus.

A window of ``SPAN`` words is an edge, between the words it begins and ends with. Edges that occur more than once are
the graph. It is built and followed in steps, each a Spark job over less than the one before:

1. Anchors. Of the runs of ``ANCHOR`` words in a window, that of the smallest hash is its anchor; neighbouring windows
   mostly share it, so there are some six times fewer anchors than windows. Equal windows have equal anchors: an
   anchor that occurs once proves its windows single. Counting anchors finds the documents, and their parts, that matter.
2. Edges. Windows with repeated anchors are gathered by anchor, as stretches of consecutive windows. For each edge the
   source of an occurrence is the previous one in its document or else the very first; consecutive windows with
   consecutive sources make one row. Anchors that are very frequent go another way, so that no group is gathered: their
   edges are aggregated to first occurrences, which are sent or joined back.
3. Spans. Joined over anchors, the rows become spans of a document, each with source coordinates: runs of windows whose
   sources are consecutive. They take the place of path compaction, which removal does without. The graph's nonbranching
   paths, the stretches of source text that no span enters or leaves, can be had from them (``paths``).
4. Verification. The words at a span's coordinates and at its source's are hashed anew, with SHA-256, and compared by a
   join; a span that differs (two windows with the same 64-bit hash) is dropped before words are removed.

A window is judged on the input, so the word of a removed source stays a source.

Defined results: null and empty texts have no words. A null id is the smallest. Rows that share an id are judged as one
document's rows: a window at the same place of both is no earlier occurrence of itself. Repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.llm import common
from burnish.llm.common import attach, col, in_python, is_small, query, settle, table
from burnish.llm.shingles import Words, portions, windows, words_of

SPAN, ANCHOR = 20, 10
#: Windows that a task looks at together when it compares those of an anchor.
TOGETHER = 300_000
NO_ID = -(1 << 63)

KEY = ["doc_id", "text_key"]
OCCURRENCES = "doc_id long, text_key long, start long, n long, source_id long, source_key long, source_start long"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.coalesce(col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"))
    return found.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def anchored(words: Words, span: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per window: its first word, hash, anchor's hash and anchor's first word."""
    edges, at = windows(words, span)
    short, places = windows(words, anchor)
    every = np.zeros(len(words.hashes), np.uint64)
    every[places] = short
    best, where = every[at].copy(), at.copy()
    for i in range(1, span - anchor + 1):
        less = every[at + i] < best
        best[less] = every[at + i][less]
        where[less] = (at + i)[less]
    return at, edges, best, where


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        texts = [t.as_py().encode() for t in batch.column("text")]
        for a, b in portions(texts):
            yield batch.slice(a, b - a), words_of(texts[a:b])


def _longs(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns.values()], list(columns))


def anchors_of(texts: DataFrame, span: int, anchor: int) -> DataFrame:
    """Rows (doc_id, text_key, anchor, n): how often the anchor is one in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _portions(batches):
            _, _, hashes, where = anchored(words, span, anchor)
            first = np.unique(where, return_index=True)[1]
            owner = np.searchsorted(words.offsets, where[first], "right") - 1
            order = np.lexsort((hashes[first], owner))
            owner, hashes = owner[order], hashes[first][order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (hashes[1:] != hashes[:-1])])[: len(owner)])
            n = np.diff(np.concatenate([new, [len(owner)]]))
            ids, keys = (batch.column(c).to_numpy()[owner[new]] for c in KEY)
            yield _longs(doc_id=ids, text_key=keys, anchor=hashes[new], n=n)

    return in_python(texts, run, "doc_id long, text_key long, anchor long, n long")


def stretches(met: DataFrame, span: int, anchor: int) -> DataFrame:
    """Of documents with their repeated anchors: rows (anchor, doc_id, text_key, start, edges) of consecutive windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in _portions(batches):
            at, edges, hashes, _ = anchored(words, span, anchor)
            owner = np.searchsorted(words.offsets, at, "right") - 1
            keep = np.zeros(len(at), bool)
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            lists = batch.column("anchors")
            for i in range(batch.num_rows):
                part = slice(bounds[i], bounds[i + 1])
                keep[part] = np.isin(hashes[part], lists[i].values.to_numpy().view(np.uint64))
            at, edges, hashes, owner = at[keep], edges[keep], hashes[keep], owner[keep]
            if not len(at):
                continue
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(owner) != 0) | (hashes[1:] != hashes[:-1])]))
            raw, ends = edges.tobytes(), [*(cut[1:] * 8).tolist(), len(edges) * 8]
            blobs = pa.array([raw[a:b] for a, b in zip((cut * 8).tolist(), ends, strict=True)], pa.binary())
            ids, keys = (batch.column(c).to_numpy()[owner[cut]] for c in KEY)
            columns = [hashes[cut].view(np.int64), ids, keys, at[cut] - words.offsets[owner[cut]]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), blobs], ["anchor", *KEY, "start", "edges"])

    return in_python(met, run, "anchor long, doc_id long, text_key long, start long, edges binary")


def sources_of(edges, ids, keys, starts) -> tuple[np.ndarray, np.ndarray]:
    """Per occurrence of an edge whether it has an earlier one, and the number of its source."""
    order = np.lexsort((keys, starts, ids, edges))
    e, i, k, s = edges[order], ids[order], keys[order], starts[order]
    new = np.concatenate([[True], e[1:] != e[:-1]])[: len(e)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))
    again = (i != i[first]) | (s != s[first])
    before = np.concatenate([[0], np.arange(len(e) - 1)])[: len(e)]
    own = ~new & (i == i[before]) & (k == k[before]) & (s > s[before])
    source = np.where(own, before, first)
    has, out = np.zeros(len(e), bool), np.zeros(len(e), np.int64)
    has[order], out[order] = again, order[source]
    return has, out


def compare(anchors: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of stretches in the order of their anchors: repeated runs of windows with their sources (OCCURRENCES)."""

    def resolve(rows: list[tuple]) -> pa.RecordBatch:
        lengths = np.array([len(r[4]) // 8 for r in rows])
        edges = np.frombuffer(b"".join([r[4] for r in rows]), np.uint64)
        row = np.repeat(np.arange(len(rows)), lengths)
        ids, keys, begin = (np.array([r[c] for r in rows], np.int64)[row] for c in (1, 2, 3))
        starts = begin + np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        has, source = sources_of(edges, ids, keys, starts)
        at = np.flatnonzero(has)
        return _runs(row[at], ids[at], keys[at], starts[at], ids[source[at]], keys[source[at]], starts[source[at]])

    waiting, size, seen = [], 0, set()
    for batch in anchors:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= TOGETHER and row[0] != waiting[-1][0]:
                yield resolve(waiting)
                waiting, size, seen = [], 0, set()
            if row[:4] in seen:  # the same document, listed twice
                continue
            seen.add(row[:4])
            waiting.append(row)
            size += len(row[4]) // 8
    if waiting:
        yield resolve(waiting)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of stretches: the row, id, key, start and edge of every window."""
    blobs = batch.column("edges").to_pylist()
    lengths = np.array([len(b) // 8 for b in blobs], np.int64)
    row = np.repeat(np.arange(len(blobs)), lengths)
    ids, keys, begin = (batch.column(c).to_numpy()[row] for c in (*KEY, "start"))
    starts = begin + np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return row, ids, keys, starts, np.frombuffer(b"".join(blobs), np.int64)


def _runs(row, ids, keys, starts, s_ids, s_keys, s_starts) -> pa.RecordBatch:
    """Occurrences in order, those joined that continue each other in their row and at their source (OCCURRENCES)."""
    same = (np.diff(row) == 0) & (np.diff(starts) == 1) & (np.diff(s_starts) == 1) & (np.diff(s_ids) == 0) & (s_keys[1:] == s_keys[:-1])
    cut = np.flatnonzero(np.concatenate([[True], ~same])[: len(row)])
    n = np.diff(np.concatenate([cut, [len(row)]]))
    return _longs(doc_id=ids[cut], text_key=keys[cut], start=starts[cut], n=n, source_id=s_ids[cut], source_key=s_keys[cut], source_start=s_starts[cut])


def compare_frequent(rows: DataFrame) -> DataFrame:
    """The same for stretches of frequent anchors, without gathering an anchor's or an edge's occurrences.

    First occurrences are aggregated, after every batch has done so for itself. If the repeated edges are few enough they
    are sent to where the stretches are; otherwise occurrences are joined with them, edge by edge.
    """

    def first_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, ids, keys, starts, edges = _unpacked(batch)
            order = np.lexsort((keys, starts, ids, edges))
            e = edges[order]
            new = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]])[: len(e)])
            n = np.diff(np.concatenate([new, [len(e)]]))
            at = order[new]
            yield _longs(edge=e[new], doc_id=ids[at], start=starts[at], text_key=keys[at], n=n)

    seen = in_python(rows, first_of_batch, "edge long, doc_id long, start long, text_key long, n long")
    first = F.min(F.struct("doc_id", "start", "text_key")).alias("first")
    firsts = settle(seen.groupBy("edge").agg(first, F.sum("n").alias("size")).where("size > 1"))
    if not is_small(firsts):
        return _joined_with_first(rows, firsts)
    table = firsts.select("edge", "first.*").orderBy("edge").toPandas()
    known = rows.sparkSession.sparkContext.broadcast([table[c].to_numpy(np.int64) for c in ("edge", "doc_id", "start", "text_key")])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge, first_ids, first_starts, first_keys = known.value
        for batch in batches:
            row, ids, keys, starts, edges = _unpacked(batch)
            if not len(edge) or not len(edges):
                continue
            at = np.minimum(np.searchsorted(edge, edges), len(edge) - 1)
            again = (edge[at] == edges) & ((ids != first_ids[at]) | (starts != first_starts[at]))
            # An earlier occurrence in the same stretch makes the better source: loops then run along themselves.
            order = np.lexsort((starts, edges, row))
            before = np.concatenate([order[:1], order[:-1]])
            own = (edges[before] == edges[order]) & (row[before] == row[order]) & (starts[before] < starts[order])
            source = np.full(len(edges), -1)
            source[order[own]] = starts[before[own]]
            local = source >= 0
            s_ids, s_keys = np.where(local, ids, first_ids[at]), np.where(local, keys, first_keys[at])
            s_starts = np.where(local, source, first_starts[at])
            yield _runs(*(x[again] for x in (row, ids, keys, starts, s_ids, s_keys, s_starts)))

    return in_python(rows, resolve, OCCURRENCES)


def _joined_with_first(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """Occurrences of edges joined with the first ones; a hot edge's rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, ids, keys, starts, edges = _unpacked(batch)
            yield _longs(edge=edges, doc_id=ids, text_key=keys, start=starts)

    single = settle(in_python(rows, run, "edge long, doc_id long, text_key long, start long"))
    met = attach(single, firsts, "edge", "size", single.count()).where("size IS NOT NULL AND (doc_id, start) <> (first.doc_id, first.start)")
    own = met.withColumn("own", F.expr("lag(start) OVER (PARTITION BY edge, doc_id, text_key ORDER BY start)"))
    take = lambda name: F.when(F.col("own").isNotNull(), F.col(name)).otherwise(F.col(f"first.{name}"))
    source = [take("doc_id").alias("source_id"), take("text_key").alias("source_key"), F.coalesce("own", "first.start").alias("source_start")]
    return own.select(*KEY, "start", F.lit(1).cast("long").alias("n"), *source)


def joined_spans(occurrences: DataFrame) -> DataFrame:
    """Runs that continue each other, in the document and at the source, as one (OCCURRENCES; n counts windows)."""
    before = "lag(struct(start + n AS start, source_id, source_key, source_start + n AS source_start)) OVER (PARTITION BY doc_id, text_key ORDER BY start)"
    here = "struct(start, source_id, source_key, source_start)"
    marked = occurrences.withColumn("new", F.expr(f"CASE WHEN {before} = {here} THEN 0 ELSE 1 END"))
    numbered = marked.withColumn("span", F.expr("sum(new) OVER (PARTITION BY doc_id, text_key ORDER BY start)"))
    first = F.min_by(F.struct("source_id", "source_key", "source_start"), "start").alias("s")
    whole = numbered.groupBy(*KEY, "span").agg(F.min("start").alias("start"), F.sum("n").alias("n"), first)
    return whole.select(*KEY, "start", "n", "s.source_id", "s.source_key", "s.source_start")


def repeated_spans(texts: DataFrame, span: int, anchor: int) -> DataFrame:
    """Spans of documents that repeat earlier text, with the coordinates of their sources (OCCURRENCES), settled."""
    anchors = settle(anchors_of(texts, span, anchor))
    total = anchors.count()
    counted = anchors.groupBy("anchor").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).where("n > 1")
    repeated = settle(counted)
    met = attach(anchors.drop("n"), repeated, "anchor", "docs", total).where("docs IS NOT NULL")
    per_doc = settle(met.groupBy(*KEY).agg(F.collect_list("anchor").alias("anchors")))
    rows = stretches(with_info(texts, per_doc), span, anchor)
    hot = max(common.HOT_ROWS, total // 1_000_000)
    frequent = settle(repeated.where(F.col("n") >= hot).select(F.col("anchor").alias("hot_anchor")))
    if frequent.isEmpty():
        found = compared(rows)
    else:
        # At most a millionth of the anchors or 1 / HOT_ROWS of them: small enough to send around.
        marked = settle(rows.join(F.broadcast(frequent), F.col("anchor") == F.col("hot_anchor"), "left"))
        usual, often = (marked.where(f"hot_anchor IS {what}").drop("hot_anchor") for what in ("NULL", "NOT NULL"))
        distinct = settle(often.dropDuplicates([*KEY, "start"]).drop("anchor"))
        found = compared(usual).unionByName(compare_frequent(distinct))
    return settle(joined_spans(found))


def compared(rows: DataFrame) -> DataFrame:
    return in_python(rows.repartition("anchor").sortWithinPartitions("anchor"), compare, OCCURRENCES)


def with_info(texts: DataFrame, info: DataFrame) -> DataFrame:
    """The texts that ``info`` has a row for, with its columns; only they are shuffled, if their ids can be sent around."""
    ids = info.select("doc_id").distinct()
    some = texts.join(F.broadcast(ids), "doc_id", "left_semi") if is_small(ids) else texts
    return some.join(info, KEY)


def paths(spans: DataFrame) -> DataFrame:
    """Nonbranching paths: source stretches (source_id, source_key, start, n windows) that no span enters or leaves, with
    the number of spans that run through them."""
    ends = F.explode(F.array(F.struct(F.col("source_start").alias("at"), F.lit(1).alias("step")), F.struct((F.col("source_start") + F.col("n")).alias("at"), F.lit(-1).alias("step"))))
    cuts = spans.select("source_id", "source_key", ends.alias("c")).groupBy("source_id", "source_key", F.col("c.at").alias("start")).agg(F.sum("c.step").alias("step"))
    order = "OVER (PARTITION BY source_id, source_key ORDER BY start)"
    out = cuts.withColumn("n", F.expr(f"lead(start) {order} - start")).withColumn("spans", F.expr(f"sum(step) {order}"))
    return out.where("spans > 0").select("source_id", "source_key", "start", "n", "spans")


def _digests(rows: DataFrame, span: int) -> DataFrame:
    """Of texts with wanted stretches (start, n): rows (doc_id, text_key, start, n, digest) of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, key, text, wanted in zip(*(batch.column(c).to_pylist() for c in (*KEY, "text", "wanted")), strict=True):
                words = text.encode().split()
                for w in wanted:
                    data = b" ".join(words[w["start"] : w["start"] + w["n"] + span - 1])
                    out.append((doc_id, key, w["start"], w["n"], hashlib.sha256(data).digest()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*KEY, "start", "n", "digest"])

    return in_python(rows.select(*KEY, "text", "wanted"), run, "doc_id long, text_key long, start long, n long, digest binary")


def verified(texts: DataFrame, spans: DataFrame, span: int) -> DataFrame:
    """The spans whose words are those at their source."""
    here = spans.select(*KEY, "start", "n")
    there = spans.select(F.col("source_id").alias("doc_id"), F.col("source_key").alias("text_key"), F.col("source_start").alias("start"), "n")
    asked = here.union(there).distinct().groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("wanted"))
    digests = settle(_digests(with_info(texts, settle(asked)), span).distinct())
    own = digests.withColumnRenamed("digest", "own_digest")
    place = ["doc_id", "text_key", "start", "n"]
    source = digests.select(*[F.col(c).alias(f"of_{c}") for c in place], "digest")
    same = [F.col(a) == F.col(f"of_{b}") for a, b in zip(("source_id", "source_key", "source_start", "n"), place, strict=True)]
    both = spans.join(own, place).join(source, same[0] & same[1] & same[2] & same[3])
    return settle(both.where("digest = own_digest").select(*spans.columns))


def _kept(text: bytes, spans: list[tuple[int, int]], span: int) -> tuple[int, int, bytes]:
    """Words, words removed, and what is left."""
    words = text.split()
    if not spans:
        return len(words), 0, b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, n in spans:
        change[start] += 1
        change[start + n + span - 1] -= 1
    gone = np.cumsum(change)[:-1] > 0
    return len(words), int(gone.sum()), b" ".join([words[i] for i in np.flatnonzero(~gone)])


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, anchor: int = ANCHOR, with_text: bool = True
) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and, unless told not to, the text that is left."""
    texts = _texts(docs, id_col, text_col)
    spans = verified(texts, repeated_spans(texts, span, anchor), span)
    per_doc = settle(spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("spans")))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [[]] * batch.num_rows
            out = [_kept(t.as_py().encode(), [(s["start"], s["n"]) for s in own], span) for t, own in zip(batch.column("text"), lists, strict=True)]
            columns = [
                batch.column("doc_id"),
                pa.array([o[0] for o in out], pa.int64()),
                pa.array([o[1] for o in out], pa.int64()),
                pa.array([hashlib.sha256(o[2]).hexdigest() for o in out], pa.string()),
                pa.array([o[2].decode() if with_text else None for o in out], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"
    ids = per_doc.select("doc_id", "text_key")
    rest = texts.join(F.broadcast(ids) if is_small(ids) else ids, KEY, "left_anti")
    cut = in_python(with_info(texts, per_doc).select("doc_id", "text", "spans"), run, schema)
    whole = in_python(rest.select("doc_id", "text"), run, schema)
    doc_id: Column = F.nullif(F.col("doc_id"), F.lit(NO_ID))
    out = cut.unionByName(whole).withColumn("doc_id", doc_id)
    return out if with_text else out.drop("text")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (
    SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS seq
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM d)
),
f AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY doc_id, s) AS place FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS k FROM f WHERE place > 1),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM d),
kept AS (
    SELECT doc_id, count(*) AS n_words, count(gone.k) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (gone.k IS NULL) AS text
    FROM each LEFT JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op2_substring_dedup", ORACLE)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)

"""Exact deduplication, mixing and archives: awkward rows, forced large paths, and the files themselves."""

from __future__ import annotations

import hashlib
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from burnish.llm import common, exact_dedup, mixing, warc
from burnish.operators.scratch import new_folder


@pytest.fixture(params=[False, True], ids=["small", "forced"])
def paths(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(common.is_small, "__defaults__", (1,))
        monkeypatch.setattr(common, "HOT_ROWS", 5)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "d", True) for i, t in rows], "doc_id long, text string, kept string, digest string, maybe boolean")


ROWS = [(i, t) for i, t in enumerate(["a", "b", "a", None, "", " ", "c", "a", "é", "é", "x" * 100_000] + ["many"] * 30)] + [(None, "b"), (None, "z"), (7, "a"), (50, "d"), (50, "d")]


def test_marks(spark, paths):
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""]) for i, t in ROWS]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark_copies(frame(spark, ROWS)).collect()]
    assert Counter(got) == Counter(want)


def test_drop_copies_keeps_columns(spark, paths):
    df = frame(spark, ROWS)
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, (r.text or "")[:4]) for r in out.collect() if r.doc_id is not None) == sorted(
        [(50, "d"), (50, "d"), (1, "b"), (4, ""), (5, " "), (6, "c"), (7, "a"), (7, "a"), (9, "é"), (10, "xxxx"), (40, "many")]
    )
    assert exact_dedup.mark_copies(df.where("doc_id < 0")).count() == exact_dedup.drop_copies(df.where("doc_id < 0")).count() == 0


def test_drop_copies_keeps_one_row_of_texts_without_ids(spark, paths):
    rows = [(None, "p")] * 20 + [(None, "q"), (None, None), (None, ""), (None, "r"), (1, "r"), (2, "s")]
    out = exact_dedup.drop_copies(frame(spark, rows))
    assert sorted(((r.doc_id, r.text or "") for r in out.collect()), key=repr) == sorted([(None, "p"), (None, "q"), (None, ""), (1, "r"), (2, "s")], key=repr)


def test_many_slices_give_the_same_and_move_no_row(spark, monkeypatch):
    rows = common.settle(frame(spark, [(i, str(i % 3000)) for i in range(3100)]).select("doc_id", exact_dedup.text_digest("text").alias("digest")))
    bloom = common.settle(exact_dedup.repeated_bits(rows, 1024))
    whole = {r.doc_id for r in exact_dedup.maybe_repeated(rows, bloom, 1024).where("maybe").collect()}
    monkeypatch.setattr(exact_dedup, "SLICE_WORDS", 64)
    monkeypatch.setattr(exact_dedup, "SLICES_AT_ONCE", 5)
    sliced = exact_dedup.maybe_repeated(rows, bloom, 1024)
    assert sliced.count() == 3100 and {r.doc_id for r in sliced.where("maybe").collect()} == whole
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("BroadcastHashJoin") == 4


def test_rows_without_ids_are_mixed_apart(spark):
    df = spark.range(4000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('text ', id) AS text", "'s' AS source")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = mixing.mix(df, {"s": 1.0}, total=8000).select("text", "copy", F.spark_partition_id().alias("part")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    counts = Counter(r.text for r in out)
    assert abs(len(out) - 8000) < 500 and len(set(counts.values())) > 4 and len({r.part for r in out}) > 1


def test_only_possible_repeats_reach_the_second_pass(spark):
    rows = common.settle(frame(spark, [(i, str(i % 3000)) for i in range(3100)]).select("doc_id", exact_dedup.text_digest("text").alias("digest")))
    words = 1024
    tested = exact_dedup.maybe_repeated(rows, common.settle(exact_dedup.repeated_bits(rows, words)), words)
    passed = {r.doc_id for r in tested.where("maybe").collect()}
    assert {i for i in range(3100) if i < 100 or i >= 3000} <= passed and len(passed) < 1000


def sources(spark, sizes):
    rows = [(i, s, f"t{i}", 1, 2.0, "m") for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "doc_id long, source string, text string, copy int, mean double, key string")


def test_shares_come_out_as_weighed(spark, paths):
    df = sources(spark, {"a": 3000, "b": 1000, None: 500, "none": 200})
    out = mixing.mix(df, {"a": 1.0, "b": 1.0, None: 2.0, "none": 0.0, "absent": 0.0}, total=8000)
    assert out.columns == [*df.columns, "copy_"]
    got = Counter(r.source for r in out.collect())
    assert got["none"] == 0
    for name, mean in (("a", 2000), ("b", 2000), (None, 4000)):
        assert abs(got[name] - mean) < 5 * mean**0.5
    again = mixing.mix(df.repartition(3), {"a": 1.0, "b": 1.0, None: 2.0}, total=8000)
    assert Counter((r.doc_id, r.copy_) for r in again.collect()) == Counter((r.doc_id, r.copy_) for r in out.collect())


def test_large_means_and_awkward_weights(spark):
    df = sources(spark, {"a": 20, "b": 20})
    got = Counter(r.source for r in mixing.mix(df, {"a": 1.0, "b": float("nan")}, total=20_000).collect())
    assert set(got) == {"a"} and abs(got["a"] - 20_000) < 5 * 20_000**0.5
    assert mixing.mix(df, {"b": -1.0}).count() == 0 == mixing.mix(df.where("doc_id < 0")).count()
    odd = spark.createDataFrame([(None, None), (None, None), (1, "s")], "doc_id long, source string")
    assert mixing.mix(odd, {None: 1.0}, total=4).count() in range(0, 30)


def test_rows_are_spread_over_the_result(spark):
    out = [r.source for r in mixing.mix(sources(spark, {"a": 2000, "b": 2000}), {"a": 1.0, "b": 1.0}).collect()]
    half = Counter(out[: len(out) // 2])
    assert abs(half["a"] - half["b"]) < 300


PAGES = [(5, "http://x/ y\r\n", "<p>" + "é" * 80), (3, None, "<p>" + "é" * 80), (9, "u", "<p>" + "é" * 80), (4, "u", "short"), (6, "u", "short")]
PAGES += [(7, "u", None), (None, None, "n" * 200), (8, "u", "n" * 200), (10, "u", "a\r\n\r\nb" * 300_000), (11, "", "\r\n" * 60)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, size int")


def test_archives_hold_what_was_written(spark, paths):
    folder = new_folder(spark)
    files = warc.write_archives(warc.mark_revisits(pages(spark)).repartition(2), folder)
    got = {r.page_id: r for r in warc.read_archives(files, folder).collect()}
    first = {}
    for i, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0])):
        first.setdefault(html or "", i)
    assert len(got) == len(PAGES) and sum(r.records for r in files.collect()) == len(PAGES)
    for i, url, html in PAGES:
        data = (html or "").encode()
        r, head = got[i], first[html or ""]
        revisit = len(data) >= 100 and head != i
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", head) if revisit else ("response", None))
        assert r.payload == (None if revisit else (html or ""))
    assert got[5].url == "http://x/%20y%0D%0A"


def test_each_record_is_a_frame_behind_the_dictionary(spark):
    import zstandard
    from pyarrow import fs

    folder = new_folder(spark)
    many = [(i, f"http://h/{i}", f"<html><body class='page'>{i} common markup of every page {i * 7}</body></html>" * 3) for i in range(400)]
    files = warc.write_archives(warc.mark_revisits(pages(spark, many)).coalesce(1), folder)
    (name,) = [r.file for r in files.collect()]
    system, root = warc._open_folder(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    data = system.open_input_stream(f"{root}/{name}", compression=None).read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.DICTIONARY_MAGIC and 1000 < size <= warc.DICTIONARY_BYTES
    rest, records = data[8 + size :], 0
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    while rest:
        frame = one.decompressobj()
        assert frame.decompress(rest).startswith(b"WARC/1.1\r\n")
        rest, records = frame.unused_data, records + 1
    assert records == 400
    assert len(data) - size < sum(len(h) for _, _, h in many)


def test_no_pages(spark):
    folder = new_folder(spark)
    files = warc.write_archives(warc.mark_revisits(pages(spark).where("page_id < 0")), folder)
    assert warc.read_archives(files, folder).count() == 0


def test_broken_archives_are_refused(spark):
    record = warc.record_bytes(1, "u", b"payload", hashlib.sha256(b"other").hexdigest(), None)
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(record)

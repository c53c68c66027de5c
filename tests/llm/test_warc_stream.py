"""Archives are read as streams, and no two records share an id."""

import re

import pytest


def _records(spark, path):
    from gapmeter.llm import warc
    pieces = spark.read.option("lineSep", "\r\n\r\n").text(path).selectExpr("cast(value as binary) v").toLocalIterator()
    return [h for h, _ in warc.parse(bytes(r.v) for r in pieces)]


def test_record_ids_are_unique_and_revisits_name_existing_ones(spark, tmp_path):
    from gapmeter.llm import warc
    same, other = "<p>" + "copy " * 40, "<p>" + "other " * 40
    rows = [(1, "u", same), (2, "u", same), (2, "u", same), (None, None, same), (None, None, "x"), (None, None, "x"), (5, "u", other), (5, "v", other), (6, "u", other), (7, "u", "é" * 90_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write(warc.records(df), f"file://{tmp_path}/w", chunk_bytes=1 << 15)
    heads = _records(spark, f"file://{tmp_path}/w")
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(ids) == len(set(ids)) == 9 + 6 and all(re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}(#\d+)?>", i) for i in ids)
    named = [h["WARC-Refers-To"] for h in heads if "WARC-Refers-To" in h]
    assert named and set(named) <= set(ids)
    assert {h["X-Refers-To-Page-ID"] for h in heads if h["WARC-Type"] == "revisit"} == {"1", "5"}


def test_an_archive_larger_than_a_buffer_streams(spark, tmp_path):
    """One archive of many records, with separators and broken lines inside payloads, through batches of a few pieces."""
    from gapmeter.llm import warc
    rows = [(i, "u", ("a\r\n\r\nb" * (i % 50)) + "\r\n\r\n" * (i % 3) + "é" * i + f"{warc.VERSION}\r\n") for i in range(400)] + [(999, "u", "\r\n\r\n" * 40_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(warc.records(df), f"file://{tmp_path}/w", chunk_bytes=1 << 12)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {}
        for r in warc.read_chunks(spark, f"file://{tmp_path}/w").collect():
            got[r.page_id] = got.get(r.page_id, b"") + bytes(r.block)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == {i: t.encode() for i, _, t in rows}


def test_broken_archives_are_errors():
    from gapmeter.llm import warc
    good = [b"WARC/1.1\r\nContent-Length: 6", b"a", b"b"]
    head, block = next(warc.parse([b"WARC/1.1\r\nContent-Length: 6", b"a", b"b"][:2] + [b"b"]))
    assert block == b"a\r\n\r\nb" and head["Content-Length"] == "6"
    for bad in (good[:2], [b"HTTP/1.1"], [b"WARC/1.1\r\nContent-Length: 1", b"ab"]):
        with pytest.raises(ValueError):
            list(warc.parse(bad))
    assert list(warc.parse([b"WARC/1.1\r\nContent-Length: 0", b""])) == [({"Content-Length": "0"}, b"")]

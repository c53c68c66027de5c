"""WARC as a chunked record table.

A payload larger than ``chunk_bytes`` is written as segments: the first record and
``continuation`` records (WARC-Segment-Number), one row per (record id, segment). No
row, header or reader buffer ever holds more than a segment besides the input row.
Rows become archive files through Spark's text writer with CRLF CRLF as separator,
which is the end of a WARC record; files are gzip streams in the shared folder.
Reading streams a file through Spark's text reader, so no archive is ever one value, however large. It
yields (record id, segment) rows and carries the payload digest from segment to segment; the segments
of a record stand in one file.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize

CRLF = "\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Up to so many repeated ids are broadcast.
BROADCAST_ROWS = 100_000
END = b"\r\n\r\n"


def record_types(pages: DataFrame, least_bytes: int = 100, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(digest, first_id) of payloads of at least ``least_bytes`` that stand in several rows."""
    light = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b"")).alias("p"))
    light = light.where(F.length("p") >= least_bytes).select("page_id", F.sha2("p", 256).alias("digest"))
    return materialize(light.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id"))


def records(pages: DataFrame, least_bytes: int = 100, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row per record: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to; copy and
    named settle record ids where page ids repeat."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b"")).alias("payload")) \
        .withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    first = record_types(pages, least_bytes, id_col, payload_col).select(F.col("digest").alias("payload_digest"), "first_id")
    rows = rows.join(first, "payload_digest", "left")
    revisit = F.col("first_id").isNotNull() & (F.col("payload_bytes") >= least_bytes) & F.coalesce(F.col("page_id") != F.col("first_id"), F.lit(True))
    # rows that share an id get a number of their own, as records must not share an id; no revisit names one of them then
    alone = {"copy": F.col("page_id").isNull(), "named": F.lit(True)}
    twice = materialize(pages.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id"))
    if n := twice.count():
        for name, column in (("copy", "page_id"), ("named", "refers")):
            one = twice.withColumnRenamed("_id", f"_{name}")
            rows = rows.withColumn("refers", F.when(revisit, F.col("first_id"))).join(F.broadcast(one) if n <= BROADCAST_ROWS else one, F.col(column) == F.col(f"_{name}"), "left")
        alone = {"copy": F.col("_copy").isNotNull() | F.col("page_id").isNull(), "named": F.col("_named").isNull()}
    rows = rows.withColumn("copy", F.when(alone["copy"], F.monotonically_increasing_id() + 1).otherwise(F.lit(0)).cast("long")).withColumn("named", alone["named"])
    return rows.select("page_id", "copy", "named", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
                       F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
                       F.when(revisit, F.col("first_id")).alias("refers_to"))


def _record_uri(page_id: Column, copy: Column | None = None) -> Column:
    """urn:uuid from a digest of the page id: the same in every run, so revisits can name it. ``copy`` tells rows of one id
    (or none) apart; an id that stands alone has 0."""
    more = F.lit("") if copy is None else F.when(copy > 0, F.concat(F.lit(":"), copy.cast("string"))).otherwise(F.lit(""))
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null")), more).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def chunk_table(rows: DataFrame, chunk_bytes: int = 1 << 18) -> DataFrame:
    """One row per (record, segment) holding the WARC record without its end, as text bytes."""
    n = F.greatest(F.lit(1), F.ceil(F.coalesce(F.length("payload"), F.lit(0)) / chunk_bytes)).cast("int")
    rows = rows.withColumn("segment", F.explode(F.sequence(F.lit(1), n))).withColumn("segments", n)
    block = F.coalesce(F.substring("payload", (F.col("segment") - 1) * chunk_bytes + 1, F.lit(chunk_bytes)), F.lit(b""))
    rows = rows.withColumn("block", block)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    uri = _record_uri(F.col("page_id"), F.col("copy"))
    kind = F.when(F.col("segment") > 1, F.lit("continuation")).otherwise(F.col("record_type"))
    split, revisit = F.col("segments") > 1, F.col("record_type") == "revisit"
    last = split & (F.col("segment") == F.col("segments"))
    head = F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", kind),
        line("WARC-Record-ID", F.when(F.col("segment") > 1, F.concat(F.regexp_replace(uri, ">$", "#"), F.col("segment").cast("string"), F.lit(">"))).otherwise(uri)),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " "))).otherwise(F.lit("")),
        line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), F.when(F.col("named"), line("WARC-Refers-To", _record_uri(F.col("refers_to")))).otherwise(F.lit("")),
                                 line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        F.when(split, line("WARC-Segment-Number", F.col("segment").cast("string"))).otherwise(F.lit("")),
        F.when(split & (F.col("segment") > 1), line("WARC-Segment-Origin-ID", uri)).otherwise(F.lit("")),
        F.when(last, line("WARC-Segment-Total-Length", F.length("payload").cast("string"))).otherwise(F.lit("")),
        line("Content-Length", F.length("block").cast("string")), F.lit(CRLF))
    return rows.select(F.concat(head.cast("binary"), F.col("block")).cast("string").alias("value"))


def write(rows: DataFrame, path: str, chunk_bytes: int = 1 << 18) -> None:
    """Write records as gzip WARC files below ``path``; a record's segments follow each other in one file."""
    chunk_table(rows, chunk_bytes).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def parse(pieces):
    """(headers, block) per record from what stands between CRLF CRLF in archives, in its order. Blocks may hold or end in
    line ends, so records are taken by their length. No more than a segment and a piece is in memory."""
    buffer, head, need = bytearray(), None, 0
    for piece in pieces:
        buffer += piece
        buffer += END
        while True:
            if head is None:
                skip = 0
                while buffer[skip:skip + 2] == b"\r\n":  # left over where an archive ends in more line ends than one
                    skip += 2
                del buffer[:skip]
                end = buffer.find(END)
                if end < 0:
                    break
                lines = buffer[:end].decode("utf-8").split(CRLF)
                if lines[0] != VERSION:
                    raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
                head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
                need = int(head["Content-Length"])
                del buffer[:end + len(END)]
            if len(buffer) < need + len(END):
                break
            if buffer[need:need + len(END)] != END:
                raise ValueError("record length and content differ")
            yield head, bytes(buffer[:need])
            del buffer[:need + len(END)]
            head = None
    if head is not None or buffer.strip():
        raise ValueError("archive ends within a record")


READ = ("page_id long, record_type string, refers_to long, segment int, block binary, bytes_so_far long, "
        "digest_so_far string, stated_digest string, stated_bytes long, last boolean")


def read_chunks(spark, path: str, with_block: bool = True) -> DataFrame:
    """(record, segment) rows of all archives below ``path``, with the running size and digest of the payload."""
    # an archive is a compressed text stream: Spark inflates it step by step, and hands on piece after piece in its order
    pieces = spark.read.option("lineSep", CRLF + CRLF).option("pathGlobFilter", "part-*").text(path).select(F.col("value").cast("binary"))

    def run(batches):
        names, out, size, state, seen, total = [x.split()[0] for x in READ.split(", ")], [], 0, None, 0, 0
        for head, block in parse(x.as_py() for batch in batches for x in batch.column(0)):
            kind, number = head["WARC-Type"], int(head.get("WARC-Segment-Number", "1"))
            if kind != "continuation":
                state, seen, first = hashlib.sha256(), 0, head
                total = int(head["X-Payload-Length"]) if "WARC-Segment-Number" in head else len(block)
            elif state is None or head["WARC-Segment-Origin-ID"] != first["WARC-Record-ID"]:
                raise ValueError("segment without its record")
            state.update(block)
            seen += len(block)
            refers = first.get("X-Refers-To-Page-ID")
            out.append((int(head["X-Page-ID"]) if head["X-Page-ID"] else None, first["WARC-Type"], int(refers) if refers else None, number,
                        block if with_block else None, seen, state.hexdigest(), first["WARC-Payload-Digest"].removeprefix("sha256:"),
                        int(first["X-Payload-Length"]), seen >= total))
            size += len(block) if with_block else 0
            if size > 1 << 22 or len(out) >= 4096:
                yield _batch(out, names)
                out, size = [], 0
        if out:
            yield _batch(out, names)

    return pieces.mapInArrow(run, READ)


def _batch(rows, names):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows)), kinds)], names)


def round_trip(pages: DataFrame, least_bytes: int = 100, chunk_bytes: int = 1 << 18,
               id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """Write a record per page, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response are those of the payload read; a revisit has no block, its
    stated ones are of the payload it refers to. Null payload: empty, so response. Null id: a
    record of its own, never referred to unless all equal payloads have none (then response).
    Repeated rows: all rows with the smallest id are responses, each with a record id of its own. Empty table: no rows.
    """
    folder = f"{ensure_checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(records(pages, least_bytes, id_col, payload_col, url_col), folder, chunk_bytes)
    rows = read_chunks(pages.sparkSession, folder, with_block=False).where("last")
    response = F.col("record_type") == "response"
    return rows.select("page_id", F.when(response, F.col("bytes_so_far")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
                       F.when(response, F.col("digest_so_far")).otherwise(F.col("stated_digest")).alias("payload_digest"), "record_type", "refers_to")

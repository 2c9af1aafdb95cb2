"""WARC archives: a writer in SQL expressions, and a reader that verifies record boundaries.

Writing.  Rows with equal payloads of at least ``min_revisit_bytes`` bytes share
one response record, that of the largest page id; the others become revisit
records that name it.  A record is one string, and as every WARC record ends in
CR LF CR LF, Spark's text writer with that line separator writes the archive
through whatever file system the path names, with committed and repeatable tasks.

Reading.  Spark's text reader splits files at the magic ``WARC/1.1 CR LF``
wherever it occurs, payloads included, so each piece is a candidate record.
Tasks emit, for each candidate, its offset and the offset of the successor that
its own length header gives.  Pointer jumping from each file's start marks the
candidates that the chain reaches: in every round the marked set is joined with
the jump table, and the table with itself, so a file of n records takes log n
rounds over a narrow table.  All other candidates are bytes of some payload, and
records that hold such bytes are put together in a second scan of those alone.

Defined cases: a null payload is empty; rows that share the largest id of a
group are all responses; a null id is written without an id; a group of null
ids is all responses; records that the chain doesn't reach are never returned;
an empty table gives an empty archive.  Payloads count as equal when size and
SHA-1 agree.  Extra columns, whatever their names, aren't written, and without a
url column records have no target.  A payload of any length is one string, up to
Spark's 2 GB.  The offsets of a file are a running sum over its candidates in one
task (narrow rows), so files should stay below some millions of records; those
written here hold ``records_per_file``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import dropped, new_path, stored

#: Most repeated payloads, at about 100 bytes in memory each, that are broadcast; more are joined by a shuffle.
FIRST_ROWS = 200_000
MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1: five hexadecimal digits make four of base 32."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """id, url, payload (binary), digest, refers_to: null for responses."""
    url = F.col("url") if "url" in [c.lower() for c in pages.columns] else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", base32_of_sha1(F.col("payload"))).withColumn("size", F.octet_length("payload"))
    # stored and counted: a short table is broadcast and payloads stay where they are
    first = stored(rows.where(F.col("size") >= min_revisit_bytes).groupBy("digest", "size").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-first")
    first = first.hint("broadcast" if first.count() <= FIRST_ROWS else "merge")
    rows = rows.join(first, ["digest", "size"], "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.select("id", "url", "payload", "digest", "size", refers.alias("refers_to"))


def record(rows: DataFrame) -> Column:
    """A record without the separator at its end, as bytes in a string."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n")), F.lit(""))
    response = F.col("refers_to").isNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("size")), F.lit("\r\n"))
    block = F.concat(http, F.when(response, F.col("payload").cast("string")).otherwise(""))
    kind = F.when(response, "response").otherwise("revisit")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    uri = F.regexp_replace("url", "[\\r\\n]", "")
    head = F.concat(F.lit(MAGIC), line("WARC-Type", kind), line("WARC-Record-ID", urn("id")), line("WARC-Target-URI", uri), line("WARC-Refers-To", urn("refers_to")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(block)), F.lit("\r\n"))
    return F.concat(head, block)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", min_revisit_bytes: int = 0, records_per_file: int = 100_000) -> None:
    rows = with_revisits(pages, id_col, payload_col, min_revisit_bytes)
    rows.select(record(rows).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


_HEADER = re.compile(rb"([A-Za-z-]+): ([^\r\n]*)\r\n")


def _head(piece: bytes) -> tuple[dict[bytes, bytes], int]:
    """Header fields of a candidate and the bytes before its block; none if it isn't a record's beginning."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return {}, 0
    return {k.lower(): v for k, v in _HEADER.findall(piece, 0, end + 2)}, end + 4


def _long(value: bytes | None) -> int | None:
    return int(value) if value and re.fullmatch(rb"-?\d{1,18}", value) else None


def _page(urn: bytes | None) -> int | None:
    """The page id of a record's name, any 64-bit number."""
    m = re.fullmatch(rb"<urn:page:(-?\d{1,19})>", urn or b"")
    return int(m[1]) if m and -(1 << 63) <= int(m[1]) < 1 << 63 else None


def _parsed(fields: dict[bytes, bytes], block: bytes) -> dict:
    """What a record tells of its payload; a response's is hashed anew."""
    http, start = {}, block.find(b"\r\n\r\n") + 4
    if start >= 4:
        http = {k.lower(): v for k, v in _HEADER.findall(block, 0, start - 2)}
    kind = fields.get(b"warc-type", b"").decode()
    payload = block[max(start, 0) if start >= 4 else 0 :]
    if kind == "revisit":
        size, digest = _long(http.get(b"content-length")), fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {"page_id": _page(fields.get(b"warc-record-id")), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _page(fields.get(b"warc-refers-to"))}


_RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_NAMES = [x.split()[0] for x in _RECORD.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[int], list[bytes]]]:
    """(files, places, bytes): a piece's place is its block's start and its number in the block."""
    seen: dict[tuple[str, int], int] = {}
    for batch in batches:
        files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        number = []
        for key in zip(files, starts, strict=True):
            number.append(seen.get(key, 0))
            seen[key] = number[-1] + 1
        yield files, list(zip(starts, number, strict=True)), batch.column(2).to_pylist()


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for files, places, pieces in _pieces(batches):
        rows = []
        for piece in pieces:
            fields, head = _head(piece)
            length = _long(fields.get(b"content-length"))
            span = None if length is None or length < 0 else head + length + len(END)
            whole = span == len(piece)
            rows.append((len(piece), span, whole, _parsed(fields, piece[head : head + length]) if whole else None))
        kind = pa.struct(list(zip(_NAMES, _TYPES, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(files), pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_()), pa.array([r[3] for r in rows], kind)], ["file", "block", "number", "bytes", "span", "whole", "record"])


def _scan(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Of each piece after a magic: file, block, number, offset, successor, whole, record (if whole)."""
    rows = _scan(spark, path).mapInArrow(_candidates, f"file string, block bigint, number bigint, bytes bigint, span bigint, whole boolean, record struct<{_RECORD.replace(' ', ':').replace(',:', ',')}>")
    order = Window.partitionBy("file").orderBy("block", "number")
    magic = len(MAGIC)
    # a file begins with the magic, so its first piece is the empty one before that
    end = F.sum(F.col("bytes") + magic).over(order)
    rows = rows.withColumn("offset", end - F.col("bytes") - 2 * magic).where("offset >= 0")
    return rows.withColumn("successor", F.col("offset") + magic + F.col("span")).drop("span")


def reachable(links: DataFrame) -> DataFrame:
    """(file, offset) that the chain of successors reaches from offset 0 of each file, by pointer jumping.

    Every join is hinted: the planner would broadcast these tables by their compressed sizes, far below those in memory.
    """
    jumps = stored(links.where("successor is not null").select("file", "offset", "successor"), "warc-jumps")
    found = stored(links.where("offset = 0").select("file", "offset"), "warc-found")
    places = stored(links.select("file", F.col("offset").alias("successor")), "warc-places")
    jumps_in = stored(jumps.join(places.hint("merge"), ["file", "successor"], "left_semi").select("file", "offset", "successor"), "warc-jumps")
    dropped(jumps, places)
    jumps, count = jumps_in, found.count()
    while True:
        ahead = found.join(jumps.hint("merge"), ["file", "offset"]).select("file", F.col("successor").alias("offset"))
        more = stored(found.union(ahead).distinct(), "warc-found")
        dropped(found)
        found, before = more, count
        count = found.count()
        if count == before:
            dropped(jumps)
            return found
        onward = jumps.select("file", F.col("offset").alias("successor"), F.col("successor").alias("next"))
        twice = stored(jumps.join(onward.hint("merge"), ["file", "successor"]).select("file", "offset", F.col("next").alias("successor")), "warc-jumps")
        dropped(jumps)
        jumps = twice


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for pieces in batch.column(0).to_pylist():
            whole = MAGIC.encode().join(pieces)
            fields, head = _head(whole)
            length = _long(fields.get(b"content-length"))
            rows.append(_parsed(fields, whole[head : head + length]))
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for files, places, pieces in _pieces(batches):
        yield pa.RecordBatch.from_arrays([pa.array(files), pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64()), pa.array(pieces, pa.binary())], ["file", "block", "number", "piece"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record that the chain reaches."""
    pieces = stored(candidates(spark, path), "warc-candidates")
    real = reachable(pieces)
    records = pieces.join(real.hint("merge"), ["file", "offset"])
    whole = records.where("whole").select("record.*")
    if not records.where("not whole").limit(1).count():
        return whole
    # pieces without a boundary of their own belong to the last record before them
    flagged = pieces.join(real.withColumn("real", F.lit(True)).hint("merge"), ["file", "offset"], "left")
    owner = F.last(F.when(F.col("real"), F.struct("offset", "whole")), True).over(Window.partitionBy("file").orderBy("offset"))
    parts = flagged.withColumn("owner", owner).where("not owner.whole").select("file", "block", "number", "offset", F.col("owner.offset").alias("owner"))
    scan = _scan(spark, path).mapInArrow(_numbered, "file string, block bigint, number bigint, piece binary")
    joined = scan.join(parts.hint("shuffle_hash"), ["file", "block", "number"])
    grouped = joined.groupBy("file", "owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "piece"))), lambda x: x["piece"]).alias("pieces"))
    return whole.union(grouped.select("pieces").mapInArrow(_assembled, _RECORD))


def through_warc(pages: DataFrame, path: str | None = None, id_col: str = "page_id", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the pages as an archive and reads it back."""
    path = path or new_path(pages.sparkSession, "warc")
    write_warc(pages, path, id_col, payload_col, min_revisit_bytes)
    return read_warc(pages.sparkSession, path).withColumnRenamed("page_id", id_col)

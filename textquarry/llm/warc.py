"""WARC archives: a writer of one gzip member per record, and a splittable reader.

The reader deals out byte ranges of the files. A task looks for gzip magic in its range, takes a
place for a record if it decodes to a WARC header, and owns the records that start in its range,
reading past its end to finish the last one. Bytes in a record that look like another record (an
archive within an archive, stored without compression) can mislead a task that starts in their midst;
the records of all ranges are therefore held against each other, and what starts before the record
before it has ended is left out.

Files are opened by URI through pyarrow's file systems, in the tasks; nothing passes the driver.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, slices, stored, table

#: Bytes of a range, of a file before the next one is begun, and read at a time.
SPLIT_BYTES, FILE_BYTES, READ_BYTES = 8 << 20, 1 << 30, 1 << 20
#: Payloads of fewer bytes are always written whole.
MIN_REVISIT_BYTES = 0

_MAGIC = b"\x1f\x8b\x08"
_MAX_HEADER = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")

RECORD = "file string, offset long, next_offset long, range_start long, warc_type string, record_id string, refers_to string, target_uri string, declared_digest string, payload_bytes long, payload_digest string, payload binary, error string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<{uuid.uuid4().urn}>"


def page_of(column):
    """The page id in a record id; null for records that have none."""
    return F.regexp_extract(column, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, not yet compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:unknown"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _write(folder: str, date: str, file_bytes: int):
    def run(batches):
        from pyarrow import fs

        files, inside = fs.FileSystem.from_uri(folder)
        files.create_dir(inside, recursive=True)
        out, name, size = None, None, 0
        for batch in batches:
            for part in slices(batch, 2):
                for row in part.to_pylist():
                    payload = row["payload"]
                    if out is None:
                        # A new name at each attempt; only what the finished attempts return is read.
                        name, size = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{inside}/{name}", compression=None)
                    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = record_bytes(row["page_id"], row["url"], payload, payload_digest(payload), row["refers_to"], row["revisit"], date)
                    data = deflate.compress(data) + deflate.flush()
                    out.write(data)
                    size += len(data)
                    if size >= file_bytes:
                        out.close()
                        yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "size": [size]})
                        out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "size": [size]})

    return run


def write_pages(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write page_id, url, html as records under folder (a URI); file and size of each archive.

    Of equal payloads of min_revisit bytes or more, the one with the smallest page_id is written whole,
    the others as revisits of it. Rows that share that id and payload are each written whole, as are
    payloads of which no row has an id; a row without an id revisits one that has. A null html is an
    empty payload, a null url is written as urn:unknown. Extra columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    whole = rows.filter(F.octet_length("payload") >= min_revisit).select("page_id", "digest")
    first = whole.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    # Revisits only, as ids and digests: pages themselves are dealt out anew only if these are many.
    revisits = whole.join(first.select("digest", "first"), "digest").filter("page_id IS NULL OR page_id <> first").select(F.col("page_id").alias("own"), F.col("digest").alias("own_digest"), F.col("first").alias("refers_to")).distinct()
    revisits = stored(revisits, "revisits")
    rows = rows.join(revisits, (rows["digest"] == revisits["own_digest"]) & rows["page_id"].eqNullSafe(revisits["own"]), "left")
    rows = rows.select("page_id", "url", "payload", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))
    return stored(rows.mapInArrow(_write(folder, date, file_bytes), "file string, size long"), "archives")


class _Bytes:
    """A file's bytes from a moving place on, read a piece at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.held = file, size, 0, b""

    def at(self, place: int, count: int) -> bytes:
        """Up to count bytes from place; fewer only at the end of the file."""
        end = min(place + count, self.size)
        if place < self.start or end > self.start + len(self.held):
            want = min(max(count, READ_BYTES), self.size - place)
            self.file.seek(place)
            self.start, self.held = place, self.file.read(want)
        return self.held[place - self.start : end - self.start]

    def find(self, what: bytes, place: int, end: int) -> int:
        """The first place of what that starts in [place, end), or -1."""
        while place < end:
            count = min(READ_BYTES, end - place)
            k = self.at(place, count + len(what) - 1).find(what)
            if k >= 0:
                return place + k
            place += count
        return -1


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines[1:]) if colon}


def _starts(piece: bytes) -> bytes:
    try:
        return zlib.decompressobj(31).decompress(piece, 7)
    except zlib.error:
        return b""


def read_record(data: _Bytes, place: int) -> dict | None:
    """The record whose gzip member starts at place, or None if none does."""
    inflate, out, at = zlib.decompressobj(31), bytearray(), place
    head = length = None
    error = None
    while not inflate.eof:
        piece = data.at(at, 1 << 16)
        if not piece:
            error = "ends within a record"
            break
        at += len(piece)
        try:
            out += inflate.decompress(piece)
        except zlib.error as e:
            if head is None and _starts(data.at(place, 4096)) != b"WARC/1.":
                return None
            error = str(e)
            break
        if head is None:
            if not b"WARC/1.".startswith(out[:7]):
                return None
            end = out.find(b"\r\n\r\n")
            if end < 0:
                if len(out) > _MAX_HEADER:
                    return None
                continue
            head = _fields(bytes(out[:end]))
            if not head.get("content-length", "").isdigit() or "warc-type" not in head:
                return None
            length = int(head["content-length"])
            start = end + 4
    if head is None:
        if error is None or _starts(data.at(place, 4096)) != b"WARC/1.":
            return None
        head, start, length = {"warc-type": "unreadable"}, 0, len(out)
    if error is None and bytes(out[start + length :]) != b"\r\n\r\n":
        error = "length differs from its header"
    next_place = at - len(inflate.unused_data) if inflate.eof else place + 1
    return {"head": head, "block": bytes(out[start : start + length]), "next": next_place, "error": error}


def _row(file: str, range_start: int, place: int, record: dict, keep_payload: bool) -> dict:
    head, block = record["head"], record["block"]
    payload, http = block, {}
    if head.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(top)
    kind = head["warc-type"]
    declared = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    error = record["error"]
    if kind == "revisit":
        size, digest = (int(http["content-length"]) if http.get("content-length", "").isdigit() else None), declared
    else:
        size, digest = len(payload), payload_digest(payload)
        if error is None and declared and declared != digest and kind == "response":
            error = "payload differs from its digest"
    return {
        "file": file, "offset": place, "next_offset": record["next"], "range_start": range_start, "warc_type": kind,
        "record_id": head.get("warc-record-id"), "refers_to": head.get("warc-refers-to"), "target_uri": head.get("warc-target-uri"),
        "declared_digest": declared, "payload_bytes": size, "payload_digest": digest, "payload": payload if keep_payload else None, "error": error,
    }


def range_records(data: _Bytes, file: str, start: int, end: int, keep_payload: bool = True):
    """Records that start in [start, end) of a file."""
    place = data.find(_MAGIC, start, end)
    while 0 <= place < end:
        record = read_record(data, place)
        if record is not None:
            yield _row(file, start, place, record, keep_payload)
        place = data.find(_MAGIC, record["next"] if record else place + 1, end)


_ARROW = pa.schema([(n, pa.binary() if k == "binary" else pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in RECORD.split(", "))])


def _read(keep_payload: bool):
    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                files, inside = fs.FileSystem.from_uri(row["file"])
                with files.open_input_file(inside) as file:
                    rows, held = [], 0
                    for found in range_records(_Bytes(file, row["size"]), row["file"], row["start"], min(row["start"] + row["split"], row["size"]), keep_payload):
                        rows.append(found)
                        held += found["payload_bytes"] or 0
                        if held > 4 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES, keep_payload: bool = True) -> DataFrame:
    """Records of archives given by file (a URI) and size, in RECORD's columns.

    A record that starts well but cannot be decoded to its end has an error and what could be read.
    """
    spark: SparkSession = files.sparkSession
    ranges = files.filter("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"), F.lit(split_bytes).cast("long").alias("split"))
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    records = stored(ranges.mapInArrow(_read(keep_payload), RECORD), "records")
    # A range for each split_bytes of a file: few rows, whatever the number of records.
    ends = records.filter("error IS NULL").groupBy("file", "range_start").agg(F.max("next_offset").alias("end"))
    ends = ends.select("file", "range_start", F.max("end").over(Window.partitionBy("file").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)).alias("begins"))
    inside = records.join(ends, ["file", "range_start"], "left")
    return inside.filter("begins IS NULL OR offset >= begins").select(*records.columns)


def pages_through_archives(pages: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Pages written to archives and read back: ids, payload size and digest, record type, revisited page."""
    records = read_archives(write_pages(pages, folder), split_bytes, keep_payload=False)
    checked = records.withColumn("ok", F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.concat_ws(" ", "file", "offset", "error")).cast("boolean"))).filter("ok")
    return checked.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"))


def query(spark, sf_dir: str) -> DataFrame:
    return pages_through_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))


ORACLE = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
         h AS (SELECT page_id, b, sha1(b) AS x FROM p)
    SELECT page_id, octet_length(b) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda k:
               substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                      ((('0x' || substr(x, (5 * (k // 4) + 1)::INTEGER, 5))::BIGINT >> (5 * (3 - k % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
           CASE WHEN page_id = min(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> min(page_id) OVER same THEN min(page_id) OVER same END AS refers_to
    FROM h WINDOW same AS (PARTITION BY b)
"""

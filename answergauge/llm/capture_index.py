"""WARC archives with a two-level capture index.

Writing: each page is one WARC record; of equal payloads only the first is stored, the others revisit it. Spark's
text sink writes the files: a record ends in an empty line, which is the sink's line separator, so every part
file is a plain WARC file on any file system that Spark knows.

Indexing: the files are parsed by the lengths in their headers. Captures are sorted by reversed-host key over range
partitions and packed into compressed blocks; a sparse directory keeps the first and last key of each block, and of
each partition.

Looking up: a key is searched for in the (few) partition bounds, then by binary search in the directory of
its partition, then in the block it points to; the records found are read by their byte ranges.

Cases: a NULL html is an empty payload, a NULL url has the empty key; rows without page_id are responses and
nothing refers to them; rows that repeat the smallest page_id with an equal payload are all responses;
line breaks in urls are written as escapes; a key of very many captures spreads over several blocks and
partitions; empty tables give empty archives and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answergauge.llm.common import materialised, ship_package
from answergauge.operators.layout import shared_path

LEAST_BYTES = 100
BLOCK_LINES = 300
FILE_RECORDS = 5000
READ_ROWS = 500
CRLF = "\r\n"
# Fixed values of the format.
VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
PAGE = "urn:page:"

_CAPTURE = "key string, url string, file string, offset long, length long"
_RECORD = (
    "url string, file string, offset long, page_id long, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long, payload string"
)


_ARROW_RECORD = pa.schema(
    [
        ("url", pa.string()),
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.string()),
    ]
)


def surt(url: str | None) -> str:
    """The key of a url: host labels reversed, then port, path and query; no scheme, user or fragment."""
    rest = (url or "").replace("\r", "%0D").replace("\n", "%0A").split("#", 1)[0]
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(?://)?", "", rest, count=1)
    at = re.search(r"[/?]", rest)
    host, path = (rest[: at.start()], rest[at.start() :]) if at else (rest, "")
    name, _, port = host.rpartition("@")[2].lower().partition(":")
    if not name and not path:
        return ""
    port = "" if port in ("", "80", "443") else f":{port}"
    return ",".join(reversed(name.strip(".").split("."))) + port + ")" + (path if path.startswith("/") else "/" + path)


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Pages (page_id, url, html) with payload_bytes, payload_digest and refers_to, NULL for responses."""
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    sized = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text.alias("html")).withColumns(
        {"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2(F.col("html").cast("binary"), 256)}
    )
    large = F.col("payload_bytes") >= least_bytes
    # Combines before the shuffle, so thousands of copies are one row a task. What is written is small where
    # copies are few: its size decides whether Spark broadcasts it.
    repeated = materialised(
        sized.where(large)
        .groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    joined = sized.join(repeated, large & (F.col("payload_digest") == F.col("_digest")), "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id") != F.col("_first"), F.col("_first"))).drop(
        "_digest", "_first"
    )


def write_archives(pages: DataFrame, folder: str) -> None:
    """Writes one record per page into WARC files in ``folder``."""
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")

    def field(name: str, value) -> list:
        """A header line, left out where the value is NULL."""
        return [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))]

    record = F.concat(
        F.lit(VERSION + CRLF),
        *field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        *field("WARC-Record-ID", F.concat(F.lit("<" + PAGE), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        *field("WARC-Date", F.lit(DATE)),
        *field("WARC-Target-URI", url),
        *field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        *field("WARC-Refers-To", F.concat(F.lit("<" + PAGE), F.col("refers_to").cast("string"), F.lit(">"))),
        *field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        *field("X-Payload-Length", F.when(revisit, F.col("payload_bytes").cast("string"))),
        *field("Content-Type", F.lit("application/http; msgtype=response")),
        *field("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )
    pages.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option(
        "maxRecordsPerFile", FILE_RECORDS
    ).mode("errorifexists").text(folder)


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogateescape").split(CRLF)
    return dict(line.split(": ", 1) for line in lines[1:] if ": " in line)


def records_of(content: bytes) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Offset, length and header fields of each record of a WARC file."""
    at, gap = 0, (CRLF + CRLF).encode()
    while at < len(content):
        body = content.index(gap, at) + len(gap)
        fields = _headers(content[at : body - len(gap)])
        end = body + int(fields["Content-Length"])
        yield at, end - at, fields
        at = end + len(gap)


def parse_record(record: bytes) -> dict:
    """Page id, type, payload and reference of one record. A stored payload's digest is computed anew."""
    gap = (CRLF + CRLF).encode()
    head, _, block = record.partition(gap)
    fields = _headers(head)
    payload = block.partition(gap)[2]
    page = fields["WARC-Record-ID"][1 + len(PAGE) : -1]
    out = {
        "url": fields.get("WARC-Target-URI"),
        "page_id": int(page) if page else None,
        "record_type": fields["WARC-Type"],
        "refers_to": None,
        "payload": None,
    }
    if fields["WARC-Type"] == "revisit":
        size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].partition(":")[2]
        out["refers_to"] = int(fields["WARC-Refers-To"][1 + len(PAGE) : -1])
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        out["payload"] = payload.decode("utf-8", "replace")
    return out | {"payload_bytes": size, "payload_digest": digest}


@dataclass(frozen=True)
class CaptureIndex:
    """Where the archives and the two levels of the index lie. ``blocks``: part, block, first, last, lines;
    ``parts``: the bounds of each range partition, at most as many as there were partitions."""

    spark: SparkSession
    folder: str
    blocks: DataFrame
    parts: list[tuple[int, str, str]]

    def lookup(self, keys: DataFrame) -> DataFrame:
        """All captures of the keys (column ``key``): key, url, file, offset, length."""
        parts = sorted(self.parts, key=lambda p: (p[1], p[0]))
        firsts, lasts = [p[1] for p in parts], [p[2] for p in parts]

        def to_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [
                    (key, parts[i][0])
                    for key in batch.column("key").to_pylist()
                    for i in range(bisect_left(lasts, key), bisect_right(firsts, key))
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())],
                    names=["key", "part"],
                )

        def to_blocks(wanted: pa.Table, directory: pa.Table) -> pa.Table:
            rows = sorted(directory.to_pylist(), key=lambda r: r["block"])
            first, last = [r["first"] for r in rows], [r["last"] for r in rows]
            found = [
                (key, part, rows[i]["block"])
                for key, part in zip(wanted["key"].to_pylist(), wanted["part"].to_pylist())
                for i in range(bisect_left(last, key), bisect_right(first, key))
            ]
            columns = list(zip(*found)) or [(), (), ()]
            return pa.table(
                {
                    "key": pa.array(columns[0], pa.string()),
                    "part": pa.array(columns[1], pa.int32()),
                    "block": pa.array(columns[2], pa.int32()),
                }
            )

        def in_blocks(wanted: pa.Table, block: pa.Table) -> pa.Table:
            out = []
            for data in block["lines"].to_pylist():
                lines = [json.loads(line) for line in zlib.decompress(data).decode().split("\n")]
                held = [line[0] for line in lines]
                for key in wanted["key"].to_pylist():
                    out += lines[bisect_left(held, key) : bisect_right(held, key)]
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.table(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "url", "file", "offset", "length"]
            )

        wanted = keys.select(F.coalesce(F.col("key"), F.lit("")).alias("key")).distinct()
        by_part = wanted.mapInArrow(to_parts, "key string, part int").groupBy("part")
        directory = self.blocks.select("part", "block", "first", "last").groupBy("part")
        pointed = by_part.cogroup(directory).applyInArrow(to_blocks, "key string, part int, block int")
        blocks = self.blocks.select("part", "block", "lines").groupBy("part", "block")
        return pointed.groupBy("part", "block").cogroup(blocks).applyInArrow(in_blocks, _CAPTURE)

    def fetch(self, captures: DataFrame) -> DataFrame:
        """The records at the byte ranges of ``captures``, parsed. Only the ranges are read, in order within each
        archive, where the tasks can open the store; else Spark reads the archives that have any."""
        store = _opened(self.folder)
        if store is None:
            return self._fetch_whole(captures)
        uri = self.folder

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, root = _opened(uri)
            name, file = None, None
            for batch in batches:
                for at in range(0, batch.num_rows, READ_ROWS):
                    out = []
                    some = batch.slice(at, READ_ROWS)
                    for own, offset, length in zip(*(some.column(c).to_pylist() for c in ("file", "offset", "length"))):
                        if own != name:
                            name, file = own, system.open_input_file(f"{root}/{own}")
                        file.seek(offset)
                        out.append({"file": own, "offset": offset} | parse_record(file.read(length)))
                    yield pa.RecordBatch.from_pylist(out, _ARROW_RECORD)

        placed = captures.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
        return placed.mapInArrow(read, _RECORD)

    def _fetch_whole(self, captures: DataFrame) -> DataFrame:
        files = (
            self.spark.read.format("binaryFile")
            .load(self.folder)
            .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
        )

        def read(ranges: pa.Table, content: pa.Table) -> pa.Table:
            held = content["content"][0].as_py() if content.num_rows else b""
            rows = [
                {"file": file, "offset": offset} | parse_record(held[offset : offset + length])
                for file, offset, length in zip(*(ranges[c].to_pylist() for c in ("file", "offset", "length")))
            ]
            return pa.Table.from_pylist(rows, _ARROW_RECORD)

        return captures.groupBy("file").cogroup(files.groupBy("file")).applyInArrow(read, _RECORD)


def _opened(uri: str):
    """The file system and the path of a folder, if pyarrow has the file system; else None."""
    try:
        return FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    except (pa.ArrowException, OSError):
        return None


def build_index(spark: SparkSession, folder: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Parses the archives in ``folder`` and builds both levels of the index."""
    ship_package(spark)

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                rows = []
                for offset, length, fields in records_of(content.as_py()):
                    url = fields.get("WARC-Target-URI")
                    rows.append((surt(url), url, file, offset, length))
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "url", "file", "offset", "length"]
                )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, count = [], 0

        def packed(rows: list[list]) -> pa.RecordBatch:
            nonlocal count
            count += 1
            data = zlib.compress("\n".join(json.dumps(r) for r in rows).encode())
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "block": pa.array([count - 1], pa.int32()),
                    "first": [rows[0][0]],
                    "last": [rows[-1][0]],
                    "lines": pa.array([data], pa.binary()),
                }
            )

        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else None
            waiting += [list(r.values())[:5] for r in batch.to_pylist()]
            while len(waiting) >= block_lines:
                yield packed(waiting[:block_lines])
                del waiting[:block_lines]
        if waiting:
            yield packed(waiting)

    files = spark.read.format("binaryFile").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    order = ["key", "file", "offset"]  # no two captures are equal, so a frequent key is split over partitions
    parsed = materialised(named.mapInArrow(captures, _CAPTURE))
    ordered = parsed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    made = materialised(
        ordered.mapInArrow(blocks, "part int, block int, first string, last string, lines binary")
    )
    bounds = made.groupBy("part").agg(F.min("first"), F.max("last")).collect()  # one row a partition
    return CaptureIndex(spark, folder, made, [tuple(r) for r in bounds])


def keys_of(pages: DataFrame) -> DataFrame:
    """The keys (column ``key``) of the urls of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": [surt(u) for u in batch.column("url").to_pylist()]})

    return pages.select(F.col("url").cast("string").alias("url")).mapInArrow(run, "key string")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives, indexes them, looks up every url and reads all records back by their ranges."""
    spark = pages.sparkSession
    folder = shared_path(spark)
    write_archives(with_revisits(pages), folder)
    index = build_index(spark, folder)
    return index.fetch(index.lookup(keys_of(pages)))


__all__ = ["CaptureIndex", "archive_and_read", "build_index", "surt", "with_revisits", "write_archives"]

"""WARC archives as a Spark data source, and the archives of a crawl.

``spark.read.format("warc")`` plans each archive as ranges that begin at records,
reads the header of a record before anything else, tests it against the pushed
filters on record type and other header columns, and decodes a payload only for
records that pass and only if the option ``payload`` isn't false. Writing makes one
gzip member per record. The member's header carries its compressed size (a gzip extra
field, which other readers ignore), so an unwanted record is skipped by a seek;
without that field the member is inflated to find its end. A range ends at most
``RANGE_BYTES`` behind its start, or at the end of the record there. Archives of other
writers, ``*.warc.gz`` and plain ``*.warc``, are one range each. What isn't a record, or ends
before its time, is an error; with the option ``damaged`` as "skip" the rest of its range
is left out.

``archive`` writes one record per page: of equal payloads of at least
``least_bytes`` the page with the smallest id is a response, the others revisit it.

Defined results: a null payload is empty; smaller payloads are always responses;
pages with a null id are responses with an id-less record; rows with equal id and
equal payload are alike; a URL with line breaks or spaces at its ends, which a header can't
hold, has a header of its own beside and comes back unchanged; extra columns are not
archived; no pages make an empty archive.

Lost executors: each task attempt writes files of its own name, and only those of
committed attempts are listed in the manifest that reading starts from.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema

from reckoner.llm.common import settled

LEAST_BYTES = 100
RANGE_BYTES = 8 << 20
FILE_BYTES = 256 << 20
BATCH_BYTES = 4 << 20
#: Of a broadcast table of revisits, and of one of its rows in memory.
BROADCAST_BYTES, REVISIT_BYTES = 64 << 20, 128
COLUMNS = pa.schema(
    [(c, pa.string()) for c in ("record_id", "record_type", "target_uri", "warc_date", "refers_to", "payload_digest")]
    + [("payload_length", pa.int64()), ("content_type", pa.string()), ("payload", pa.binary())]
)
#: Column and WARC header.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "WARC-Payload-Length",
    "content_type": "Content-Type",
}
_HTTP = "application/http; msgtype=response"
_EXTRA = b"WL"
#: Base64 of a URL that its own header doesn't hold unchanged.
_EXACT = "X-Exact-Target-URI"
_MANIFEST = "_archives.json"


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field holds its own size."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 12) + _EXTRA + struct.pack("<HQ", 8, size)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(row: dict, date: str) -> bytes:
    """The bytes of one WARC record; the block is an HTTP response, bodyless for revisits."""
    body = (row.get("payload") or b"") if row["record_type"] != "revisit" else b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body
    values = {"warc_date": date, "content_type": _HTTP} | {k: row[k] for k in HEADERS if row.get(k) is not None}
    plain = {k: " ".join(str(v).split()) for k, v in values.items()}
    lines = [f"{name}: {plain[k]}" for k, name in HEADERS.items() if k in values]
    if plain.get("target_uri", "") != values.get("target_uri", ""):
        lines.append(f"{_EXACT}: {base64.b64encode(values['target_uri'].encode()).decode()}")
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def header(text: bytes) -> dict[str, str]:
    """The named fields of a record's header, names in lower case."""
    fields = {}
    for line in text.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    if exact := fields.get(_EXACT.lower()):
        fields[HEADERS["target_uri"].lower()] = base64.b64decode(exact).decode()
    return fields


def _member_size(head: bytes) -> int | None:
    """Compressed size from the extra field, if there is one."""
    if len(head) < 24 or not head[3] & 4:
        return None
    end = 12 + struct.unpack_from("<H", head, 10)[0]
    at = 12
    while at + 4 <= min(end, len(head)):
        n = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == _EXTRA and n == 8:
            return struct.unpack_from("<Q", head, at + 4)[0]
        at += 4 + n
    return None


@dataclass
class Record:
    fields: dict[str, str]
    block: bytes | None


class Damaged(ValueError):
    pass


def records(source: pa.NativeFile, start: int, end: int, wanted, payload: bool, first_bytes: int = 4096) -> Iterator[Record]:
    """Records that begin in ``start`` to ``end`` and whose header ``wanted`` accepts."""
    at = start
    while at < end:
        source.seek(at)
        raw = source.read(first_bytes)
        if raw[:5] == b"WARC/":
            found, size = _plain(source, at, raw, wanted, payload)
        elif raw[:2] == b"\x1f\x8b":
            found, size = _member(source, at, raw, wanted, payload, first_bytes)
        elif not raw.strip(b"\r\n"):
            # Blank lines at the end of a plain archive.
            found, size = None, max(1, len(raw))
        else:
            raise Damaged(f"no record at byte {at}")
        at += size
        if found:
            yield found


def _length(fields: dict[str, str], at: int) -> int:
    """The length that a header states (0 without one)."""
    text = fields.get("content-length", "0")
    if not (text.isascii() and text.isdigit()):
        raise Damaged(f"a length of {text!r} at byte {at}")
    return int(text)


def _plain(source: pa.NativeFile, at: int, raw: bytes, wanted, payload: bool) -> tuple[Record | None, int]:
    while b"\r\n\r\n" not in raw:
        more = source.read(1 << 16)
        if not more:
            raise Damaged(f"a header without end at byte {at}")
        raw += more
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = header(head)
    n = _length(fields, at)
    if not wanted(fields):
        return None, len(head) + 4 + n + 4
    if payload:
        if len(rest) < n:
            rest += source.read(n - len(rest))
        if len(rest) < n:
            raise Damaged(f"a record of {n} bytes has {len(rest)} at byte {at}")
    return Record(fields, rest[:n] if payload else None), len(head) + 4 + n + 4


def _member(source: pa.NativeFile, at: int, raw: bytes, wanted, payload: bool, first_bytes: int) -> tuple[Record | None, int]:
    size = _member_size(raw)
    inflate = zlib.decompressobj(31)
    try:
        text = inflate.decompress(raw, first_bytes)
        while b"\r\n\r\n" not in text:
            more = inflate.unconsumed_tail or source.read(first_bytes)
            if not more or inflate.eof:
                raise Damaged(f"a header without end at byte {at}")
            text += inflate.decompress(more, first_bytes)
        head, _, rest = text.partition(b"\r\n\r\n")
        fields = header(head)
        take = wanted(fields)
        if (take and payload) or size is None:
            parts = [rest]
            while not inflate.eof:
                more = inflate.unconsumed_tail or source.read(1 << 16)
                if not more:
                    raise Damaged(f"a record without end at byte {at}")
                parts.append(inflate.decompress(more))
            size = size or source.tell() - len(inflate.unused_data) - at
            rest = b"".join(parts)[: _length(fields, at)]
    except zlib.error as error:
        raise Damaged(f"{error} at byte {at}") from error
    return (Record(fields, rest if payload else None) if take else None), size


def body(fields: dict[str, str], block: bytes) -> bytes:
    """The payload of a block: what follows the HTTP header, if there is one."""
    return block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, skip_damaged: bool = False):
        self.path, self.payload, self.skip_damaged, self.tests = path, payload, skip_damaged, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take over tests of header columns; the others stay with Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
            if name not in HEADERS or name == "payload_length":
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((name, "start", f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        try:
            with system.open_input_stream(f"{root}/{_MANIFEST}") as file:
                listed = json.loads(file.read())
        except FileNotFoundError:
            found = system.get_file_info(fs.FileSelector(root))
            listed = [{"name": f.base_name, "starts": [0], "size": f.size} for f in found if f.base_name.endswith((".warc.gz", ".warc"))]
        return [Range(f"{self.path.rstrip('/')}/{f['name']}", a, b) for f in listed for a, b in zip(f["starts"], [*f["starts"][1:], f["size"]], strict=True)]

    def wanted(self, fields: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            have = fields.get(HEADERS[name].lower())
            if have is None or not (have in value if kind == "in" else have.startswith(value)):
                return False
        return True

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without files
            return
        system, name = fs.FileSystem.from_uri(partition.path)
        rows, size = [], 0
        with system.open_input_file(name) as source:
            found = records(source, partition.start, partition.end, self.wanted, self.payload)
            while True:
                try:
                    r = next(found, None)
                except Damaged as error:
                    if not self.skip_damaged:
                        raise Damaged(f"{partition.path}: {error}") from error
                    r = None
                if r is None:
                    break
                row = {c: r.fields.get(h.lower()) for c, h in HEADERS.items()}
                row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
                row["payload"] = body(r.fields, r.block) if r.block is not None else None
                rows.append(row)
                size += len(row["payload"] or b"") + 500
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, COLUMNS)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, COLUMNS)


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str):
        self.path, self.date = path, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        files: list[dict] = []
        sink = None
        for batch in iterator:
            for k in range(0, batch.num_rows, 64):
                for row in batch.slice(k, 64).to_pylist():
                    if sink is None:
                        files.append({"name": f"{uuid.uuid4().hex}.warc.gz", "starts": [0], "size": 0})
                        sink = system.open_output_stream(f"{root}/{files[-1]['name']}", compression=None)
                    now, data = files[-1], member(record(row, self.date))
                    if now["size"] - now["starts"][-1] >= RANGE_BYTES:
                        now["starts"].append(now["size"])
                    sink.write(data)
                    now["size"] += len(data)
                    if now["size"] >= FILE_BYTES:
                        sink.close()
                        sink = None
        if sink is not None:
            sink.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{_MANIFEST}") as file:
            file.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        for f in (f for m in messages if m for f in m.files):
            system.delete_file(f"{root}/{f['name']}")


class WarcSource(DataSource):
    """Options: path; payload (read; default true); damaged (read; "fail" or "skip");
    date (write; WARC-Date of records)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return from_arrow_schema(COLUMNS)

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false", self.options.get("damaged", "fail") == "skip")

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "2000-01-01T00:00:00Z"))


def register(spark: SparkSession) -> None:
    """Make format "warc" known, and let Spark push filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload a page with a smaller id has."""
    large = pages.where(F.col("bytes") >= least_bytes).select("page_id", "digest")
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return large.join(firsts, "digest").where("page_id > refers_to").distinct()


def archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> None:
    """Write the archives of ``pages`` (page_id, url, html) below ``path``.

    Pages are read twice: for their digests, which are kept, and to be written.
    """
    spark = pages.sparkSession
    register(spark)
    html = F.coalesce("html", F.lit(""))
    digest = F.unhex(F.sha2(html, 256)).alias("digest")
    again = settled(revisits(settled(pages.select("page_id", digest, F.octet_length(html).alias("bytes"))), least_bytes))
    have = pages.select("page_id", "url", digest, F.octet_length(html).cast("long").alias("bytes"), html.alias("html"))
    # The payloads are shuffled only if the revisits are too many to be sent to every task.
    if again.count() * REVISIT_BYTES <= broadcast_bytes:
        again = F.broadcast(again)
    joined = have.join(again, ["page_id", "digest"], "left")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.col(c).cast("string"))
    records_ = joined.select(
        urn("page_id").alias("record_id"),
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(None).cast("string").alias("warc_date"),
        urn("refers_to").alias("refers_to"),
        F.concat(F.lit("sha256:"), F.lower(F.hex("digest"))).alias("payload_digest"),
        F.col("bytes").alias("payload_length"),
        F.lit(_HTTP).alias("content_type"),
        F.when(F.col("refers_to").isNull(), F.encode("html", "UTF-8")).alias("payload"),
    )
    records_.write.format("warc").option("path", path).mode("append").save()


def pages_of(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to from archives.

    Size and digest of a response are computed from its payload; a revisit has none,
    and its header's are taken.
    """
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    full = read(spark, path).where("record_type = 'response'")
    slim = read(spark, path, payload=False).where("record_type = 'revisit'")
    full = full.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("found"))
    slim = slim.select("*", F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("found"))
    return full.union(slim).select(
        number("record_id").alias("page_id"), "payload_bytes", F.col("found").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), F.col("target_uri").alias("url")
    )

"""WARC archives as a Spark data source.

``spark.read.format("warc").load(folder)`` gives one row per record; ``df.write.format("warc").mode("append")`` writes
records. Files are ``*.warc`` or ``*.warc.gz`` with one gzip member per record; a member written here carries its
compressed size in the gzip header's "sl" field, so a reader jumps over it.

Planning lists the files and packs small ones into partitions of ``partition_bytes``. Filters on the header columns
are pushed down: equality, lists and prefixes on record_type, record_id, target_uri, payload_digest, refers_to and
page_id. A reader parses a record's headers first; where a pushed filter fails, it seeks to the next record without
decompressing or reading the rest. ``payload`` is "keep" (default), "verify" (payloads are decoded and checked
against their digests, the column is null) or "skip" (headers only). Files are read and written through Arrow file
systems by URI, record by record; a task holds one record.

A writer's task writes files of its own under names that start with "_", rolled at ``roll_bytes``; the commit on the
driver renames them, so a lost or repeated task leaves nothing in the archive.

Nulls and edges: a null html is an empty payload, a null page id or url an absent header. Empty tables give archives without records,
payloads of any length are one record each, and columns of pages besides id, url and html are ignored, whatever their names.

Payload digests are those of the whole payload: bare upper-case base32 SHA-1. A payload that was written before is
written as a revisit record, which has headers only.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from loomgrid.llm.common import shared_path

SCHEMA = (
    "record_type string, record_id string, page_id long, target_uri string, warc_date string, payload_digest string, "
    "payload_bytes long, refers_to string, refers_to_page long, payload binary, file string, position long"
)
#: Header names of the columns that come straight from a header. Names are fixed by the WARC format but the X- ones.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "page_id": "X-Page-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "refers_to_page": "X-Refers-To-Page-ID",
}
LONGS = ("page_id", "refers_to_page")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record_uri(page_id: int | None, digest: str) -> str:
    """The id of a page's record with a payload; a revisit has the digest of the record that it refers to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, record_type: str, refers_to: int | None, date: str = DATE) -> bytes:
    """The bytes of one record; a revisit keeps the HTTP head of its payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    digest = base32_sha1(payload)
    head = [("WARC-Type", record_type), ("WARC-Record-ID", record_uri(page_id, digest)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}")]
    head += [("X-Page-ID", str(page_id))] if page_id is not None else []
    head += [("WARC-Target-URI", _line(url))] if url is not None else []
    if record_type == "revisit":
        head += [("WARC-Refers-To", record_uri(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to)), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member with the compressed and plain sizes in its "sl" field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_head(data: bytes) -> dict[str, str]:
    lines = data.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines[1:] if x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


class _Plain:
    """Records of a file that isn't compressed."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.at = stream, size, 0

    def records(self) -> Iterator[tuple[int, bytes]]:
        """(position, head) of each record; ``rest`` reads on in it."""
        while self.at < self.size:
            start, head = self.at, b""
            self.stream.seek(start)
            while (end := head.find(b"\r\n\r\n")) < 0:
                more = self.stream.read(4096)
                if not more:
                    if head.strip():
                        raise ValueError("a record's head does not end")
                    return
                head += more
            self.body = start + end + 4
            head = head[:end]
            self.length = int(parse_head(head).get("content-length", 0))
            self.at = self.body + self.length + 4
            yield start, head

    def rest(self, most: int | None = None) -> bytes:
        self.stream.seek(self.body)
        return self.stream.read(self.length if most is None else min(most, self.length))


class _Gzip:
    """Records of a file with one gzip member per record."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.at = stream, size, 0

    def _feed(self, least: int) -> None:
        """Decompress until ``plain`` has ``least`` bytes or the member ends."""
        while len(self.plain) < least and not self.unpack.eof:
            data = self.unpack.unconsumed_tail or self.stream.read(65536 if self.jump is None or self.jump > 65536 else 8192)
            if not data:
                raise ValueError("a gzip member does not end")
            self.plain += self.unpack.decompress(data, max(4096, least - len(self.plain)))

    def records(self) -> Iterator[tuple[int, bytes]]:
        while self.at < self.size:
            start = self.at
            self.stream.seek(start)
            first = self.stream.read(24)
            self.jump = struct.unpack("<I", first[16:20])[0] if first[3:4] == b"\x04" and first[12:14] == b"sl" else None
            self.stream.seek(start)
            self.unpack, self.plain = zlib.decompressobj(zlib.MAX_WBITS | 16), b""
            while (end := self.plain.find(b"\r\n\r\n")) < 0:
                if self.unpack.eof:
                    raise ValueError("a record's head does not end")
                self._feed(len(self.plain) + 1)
            self.body, head = end + 4, self.plain[:end]
            self.length = int(parse_head(head).get("content-length", 0))
            yield start, head
            if self.jump is None:
                while not self.unpack.eof:
                    self._feed(len(self.plain) + 65536)
                self.jump = self.stream.tell() - len(self.unpack.unused_data) - start
            self.at = start + self.jump

    def rest(self, most: int | None = None) -> bytes:
        end = self.body + (self.length if most is None else min(most, self.length))
        self._feed(end)
        return self.plain[self.body : end]


def split_http(block: bytes) -> tuple[int | None, int]:
    """(the HTTP head's Content-Length, where the payload begins)."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return None, 0
    for x in block[:end].split(b"\r\n")[1:]:
        k, _, v = x.partition(b":")
        if k.strip().lower() == b"content-length" and v.strip().isdigit():
            return int(v), end + 4
    return None, end + 4


class WarcPartition(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "keep")
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if column not in HEADERS or column == "payload":
                yield f
            elif isinstance(f, EqualNullSafe):
                self.tests.append((column, "in", {f.value}))
            elif isinstance(f, (EqualTo, In)):  # a null among the values equals nothing
                self.tests.append((column, "in", {v for v in (f.value if isinstance(f, In) else (f.value,)) if v is not None}))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "prefix", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "set", None))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.is_file and x.base_name.endswith((".warc", ".warc.gz")) and not x.base_name.startswith(("_", ".")))
        out, group, size = [], [], 0
        for path, n in files:
            if group and size + n > self.partition_bytes:
                out.append(WarcPartition(group))
                group, size = [], 0
            group.append((path, n))
            size += n
        return [*out, WarcPartition(group)] if group else out

    def _wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            own = row[column]
            if kind == "in" and own not in value or kind == "set" and own is None or kind == "prefix" and not (own or "").startswith(value):
                return False
        return True

    def read(self, partition: WarcPartition) -> Iterator:
        import pyarrow as pa
        import pyarrow.fs as pafs

        if partition is None:  # no files
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])
        rows, size = [], 0
        for path, length in partition.files:
            with fs.open_input_file(path) as stream:
                source = (_Gzip if path.endswith(".gz") else _Plain)(stream, length)
                for position, head in source.records():
                    row = self._row(source, parse_head(head), path, position)
                    if row is None:
                        continue
                    rows.append(row)
                    size += 300 + len(row["payload"] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _row(self, source, head: dict[str, str], path: str, position: int) -> dict | None:
        row = {c: head.get(h.lower()) for c, h in HEADERS.items()}
        row |= {c: int(row[c]) if row[c] is not None else None for c in LONGS}
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
        if not self._wanted(row):
            return None
        length, begin = split_http(source.rest(4096))
        row |= {"payload": None, "payload_bytes": source.length - begin if length is None else length, "file": path, "position": position}
        if self.payload != "skip" and row["record_type"] not in ("revisit", "warcinfo"):
            payload = source.rest()[begin:]
            row["payload_bytes"] = len(payload)
            if row["payload_digest"] and base32_sha1(payload) != row["payload_digest"]:
                raise ValueError(f"{path} at {position}: the payload does not have its digest")
            row["payload"] = payload if self.payload == "keep" else None
        return row


class WarcFiles(WriterCommitMessage):
    def __init__(self, names: list[tuple[str, str]]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of page_id, url, payload, record_type and refers_to_page."""

    def __init__(self, options):
        self.path, self.level, self.roll = options["path"], int(options.get("level", 3)), int(options.get("roll_bytes", 256 << 20))

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        import pyarrow.fs as pafs
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        mark, suffix = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", ".warc.gz" if self.level else ".warc"
        names, stream = [], None
        try:
            for batch in iterator:
                for r in batch.to_pylist():
                    if stream is None or stream.tell() > self.roll:
                        if stream is not None:
                            stream.close()
                        final = f"{root}/pages-{mark}-{len(names):04d}{suffix}"
                        names.append((f"{root}/_{final.rpartition('/')[2]}", final))
                        stream = fs.open_output_stream(names[-1][0], compression=None)
                    data = record(r["page_id"], r["url"], r["payload"] or b"", r["record_type"], r["refers_to_page"])
                    stream.write(member(data, self.level) if self.level else data)
        finally:
            if stream is not None:
                stream.close()
        return WarcFiles(names)

    def commit(self, messages: list) -> None:
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            for own, final in m.names if m else ():
                fs.move(own, final)

    def abort(self, messages: list) -> None:
        import pyarrow.fs as pafs

        fs, _ = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for own, _ in m.names if m else ():
                fs.delete_file(own)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, record_type, refers_to_page) of pages (page_id, url, html).

    Of pages with equal payloads of at least ``least_bytes``, that with the smallest page_id is the response and the
    others revisit it. A null html is an empty payload; pages with a null id revisit like others, and are responses
    where no page with that payload has an id; repeated rows of the smallest id are responses each.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    least = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("least"))
    again = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    marked = rows.join(least, "digest", "left")
    return marked.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("least")).alias("refers_to_page"))


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0, level: int = 3) -> None:
    register(pages.sparkSession)
    records(pages, least_bytes).write.format("warc").mode("append").option("level", str(level)).save(path)


def read(spark: SparkSession, path: str, payload: str = "keep") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read every record back.

    Two scans with a pushed record type: payloads of responses are decoded and checked, revisits are headers alone.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_pages(pages, path, least_bytes)
    found = [read(spark, path, payload=how).where(F.col("record_type") == kind) for kind, how in (("response", "verify"), ("revisit", "skip"))]
    return found[0].unionByName(found[1])

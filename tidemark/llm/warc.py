"""WARC archives: a writer, and a PySpark data source that reads headers first.

*Reading.*  ``spark.read.format("tidemark_warc")`` plans partitions of about ``partitionBytes`` from the
writer's manifest, which lists stretches of whole records, so that a large archive is read by many tasks and
small ones share one.  A folder of other writers has no manifest; its files are then listed, each read by
one task.  Predicates on the record type and other header columns are pushed
down.  A record's headers are parsed first; its payload is decoded only if the predicates let the record
pass and ``payload`` is not switched off.  A plain record that is not wanted is passed by its
Content-Length, a compressed one by the member size that the writer leaves in the gzip header's extra
field (members of other writers are inflated to find their end, a piece at a time).

*Writing.*  One gzip member a record, of fixed memory.  Every attempt of a task writes a file of its own name;
the manifest, which Spark commits with the results of one attempt of each task, names those that count.
Nothing is renamed, and what a lost executor leaves is never read.

Defined cases: page_id holds whole numbers (other types are refused); record ids name pages, so that rows of
one page_id share theirs; a null payload is empty; a null URL leaves the target header out; a null page_id leaves its
record id out; payloads under ``MIN_SHARED`` bytes are never shared; rows of one page_id and one payload
are captures of the same page and are all responses if it is the first; an empty table writes no file; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

from .columns import whole_numbers
from .scratch import small_side, stage

FORMAT = "tidemark_warc"
MIN_SHARED = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
BROADCAST_ROWS = 500_000
#: Bytes of archive that a stretch of the manifest, and a partition of the reader, hold at least.
PARTITION_BYTES = 16 << 20
#: The manifest's folder among the archives.
MANIFEST = "_manifest"
#: Rows and payload bytes of an Arrow batch of the reader.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: gzip header with an extra field of one subfield, "SL": the member's size.
_HEAD = struct.Struct("<4sIBBH2sHI")
_MAGIC = b"\x1f\x8b\x08\x04"
_PIECE = 1 << 16


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member that tells its own size."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = _HEAD.size + len(body) + 8
    return _HEAD.pack(_MAGIC, 0, 0, 255, 8, b"SL", 4, size) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _line(name: str, value: object) -> str:
    text = str(value).replace("\r", "%0D").replace("\n", "%0A")
    return f"{name}: {text}\r\n"


def record(payload: bytes, digest: str, url: str | None = None, page_id: int | None = None, refers_to: int | None = None) -> bytes:
    """A response record, or a revisit record if ``refers_to`` names the page that holds the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = "WARC/1.1\r\n" + _line("WARC-Type", "response" if refers_to is None else "revisit")
    if page_id is not None:
        head += _line("WARC-Record-ID", f"<urn:page:{page_id}>")
    if url is not None:
        head += _line("WARC-Target-URI", url)
    head += _line("WARC-Date", DATE) + _line("WARC-Payload-Digest", f"sha256:{digest}")
    if refers_to is not None:
        head += _line("WARC-Refers-To", f"<urn:page:{refers_to}>") + _line("WARC-Profile", PROFILE)
    head += _line("Content-Type", "application/http; msgtype=response") + _line("Content-Length", len(block))
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, compressed: bool = True) -> DataFrame:
    """Write (page_id, url, html) as archives under ``folder`` (a URI); returns the manifest.

    Among equal payloads of MIN_SHARED bytes or more, the one of the smallest page_id is the response and
    the others are revisits.  Digests meet in a shuffle of digests; payloads are only shuffled if the
    payloads that repeat are too many to send to all tasks.
    """
    whole_numbers(pages, "page_id")
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumns({"_digest": F.sha2(html, 256), "_long": F.octet_length(html) >= MIN_SHARED})
    shared = keyed.where("_long").groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    shared = stage(shared.select(F.col("_digest").alias("_key"), "_first"), "payloads")
    # Payloads that are never shared get keys of their own, so that they don't meet in one partition.
    key = F.when(F.col("_long"), F.col("_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "html").cast("string")))
    judged = keyed.withColumn("_key", key).join(small_side(shared, BROADCAST_ROWS), "_key", "left")
    refers = F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    rows = judged.select("page_id", "url", "html", "_digest", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc" + ".gz" * compressed
        out, stretches, start, at, n = None, [], 0, 0, 0
        for batch in batches:
            for page_id, url, text, digest, refers_to in zip(*(batch.column(k) for k in range(5))):
                if out is None:
                    out = system.open_output_stream(name, compression=None)
                data = record((text.as_py() or "").encode(), digest.as_py(), url.as_py(), page_id.as_py(), refers_to.as_py())
                data = gzip_member(data) if compressed else data
                out.write(data)
                at, n = at + len(data), n + 1
                if at - start >= PARTITION_BYTES:
                    stretches.append((name, start, at - start, n))
                    start, n = at, 0
        if out is not None:
            out.close()
            if n:
                stretches.append((name, start, at - start, n))
            names = ["path", "start", "bytes", "records"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*stretches)], names=names)

    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    kinds = "path string, start long, bytes long, records long"
    rows.mapInArrow(write, kinds).write.parquet(f"{folder}/{MANIFEST}")
    return pages.sparkSession.read.schema(kinds).parquet(f"{folder}/{MANIFEST}")


class _Stream:
    """Bytes of a file, read in pieces, with jumps."""

    def __init__(self, source):
        self._source, self._held, self.at = source, b"", 0

    def peek(self, n: int) -> bytes:
        while len(self._held) < n and (more := self._source.read(max(_PIECE, n - len(self._held)))):
            self._held += more
        return self._held[:n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.skip(len(out))
        return out

    def skip(self, n: int) -> None:
        if not n:
            return
        self.at += n
        if n <= len(self._held):
            self._held = self._held[n:]
        else:
            self._held = b""
            self._source.seek(self.at)


class _Member:
    """The inflated bytes of one gzip member; leaves the stream behind the member when closed."""

    def __init__(self, stream: _Stream):
        self._stream, self._held, self._start = stream, b"", stream.at
        head = stream.peek(_HEAD.size)
        extra = head[:4] == _MAGIC and len(head) == _HEAD.size and head[12:14] == b"SL"
        self._end = stream.at + _HEAD.unpack(head)[-1] if extra else None
        self._inflate = zlib.decompressobj(31)

    def _more(self, most: int) -> bool:
        if self._inflate.eof:
            return False
        piece = self._inflate.unconsumed_tail
        if not piece:
            piece = self._stream.take(_PIECE if self._end is None else max(0, min(_PIECE, self._end - self._stream.at)))
            if not piece:
                raise ValueError("a gzip member is cut off")
        self._held += self._inflate.decompress(piece, most)
        return True

    def peek(self, n: int) -> bytes:
        while len(self._held) < n and self._more(max(4096, n - len(self._held))):
            pass
        return self._held[:n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self._held = self._held[n:]
        return out

    def close(self) -> None:
        if self._end is not None:
            self._stream.skip(self._end - self._stream.at)
            return
        while self._more(_PIECE):
            self._held = b""
        left = len(self._inflate.unused_data)
        self._stream.at -= left
        self._stream._held = self._inflate.unused_data + self._stream._held


def _headers(source) -> tuple[str, dict[str, str], int] | None:
    """The first line, the headers (names in lower case) and the bytes of both; None at the end."""
    size = 1024
    while (end := (head := source.peek(size)).find(b"\r\n\r\n")) < 0:
        if len(head) < size:
            if head.strip():
                raise ValueError("a WARC record is cut off")
            return None
        size *= 2
    lines = source.take(end + 4)[:-4].decode("utf-8", "replace").split("\r\n")
    return lines[0], {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, end + 4


_COLUMNS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type",
}


def read_records(source, wanted=lambda row: True, payload: bool = True, start: int = 0, end: int | None = None) -> Iterator[dict]:
    """Records of an open archive, plain or of gzip members, that begin from ``start`` and before ``end``.

    ``wanted`` judges a record by its headers before its payload is decoded.
    """
    stream = _Stream(source)
    stream.skip(start)
    while (end is None or stream.at < end) and (head := stream.peek(2)):
        if head == b"\r\n":
            stream.skip(2)
            continue
        inside = _Member(stream) if head == b"\x1f\x8b" else stream
        found = _headers(inside)
        if found is None:
            if inside is stream:
                return
            inside.close()
            continue
        if not found[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = found[1]
        length = int(headers.get("content-length", 0))
        row = {name: headers.get(key) for name, key in _COLUMNS.items()} | {"content_length": length, "headers": headers, "payload": None, "payload_length": None}
        good, left = wanted(row), length
        if good:
            if "application/http" in (row["content_type"] or "") and length:
                _, http, size = _headers(inside)
                row["payload_length"] = int(http["content-length"]) if "content-length" in http else None
                left = length - size
            if payload and row["record_type"] != "revisit":
                row["payload"] = inside.take(left)
                left = 0
        if inside is stream:
            stream.skip(left)
        else:
            inside.close()
        if good:
            yield row


_TESTS = {
    EqualTo: lambda a, b: a is not None and a == b, EqualNullSafe: lambda a, b: a == b, In: lambda a, b: a is not None and a in b,
    GreaterThan: lambda a, b: a is not None and a > b, GreaterThanOrEqual: lambda a, b: a is not None and a >= b,
    LessThan: lambda a, b: a is not None and a < b, LessThanOrEqual: lambda a, b: a is not None and a <= b,
    StringStartsWith: lambda a, b: a is not None and a.startswith(b), StringEndsWith: lambda a, b: a is not None and a.endswith(b),
    StringContains: lambda a, b: a is not None and b in a,
}


class _Stretches(InputPartition):
    """Stretches of files, each a path, its first byte and the byte behind it (None: all)."""

    def __init__(self, parts: list[tuple[str, int, int | None]]):
        self.parts = parts


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self._folder, self._schema = options["path"], schema
        self._payload = options.get("payload", "true").lower() == "true"
        self._size = int(options.get("partitionBytes", PARTITION_BYTES))
        self._tests: list[tuple[str, str, object, bool]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            inner, negated = (f.child, True) if isinstance(f, Not) else (f, False)
            name = inner.attribute[0] if len(inner.attribute) == 1 else ""
            if name not in _COLUMNS and name != "content_length":
                yield f
            elif isinstance(inner, IsNotNull):
                self._tests.append((name, "IsNotNull", None, negated))
            elif type(inner) in _TESTS:
                self._tests.append((name, type(inner).__name__, inner.value, negated))
            else:
                yield f

    def _stretches(self) -> Iterator[tuple[str, int, int | None, int]]:
        """Path, start, end and bytes of all that is to be read."""
        from pyarrow import fs, parquet

        system, root = fs.FileSystem.from_uri(self._folder)
        info, manifest = system.get_file_info([root, f"{root}/{MANIFEST}"])
        if manifest.type == fs.FileType.Directory:
            listed = [f.path for f in system.get_file_info(fs.FileSelector(manifest.path)) if f.path.endswith(".parquet")]
            for path in sorted(listed):
                rows = parquet.read_table(path, columns=["path", "start", "bytes"], filesystem=system)
                for name, start, size in zip(*(c.to_pylist() for c in rows.columns)):
                    yield name, start, start + size, size
            return
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        for f in sorted((f for f in files if f.is_file and f.path.endswith((".warc", ".warc.gz"))), key=lambda f: f.path):
            yield f.path, 0, None, f.size

    def partitions(self):
        out, parts, held = [], [], 0
        for path, start, end, size in self._stretches():
            if parts and held + size > self._size:
                out.append(_Stretches(parts))
                parts, held = [], 0
            parts.append((path, start, end))
            held += size
        return [*out, _Stretches(parts)] if parts or not out else out

    def _wanted(self, row: dict) -> bool:
        for name, kind, value, negated in self._tests:
            own = row[name]
            if kind == "IsNotNull":
                passed = own is not None
            else:
                passed = next(test for f, test in _TESTS.items() if f.__name__ == kind)(own, value)
                if negated and own is None and kind != "EqualNullSafe":
                    return False
            if passed == negated:
                return False
        return True

    def read(self, partition):
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = fs.FileSystem.from_uri(self._folder)
        shape = to_arrow_schema(self._schema)
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_ARROW.get(f.name, lambda v: v)(r[f.name]) for r in rows], f.type) for f in shape], schema=shape)

        for path, start, end in partition.parts:
            with system.open_input_file(path) as source:
                for row in read_records(source, self._wanted, self._payload and "payload" in shape.names, start, end):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


#: How values are told to Arrow, where not as they are.
_ARROW = {"headers": lambda found: list(found.items())}


class WarcDataSource(DataSource):
    """Records of WARC files: headers as columns, the rest as a map, and the payload."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in _COLUMNS) + ", content_length long, payload_length long, payload binary, headers map<string,string>"

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, schema)


def read_archives(spark: SparkSession, folder: str, payload: bool = True, **options) -> DataFrame:
    """Records under ``folder``; predicates are pushed down while the session lets them, which this turns on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format(FORMAT).option("payload", str(payload).lower()).options(**options).load(folder)


def page_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Per record of `write_archives`: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are measured from their decoded payloads, revisits from their headers alone.
    """
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).cast("long")
    responses = read_archives(spark, folder).where("record_type = 'response'")
    responses = responses.select(F.when(F.col("record_id").isNotNull(), page("record_id")).alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = read_archives(spark, folder, payload=False).where("record_type = 'revisit'")
    revisits = revisits.select(F.when(F.col("record_id").isNotNull(), page("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)

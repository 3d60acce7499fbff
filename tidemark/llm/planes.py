"""Token ids in binary files of shuffled bit or byte planes.

A shard holds documents in order.  Their ids, little-endian unsigned 32-bit integers, are cut into blocks
of a fixed number of ids, whatever the documents' ends.  A block is transposed into byte planes (all first
bytes, all second bytes, ...) or bit planes, and each plane is compressed with zstandard by itself, so
that planes of high bytes, which are nearly constant, take almost no room.

Layout of a shard, integers little-endian::

    magic "TIDEPLN1" | uint32 ids a block | uint32 planes (4 or 32)
    planes of block 0, planes of block 1, ...
    index, compressed:  uint32 [blocks, planes] compressed sizes | int64 [docs] doc_id
                        | uint8 [docs] doc_id is there | int64 [docs] number of ids
    footer: uint64 offset of index, bytes of index, ids, docs, blocks | magic

Documents are encoded where they lie; what is shuffled are their ids, in two bytes each where the vocabulary
lets them, to ranges of doc_ids that are planned from the ids' quantiles alone.

A block's place is the sum of the sizes before it, so any range of ids is read without the rest.

Every attempt of a task writes a file of its own name, and the manifest, which Spark commits with the results
of one attempt of each task, names the files that count; nothing is renamed and readers look at no others.

Defined cases: doc_id holds whole numbers (other types are refused); a null or empty text has its end id
alone; null doc_ids come first; rows that share a doc_id are separate documents, in the order of their
texts' hashes; an empty table writes no shard; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .columns import whole_numbers
from .scratch import stage

MAGIC = b"TIDEPLN1"
HEAD, FOOT = struct.Struct("<8sII"), struct.Struct("<QQQQQ8s")
BLOCK_IDS = 1 << 16
LEVEL = 3
END_ID = 2
#: Words that a worker remembers here; no other operator's tables lie beside them.
MEMORY_WORDS = 300_000


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """Planes of a block of uint32 ids, lowest byte or bit first."""
    grid = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    if planes == 32:
        grid = np.unpackbits(grid, axis=1, bitorder="little")
        return [np.packbits(grid[:, k], bitorder="little").tobytes() for k in range(32)]
    return [grid[:, k].tobytes() for k in range(4)]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    if len(parts) == 32:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in parts], axis=1)
        return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)).reshape(-1).view("<u4")


class ShardWriter:
    """Writes one shard to an open binary stream, a block at a time."""

    def __init__(self, out, planes: int = 4, block_ids: int = BLOCK_IDS, level: int = LEVEL):
        import zstandard

        self._out, self._planes, self._block = out, planes, 4 * block_ids
        self._compress = zstandard.ZstdCompressor(level=level).compress
        self._held, self._sizes, self._docs, self._counts = bytearray(), [], [], []
        out.write(HEAD.pack(MAGIC, block_ids, planes))
        self._at = HEAD.size

    def _flush(self, block: bytes) -> None:
        for plane in to_planes(np.frombuffer(block, "<u4"), self._planes):
            packed = self._compress(plane)
            self._sizes.append(len(packed))
            self._out.write(packed)
            self._at += len(packed)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._docs.append(doc_id)
        self._counts.append(len(ids) // 4)
        self._held += ids
        while len(self._held) >= self._block:
            self._flush(bytes(self._held[: self._block]))
            del self._held[: self._block]

    def close(self) -> int:
        """Write what is left and the index; return the number of ids."""
        if self._held:
            self._flush(bytes(self._held))
        there = np.array([d is not None for d in self._docs], np.uint8)
        parts = (np.array(self._sizes, "<u4"), np.array([d or 0 for d in self._docs], "<i8"), there, np.array(self._counts, "<i8"))
        index, total = self._compress(b"".join(p.tobytes() for p in parts)), sum(self._counts)
        self._out.write(index)
        self._out.write(FOOT.pack(self._at, len(index), total, len(self._docs), len(self._sizes) // self._planes, MAGIC))
        return total


class ShardReader:
    """Reads a shard from a random-access stream; only the blocks that are asked for are decoded."""

    def __init__(self, source, size: int):
        import zstandard

        self._source, self._expand = source, zstandard.ZstdDecompressor().decompress
        magic, self.block_ids, self.planes = HEAD.unpack(self._at(0, HEAD.size))
        offset, length, self.n_ids, docs, blocks, again = FOOT.unpack(self._at(size - FOOT.size, FOOT.size))
        if magic != MAGIC or again != MAGIC:
            raise ValueError("not a whole shard of token planes")
        index, at = self._expand(self._at(offset, length)), 4 * blocks * self.planes
        sizes = np.frombuffer(index, "<u4", blocks * self.planes).astype(np.int64)
        self._starts = np.concatenate(([0], np.cumsum(sizes))) + HEAD.size
        ids = np.frombuffer(index, "<i8", docs, at)
        there = np.frombuffer(index, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [int(d) if t else None for d, t in zip(ids, there)]
        self.counts = np.frombuffer(index, "<i8", docs, at + 9 * docs)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))[:docs]

    def _at(self, offset: int, length: int) -> bytes:
        self._source.seek(offset)
        return self._source.read(length)

    def block(self, k: int) -> np.ndarray:
        edges = self._starts[k * self.planes : (k + 1) * self.planes + 1]
        data, n = self._at(int(edges[0]), int(edges[-1] - edges[0])), min(self.block_ids, self.n_ids - k * self.block_ids)
        return from_planes([self._expand(data[a - edges[0] : b - edges[0]]) for a, b in zip(edges[:-1], edges[1:])], n)

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids of any range of the shard."""
        if count <= 0:
            return np.empty(0, "<u4")
        first, last = start // self.block_ids, (start + count - 1) // self.block_ids
        whole = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return whole[start - first * self.block_ids :][:count]

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """doc_id, start and ids (in parts of a block at most) of each document, in order."""
        k, block = -1, None
        for doc_id, start, count in zip(self.doc_ids, self.starts.tolist(), self.counts.tolist()):
            parts, at, end = [], start, start + count
            while at < end:
                if at // self.block_ids != k:
                    k = at // self.block_ids
                    block = self.block(k)
                inside = at - k * self.block_ids
                parts.append(block[inside : inside + end - at])
                at += len(parts[-1])
            yield doc_id, start, parts


def write_shards(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, planes: int = 4, block_ids: int = BLOCK_IDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode ``docs`` and write them as shards in ascending doc_id order under ``folder`` (a URI).

    Returns the staged manifest: path, n_ids, n_docs and ``start``, the ids of all shards before it.
    """
    path, spark = vocabulary or tokens.vocabulary(), docs.sparkSession
    whole_numbers(docs, doc_id)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n, nulls, bounds = _ranges(rows.select("doc_id"), parts)
    width = np.dtype("<u2" if max(tokens.encoder(path).size, end_id + 1) <= 1 << 16 else "<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(path, memory_words=MEMORY_WORDS), end_id.to_bytes(4, "little")
        for batch in batches:
            part = _parts(batch.column(0), batch.column(2).to_numpy(), n, nulls, bounds)
            ids = encoder.column(batch.column(1), width, end)
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column(0), batch.column(2), ids], names=["part", "doc_id", "text_hash", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(folder)
        number, writer, n_docs = TaskContext.get().partitionId(), None, 0
        name = f"{root}/shard-{number:06d}-{uuid.uuid4().hex}.planes"
        for batch in batches:
            if batch.num_rows and writer is None:
                out = system.open_output_stream(name, compression=None)
                writer = ShardWriter(out, planes, block_ids)
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer.add(key, np.frombuffer(ids.as_py(), width).astype("<u4").tobytes())
            n_docs += batch.num_rows
        if writer is not None:
            total = writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([name]), pa.array([total]), pa.array([n_docs])], names=["part", "path", "n_ids", "n_docs"])

    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    encoded = rows.mapInArrow(encode, "part int, doc_id long, text_hash long, ids binary")
    ranged = encoded.repartitionById(n, "part").sortWithinPartitions("doc_id", "text_hash", "ids").select("doc_id", "ids")
    manifest = stage(ranged.mapInArrow(write, "part int, path string, n_ids long, n_docs long"), "plane-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))).drop("part")


def _ranges(ids: DataFrame, parts: int) -> tuple[int, int, np.ndarray]:
    """How many ranges there are, how many of them are for nulls, and the bounds between the others, from the ids alone."""
    shares = [k / parts for k in range(1, parts)] or [0.5]
    every, there, found = ids.agg(F.count(F.lit(1)), F.count("doc_id"), F.percentile_approx("doc_id", shares, max(10_000, 20 * parts))).first()
    bounds = np.array((found or [])[: parts - 1], np.int64)
    if not every or there == every:
        return parts, 0, bounds
    return parts + (nulls := max(1, parts * (every - there) // every)), nulls, bounds


def _parts(ids: pa.Array, hashes: np.ndarray, n: int, nulls: int, bounds: np.ndarray) -> np.ndarray:
    """The range of each row; nulls, and an id that fills several ranges, are dealt over theirs in order of their texts' hashes."""
    there = ids.is_valid().to_numpy(zero_copy_only=False)
    keys = ids.fill_null(0).to_numpy()
    low = np.where(there, nulls + np.searchsorted(bounds, keys, "left"), 0)
    high = np.where(there, nulls + np.searchsorted(bounds, keys, "right"), max(nulls - 1, 0))
    share = (hashes.astype(np.float64) + 2.0**63) / 2.0**64
    return np.minimum(low + np.floor(share * (high - low + 1)).astype(np.int64), high).astype(np.int32)


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame, digest: bool = True) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens and ids_crc32, or ids if not ``digest``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_file(path) as source:
                    rows, held = [], 0
                    for doc_id, start, parts in ShardReader(source, source.size()).documents():
                        crc = 0
                        for part in parts:
                            crc = zlib.crc32(part.tobytes(), crc)
                        count = sum(map(len, parts))
                        rows.append((doc_id, base + start, count, crc if digest else b"".join(p.tobytes() for p in parts)))
                        held += 1 if digest else count
                        if held >= BLOCK_IDS:
                            yield _batch(rows, digest)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, digest)

    files = manifest.select("path", "start")
    spread = files.repartition(max(1, files.count()))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def _batch(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

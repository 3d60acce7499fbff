"""Best-fit packing with certified bin counts.

Documents are encoded, closed with an end id and, only where longer than a sequence, cut into pieces of
full length.  Pieces are dealt over partitions of a bounded number of rows, and each is packed by
best-fit decreasing.  Dual feasible functions give a lower bound on the bins of each partition.  A
partition that meets its bound is certified and gives up only its emptiest bin, which may be the part of
a bin that the bounds of all partitions round up.  One with a gap keeps its fuller bins and gives up the
pieces of eight bins more for each that it is over.  These are dealt anew over fewer partitions, so that
partitions exchange pieces, and packed again, until one partition is left or the rounds are over.
Every piece is placed in any case; the rounds only lower the number of sequences.

Partitions hold row numbers and lengths alone; what else the pieces carry (ids, if asked for) is joined to
their places afterwards.

Defined cases: a null or empty text is a document of its end id alone; a null doc_id stays null; rows
that share a doc_id or a text are separate documents; an empty table packs to no rows; `pack_documents` reads
the two columns that are named and no others; `pack` carries other columns along, but replaces those that
have the name of one that it adds.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .scratch import stage
from .words import raw_texts

CAPACITY = 4096
END_ID = 1
#: Rows of one packing partition, and rounds of exchange.
PARTITION_ROWS = 32_768
ROUNDS = 6


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row a piece: row_id, doc_id, piece, start, length, ids_crc32 and, if asked for, ids (uint32 bytes)."""
    path = vocabulary or tokens.vocabulary()
    key_type = docs.schema[doc_id].dataType
    fields = [
        T.StructField("row_id", T.LongType()), T.StructField("doc_id", key_type), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * keep_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = tokens.encoder(path), end_id.to_bytes(4, "little")
        row, size = TaskContext.get().partitionId() << 33, 4 * capacity
        for batch in batches:
            origin, number, lengths, sums, kept = [], [], [], [], []
            for k, raw in enumerate(raw_texts(batch.column(1))):
                ids = encoder.ids(raw) + end
                for n, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size] if len(ids) > size else ids
                    origin.append(k)
                    number.append(n)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(part)
            columns = [
                pa.array(np.arange(row, row + len(origin))), batch.column(0).take(pa.array(origin, pa.int64())), pa.array(number, pa.int32()),
                pa.array(np.array(number, np.int64) * capacity), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
            ]
            row += len(origin)
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids, names=schema.names)

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(cut, schema)


def bin_bound(lengths: np.ndarray, capacity: int = CAPACITY, steps: int = 32) -> int:
    """The best lower bound on bins that two families of dual feasible functions give (exact integers)."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    counts, sums = np.cumsum(count), np.cumsum(count * sizes)
    # Sizes over capacity - e count as a whole bin, sizes under e as nothing.
    e = np.arange(1, capacity // 2 + 1)
    whole = counts[-1] - counts[capacity - e]
    rest = sums[capacity - e] - sums[e - 1]
    best = int(np.max(whole + -(-rest // capacity)))
    for k in range(1, steps + 1):  # sizes are rounded down to k-ths, but for multiples of 1 / (k + 1)
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int(np.sum(count * value)) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length.  Open bins are listed by free room; a bit mask finds the tightest."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = opened = 0
    for item, length in zip(order.tolist(), lengths[order].tolist()):
        fitting = mask >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, chosen = capacity, opened
            opened += 1
        bins[item], offsets[item] = chosen, capacity - room
        if room > length:
            by_room[room - length].append(chosen)
            mask |= 1 << (room - length)
    return bins, offsets


_PLACED = "row_id long, length long, bucket long, sequence_id long, offset long, loose boolean, partition_bins long, partition_bound long"


def _packer(capacity: int, number: int, exchange: bool) -> Callable[[pa.Table], pa.Table]:
    def packed(table: pa.Table) -> pa.Table:
        table = table.select(["row_id", "length", "bucket"]).sort_by("row_id")
        lengths = table["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        used, bound = int(bins.max()) + 1, bin_bound(lengths, capacity)
        loose = np.zeros(len(lengths), bool)
        if exchange:
            fill = np.bincount(bins, weights=lengths, minlength=used)
            emptiest = np.argsort(fill, kind="stable")[: 1 + 8 * (used - bound)]
            loose = np.isin(bins, emptiest)
        bucket = table["bucket"].to_numpy()
        columns = {
            "sequence_id": ((number << 56) | (bucket << 24)) + bins, "offset": offsets, "loose": loose,
            "partition_bins": np.full(len(bins), used), "partition_bound": np.full(len(bins), bound),
        }
        for name, values in columns.items():
            table = table.append_column(name, pa.array(values))
        return table

    return packed


def pack(pieces: DataFrame, capacity: int = CAPACITY, partition_rows: int = PARTITION_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Place pieces (``row_id``, one for each, ``length`` and columns that are carried along) into sequences.

    Adds ``sequence_id``, ``offset``, ``round``, ``bucket`` and its certificate ``partition_bins`` and
    ``partition_bound``.  Pieces of full length are sequences of their own (round -1).
    """
    added = ("bucket", "sequence_id", "offset", "partition_bins", "partition_bound", "round")
    pieces = stage(pieces.drop(*added), "pack-pieces")
    slim = pieces.select("row_id", F.col("length").cast("long").alias("length"))
    none = F.lit(None).cast("long")
    full = slim.where(F.col("length") >= capacity).select(
        "row_id", F.lit(0).cast("long").alias("bucket"), (-1 - F.col("row_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        none.alias("partition_bins"), none.alias("partition_bound"), F.lit(-1).alias("round"),
    )
    out, open_pieces = full, slim.where(F.col("length") < capacity)
    left = open_pieces.count()
    for number in range(rounds):
        partitions = -(-left // partition_rows) or 1
        exchange = partitions > 1 and number + 1 < rounds
        dealt = open_pieces.withColumn("bucket", F.pmod(F.xxhash64("row_id", F.lit(number)), F.lit(partitions)))
        packed = stage(dealt.groupBy("bucket").applyInArrow(_packer(capacity, number, exchange), _PLACED), "pack-round")
        out = out.unionByName(packed.where("not loose").select("row_id", *added[:-1]).withColumn("round", F.lit(number)))
        if not exchange or not (left := packed.where("loose").count()):
            break
        open_pieces = packed.where("loose").select("row_id", "length")
    return pieces.join(out, "row_id")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, keep_ids: bool = False, **how) -> DataFrame:
    """Encode and pack; with ``keep_ids`` the rows hold their ids, for `sequences`."""
    return pack(token_pieces(docs, vocabulary, capacity, end_id, keep_ids=keep_ids), capacity, **how)


def sequences(packed: DataFrame) -> DataFrame:
    """One row a sequence: its ids (uint32 bytes) in place; each holds at most ``capacity`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids")
    )

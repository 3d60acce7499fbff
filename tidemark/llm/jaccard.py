"""N-gram Jaccard join by grouped prefixes, and the classes of near-duplicates that its links make.

A document's set holds its distinct shingles of ``ngram`` words, as 64-bit hashes.  Two documents link when
100 * intersection >= percent * union.

1. *Sets to classes.*  Documents of equal sets (128-bit digests) form a class, named by its smallest doc_id.
2. *Order.*  Shingles are ordered from rare to frequent, then by hash; two sets that link share one of
   their first n - ceil(n * percent / 100) + 1 shingles in any common order.  Counts are of all documents,
   kept in a table of fixed size in which a rare shingle may share the slot of a frequent one.  That moves
   work, never results: any order is right.
3. *Groups.*  Classes with identical prefixes and sizes collapse into one group, and only groups are
   indexed by the shingles of their prefix.  Index cells with the same groups are one cell.
4. *Group pairs.*  Every group of a cell meets the cell's most common group (a star, so a cell of m groups
   gives m pairs).  A pair is filtered by size and by the parity bits on which all members of a group
   agree: parity bits of two sets differ in at most as many places as the sets differ in shingles.
5. *Expand and verify.*  In a pair that passes, the most common member of either group meets the members of
   the other one, and likewise inside a group; the parity bits of the members filter again, and
   what is left is verified on the whole sets.  Links give components.
6. *The rest.*  Only cells whose members are not all in one component go on.  In them, the groups outside the cell's main
   component meet all others of about their length, as sets that link differ little in size, in blocks that are
   dealt by hash; pairs that are not wholly in one component pass the filters of 4.  Only members of such pairs meet each other,
   in blocks again, and are verified.  So no link between components is lost, and no cell is ever
   spelt out as all its pairs.

Links inside a component beyond those that make it one are not looked for, nor counted.

Defined cases: doc_id holds whole numbers (other types are refused); a null text, or one without words, has an empty set, links with nothing and is its own
component; with fewer words than ``ngram`` the whole sequence is the one shingle; rows that share a doc_id
are one document to the links, with n_shingles of each row; a null doc_id takes no part (component_id
null); repeated rows are kept; an empty table gives no rows.  `near_duplicates` reads the two columns that
are named and no others, `deduplicated` carries all along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import covered, uncovered, whole_numbers
from .components import components
from .remembered import remembered
from .scratch import arrow_rows, release, small_side, stage
from .words import raw_texts

NGRAM, PERCENT = 3, 90
#: Slots of the table of rarity, a byte each, that goes to all tasks: 2 to these powers, least and most, by the number of documents.
TABLE_BITS, MOST_TABLE_BITS = 24, 27
#: Rows of a side that may be broadcast once they have been counted.
BROADCAST_ROWS = 400_000
#: Rows at home in a block, on average, and how many times as many visitors it has.
BLOCK, VISITORS = 256, 4
#: Groups of a cell that one task orders at most; the middle of a larger cell is found by partial aggregates.
ORDERED = 64
#: Parity bits of a set, at least; those of a group are as many, in words of 64.
BITS = 1024
WORDS = BITS // 64

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S32)) * _A
    h = (h ^ (h >> _S29)) * _B
    return h ^ (h >> _S32)


class _WordHashes(dict):
    """64-bit hashes of words; at most LIMIT are remembered."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value
        return value


def shingles(raw: bytes, ngram: int = NGRAM) -> np.ndarray:
    """The set of a text: sorted distinct uint64 hashes."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(remembered("word hashes", _WordHashes).__getitem__, words), np.uint64, len(words))
    size = min(ngram, len(words))
    out = _mix(hashed[: len(words) - size + 1] + np.uint64(size))
    for k in range(1, size):
        out = _mix(out + hashed[k : len(words) - size + 1 + k])
    return np.unique(out)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def most_apart(total, percent: int):
    """The most shingles in which two sets of ``total`` shingles together may differ and still link."""
    return total * (100 - percent) // (100 + percent)


def rarity_table(docs: DataFrame, ngram: int) -> np.ndarray:
    """How often the most frequent shingle of each slot occurs in all documents, as 8 * log2 + 1; 0 if once.

    A shingle's slot is the first bits of its hash, as many as the table's size asks for.  Tasks sort the first bits of their shingles'
    hashes and send them as compressed differences, one to two bytes each, to the task of their range,
    which counts them and fills its part of the table.
    """
    expected = max(1, docs.count()) * 1000
    parts = min(max((expected >> 21).bit_length(), 6), 20)
    width = 32 if expected <= 1 << 30 else 48
    kind = np.dtype("<u4" if width == 32 else "<u8")
    bits = min(MOST_TABLE_BITS, max(TABLE_BITS, (expected >> 7).bit_length()))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=1).compress
        waiting, size = [], 0

        def flush() -> pa.RecordBatch:
            values = np.sort(np.concatenate(waiting).astype(kind))
            starts = np.arange(1 << parts, dtype=np.uint64) << np.uint64(width - parts)
            cuts = np.append(np.searchsorted(values, starts.astype(kind)), len(values))
            full = np.nonzero(np.diff(cuts))[0]
            steps = np.diff(values, prepend=kind.type(0))
            steps[cuts[full]] = values[cuts[full]] - starts[full].astype(kind)
            planes = steps.view(np.uint8).reshape(-1, kind.itemsize)
            blobs = [compress(planes[cuts[k] : cuts[k + 1]].T.tobytes()) for k in full]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array(blobs, pa.binary())], names=["part", "steps"])

        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                waiting.append(shingles(raw, ngram) >> np.uint64(64 - width))
                size += len(waiting[-1])
                if size > 1 << 20:
                    yield flush()
                    waiting, size = [], 0
        if size:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        import zstandard

        expand, part = zstandard.ZstdDecompressor().decompress, table["part"][0].as_py()
        values = []
        for blob in table["steps"]:
            planes = np.frombuffer(expand(blob.as_py()), np.uint8).reshape(kind.itemsize, -1)
            values.append(np.cumsum(np.ascontiguousarray(planes.T).view(kind).reshape(-1), dtype=kind))
        found, times = np.unique(np.concatenate(values), return_counts=True)
        found, times = found[times > 1], times[times > 1]
        slots = np.zeros(1 << (bits - parts), np.uint8)
        np.maximum.at(slots, (found >> kind.type(width - bits)).astype(np.int64), np.minimum(255, 1 + 8 * np.log2(times)).astype(np.uint8))
        return pa.table({"part": pa.array([part], pa.int64()), "slots": pa.array([slots.tobytes()], pa.binary())})

    spelt = docs.select("text").mapInArrow(spell, "part long, steps binary")
    with arrow_rows(docs.sparkSession, 1000):
        filled = spelt.groupBy("part").applyInArrow(count, "part long, slots binary").toArrow()
    table = np.zeros((1 << parts, 1 << (bits - parts)), np.uint8)
    for part, slots in zip(filled["part"].to_pylist(), filled["slots"]):
        table[part] = np.frombuffer(slots.as_buffer(), np.uint8)
    return table.reshape(-1)


def signatures(docs: DataFrame, ngram: int, percent: int) -> DataFrame:
    """Per row of (doc_id, text), staged: n, digest (c1, c2), prefix and its digest (g1, g2), common, fold, bits.

    fold holds BITS parity bits as words, bits those of a set of more shingles than that.
    """
    table = docs.sparkSession.sparkContext.broadcast(rarity_table(docs, ngram))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = table.value
        unused = np.uint64(65 - len(slots).bit_length())
        salts = np.array([0x1B873593, 0x85EBCA6B], np.uint64)
        for batch in batches:
            numbers, prefixes, folds, bits = np.zeros((batch.num_rows, 6), np.int64), [], np.zeros((batch.num_rows, WORDS), np.int64), []
            for k, raw in enumerate(raw_texts(batch.column(1))):
                found = shingles(raw, ngram)
                n = len(found)
                if not n:
                    prefixes.append(found)
                    bits.append(None)
                    continue
                often = slots[found >> unused]
                prefix = found[np.argsort(often, kind="stable")[: prefix_length(n, percent)]]
                whole = [int(_mix(found ^ s).sum()) for s in salts] + [int(_mix(prefix ^ s).sum()) for s in salts]
                numbers[k] = np.array([n, int(often.sum(dtype=np.int64)), *whole], np.uint64).view(np.int64)
                prefixes.append(prefix)
                own = parities(found)
                folds[k] = _folded(own, BITS // 8).view(np.int64)
                bits.append(own if 8 * len(own) > BITS else None)
            edges = np.concatenate(([0], np.cumsum([len(p) for p in prefixes])))
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat))
            words = pa.ListArray.from_arrays(pa.array(np.arange(0, WORDS * (batch.num_rows + 1), WORDS), pa.int32()), pa.array(folds.reshape(-1)))
            columns = [batch.column(0), *(pa.array(numbers[:, k]) for k in range(6)), lists, words, pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "common", "c1", "c2", "g1", "g2", "prefix", "fold", "bits"])

    schema = "doc_id long, n long, common long, c1 long, c2 long, g1 long, g2 long, prefix array<long>, fold array<long>, bits binary"
    with arrow_rows(docs.sparkSession, 1000):
        return stage(docs.mapInArrow(sign, schema), "signatures")


def parities(found: np.ndarray) -> bytes:
    """Parity bits of a set: BITS, or for large sets the next power of two from their size."""
    bits = max(BITS, 1 << (len(found) - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(bits: bytes, size: int) -> np.ndarray:
    """Parity bits of ``size`` bytes; those of half the number are the exclusive or of both halves."""
    out = np.frombuffer(bits, np.uint64)
    while len(out) > size // 8:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def least_apart(bits: list[bytes], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Shingles in which sets p[i] and q[i] differ at least."""
    sizes = np.fromiter(map(len, bits), np.int64, len(bits))
    shorter = np.minimum(sizes[p], sizes[q]) if len(p) else np.empty(0, np.int64)
    out = np.zeros(len(p), np.int64)
    for size in np.unique(shorter).tolist():
        pairs = np.nonzero(shorter == size)[0]
        rows, where = np.unique(np.concatenate((p[pairs], q[pairs])), return_inverse=True)
        folded, half = np.stack([_folded(bits[r], size) for r in rows]), len(pairs)
        for at in range(0, half, step := max(1, (8 << 20) // size)):
            x, y = where[at : min(at + step, half)], where[half + at : half + min(at + step, half)]
            out[pairs[at : at + step]] = np.bitwise_count(folded[x] ^ folded[y]).sum(axis=1)
    return out


def _words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """[rows, WORDS] of a column of words."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)


def _parities_of(fold: pa.Array | pa.ChunkedArray, bits: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [long or short.tobytes() for long, short in zip(bits.to_pylist(), _words(fold))]


def groups_apart(ones: np.ndarray, ors: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Shingles in which any member of group p[i] and any of group q[i] differ at least: bits that are set in all
    members of one and in none of the other."""
    out = np.zeros(len(p), np.int64)
    for at in range(0, len(p), 1 << 16):
        x, y = p[at : at + (1 << 16)], q[at : at + (1 << 16)]
        out[at : at + (1 << 16)] = np.bitwise_count((ones[x] & ~ors[y]) | (ones[y] & ~ors[x])).sum(axis=1)
    return out


def _cells(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged: groups that share a shingle of their prefixes, and the members of all those groups.

    (cell, gid, n, members, common, middle, ones, ors) has a row for each group of a cell; middle is the group's
    most common member, ones and ors are the parity bits that all and that any of its members have.
    (gid, members, doc_id, n, common, fold, bits) has a row for each class.
    """
    shared = stage(classes.groupBy("g1", "g2", "n").agg(F.min("doc_id").alias("gid"), F.count(F.lit(1)).alias("members")).where("members > 1"), "groups")
    grouped = classes.join(small_side(shared, BROADCAST_ROWS), ["g1", "g2", "n"], "left").withColumns({
        "gid": F.coalesce("gid", "doc_id"), "members": F.coalesce("members", F.lit(1)),
    })
    index = grouped.where("doc_id = gid").select("gid", "members", F.explode("prefix").alias("token"))
    seen = index.groupBy("token").agg(F.sum("members").alias("m"), F.count(F.lit(1)).alias("k"), F.min("gid").alias("low"), F.max("gid").alias("high"))
    seen = stage(seen.where("m > 1"), "busy")
    # The least and the greatest name both groups of a shingle of two; only those of more are looked up again.
    pairs = seen.where("k <= 2").select(F.xxhash64("low", "high").alias("cell"), F.explode(F.array_distinct(F.array("low", "high"))).alias("gid"))
    more = small_side(stage(seen.where("k > 2").select("token"), "busier"), BROADCAST_ROWS)
    rows = stage(index.join(more, "token").select("token", "gid"), "index")
    hashed = rows.groupBy("token").agg(
        F.xxhash64(F.count(F.lit(1)), F.bit_xor(F.xxhash64("gid")), F.bit_xor(F.xxhash64("gid", F.lit("again")))).alias("cell")
    )
    hashed = stage(hashed, "token-cells")
    cells = stage(rows.join(small_side(hashed, BROADCAST_ROWS), "token").select("cell", "gid").union(pairs).distinct(), "cells")
    inside = stage(cells.select("gid").distinct(), "indexed")
    members = grouped.join(small_side(inside, BROADCAST_ROWS), "gid").select("gid", "members", "doc_id", "n", "common", "fold", "bits")
    members = stage(members, "members")
    # The inverse of a doc_id falls as the doc_id rises, without an overflow.
    words = [F.col("fold")[k] for k in range(WORDS)]
    one = members.where("members = 1").select("gid", "n", "members", "common", F.col("doc_id").alias("middle"), F.col("fold").alias("ones"), F.col("fold").alias("ors"))
    many = members.where("members > 1").groupBy("gid", "n", "members").agg(
        F.max(F.struct("common", F.bitwise_not("doc_id").alias("inverse"))).alias("top"),
        F.array(*map(F.bit_and, words)).alias("ones"), F.array(*map(F.bit_or, words)).alias("ors"),
    ).select("gid", "n", "members", "top.common", F.bitwise_not("top.inverse").alias("middle"), "ones", "ors")
    faced = stage(cells.join(one.union(many), "gid").select("cell", "gid", "n", "members", "common", "middle", "ones", "ors"), "faced")
    release(rows, seen, hashed, inside, cells)
    return faced, members


_GROUP_PAIRS = "a_gid long, a_members long, a long, b_gid long, b_members long, b long, sure boolean"


def _group_pairs(x: pa.RecordBatch, y: pa.RecordBatch, good: np.ndarray) -> pa.RecordBatch:
    """Rows (gid, n, members, middle) of both sides as pairs; sure where the groups' bits are those of the one member of each."""
    (a, n, k, u), (b, m, l, v) = (side.columns[:4] for side in (x, y))
    sure = (k.to_numpy() == 1) & (l.to_numpy() == 1) & (np.minimum(n.to_numpy(), m.to_numpy()) <= BITS)
    return pa.RecordBatch.from_arrays([a, k, u, b, l, v, pa.array(sure)], names=["a_gid", "a_members", "a", "b_gid", "b_members", "b", "sure"]).filter(pa.array(good))


def _stars(faced: DataFrame, percent: int, large: int = ORDERED) -> DataFrame:
    """Pairs of each group and the most common group of its cell, as far as the filters let them.

    The middle of a cell of more than ``large`` groups is found by partial aggregates and joined to them
    where they lie; only smaller cells are ordered, each within a task.
    """
    sizes = stage(faced.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > large).select("cell"), "large-cells")
    big = small_side(sizes, BROADCAST_ROWS)
    face = ("gid", "n", "members", "middle", "ones", "ors")
    common_first = Window.partitionBy("cell").orderBy(F.col("common").desc(), "gid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = faced.join(big, "cell", "left_anti").withColumn("x", F.first(F.struct(*face)).over(common_first))
    top = F.max(F.struct("common", F.bitwise_not("gid").alias("inverse"), F.struct(*face).alias("x"))).alias("top")
    inside = faced.join(big, "cell")
    middles = inside.groupBy("cell").agg(top).select("cell", "top.x")
    joined = inside.join(small_side(stage(middles, "middles"), BROADCAST_ROWS), "cell")
    pairs = ordered.select("x", *face).unionByName(joined.select("x", *face)).where("gid != x.gid")
    pairs = pairs.select(*[F.col(f"x.{c}").alias(f"x_{c}") for c in face], *face)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.select(list(range(6))), batch.select(list(range(6, 12)))
            n, m = x.column(1).to_numpy(), y.column(1).to_numpy()
            at = np.arange(batch.num_rows)
            ones, ors = (np.concatenate((_words(x.column(k)), _words(y.column(k)))) for k in (4, 5))
            good = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (groups_apart(ones, ors, at, batch.num_rows + at) <= most_apart(n + m, percent))
            yield _group_pairs(x, y, good)

    return pairs.mapInArrow(passing, _GROUP_PAIRS).distinct()


def _close(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of members those that their sizes and their own parity bits let pass."""
    own = members.select("doc_id", "n", "fold", "bits").distinct()
    joined = pairs.join(own.toDF("a", "a_n", "a_fold", "a_bits"), "a").join(own.toDF("b", "b_n", "b_fold", "b_bits"), "b")
    joined = joined.select("a", "a_n", "a_fold", "a_bits", "b", "b_n", "b_fold", "b_bits")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(1).to_numpy(), batch.column(5).to_numpy()
            good = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            at = np.nonzero(good)[0]
            apart = least_apart(_parities_of(batch.column(2), batch.column(3)) + _parities_of(batch.column(6), batch.column(7)), at, batch.num_rows + at)
            good[at] = apart <= most_apart(n[at] + m[at], percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4)], names=["a", "b"]).filter(pa.array(good))

    return joined.mapInArrow(passing, "a long, b long")


def _expanded(pairs: DataFrame, faced: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members: the middle of either group with the members of the other, and of its own."""
    pairs = stage(pairs, "group-pairs")
    alone = pairs.where("a_members = 1 and b_members = 1")
    own = faced.where("members > 1").select(F.col("middle").alias("a"), "gid").distinct()
    spread = pairs.where("b_members > 1").select("a", F.col("b_gid").alias("gid")).union(pairs.where("a_members > 1").select("b", "a_gid")).union(own).distinct()
    spread = spread.join(members.where("members > 1").select("gid", F.col("doc_id").alias("b")), "gid").where("a != b").select("a", "b")
    doubtful = stage(alone.where("not sure").select("a", "b").union(spread).distinct(), "doubtful")
    return alone.where("sure").select("a", "b").union(_close(doubtful, members, percent)).distinct()


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows (cell, home, key, ...) dealt over blocks (cell, i, j), sorted by block: every row at home meets every visitor of its cell once.

    Rows at home are cut into parts of about ``block`` and visitors into parts of about VISITORS times as many; each row goes to
    all blocks of its part, so a cell of few rows at home is hardly copied, however many visitors it has.
    """
    parts = [F.greatest(F.ceil(F.count_if(at) / size), F.lit(1)).cast("long").alias(name) for at, size, name in ((F.col("home"), block, "homes"), (~F.col("home"), VISITORS * block, "visits"))]
    sizes = stage(rows.groupBy("cell").agg(*parts).where("homes > 1 OR visits > 1"), "block-sizes")
    sized = rows.join(small_side(sizes, BROADCAST_ROWS), "cell", "left").withColumns({c: F.coalesce(c, F.lit(1).cast("long")) for c in ("homes", "visits")})
    own, others = F.when(F.col("home"), F.col("homes")).otherwise(F.col("visits")), F.when(F.col("home"), F.col("visits")).otherwise(F.col("homes"))
    dealt = sized.withColumns({"chunk": F.pmod(F.xxhash64("key"), own), "last": others - 1}).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    dealt = dealt.withColumns({"i": F.when(F.col("home"), F.col("chunk")).otherwise(F.col("other")), "j": F.when(F.col("home"), F.col("other")).otherwise(F.col("chunk"))})
    return dealt.drop("homes", "visits", "last", "chunk", "other").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The tables of one block each; a block may go on in the next batch."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        keys = np.stack([table[c].to_numpy() for c in ("cell", "i", "j")])
        cuts = np.concatenate(([0], np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1))
        for start, end in zip(cuts[:-1], cuts[1:]):
            yield table.slice(start, end - start).combine_chunks()
        held = table.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _meeting(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a row at home and a visitor each, by size and where they are not in one component."""
    n, low, high, home, key = (table[c].to_numpy() for c in ("n", "low", "high", "home", "key"))
    x, y = np.nonzero(home)[0], np.nonzero(~home)[0]
    good = 100 * np.minimum.outer(n[x], n[y]) >= percent * np.maximum.outer(n[x], n[y])
    good &= (key[x][:, None] != key[y]) & (np.minimum.outer(low[x], low[y]) < np.maximum.outer(high[x], high[y]))
    p, q = np.nonzero(good)
    return x[p], y[q]


def _most(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, main): the label that most rows of a key have."""
    counted = rows.groupBy(key, label).agg(F.count(F.lit(1)).alias("k"))
    return counted.groupBy(key).agg(F.max_by(label, F.struct("k", label)).alias("main"))


def _rest(faced: DataFrame, members: DataFrame, labels: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs (a, b) of members of one cell and two components that pass the filters."""
    labelled = members.join(small_side(labels, BROADCAST_ROWS), F.col("doc_id") == F.col("node"), "left")
    labelled = stage(labelled.select("gid", "members", "doc_id", "n", "fold", "bits", F.coalesce("component", "doc_id").alias("label")), "labelled")
    sides = stage(labelled.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high")), "sides")
    marked = stage(faced.drop("common").join(small_side(sides, BROADCAST_ROWS), "gid"), "marked")
    # Two classes in a cell have met already.
    mixed = marked.groupBy("cell").agg(F.sum("members").alias("size"), F.min("low").alias("least"), F.max("high").alias("most"))
    mixed = stage(mixed.where("size > 2 and least < most").select("cell"), "mixed-cells")
    # Groups of a cell's main component need not meet each other: only the others are at home. Sizes of sets that
    # link are less than one step of this ladder apart, so all groups visit their own step and the two beside it.
    step = F.floor(F.log(F.col("n")) / float(1.0001 * np.log(100 / percent))) if percent < 100 else F.col("n")
    inside = marked.join(small_side(mixed, BROADCAST_ROWS), "cell").withColumn("step", step.cast("long"))
    main = stage(_most(inside.where("low = high"), "cell", "low"), "main-components")
    rows = inside.join(small_side(main, BROADCAST_ROWS), "cell", "left")
    homes = rows.where("main IS NULL OR low != main OR high != main").withColumn("home", F.lit(True))
    visits = rows.withColumns({"home": F.lit(False), "step": F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1))})
    columns = ("gid", "n", "members", "middle", "ones", "ors", "low", "high")
    rows = homes.unionByName(visits).select(F.xxhash64("cell", "step").alias("cell"), "home", F.col("gid").alias("key"), *columns)
    # Visitors of a step where nobody is at home stay out.
    busy = stage(homes.select(F.xxhash64("cell", "step").alias("cell")).distinct(), "busy-steps")
    rows = stage(rows.join(small_side(busy, BROADCAST_ROWS), "cell", "left_semi"), "to-meet")

    def meet_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_block(batches):
            p, q = _meeting(table, percent)
            n = table["n"].to_numpy()
            close = groups_apart(_words(table["ones"]), _words(table["ors"]), p, q) <= most_apart(n[p] + n[q], percent)
            batch = table.select(["gid", "n", "members", "middle"]).to_batches()[0]
            p, q = p[close], q[close]
            yield _group_pairs(batch.take(pa.array(p)), batch.take(pa.array(q)), np.ones(len(p), bool))

    pairs = stage(_blocks(rows, block).mapInArrow(meet_groups, _GROUP_PAIRS).distinct(), "more-group-pairs")
    alone = pairs.where("a_members = 1 and b_members = 1")
    sure = alone.where("sure").select("a", "b").union(_close(alone.where("not sure").select("a", "b"), members, percent))
    # The members of pairs of larger groups meet in blocks of their own, the fewer ones at home; in a group that is not in
    # one component, the members outside its main one are at home.
    fewer = F.col("a_members") <= F.col("b_members")
    both = pairs.where("a_members > 1 OR b_members > 1").select(F.xxhash64("a_gid", "b_gid").alias("cell"), F.explode(F.array(
        F.struct(F.col("a_gid").alias("gid"), fewer.alias("home")), F.struct(F.col("b_gid").alias("gid"), (~fewer).alias("home")))).alias("side"))
    columns = (F.col("doc_id").alias("key"), "doc_id", "n", "fold", "bits", F.col("label").alias("low"), F.col("label").alias("high"))
    across = both.select("cell", "side.home", "side.gid").distinct().join(labelled, "gid").select("cell", "home", *columns)
    torn = labelled.join(small_side(stage(sides.where("low < high").select("gid"), "torn-groups"), BROADCAST_ROWS), "gid")
    torn = torn.join(small_side(stage(_most(torn, "gid", "label"), "main-labels"), BROADCAST_ROWS), "gid")
    within = torn.withColumn("cell", F.xxhash64("gid", "gid"))
    within = within.where("label != main").select("cell", F.lit(True).alias("home"), *columns).unionByName(within.select("cell", F.lit(False).alias("home"), *columns))
    inner = across.unionByName(within)

    def meet_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_block(batches):
            p, q = _meeting(table, percent)
            n, ids = table["n"].to_numpy(), table["doc_id"].to_numpy()
            close = least_apart(_parities_of(table["fold"], table["bits"]), p, q) <= most_apart(n[p] + n[q], percent)
            a, b = ids[p[close]], ids[q[close]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return sure.union(_blocks(stage(inner, "inner"), block).mapInArrow(meet_members, "a long, b long")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, ngram: int, percent: int) -> DataFrame:
    """The staged links among candidate pairs (a, b), from the whole sets of their documents.

    Texts of the documents in pairs are what is shuffled; they take less room than their sets.  Pairs meet
    by their a, whose set is made once for at most about BLOCK pairs.
    """
    pairs = stage(pairs, "pairs")
    many = stage(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")).where("parts > 1"), "busy-centres")
    parts = F.coalesce(F.col("parts"), F.lit(1))
    dealt = pairs.join(small_side(many, BROADCAST_ROWS), "a", "left").select(F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), parts).alias("part"), "b")
    centres = dealt.select("centre", "part", F.col("centre").alias("doc_id"), F.lit(0).alias("role")).distinct()
    wanted = stage(dealt.select("centre", "part", F.col("b").alias("doc_id"), F.lit(1).alias("role")).union(centres), "wanted")
    rows = docs.join(small_side(wanted, BROADCAST_ROWS), "doc_id").select("centre", "part", "role", "doc_id", "text")
    rows = rows.repartition("centre", "part").sortWithinPartitions("centre", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            a, b = [], []
            for centre, part, role, doc_id, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), raw_texts(batch.column(4))):
                found = shingles(raw, ngram)
                if role == 0:
                    if (centre, part) != key:
                        key, held = (centre, part), []
                    held.append(found)
                elif any(similar(found, x, percent) for x in held):
                    a.append(centre)
                    b.append(doc_id)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    with arrow_rows(docs.sparkSession, 256):
        links = stage(rows.mapInArrow(run, "a long, b long").distinct(), "links")
    release(pairs, many, wanted)
    return links


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if not len(x) or not len(y):
        return False
    if len(x) > len(y):
        x, y = y, x
    inside = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * inside >= percent * (len(x) + len(y) - inside)


def near_duplicates(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    whole_numbers(docs, doc_id)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = signatures(docs, ngram, percent)
    members = signed.where("n > 0 and doc_id is not null")
    # Only sets that occur again need a look for their smallest doc_id; a row of any other is a class.
    again = members.groupBy("c1", "c2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    again = stage(again.drop("copies"), "copies")
    first = members.join(small_side(again, BROADCAST_ROWS), ["c1", "c2"], "left")
    classes = first.where("least is null").unionByName(first.where("doc_id = least").dropDuplicates(["c1", "c2"]))
    faced, inside = _cells(classes.select("doc_id", "n", "common", "g1", "g2", "prefix", "fold", "bits"))
    links = _verified(_expanded(_stars(faced, percent), faced, inside, percent), docs, ngram, percent)
    labels = stage(components(links), "labels")
    more = _verified(_rest(faced, inside, labels, percent, block), docs, ngram, percent)
    if not more.isEmpty():
        labels = stage(components(links.unionByName(more)), "labels")
    named = classes.join(small_side(labels, BROADCAST_ROWS), F.col("doc_id") == F.col("node"), "left")
    named = named.withColumn("component", F.coalesce("component", "doc_id")).where("least is not null or component != doc_id")
    named = stage(named.select("c1", "c2", "component").distinct(), "named")
    release(faced, inside, links, more)
    out = signed.select("doc_id", "n", "c1", "c2").join(small_side(named, BROADCAST_ROWS), ["c1", "c2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def deduplicated(docs: DataFrame, ngram: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; rows without a doc_id stay."""
    found = near_duplicates(docs, ngram, percent, text, doc_id).where("doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct()
    keep = small_side(stage(found, "keepers"), BROADCAST_ROWS)
    rows, own = covered(docs)
    key = F.col(own[doc_id])
    named = rows.join(keep, key == F.col("_keep"), "left_semi")
    # Texts are only shuffled for rows that repeat a doc_id.
    repeated = rows.where(key.isNotNull()).groupBy(key.alias("_again")).count().where("count > 1").select("_again")
    repeated = small_side(stage(repeated, "repeated"), BROADCAST_ROWS)
    again = key == F.col("_again")
    once = named.join(repeated, again, "left_anti")
    return uncovered(once.unionByName(named.join(repeated, again, "left_semi").dropDuplicates([own[doc_id]])).unionByName(rows.where(key.isNull())), docs)

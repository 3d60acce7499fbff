"""Approximate nearest neighbours by cosine: one hierarchical navigable small-world graph a shard.

Rows are dealt over regions, whose centres are fitted to a bounded sample, and a region of more than
``shard_rows`` rows over several shards by hash, so that no shard grows with the data.  In a shard, equal
vectors are one node.  A node's level is drawn from its hash, a sixteenth of each level going on to the
next.  A level's graph is built by insertion, a batch of nodes after the other: each new node searches the
graph so far and the batch itself, is linked to near nodes in different directions (a candidate nearer to an
earlier pick than to the node is passed over while others are left), and its neighbours choose their
links anew with it among them.  Such links alone may fall into islands where many rows are close
together, so a level also gets the nodes that the level below needs: from them, links lead to every
node there.  The top level of at most TOP nodes has no links.  A graph is stored in one row as flat
arrays: nodes of each level, and a fixed number of neighbour slots for each of them, -1 where free.

A search scores the whole top level and goes down from its best nodes, several at once, with a beam on
each level; all queries of a block go in step.  The beam's best nodes are measured again on the original
vectors.  A query meets the shards of the ``probes`` regions with the nearest centres (None: of all), and the
results of shards are merged by score and id.

Defined cases: vec_id holds whole numbers (other types are refused); vectors that are null, empty, zero or hold null or non-finite components take no part;
only vectors of one length are compared; rows equal in id and vector count once; rows that share an id
but not the vector are candidates of their own, though never each other's, and one query whose nearest
are those of any of its vectors; ties go to the
smaller id; a query without candidates has no rows; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import whole_numbers
from .scratch import small_side, stage

SHARD_ROWS = 4096
QUERY_BLOCK = 256
LINKS, BASE_LINKS, CANDIDATES, BEAM = 16, 32, 48, 96
#: Nodes that are inserted together.
INSERTED = 512
#: Regions whose shards a query meets, most regions of vectors of one length, and lengths that get regions.
PROBES, REGIONS, DIMS = 16, 4096, 16
#: Rows and values of the sample that the centres are fitted to, at most, and rounds of fitting.
SAMPLE_ROWS, SAMPLE_VALUES, ROUNDS = 1 << 16, 1 << 23, 8
#: Nodes of a beam that are measured again, beyond the neighbours that are asked for.
SPARE = 9
#: Most nodes of a level that is scored whole, and nodes from which the level below is entered.
TOP, SEEDS = 512, 32


def usable(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _chosen(unit: np.ndarray, own: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """[rows, keep] of the candidates ``ids`` (-1: none) of the nodes ``own``, those in different directions first."""
    out = np.full((len(own), keep), -1, np.int64)
    for at in range(0, len(own), 128):
        part = ids[at : at + 128]
        near = np.where(part >= 0, np.einsum("nd,nwd->nw", unit[own[at : at + 128]], unit[part]), -np.inf)
        order = np.argsort(-near, axis=1, kind="stable")
        part, near = np.take_along_axis(part, order, 1), np.take_along_axis(near, order, 1)
        spread = unit[part]
        mutual = spread @ spread.transpose(0, 2, 1)
        picked = np.zeros(part.shape, bool)
        for c in range(part.shape[1]):
            shadowed = (picked[:, :c] & (mutual[:, c, :c] > near[:, c, None])).any(axis=1)
            picked[:, c] = ~shadowed & (part[:, c] >= 0) & (picked[:, :c].sum(axis=1) < keep)
        rank = np.argsort(~picked, axis=1, kind="stable")[:, :keep]  # the picked ones first, then the nearest of the rest
        out[at : at + 128, : rank.shape[1]] = np.take_along_axis(part, rank, 1)
    return out


def _nearest(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores of each row, best first."""
    most = min(most, scores.shape[1])
    best = np.argpartition(-scores, most - 1, axis=1)[:, :most] if most else np.empty((len(scores), 0), np.int64)
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(scores, best, 1), axis=1, kind="stable"), 1)


def _linked(unit: np.ndarray, links: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Add links from a[i] to b[i]; a node without room for all chooses anew."""
    order = np.lexsort((b, -np.einsum("nd,nd->n", unit[a], unit[b]), a))
    a, b = a[order], b[order]
    own, begin, count = np.unique(a, return_index=True, return_counts=True)
    place = np.arange(len(a)) - np.repeat(begin, count)
    slots = links.shape[1]
    fits = place < slots  # the nearest of the new ones
    more = np.full((len(own), min(slots, int(count.max()))), -1, np.int64)
    more[np.repeat(np.arange(len(own)), count)[fits], place[fits]] = b[fits]
    both = np.concatenate((links[own], more), axis=1)
    held = both >= 0
    room = held.sum(axis=1) <= slots
    packed = np.take_along_axis(both, np.argsort(~held, axis=1, kind="stable"), 1)
    links[own[room]] = packed[room, :slots]
    if not room.all():
        links[own[~room]] = _chosen(unit, own[~room], both[~room], slots)


def _inserted(unit: np.ndarray, slots: int) -> np.ndarray:
    """[n, slots] links among the rows, which are inserted in their order, a batch at a time; -1 where free."""
    n = len(unit)
    links = np.full((n, slots), -1, np.int64)
    first = min(n, TOP)
    at = 0
    while at < n:
        fresh = np.arange(at, min(n, at + (INSERTED if at else first)))
        among = unit[fresh] @ unit[fresh].T
        np.fill_diagonal(among, -np.inf)
        candidates = fresh[_nearest(among, min(CANDIDATES, len(fresh) - 1))]
        if at:
            seeds = _nearest(unit[fresh] @ unit[:first].T, SEEDS)
            candidates = np.concatenate((candidates, _beam(unit, np.arange(at), links, unit[fresh], seeds, CANDIDATES)), axis=1)
        if candidates.shape[1]:
            picked = _chosen(unit, fresh, candidates, LINKS)
            a, b = np.repeat(fresh, picked.shape[1]), picked.reshape(-1)
            a, b = a[b >= 0], b[b >= 0]
            pairs = np.unique(np.concatenate((a * n + b, b * n + a)))
            _linked(unit, links, pairs // n, pairs % n)
        at = int(fresh[-1]) + 1
    return links


def _entries(links: np.ndarray, above: np.ndarray) -> np.ndarray:
    """``above`` and what it lacks: nodes from which links lead to every node of a level."""
    entries, reached, front = above.copy(), above.copy(), np.nonzero(above)[0]
    while True:
        while len(front):
            near = links[front]
            near = np.unique(near[near >= 0])
            front = near[~reached[near]]
            reached[front] = True
        front = np.nonzero(~reached)[0][:1]
        if not len(front):
            return entries
        entries[front] = reached[front] = True


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))  # near copies differ beyond single precision


class Graph:
    """A shard's graph; ``nodes[l]`` are the nodes of level l and ``links[l]`` their neighbours there, as nodes (none on top)."""

    def __init__(self, nodes: list[np.ndarray], links: list[np.ndarray]):
        self.nodes, self.links = nodes, links

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        unit = _unit(vectors)
        noise = (unit.astype(np.float32).view(np.uint32).astype(np.uint64) * (2 * np.arange(unit.shape[1], dtype=np.uint64) + 1)).sum(axis=1)
        noise = (noise ^ (noise >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        chance = ((noise >> np.uint64(11)).astype(np.float64) + 1) / 2**53
        levels = np.floor(-np.log(np.minimum(chance, 1)) / np.log(LINKS)).astype(np.int64)
        turn = np.argsort((noise ^ (noise >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F), kind="stable")
        nodes, links = [np.arange(len(unit), dtype=np.int32)], []
        while not links or len(nodes[-1]) > TOP:
            level, inside = len(links), nodes[-1]
            order = turn[np.isin(turn, inside)]  # the level's nodes in the order of their insertion
            own = _inserted(unit[order], LINKS if level else BASE_LINKS)
            back = np.argsort(order)
            named = np.where(own >= 0, order[own], -1)[back].astype(np.int32)
            links.append(named)
            local = np.where(named >= 0, np.searchsorted(inside, named), -1)
            nodes.append(inside[_entries(local, levels[inside] > level)])
        return cls(nodes, links)

    def flat(self) -> bytes:
        counts = np.array([len(self.nodes), *map(len, self.nodes)], np.int32)
        return b"".join(x.tobytes() for x in (counts, *self.nodes, *self.links))

    @classmethod
    def of(cls, flat: bytes) -> Graph:
        values = np.frombuffer(flat, np.int32)
        counts = values[1 : 1 + values[0]]
        at, nodes, links = 1 + len(counts), [], []
        for n in counts:
            nodes.append(values[at : at + n])
            at += n
        for level, n in enumerate(counts[:-1]):
            slots = LINKS if level else BASE_LINKS
            links.append(values[at : at + n * slots].reshape(n, slots))
            at += n * slots
        return cls(nodes, links)

    def search(self, unit: np.ndarray, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """[queries, at most beam] nodes, best first, -1 where there are no more."""
        top = self.nodes[-1]
        best = np.argsort(-(queries @ unit[top].T), axis=1, kind="stable")[:, : min(SEEDS, beam)]
        found = top[best].astype(np.int64)
        for level in range(len(self.links) - 1, -1, -1):
            found = _beam(unit, self.nodes[level], self.links[level], queries, found[:, : min(SEEDS, beam)], beam)
        return found


def _beam(unit: np.ndarray, nodes: np.ndarray, links: np.ndarray, queries: np.ndarray, seeds: np.ndarray, beam: int) -> np.ndarray:
    """[queries, at most beam] of the ``nodes`` (in order) of a level that links lead to from the seeds, best first, -1 where there are no more."""
    q = np.arange(len(queries))
    beam = min(beam, len(nodes))
    seeds = seeds[:, :beam]
    found, scores = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -np.inf, unit.dtype)
    done = np.ones((len(q), beam), bool)
    seen = np.zeros((len(q), len(unit)), bool)
    wide, real = seeds.shape[1], seeds >= 0
    found[:, :wide], done[:, :wide] = seeds, ~real
    scores[:, :wide] = np.where(real, np.einsum("qd,qnd->qn", queries, unit[seeds]), -np.inf)
    a, place = np.nonzero(real)
    seen[a, seeds[a, place]] = True
    active = q
    while len(active):
        open_scores = np.where(done[active], -np.inf, scores[active])
        pick = open_scores.argmax(axis=1)
        going = open_scores[np.arange(len(active)), pick] > -np.inf
        active, pick = active[going], pick[going]
        if not len(active):
            break
        done[active, pick] = True
        near = links[np.searchsorted(nodes, found[active, pick])]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        seen[active[:, None], np.where(fresh, near, found[active, pick][:, None])] = True
        near_scores = np.where(fresh, np.einsum("qd,qnd->qn", queries[active], unit[near]), -np.inf)
        all_scores = np.concatenate((scores[active], near_scores), axis=1)
        top = np.argpartition(-all_scores, beam - 1, axis=1)[:, :beam]
        scores[active] = np.take_along_axis(all_scores, top, 1)
        found[active] = np.take_along_axis(np.concatenate((found[active], near), axis=1), top, 1)
        done[active] = np.take_along_axis(np.concatenate((done[active], ~fresh), axis=1), top, 1)
    order = np.argsort(-scores, axis=1, kind="stable")
    found = np.take_along_axis(found, order, 1)
    return np.where(np.take_along_axis(scores, order, 1) > -np.inf, found, -1)


def _cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row by row in double precision, the same for equal pairs wherever they stand."""
    dots = (queries * vectors).sum(axis=1)
    return dots / (np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((vectors * vectors).sum(axis=1)))


@dataclass(frozen=True)
class Index:
    """Shards (dim, region, shard, ids, counts, vectors, graph), how many of them each region has, and the regions' centres by dim."""

    shards: DataFrame
    regions: DataFrame
    centres: dict[int, np.ndarray]


def fitted_centres(sample: np.ndarray, regions: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit vectors, one a region, moved to the middle of the rows that are nearest to them."""
    unit = _unit(sample)
    centres = unit[:: max(1, len(unit) // regions)][:regions].copy()
    for _ in range(rounds):
        own = np.concatenate([(unit[at : at + 4096] @ centres.T).argmax(axis=1) for at in range(0, len(unit), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


def _centres(vectors: DataFrame, shard_rows: int) -> dict[int, np.ndarray]:
    """Centres for the DIMS most frequent lengths of vectors; rows of other lengths are one region."""
    frequent = vectors.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(DIMS).collect()
    out = {}
    for dim, rows in frequent:
        wanted = min(SAMPLE_ROWS, max(1, SAMPLE_VALUES // dim))
        draw = F.pmod(F.xxhash64("vec_id", "vector", F.lit("centres")), F.lit(1 << 30)) < F.lit(int(min(1.0, wanted / rows) * (1 << 30)))
        drawn = vectors.where((F.size("vector") == dim) & draw).orderBy("vec_id", "vector").limit(2 * wanted).select("vector").toArrow()["vector"].combine_chunks()
        sample = drawn.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        regions = min(REGIONS, -(-rows // shard_rows), max(1, len(sample) // 8))
        if len(sample) and regions > 1:
            out[dim] = fitted_centres(sample, regions)
    return out


def _placed(vectors: DataFrame, centres: dict[int, np.ndarray], probes: int | None) -> DataFrame:
    """vec_id, vector, dim and region: the ``probes`` nearest regions, a row each (None: all)."""
    table = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                rows = pa.array(np.nonzero(dims == dim)[0])
                ids, held = batch.column(0).take(rows), batch.column(1).take(rows)
                near = np.zeros((len(rows), 1), np.int64)
                if (own := table.value.get(dim)) is not None:
                    unit = _unit(held.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) + 0.0)
                    near = _nearest(unit @ own.T, len(own) if probes is None else probes)
                again = pa.array(np.repeat(np.arange(len(rows)), near.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(again), held.take(again), pa.array(np.full(len(again), dim, np.int32)), pa.array(near.reshape(-1).astype(np.int32))], names=["vec_id", "vector", "dim", "region"]
                )

    return vectors.select("vec_id", "vector").mapInArrow(run, "vec_id long, vector array<double>, dim int, region int")


def build_index(vectors: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS) -> Index:
    """The staged shards of ``vectors``, which has vec_id and vector (array of double).

    Of equal vectors a node keeps the k + 1 smallest ids, which are all that a list of k neighbours can hold of them.
    """
    centres = _centres(vectors, shard_rows)
    placed = _placed(vectors, centres, 1)
    regions = stage(placed.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards")), "hnsw-regions")
    dealt = placed.join(small_side(regions, REGIONS * DIMS), ["dim", "region"]).withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.col("shards"))).drop("shards")

    def build(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        rows = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) + 0.0
        ids = table["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        rows, ids = rows[order], ids[order]
        _, first, where = np.unique(rows.view(np.dtype((np.void, 8 * dim))).reshape(-1), return_index=True, return_inverse=True)
        held: list[list[int]] = [[] for _ in first]
        for node, vec_id in zip(where.tolist(), ids.tolist()):
            if len(held[node]) <= k and (not held[node] or held[node][-1] != vec_id):
                held[node].append(vec_id)
        unique = np.ascontiguousarray(rows[first])
        flat = [np.array(sum(held, []), np.int64).tobytes(), np.array([len(h) for h in held], np.int32).tobytes(), unique.tobytes(), Graph.build(unique).flat()]
        place = table.select(["dim", "region", "shard"]).slice(0, 1)
        for name, value in zip(("ids", "counts", "vectors", "graph"), flat):
            place = place.append_column(name, pa.array([value], pa.binary()))
        return place

    schema = "dim int, region int, shard long, ids binary, counts binary, vectors binary, graph binary"
    return Index(stage(dealt.groupBy("dim", "region", "shard").applyInArrow(build, schema), "hnsw"), regions, centres)


def search_index(index: Index, queries: DataFrame, k: int = 5, beam: int = BEAM, block: int = QUERY_BLOCK, probes: int | None = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest that the graphs of the probed regions find for each query."""
    queries = stage(queries.select("vec_id", "vector").distinct(), "hnsw-queries")
    routed = _placed(queries, index.centres, probes)
    asked = routed.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    met = stage(index.regions.join(asked, ["dim", "region"]), "hnsw-asked")
    dealt = routed.join(small_side(met, REGIONS * DIMS), ["dim", "region"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    dealt = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    packed = dealt.groupBy("dim", "region", "shard", "block").agg(F.collect_list(F.struct("vec_id", "vector")).alias("queries"))
    met = index.shards.join(packed, ["dim", "region", "shard"]).select("dim", "ids", "counts", "vectors", "graph", "queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, ids, counts, vectors, graph = (batch.column(c)[r].as_py() for c in range(5))
                asked = batch.column(5)[r].values
                query_ids = asked.field("vec_id").to_numpy()
                query = asked.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) + 0.0
                vectors = np.frombuffer(vectors).reshape(-1, dim)
                counts = np.frombuffer(counts, np.int32).astype(np.int64)
                starts, ids = np.cumsum(counts) - counts, np.frombuffer(ids, np.int64)
                nodes = Graph.of(graph).search(_unit(vectors), _unit(query), beam)[:, : k + SPARE]
                a, place = np.nonzero(nodes >= 0)
                node = nodes[a, place]
                score = _cosines(query[a], vectors[node])
                # A node stands for up to k + 1 ids.
                times = counts[node]
                a, score = np.repeat(a, times), np.repeat(score, times)
                vec = ids[np.repeat(starts[node], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
                other = vec != query_ids[a]
                a, score, vec = a[other], score[other], vec[other]
                order = np.lexsort((vec, -score, a))
                a, score, vec = a[order], score[order], vec[order]
                best = np.arange(len(a)) - np.searchsorted(a, a) < k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_ids[a[best]]), pa.array(vec[best]), pa.array(score[best])], names=["query_id", "vec_id", "score"]
                )

    found = met.mapInArrow(search, "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(
    vectors: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = BEAM, probes: int | None = PROBES
) -> DataFrame:
    """The k nearest of each row whose id is divisible by ``every``, among all other rows."""
    whole_numbers(vectors, vec_id)
    sound = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(vector)))
    sound = sound.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return search_index(build_index(sound, k, shard_rows), sound.where(F.pmod("vec_id", F.lit(every)) == 0), k, beam, probes=probes)

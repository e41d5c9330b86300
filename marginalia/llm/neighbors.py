"""The most similar vectors of every vector: NN-descent by Spark joins, and greedy search in the graph it builds.

Vectors are normalised and exact copies collapsed, so a node is a direction with any number of member records. A first graph
comes from a forest of random-hyperplane orders: nodes sorted by the signs of random projections are compared within blocks
of fixed size; how many trees there are follows from the number of blocks. NN-descent then improves it: around every node its
neighbours and the nodes that have it as a neighbour meet (two joins), are compared with each other where one of a pair is
new, and every better neighbour found is merged. A round ends with a written table; rounds stop when few neighbours change.
A node's neighbours are one row (packed arrays), all state is a constant number of entries a node, blocks are cut at a fixed
size however many nodes share a cell or a hub, and nothing is collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from marginalia.session import materialize, release

DIM = 64
#: Neighbours given out, and neighbours kept a node while building.
K = 10
KEEP = 24
#: Nodes of a block that are compared with each other; one block needs one tree, each doubling of the blocks TREES_PER_DOUBLING more.
BLOCK = 8192
TREES_PER_DOUBLING = 2
#: Nodes that meet around one centre at once; a hub with more has them compared block by block.
MEETING = 64
#: Rounds end when less than this part of all kept neighbours is new; there are at most LEAST_ROUNDS and one more each doubling.
STEADY = 0.02
LEAST_ROUNDS = 4
_BITS = 24
#: Tables that hold the surroundings of the nodes for a search, so that a part of them is shuffled at a time. Searches see vectors as 16-bit numbers, of which this is 1.
SLICES = 4
_UNIT = 32767.0


def members(records: DataFrame, key: str, vector: str, dim: int = DIM) -> DataFrame:
    """key, node, vec of the valid vectors: ``vec`` is the normalised vector as float32 bytes, ``node`` its 64-bit hash.

    Valid means not null, ``dim`` numbers, none of them null, NaN or infinite, not all zero; others and null keys are left out.
    """

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if b.num_rows else np.empty((0, dim))
            top = np.abs(x).max(axis=1, initial=0, keepdims=True)
            ok = (np.isfinite(x).all(axis=1) & (top[:, 0] > 0)) if len(x) else np.empty(0, bool)
            x, top = x[ok], top[ok]
            x = x / top
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4") + np.float32(0)
            yield pa.record_batch([b.column(0).filter(pa.array(ok)), pa.array([r.tobytes() for r in x], pa.binary())], names=["key", "vec"])

    shaped = records.select(F.col(key).cast("string").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    shaped = shaped.where(F.col("key").isNotNull() & (F.size("v") == dim) & ~F.exists("v", lambda e: e.isNull() | F.isnan(e)))
    return shaped.mapInArrow(normalise, "key string, vec binary").select("key", F.xxhash64("vec").alias("node"), "vec")


def _matrix(col: pa.Array, dtype: str, width: int) -> np.ndarray:
    """A binary column of rows of equal length as a matrix."""
    n = len(col)
    if not n:
        return np.empty((0, width), dtype)
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype).reshape(n, width)


def _binary(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    x = np.ascontiguousarray(x)
    size = x.shape[1] * x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def _short(x: np.ndarray) -> pa.Array:
    """Vectors as they travel while the graph is built: a byte a number and their scale. Cosines of them are off by about 0.001."""
    scale = np.maximum(np.abs(x).max(axis=1, keepdims=True), np.float32(1e-30)) / np.float32(127)
    return _binary(np.hstack([np.ascontiguousarray(scale, "<f4").view(np.int8), np.rint(x / scale).astype(np.int8)]))


def _long(col: pa.Array, dim: int) -> np.ndarray:
    raw = _matrix(col, "i1", dim + 4)
    return raw[:, 4:].astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view("<f4")


#: A node's neighbours in one row: ids, similarities and whether they are new, as packed arrays of equal length.
_GRAPH = "node long, others binary, sims binary, fresh binary, size int, new int"
_EDGE = "node long, other long, sim float, fresh boolean"


def _packed(ids: np.ndarray, others: np.ndarray, sims: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
    """Edges sorted by node as one row a node."""
    begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.empty(0, np.int64)
    bounds = np.append(begin, len(ids))

    def column(x: np.ndarray, dtype: str) -> pa.Array:
        x = np.ascontiguousarray(x, dtype)
        return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((bounds * x.itemsize).astype(np.int32)), pa.py_buffer(x)])

    new = np.add.reduceat(fresh.astype(np.int32), begin) if len(begin) else np.empty(0, np.int32)
    columns = [pa.array(ids[begin]), column(others, "<i8"), column(sims, "<f4"), column(fresh, "?"), pa.array(np.diff(bounds).astype(np.int32)), pa.array(new.astype(np.int32))]
    return pa.record_batch(columns, names=["node", "others", "sims", "fresh", "size", "new"])


def _unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The edges of packed rows: node, other, sim, fresh."""

    def flat(col: pa.Array, dtype: str) -> np.ndarray:
        offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
        return np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype)

    if not b.num_rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, bool)
    return np.repeat(b.column(0).to_numpy(), b.column(4).to_numpy()), flat(b.column(1), "<i8"), flat(b.column(2), "<f4"), flat(b.column(3), "?")


def edges_of(graph: DataFrame, most: int = KEEP) -> DataFrame:
    """The edges of a packed graph, the best ``most`` of every node: node, other, sim, fresh."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(4).to_numpy()
            rank = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            yield pa.record_batch([pa.array(x[rank < most]) for x in _unpacked(b)], names=["node", "other", "sim", "fresh"])

    return graph.mapInArrow(unpack, _EDGE)


def _top(ids: np.ndarray, others: np.ndarray, sims: np.ndarray, fresh: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """The best ``keep`` distinct others a node; of equal pairs one that is not fresh stays; ties go to the smaller other."""
    order = np.lexsort((fresh, others, ids))
    ids, others, sims, fresh = ids[order], others[order], sims[order], fresh[order]
    first = np.ones(len(ids), bool)
    first[1:] = (ids[1:] != ids[:-1]) | (others[1:] != others[:-1])
    ids, others, sims, fresh = ids[first], others[first], sims[first], fresh[first]
    order = np.lexsort((others, -sims, ids))
    ids, others, sims, fresh = ids[order], others[order], sims[order], fresh[order]
    begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.empty(0, np.int64)
    rank = np.arange(len(ids)) - np.repeat(begin, np.diff(np.append(begin, len(ids))))
    best = rank < keep
    return ids[best], others[best], sims[best], fresh[best]


def _merge(graphs: DataFrame, keep: int) -> DataFrame:
    """The best distinct neighbours of every node, of packed rows of which a node may have several."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = list(_unpacked(b))
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
            at = np.searchsorted(cols[0], cols[0][-1])
            done, rest = [c[:at] for c in cols], [c[at:] for c in cols]
            if len(rest[0]) > 64 * keep:  # a hub's list stays short
                rest = list(_top(*rest, keep))
            if at:
                yield _packed(*_top(*done, keep))
        if rest is not None and len(rest[0]):
            yield _packed(*_top(*rest, keep))

    return graphs.repartition("node").sortWithinPartitions("node").mapInArrow(merge, _GRAPH)


def _best_of_rows(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``m`` largest numbers of each row, and some more: a sample of the columns gives a bound that about
    four times as many exceed; rows with too few beyond it are done in full."""
    width = s.shape[1]
    if width < 64 * m:
        best = np.argpartition(-s, m - 1, axis=1)[:, :m]
        return np.repeat(np.arange(len(s)), m), best.ravel()
    step = max(1, width // (16 * m))
    sample = s[:, ::step]
    k = max(1, round(4 * m / step))
    bound = np.partition(sample, sample.shape[1] - k, axis=1)[:, sample.shape[1] - k]
    i, j = np.divmod(np.flatnonzero(s > bound[:, None]), width)
    few = np.flatnonzero(np.bincount(i, minlength=len(s)) < m)
    if len(few):
        other = ~np.isin(i, few)
        best = np.argpartition(-s[few], m - 1, axis=1)[:, :m]
        i, j = np.append(i[other], np.repeat(few, m)), np.append(j[other], best.ravel())
    return i, j


def forest(nodes: DataFrame, trees: int, keep: int = KEEP, block: int = BLOCK, dim: int = DIM, seed: int = 7) -> DataFrame:
    """A first graph: in each of several random orders the nodes of a block are compared with each other."""
    planes = np.random.default_rng(seed).standard_normal((trees, _BITS + 1, dim)).astype(np.float32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(_BITS - 1, -1, -1, dtype=np.int64)
        for b in batches:
            x = _matrix(b.column(1), "<f4", dim)
            small = _short(x)
            for t in range(trees):
                p = x @ planes[t].T
                spot = ((p[:, :_BITS] > 0) @ weights) * 4096 + np.clip((p[:, _BITS] + 4) * 512, 0, 4095).astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(x), t, np.int32)), pa.array(spot), b.column(0), small], names=["tree", "spot", "node", "vec"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, tree, size = [], [], -1, 0

        def flush() -> Iterator[pa.RecordBatch]:
            """Blocks of nearly equal size, none larger than ``block``."""
            i, x = np.concatenate(ids), np.concatenate(vecs)
            cuts = np.linspace(0, len(i), -(-len(i) // block) + 1).astype(np.int64)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                own, y = i[lo:hi], x[lo:hi]
                m = min(keep, len(own) - 1)
                for r in range(0, len(own), 1024) if m > 0 else ():
                    s = y[r : r + 1024] @ y.T
                    s[np.arange(len(s)), r + np.arange(len(s))] = -2
                    a, j = _best_of_rows(s, m)
                    sim = s[a, j]
                    order = np.argsort(a * 4.0 - sim)  # by row, then the most similar first
                    a, j, sim = a[order], j[order], sim[order]
                    begin = np.searchsorted(a, np.arange(len(s)))
                    best = np.arange(len(a)) - begin[a] < m
                    yield _packed(own[r + a[best]], own[j[best]], sim[best], np.ones(int(best.sum()), bool))

        for b in batches:
            t, node, x = b.column(0).to_numpy(), b.column(2).to_numpy(), _long(b.column(3), dim)
            for piece in np.split(np.arange(len(t)), np.flatnonzero(np.diff(t)) + 1):
                if not len(piece):
                    continue
                if size and t[piece[0]] != tree or size >= 2 * block:
                    yield from flush()
                    ids, vecs, size = [], [], 0
                tree = t[piece[0]]
                ids.append(node[piece])
                vecs.append(x[piece])
                size += len(piece)
        if size:
            yield from flush()

    placed = nodes.select("node", "vec").mapInArrow(place, "tree int, spot long, node long, vec binary")
    ordered = placed.repartitionByRange("tree", "spot").sortWithinPartitions("tree", "spot")
    return _merge(ordered.mapInArrow(compare, _GRAPH), keep)


def descend(graph: DataFrame, nodes: DataFrame, keep: int = KEEP, dim: int = DIM, meeting: int = MEETING) -> DataFrame:
    """One round of NN-descent: neighbours of a node, in either direction, are compared with each other where one is new."""

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, other, _, fresh = _unpacked(b)
            yield pa.record_batch([pa.array(np.append(node, other)), pa.array(np.append(other, node)), pa.array(np.append(fresh, fresh))], names=["centre", "node", "fresh"])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, _, sim, _ = _unpacked(b)
            full = b.column(4).to_numpy() >= keep
            begin = np.append(0, np.cumsum(b.column(4).to_numpy())[:-1])
            low = np.minimum.reduceat(sim, begin) if len(node) else np.empty(0, np.float32)
            yield pa.record_batch([b.column(0), pa.array(np.where(full, low, -2).astype(np.float32))], names=["node", "worst"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(), _long(b.column(4), dim)]
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
            at = int(np.searchsorted(cols[0], cols[0][-1]))
            if len(cols[0]) - at > 4096:
                at = len(cols[0])  # a hub is met in blocks anyway
            rest = [c[at:] for c in cols]
            if at:
                yield from found([c[:at] for c in cols])
        if rest is not None and len(rest[0]):
            yield from found(rest)

    def found(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        centre, ids, fresh, worst, vec = cols
        cut = np.append(np.flatnonzero(np.append(True, centre[1:] != centre[:-1])), len(centre))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, end in zip(cut[:-1], cut[1:], strict=True):
            for a in range(lo, end, meeting):
                z = min(a + meeting, end)
                if z - a < 2 or not fresh[a:z].any():
                    continue
                x, new, w, own = vec[a:z], fresh[a:z], worst[a:z], ids[a:z]
                s = x @ x.T
                better = (s > w[:, None]) & (new[:, None] | new[None, :])
                i, j = np.nonzero(better)
                if len(i):
                    out.append((own[i], own[j], s[i, j]))
        if out:
            i, j, s = (np.concatenate(c) for c in zip(*out, strict=True))
            real = i != j
            yield _packed(*_top(i[real], j[real], s[real], np.ones(int(real.sum()), bool), keep))

    small = nodes.select("node", "vec").mapInArrow(_shortened(dim), "node long, vec binary").join(graph.mapInArrow(known, "node long, worst float"), "node")
    meetings = graph.mapInArrow(around, "centre long, node long, fresh boolean").join(small, "node").select("centre", "node", "fresh", "worst", "vec")
    ordered = meetings.repartitionByRange("centre", F.xxhash64("node")).sortWithinPartitions("centre")

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, other, sim, fresh = _unpacked(b)
            yield _packed(node, other, sim, np.zeros(len(fresh), bool))

    return _merge(graph.mapInArrow(settled, _GRAPH).unionByName(ordered.mapInArrow(meet, _GRAPH)), keep)


def _shortened(dim: int):
    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), _short(_matrix(b.column(1), "<f4", dim))], names=["node", "vec"])

    return shorten


def build_graph(nodes: DataFrame, keep: int = KEEP, trees: int | None = None, rounds: int | None = None, dim: int = DIM, block: int = BLOCK) -> DataFrame:
    """The neighbour graph of the nodes, one packed row a node with up to ``keep`` neighbours (see :func:`edges_of`).

    Trees and the most rounds follow from the number of nodes unless they are given: the more blocks the nodes fill, the
    rarer two near nodes share one."""
    doublings = math.log2(max(1.0, nodes.count() / block))
    trees = trees or 1 + math.ceil(TREES_PER_DOUBLING * doublings)
    rounds = rounds if rounds is not None else LEAST_ROUNDS + math.ceil(doublings)
    graph = materialize(forest(nodes, trees, keep, block, dim), "graph")
    for _ in range(rounds):
        better = materialize(descend(graph, nodes, keep, dim), "graph")
        new, total = better.agg(F.sum("new"), F.sum("size")).first()
        release(graph)
        graph = better
        if not total or new < STEADY * total:
            break
    return graph


def exact_similarity(pairs: DataFrame, nodes: DataFrame, dim: int = DIM, firsts: DataFrame | None = None) -> DataFrame:
    """``pairs`` (node, other) with ``sim`` as the exact cosine of the two; ``firsts`` has the vectors of ``node`` if ``nodes`` hasn't."""

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, o = (_matrix(b.column(i), "<f4", dim).astype(np.float64) for i in (2, 3))
            norm = np.sqrt((a * a).sum(axis=1) * (o * o).sum(axis=1))
            yield pa.record_batch([b.column(0), b.column(1), pa.array((a * o).sum(axis=1) / np.where(norm > 0, norm, 1))], names=["node", "other", "sim"])

    a, o = (nodes if firsts is None else firsts).select("node", F.col("vec").alias("va")), nodes.select(F.col("node").alias("other"), F.col("vec").alias("vo"))
    return pairs.select("node", "other").join(a, "node").join(o, "other").select("node", "other", "va", "vo").mapInArrow(dot, "node long, other long, sim double")


def nearest(records: DataFrame, key: str, vector: str, k: int = K, least: float | None = None, dim: int = DIM, **build: int) -> DataFrame:
    """The ``k`` most similar other records of every record: key, other_key, sim, rank (from 1); with ``least`` only those of at least that cosine.

    Similarity ties go to the smaller key. Records of one direction are each other's nearest (cosine 1) and share what lies
    around; a record with no other has no row. See :func:`members` for what is left out; repeated keys with one vector
    count once. Which neighbours are found is approximate (recall in the README), their cosines are exact.
    """
    own = materialize(members(records, key, vector, dim), "members")
    nodes = materialize(own.groupBy("node").agg(F.first("vec").alias("vec")), "nodes")
    people = own.select("node", "key").distinct()
    edges = edges_of(build_graph(nodes, dim=dim, **build), k + 6)  # a few more, as the graph's own cosines are rounded
    if least is not None:
        edges = edges.where(F.col("sim") >= least - 0.01)
    edges = exact_similarity(edges, nodes, dim)
    if least is not None:
        edges = edges.where(F.col("sim") >= least)
    some = people.withColumn("r", F.row_number().over(W.Window.partitionBy("node").orderBy("key"))).where(F.col("r") <= k + 1).select("node", "key")
    same = some.select("node", F.col("key").alias("other_key"), F.lit(1.0).alias("sim"))
    near = edges.join(some.select(F.col("node").alias("other"), F.col("key").alias("other_key")), "other").select("node", "other_key", "sim")
    order = W.Window.partitionBy("node").orderBy(F.desc("sim"), "other_key")
    around = same.unionByName(near).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    listed = around.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d"), "other_key"))).alias("around"))
    each = people.join(listed, "node").select("key", F.posexplode(F.slice(F.filter("around", lambda x: x["other_key"] != F.col("key")), 1, k)).alias("rank", "x"))
    return each.select("key", F.col("x.other_key").alias("other_key"), (-F.col("x.d")).alias("sim"), (F.col("rank") + 1).alias("rank"))


def current_vectors(vectors: DataFrame) -> DataFrame:
    """The current row of every chunk: chunk_id, v. Of several rows the highest run counts, of equal runs the largest hash."""
    return vectors.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.max_by("v", F.struct("run_id", "h")).alias("v"))


def close_pairs(records: DataFrame, key: str, vector: str, least: float = 0.9, k: int = K, dim: int = DIM) -> DataFrame:
    """Pairs of which one is among the ``k`` nearest of the other with a cosine of at least ``least``: key_a < key_b."""
    near = nearest(records, key, vector, k, least, dim)
    return near.select(F.least("key", "other_key").alias("key_a"), F.greatest("key", "other_key").alias("key_b")).distinct()


def _fixed(x: np.ndarray) -> np.ndarray:
    """Unit vectors as 16-bit numbers: products of them are summed exactly, so a pair has one similarity wherever it is met."""
    return np.rint(x * np.float32(_UNIT)).astype("<i2")


def _parts(col: pa.Array, dtype: str, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """A binary column of packed rows: where each row begins (and the last ends), counted in items, and all items."""
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype)
    return (offsets - offsets[0]) // (np.dtype(dtype).itemsize * width), raw.reshape(-1, width) if width > 1 else raw


def _surroundings(graph: DataFrame, nodes: DataFrame, dim: int) -> list[DataFrame]:
    """The neighbours of every node in either direction with their vectors, in SLICES tables: node, others, vecs, packed."""

    def fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), _binary(_fixed(_matrix(b.column(1), "<f4", dim)))], names=["other", "vec"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, other, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), "u1", 2 * dim)
            begin = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.empty(0, np.int64)
            bounds = np.append(begin, len(node))
            others, vecs = (pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((bounds * w).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(y))]) for y, w in ((other, 8), (x, 2 * dim)))
            yield pa.record_batch([pa.array(node[begin]), others, vecs], names=["node", "others", "vecs"])

    edges = edges_of(graph).select("node", "other")
    both = materialize(edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "search-graph")
    vecs = nodes.select("node", "vec").mapInArrow(fixed, "other long, vec binary")
    out = []
    for i in range(SLICES):
        rows = both.where(F.pmod("node", F.lit(SLICES)) == i).join(vecs, "other").select("node", "other", "vec")
        packed = rows.repartition("node").sortWithinPartitions("node").mapInArrow(pack, "node long, others binary, vecs binary")
        out.append(materialize(packed, "surroundings"))
    release(both)
    return out


def search(records: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int = K, beam: int = 32, starts: int = 256, dim: int = DIM, wide: int = 8, **build: int) -> DataFrame:
    """Greedy search of a query set of any size in the neighbour graph: query, other_key, sim, rank (from 1).

    Every query vector starts from ``starts`` nodes of the index (the smallest hashes: a bounded, fixed sample of entry points; all
    nodes are in the graph) and keeps a pool of its ``beam`` best nodes; in each step the ``wide`` best nodes of the pool
    that are not yet expanded meet their neighbours, until all pools are expanded (pools only get better, so this ends). What
    moves in a step is each node with its neighbours once and each query vector ``wide`` times at most, and only neighbours
    better than a pool's worst go back to it. Equal query vectors are searched once. Invalid queries have no rows; a record with
    the query's own key is left out; the cosines given out are exact.
    """
    own = materialize(members(records, key, vector, dim), "members")
    nodes = materialize(own.groupBy("node").agg(F.first("vec").alias("vec")), "nodes")
    graph = build_graph(nodes, dim=dim, **build)
    slices = _surroundings(graph, nodes, dim)
    release(graph)
    askers = materialize(members(queries, query_key, query_vector, dim).withColumnRenamed("key", "query").dropDuplicates(["query"]), "queries")
    asked = materialize(askers.groupBy("node").agg(F.first("vec").alias("vec")), "asked")
    few = asked.count() * wide <= 200_000
    entries = nodes.orderBy(F.xxhash64("node"), "node").limit(starts).select("node", "vec").collect()
    entry = np.array([r["node"] for r in entries], np.int64)
    entry_x = _fixed(np.frombuffer(b"".join(r["vec"] for r in entries), "<f4").reshape(-1, dim)).astype(np.float64)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = min(beam, len(entry))
        for b in batches:
            q = _fixed(_matrix(b.column(1), "<f4", dim)).astype(np.float64)
            sims = (q @ entry_x.T / _UNIT**2).astype(np.float32)
            i, j = _best_of_rows(sims, m) if m else (np.empty(0, np.int64),) * 2
            yield _packed(*_top(b.column(0).to_numpy()[i], entry[j], sims[i, j], np.ones(len(i), bool), beam))

    def chosen(size: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """The first ``wide`` fresh entries of every pool, whose entries are sorted, the best first."""
        upto = np.cumsum(fresh)
        begin = np.cumsum(size) - size
        before = np.where(begin > 0, upto[begin - 1], 0)
        return fresh & (upto - np.repeat(before, size) <= wide)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, other, sim, fresh = _unpacked(b)
            yield _packed(node, other, sim, fresh & ~chosen(b.column(4).to_numpy(), fresh)) if len(node) else b

    def requests(part: int):
        def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, other, sim, fresh = _unpacked(b)
                size, row = b.column(4).to_numpy(), np.repeat(np.arange(b.num_rows), b.column(4).to_numpy())
                worst = np.where(size >= beam, sim[np.cumsum(size) - 1], -2).astype(np.float32)
                at = np.flatnonzero(chosen(size, fresh) & (other % SLICES == part)) if len(row) else np.empty(0, np.int64)
                x = _fixed(_matrix(b.column(6), "<f4", dim))[row[at]]
                yield pa.record_batch([pa.array(other[at]), pa.array(b.column(0).to_numpy()[row[at]]), pa.array(worst[row[at]]), _binary(x)], names=["node", "query", "worst", "vecs"])

        return request

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, x = None, np.empty(0, np.int64), np.empty((0, dim))
        for b in batches:
            if not b.num_rows:
                continue
            node, asks, query, worst = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            id_at, all_ids = _parts(b.column(4), "<i8")
            vec_at, vecs = _parts(b.column(5), "<i2", dim)
            cut = np.append(np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (asks[1:] != asks[:-1]))), len(node))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if not asks[lo]:  # the neighbours of a node, in one row or several
                    some, y = all_ids[id_at[lo] : id_at[hi]], vecs[vec_at[lo] : vec_at[hi]].astype(np.float64)
                    ids, x = (np.append(ids, some), np.vstack([x, y])) if node[lo] == at else (some, y)
                    at = node[lo]
                elif node[lo] == at:
                    step = max(1, (1 << 21) // len(ids))
                    for r in range(lo, hi, step):
                        z = min(r + step, hi)
                        s = (vecs[vec_at[r] : vec_at[z]].astype(np.float64) @ x.T / _UNIT**2).astype(np.float32)
                        i, j = np.nonzero(s > worst[r:z, None]) if len(ids) <= 4 * beam else _best_of_rows(s, beam)
                        sim = s[i, j]
                        better = sim > worst[r + i]
                        out.append((query[r + i[better]], ids[j[better]], sim[better]))
            if out:
                q, o, s = (np.concatenate(c) for c in zip(*out, strict=True))
                order = np.argsort(q, kind="stable")
                yield _packed(q[order], o[order], s[order], np.ones(len(q), bool))

    pool = materialize(asked.select("node", "vec").mapInArrow(begun, _GRAPH), "pool")
    while True:
        open_pools = pool.where("new > 0").join(asked, "node")
        found = []
        for part, around in enumerate(slices):
            asking = open_pools.mapInArrow(requests(part), "node long, query long, worst float, vecs binary")
            if few:
                around = around.join(F.broadcast(asking.select("node").distinct()), "node", "left_semi")
            none = around.select("node", F.lit(False).alias("asks"), F.lit(0).cast("long").alias("query"), F.lit(0.0).cast("float").alias("worst"), "others", "vecs")
            both = none.unionByName(asking.select("node", F.lit(True).alias("asks"), "query", "worst", F.lit(b"").alias("others"), "vecs"))
            ordered = both.repartition("node").sortWithinPartitions("node", "asks")
            found.append(materialize(ordered.mapInArrow(meet, _GRAPH), "found"))
        better = pool.mapInArrow(settled, _GRAPH)
        for x in found:
            better = better.unionByName(x)
        better = materialize(_merge(better, beam), "pool")
        for x in (pool, *found):
            release(x)
        pool = better
        if pool.where("new > 0").isEmpty():
            break
    for x in slices:
        release(x)
    pairs = exact_similarity(edges_of(pool, k + 6), nodes, dim, asked).withColumnsRenamed({"node": "asked", "other": "node"})  # a few more, as the pool's own cosines are rounded
    people = own.select("node", F.col("key").alias("other_key")).distinct().withColumn("r", F.row_number().over(W.Window.partitionBy("node").orderBy("other_key"))).where(F.col("r") <= k + 1).drop("r")
    order = W.Window.partitionBy("query").orderBy(F.desc("sim"), "other_key")
    each = pairs.join(people, "node").select("asked", "other_key", "sim").join(askers.select(F.col("node").alias("asked"), "query"), "asked")
    found = each.where(F.col("other_key") != F.col("query")).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("query", "other_key", "sim", "rank")

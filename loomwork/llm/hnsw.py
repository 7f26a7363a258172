"""Approximate nearest neighbours: one HNSW graph per shard, results merged.

A graph is built layer by layer from the top. A layer is a flat array of
neighbour numbers (a row per node, -1 where unused). Nodes enter in growing
batches: a batch searches the layer as it stands, together with one another,
starting from where the layers above lead, keeps diverse neighbours, and the
nodes it points to take it up. All steps run on whole batches in numpy.

Equal vectors of a shard are one node, which keeps the ids of all its rows,
so copies neither crowd neighbour lists nor get lost.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import binary_column, columns, cut

LINKS = 16
WIDE = 2 * LINKS  # neighbours on the bottom layer
EF_BUILD = 80
EF_SEARCH = 160
STEP = 4  # nodes a search expands at a time
BATCH = 512
SEEN_BYTES = 64 << 20  # what a search marks as seen at a time
FAR = 1e15
LEAST_ROWS, SHARD_BYTES = 8192, 256 << 20


def placed(vectors: np.ndarray, sample: int = 4096) -> tuple[np.ndarray, float]:
    """(centre, scale) by which a shard's vectors are moved and divided before they are halved to single precision.

    The order of distances does not depend on them, but a common offset or a
    magnitude far from 1 would take the digits that tell near vectors apart.
    """
    some = vectors[:: max(1, len(vectors) // sample)].astype(np.float64)
    centre = np.median(some, axis=0)
    size = np.abs(some - centre).max(axis=1)
    size = size[size > 0]
    return centre, float(np.median(size)) if len(size) else 1.0


def single(vectors: np.ndarray, centre: np.ndarray, scale: float) -> np.ndarray:
    """Vectors for the graph; those too far out for single precision keep their direction."""
    moved = (vectors.astype(np.float64) - centre) / scale
    return (moved / np.maximum(1, np.abs(moved).max(axis=1, keepdims=True) / FAR)).astype(np.float32)


def gaps(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences from each query to its own list of nodes, and their squared lengths."""
    gap = x[ids] - q[:, None, :]
    return gap, np.einsum("bcd,bcd->bc", gap, gap)


def nearest(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances from each query to its own list of nodes; a few queries at a time, so that the differences stay in the cache."""
    out = np.empty(ids.shape, np.float32)
    step = max(1, (1 << 17) // max(1, ids.shape[1] * x.shape[1]))
    for i in range(0, len(ids), step):
        out[i: i + step] = gaps(x, q[i: i + step], ids[i: i + step])[1]
    return out


def search_layer(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for all queries: the ``ef`` nearest found (ids, or -1, and squared distances), ascending."""
    most = max(1, SEEN_BYTES // (len(x) + 1))
    if len(q) > most:
        return tuple(np.concatenate(c) for c in zip(*(search_layer(x, links, q[i: i + most], entry[i: i + most], ef) for i in range(0, len(q), most)), strict=True))
    b, n = len(q), len(x)
    ids, dist, open_ = np.full((b, ef), -1), np.full((b, ef), np.inf, np.float32), np.zeros((b, ef), bool)
    ids[:, 0], open_[:, 0] = entry, True
    dist[:, 0] = nearest(x, q, entry[:, None])[:, 0]
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True
    seen[np.arange(b), entry] = True
    live = np.arange(b)
    take = min(STEP, ef)
    while len(live):
        waiting = np.where(open_[live], dist[live], np.inf)
        best = np.argpartition(waiting, take - 1, axis=1)[:, :take] if ef > take else np.tile(np.arange(ef), (len(live), 1))
        found = np.isfinite(np.take_along_axis(waiting, best, axis=1))
        going = found.any(axis=1)
        live, best, found = live[going], best[going], found[going]
        if not len(live):
            break
        open_[live[:, None], best] = False
        new = np.where(found[:, :, None], links[ids[live[:, None], best]], -1).reshape(len(live), -1)
        new[new < 0] = n
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        new[seen[live[:, None], new]] = n
        seen[live[:, None], new] = True
        real = new < n
        safe = np.where(real, new, 0)
        far = np.where(real, nearest(x, q[live], safe), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[live], far], axis=1)
        order = np.argsort(all_d, axis=1)[:, :ef]
        dist[live] = np.take_along_axis(all_d, order, axis=1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(real, new, -1)], axis=1), order, axis=1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], real], axis=1), order, axis=1)
    return ids, dist


def diverse(x: np.ndarray, nodes: np.ndarray, ids: np.ndarray, dist: np.ndarray, keep: int) -> np.ndarray:
    """From candidates in ascending distance, those nearer to the node than to any kept before; then the nearest others."""
    b, c = ids.shape
    v, norms = gaps(x, x[nodes], np.maximum(ids, 0))
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    valid = np.isfinite(dist)
    chosen = np.zeros((b, c), bool)
    for i in range(c):
        near = np.where(chosen, between[:, i, :], np.inf).min(axis=1)
        chosen[:, i] = valid[:, i] & (dist[:, i] < near) & (chosen.sum(axis=1) < keep)
    rank = np.where(chosen, 0, np.where(valid, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :keep]
    out = np.where(np.take_along_axis(valid, order, axis=1), np.take_along_axis(ids, order, axis=1), -1)
    return out if out.shape[1] == keep else np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)


def ascend(ids: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)


def build_layer(x: np.ndarray, nodes: np.ndarray, entry: np.ndarray, width: int) -> np.ndarray:
    """Links among ``nodes``; ``entry`` is where each node's search of this layer begins (-1: the first node)."""
    links = np.full((len(x), width), -1)
    done = 1
    while done < len(nodes):
        batch = nodes[done: done + min(BATCH, max(1, done))]
        q = x[batch]
        begin = np.where(entry[batch] < 0, nodes[0], entry[batch])
        ids, dist = search_layer(x, links, q, begin, EF_BUILD)
        ids, dist = ids[:, : 3 * LINKS], dist[:, : 3 * LINKS]
        middle = q - q.mean(axis=0)
        norms = (middle * middle).sum(axis=1)
        among = norms[None, :] + norms[:, None] - 2 * middle @ middle.T
        np.fill_diagonal(among, np.inf)
        some = np.argsort(among, axis=1)[:, : LINKS // 2]
        among = nearest(x, q, batch[some])
        ids = np.concatenate([ids, batch[some]], axis=1)
        dist = np.where(ids == batch[:, None], np.inf, np.concatenate([dist, among], axis=1))
        ids, dist = ascend(ids, dist.astype(np.float32))
        chosen = diverse(x, batch, ids, dist, LINKS)
        links[batch, :LINKS] = chosen
        source, target = np.repeat(batch, LINKS), chosen.ravel()
        real = target >= 0
        source, target = source[real], target[real]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        for i in range(0, len(heads), BATCH):
            own, at, many = heads[i: i + BATCH], first[i: i + BATCH], count[i: i + BATCH]
            more = np.full((len(own), int(many.max())), -1)
            place = np.repeat(np.arange(len(own)), many), np.concatenate([np.arange(m) for m in many.tolist()])
            more[place] = source[at[0]: at[0] + int(many.sum())]
            ids = np.concatenate([links[own], more], axis=1)
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            dist = np.where(ids >= 0, nearest(x, x[own], np.maximum(ids, 0)), np.inf)
            links[own] = diverse(x, own, *ascend(ids, dist.astype(np.float32)), width)
        done += len(batch)
    return links


def build(x: np.ndarray, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the top, for single-precision vectors: (nodes in order of entry, links)."""
    random = np.random.default_rng(seed)
    level = np.floor(random.exponential(1 / np.log(LINKS), len(x))).astype(np.int64)
    order = random.permutation(len(x))
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    entry = np.full(len(x), -1)
    for one in range(int(level.max(initial=0)), -1, -1):
        nodes = order[level[order] >= one]
        if layers:  # nodes of the layer above come first, so the others may start from them
            nodes = np.r_[layers[-1][0], nodes[level[nodes] == one]]
            entry = descend(x, layers, x)
        layers.append((nodes, build_layer(x, nodes, entry, WIDE if one == 0 else LINKS)))
    return layers


def descend(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray) -> np.ndarray:
    """The node of the lowest given layer where a search goes on below."""
    out = []
    for i in range(0, len(q), BATCH):
        at = np.full(len(q[i: i + BATCH]), layers[0][0][0])
        for _, links in layers:
            at = search_layer(x, links, q[i: i + BATCH], at, 4)[0][:, 0]
        out.append(at)
    return np.concatenate(out)


class Index:
    """A shard's graph, its original vectors and the row ids of each of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.vectors, which = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, which.ravel()))
        self.rows = ids[order]
        self.first = np.searchsorted(which.ravel()[order], np.arange(len(self.vectors) + 1))
        self.held = None
        self.layers = build(self._compared()[1])

    def dump(self) -> bytes:
        sink = io.BytesIO()
        np.savez(sink, vectors=self.vectors, rows=self.rows, first=self.first, **{f"n{i}": n for i, (n, _) in enumerate(self.layers)},
                 **{f"l{i}": links.astype(np.int32) for i, (_, links) in enumerate(self.layers)})
        return sink.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Index:
        self, held = cls.__new__(cls), np.load(io.BytesIO(blob))
        self.held = None
        self.vectors, self.rows, self.first = held["vectors"], held["rows"], held["first"]
        self.layers = [(held[f"n{i}"], held[f"l{i}"].astype(np.int64)) for i in range(sum(k[0] == "l" for k in held.files))]
        return self

    def search(self, own: np.ndarray, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query number, row id, distance) of the ``k`` nearest rows found that do not have the query's id ``own``.

        What the graph finds is ranked by distances in double precision. A query
        for which it finds fewer than ``k`` rows is compared with all vectors.
        """
        place, x = self._compared()
        for i in range(0, len(q), BATCH):
            part = single(q[i: i + BATCH], *place)
            at = descend(x, self.layers[:-1], part) if len(self.layers) > 1 else np.full(len(part), self.layers[0][0][0])
            ids, _ = search_layer(x, self.layers[-1][1], part, at, ef)
            query, column = np.nonzero(ids >= 0)
            query, rows, dist = self._ranked(own[i: i + BATCH], q[i: i + BATCH], query, ids[query, column], k)
            few = np.flatnonzero(np.bincount(query, minlength=len(part)) < k)
            if len(few):
                stay = ~np.isin(query, few)
                found = [(query[stay], rows[stay], dist[stay])]
                found += [(np.full(len(r), one), r, d) for one in few.tolist() for r, d in [self._among_all(own[i + one], q[i + one], k)]]
                query, rows, dist = (np.concatenate(c) for c in zip(*found, strict=True))
            yield i + query, rows, dist

    def _compared(self) -> tuple[tuple, np.ndarray]:
        """How vectors are placed for comparison, and the shard's so placed: made once for all blocks of queries."""
        if self.held is None:
            place = placed(self.vectors)
            self.held = place, single(self.vectors, *place)
        return self.held

    def _among_all(self, own: int, q: np.ndarray, k: int, block: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
        """(row id, distance) of the ``k`` nearest rows of the shard, by comparison with every vector."""
        rows, dist = np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(self.vectors), block):
            nodes = np.arange(at, min(at + block, len(self.vectors)))
            _, more, far = self._ranked(np.array([own]), q[None, :], np.zeros(len(nodes), np.int64), nodes, k)
            rows, dist = np.r_[rows, more], np.r_[dist, far]
            best = np.lexsort((rows, dist))[:k]
            rows, dist = rows[best], dist[best]
        return rows, dist

    def _ranked(self, own: np.ndarray, q: np.ndarray, query: np.ndarray, node: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, row id, distance) of the ``k`` nearest rows among those of the given nodes."""
        gap = self.vectors[node].astype(np.float64) - q[query].astype(np.float64)
        most = np.maximum(np.abs(gap).max(axis=1), 1e-300)  # squares of very large or small components would not hold
        usual = (most > 1e-140) & (most < 1e140)
        scale = np.where(usual, 1.0, most)
        gap = gap / scale[:, None]
        dist = np.sqrt((gap * gap).sum(axis=1)) * scale
        many = np.minimum(self.first[node + 1] - self.first[node], k + 1)  # ids ascend: later copies cannot be among the nearest
        step = np.arange(many.sum()) - np.repeat(many.cumsum() - many, many)
        rows, query, dist = self.rows[np.repeat(self.first[node], many) + step], np.repeat(query, many), np.repeat(dist, many)
        other = rows != own[query]
        rows, query, dist = rows[other], query[other], dist[other]
        order = np.lexsort((rows, dist, query))
        rows, query, dist = rows[order], query[order], dist[order]
        top = np.arange(len(query)) - np.searchsorted(query, query) < k
        return query[top], rows[top], dist[top]


def usable(vector: str) -> Column:
    """Not null, not zero, all components finite numbers."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & good & F.exists(vector, lambda v: v != 0)


def _split(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, matrix, ids) for the vectors of each dimension."""
    lists = batch.column(1)
    size = np.asarray(lists.value_lengths(), np.int64)
    flat, offsets = lists.values.to_numpy(zero_copy_only=False), np.asarray(lists.offsets, np.int64)
    ids = np.asarray(batch.column(0), np.int64)
    for dim in np.unique(size).tolist():
        own = np.flatnonzero(size == dim)
        yield dim, own, flat[offsets[own][:, None] + np.arange(dim)], ids[own]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int | None = None, ef: int = EF_SEARCH) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` found for each of ``queries``, both (vec_id, embedding).

    Returns ``query_id``, ``rank`` from 1, ``vec_id``, ``score``: the Euclidean
    distance of the original vectors in double precision; ties go to the smaller
    vec_id. Every usable row is indexed. Queries go to every shard in blocks,
    so shards are as few as the cluster's cores and their size allow: at least
    ``LEAST_ROWS`` and at most ``SHARD_BYTES`` each, or ``shard_rows`` where given.

    Vectors that are null, empty, zero, or hold null or non-finite components
    take no part, nor do rows without vec_id. Vectors are compared within their
    dimension. Rows with the query's vec_id are its own and no candidates;
    equal query rows count once; repeated rows of other ids are candidates
    each. Fewer than ``k`` candidates are all returned. Empty tables give empty results.
    """
    rows = columns(vectors, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable("embedding"))
    asked = columns(queries, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable("embedding")).distinct()
    total, widest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    if shard_rows is None:
        cores = vectors.sparkSession.sparkContext.defaultParallelism
        shard_rows = min(max(LEAST_ROWS, -(-total // cores)), max(1, SHARD_BYTES // (8 * (widest + WIDE + LINKS))))
    shards = max(1, -(-total // shard_rows))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId()
        for batch in batches:
            for dim, own, matrix, ids in _split(batch):
                to = (own + n) % shards
                for shard in np.unique(to).tolist():
                    mine = to == shard
                    yield _row(shard, 0, dim, ids[mine], matrix[mine])
            n += batch.num_rows

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for shard, _, dim, ids, matrix in _rows(batch):
                held.setdefault((shard, dim), []).append((ids, matrix))
        for (shard, dim), parts in held.items():
            index = Index(*(np.concatenate(p) for p in zip(*parts, strict=True)))
            yield _row(shard, 0, dim, np.zeros(0, np.int64), np.frombuffer(index.dump(), np.uint8))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, matrix, ids in _split(batch):
                for i in range(0, len(ids), BATCH):
                    for shard in range(shards):
                        yield _row(shard, 1, dim, ids[i: i + BATCH], matrix[i: i + BATCH])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[int, Index] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                for _, kind, dim, ids, matrix in _rows(batch.slice(i, 1)):
                    if kind == 0:
                        index[dim] = Index.load(matrix.tobytes())
                    elif dim in index:
                        prints = [v.tobytes() for v in matrix]
                        for query, found, dist in index[dim].search(ids, matrix, k, ef):
                            yield pa.record_batch([pa.array(ids[query]), binary_column([prints[j] for j in query.tolist()]), pa.array(found), pa.array(dist)],
                                                  ["query_id", "vector", "vec_id", "score"])

    form = "shard int, kind int, dim int, ids binary, body binary"
    graphs = cut(rows.mapInArrow(deal, form).repartitionById(shards, F.col("shard")).mapInArrow(grow, form), "hnsw")
    both = graphs.union(asked.mapInArrow(ask, form))
    found = (both.repartitionById(shards, F.col("shard")).sortWithinPartitions("kind")
             .mapInArrow(answer, "query_id long, vector binary, vec_id long, score double"))
    order = Window.partitionBy("query_id", "vector").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _row(shard: int, kind: int, dim: int, ids: np.ndarray, body: np.ndarray) -> pa.RecordBatch:
    raw = body.tobytes() if body.dtype == np.uint8 else np.ascontiguousarray(body, np.float64 if body.dtype == np.float64 else np.float32).tobytes()
    wide = 8 if body.dtype == np.float64 else 4 if body.dtype != np.uint8 else 1
    return pa.record_batch([pa.array([x], pa.int32()) for x in (shard, kind, dim)] + [binary_column([ids.tobytes()]), binary_column([bytes([wide]) + raw])],
                           ["shard", "kind", "dim", "ids", "body"])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    for shard, kind, dim, ids, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        matrix = np.frombuffer(body, {1: np.uint8, 4: np.float32, 8: np.float64}[body[0]], offset=1)
        yield shard, kind, dim, np.frombuffer(ids, np.int64), matrix if body[0] == 1 else matrix.reshape(-1, dim)

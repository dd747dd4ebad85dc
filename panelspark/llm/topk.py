"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors go to the nearest of a few coarse centres (of a bounded sample), and a centre's vectors to shards of about SHARD_ROWS by
a hash. A centre's ball bounds the scores of all that it holds, as a node's ball does in a tree. Queries search in waves: first the
centre with the highest bound, then the next NEXT of those whose bound reaches the kth score by then, then all others whose
bound does. So the kth score is shared from wave to wave, and a shard is met only by queries that it may hold something for.
Within a shard, nodes are taken in the order of their upper bound q . centre + |q| * radius, until the next bound lies below the current
kth score. A task holds one shard's vectors and one block of at most about QUERY_ROWS queries.

Components are integers held as doubles. While all products stay under 2**52, doubles score exactly; beyond, candidates are
scored again with Python's integers. Scores beyond a long are given as the nearest long; ranks still go by the exact scores.

Defined cases: vectors that are null, or hold null or non-finite components (before or after scaling), and rows with a null
id, take no part; a vector without components takes part, and scores 0 with others of its kind; vectors are compared with
those of as many components; rows with the query's own id are no candidates for it; of rows that share a query's id, the
smallest vector asks; ties go to the smaller id; rows that repeat are hits as often as they occur, and go to the shards once,
with their number. Of equal vectors of a shard, the k + 1 smallest distinct ids are kept, each up to k times: as at most one of
them is the query's own, this is all that a top k can hold.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import words
from .storage import cut, small_batches

SHARD_ROWS = 16_384
QUERY_ROWS = 8_192
LEAF_ROWS = 64
#: Vectors, those with the smallest hashes, that coarse centres are made from, and centres at most.
SAMPLE_ROWS = 2_048
CENTRES = 256
#: Centres of the second wave.
NEXT = 4
#: Scores at which a long ends, and digits of the keys that sort scores beyond it.
_MOST = (1 << 63) - 1
_DIGITS = 700
_CELL = ["dim", "centre", "shard"]


def quantised(vectors: DataFrame, scale: int = 256, keep: Sequence[str] = ()) -> DataFrame:
    """vec_id, v (the components times scale, rounded down to integers, as doubles) and the columns to keep of the rows that take part."""
    scaled = F.transform("embedding", lambda x: F.lit(float(scale)) * x.cast("double"))
    rows = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"), *keep)
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)  # noqa: E731  # larger doubles are integers
    return rows.filter(sound).select("vec_id", F.transform("v", whole).alias("v"), *keep)


class BallTree:
    """Nodes as arrays: centre, radius, children (or -1) and range of rows; rows are in the order of `ids` and `x`.

    exact: doubles don't hold the products, so that candidates are scored by integers.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS, exact: bool = False):
        centres, radii, self.children, self.ranges = [], [], [], []
        order = np.arange(len(x))
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            rows = order[a:b]
            points = x[rows]
            centre = points.mean(axis=0)
            apart = np.sqrt(((points - centre) ** 2).sum(axis=1))
            me = len(radii)
            if parent >= 0:
                self.children[parent][side] = me
            centres.append(centre)
            radii.append(apart.max())
            self.children.append([-1, -1])
            self.ranges.append((a, b))
            if b - a > leaf and radii[-1] > 0:
                # Split along the line through two far points, at the median.
                far = points[apart.argmax()]
                axis = points[((points - far) ** 2).sum(axis=1).argmax()] - far
                half = (b - a) // 2
                order[a:b] = rows[np.argpartition(points @ axis, half)]
                todo += [(a, a + half, me, 0), (a + half, b, me, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.x, self.ids, self.exact = x[order], ids[order], exact
        self.norm = float(np.sqrt((x**2).sum(axis=1)).max(initial=0.0))

    def search(self, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """The best k (score, id) of each query among scores of at least its floor, ids other than its own."""
        if self.exact:
            return [self._search_exactly(*x, k) for x in zip(queries, own.tolist(), floors.tolist(), strict=True)]
        norms = np.sqrt((queries**2).sum(axis=1))
        bounds = queries @ self.centres.T + norms[:, None] * self.radii
        bounds += 1e-9 * np.abs(bounds) + 1e-6 * (1 + norms[:, None])  # more than rounding can take away
        out = []
        for q, me, kth, bound in zip(queries, own.tolist(), floors.tolist(), bounds, strict=True):
            best: list[tuple[int, int]] = []
            heap = [(-bound[0], 0)]
            while heap:
                least, node = heapq.heappop(heap)
                if -least < kth:
                    break
                left, right = self.children[node]
                if left >= 0:
                    for child in (left, right):
                        if bound[child] >= kth:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                a, b = self.ranges[node]
                scores = self.x[a:b] @ q
                good = np.flatnonzero(scores >= kth)
                if len(good):
                    ids = self.ids[a:b][good].tolist()
                    best += [(-int(s), i) for s, i in zip(scores[good].tolist(), ids, strict=True) if i != me]
                    best = heapq.nsmallest(k, best)
                    if len(best) == k:
                        kth = max(kth, -best[-1][0])
            out.append([(-s, i) for s, i in best])
        return out

    def _search_exactly(self, q: np.ndarray, me: int, floor: float, k: int) -> list[tuple[int, int]]:
        """The same for one query by integers; doubles only say what may be left out."""
        norm = float(np.sqrt((q**2).sum()))
        slack = (len(q) + 8) * 2.0**-50 * norm * self.norm
        sure = np.isfinite(slack)
        with np.errstate(over="ignore", invalid="ignore"):
            bounds = self.centres @ q + norm * self.radii
        bounds = bounds + slack if sure else np.full(len(self.radii), np.inf)
        best: list[tuple[int, int]] = []
        kth, heap, asked = floor, [(-float(bounds[0]), 0)], [int(c) for c in q.tolist()]
        while heap:
            least, node = heapq.heappop(heap)
            if sure and -least < kth:
                break
            left, right = self.children[node]
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(heap, (-float(bounds[child]), child))
                continue
            a, b = self.ranges[node]
            good = np.flatnonzero(self.x[a:b] @ q + slack >= float(kth)) if sure else np.arange(b - a)
            for row, i in zip(self.x[a:b][good].tolist(), self.ids[a:b][good].tolist(), strict=True):
                if i != me:
                    best.append((-sum(int(c) * d for c, d in zip(row, asked, strict=True)), i))
            best = heapq.nsmallest(k, best)
            if len(best) == k:
                kth = max(kth, -best[-1][0])
        return [(-s, i) for s, i in best]


def _exceeds(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether inner products may be too large for doubles to hold them exactly."""
    return not float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1]) < 2**52


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.flatten().to_numpy(zero_copy_only=False) if rows else np.zeros(0)
    return flat.astype(float).reshape(rows, -1) if len(flat) else np.zeros((rows, 0))


def _centres(vectors: DataFrame, most: int) -> dict[int, np.ndarray]:
    """For each number of components in a bounded sample, at most `most` centres by k-means."""
    out: dict[int, np.ndarray] = {}
    if most < 2:
        return out
    sampled = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(SAMPLE_ROWS).select("dim", "v").toArrow()
    dims = sampled["dim"].to_numpy()
    for dim in np.unique(dims[dims > 0]).tolist():
        rows = np.flatnonzero(dims == dim)
        x = np.unique(_matrix(sampled["v"].take(pa.array(rows)), len(rows)), axis=0)
        centres = x[np.linspace(0, len(x) - 1, min(most, len(x))).astype(int)]
        for _ in range(5):
            near = _nearest(x, centres)[0]
            centres = np.stack([x[near == c].mean(axis=0) for c in np.unique(near)])
        out[dim] = centres
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and how far it is; infinitely far where that is beyond doubles."""
    with np.errstate(over="ignore", invalid="ignore"):
        near = np.argmin(np.nan_to_num((centres**2).sum(axis=1) - 2 * x @ centres.T, nan=np.inf), axis=1)
        apart = np.sqrt(((x - centres[near]) ** 2).sum(axis=1))
    return near, np.nan_to_num(apart, nan=np.inf, posinf=np.inf)


def _assigned(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """vectors with centre (-1 where their number of components has none) and apart, their distance to it."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            centre, apart = np.full(len(dims), -1, np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                if dim in shared.value:
                    rows = np.flatnonzero(dims == dim)
                    centre[rows], apart[rows] = _nearest(_matrix(batch["v"].take(pa.array(rows)), len(rows)), shared.value[dim])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(centre), pa.array(apart)], names=[*batch.schema.names, "centre", "apart"])

    return vectors.mapInArrow(words.frugal(run), "vec_id long, v array<double>, times long, dim int, centre int, apart double")


def _targets(asked: DataFrame, balls, first: int, last: int | None) -> DataFrame:
    """asked (query_id, v, dim, floor) with centre: of the centres in the order of their bounds, those from `first` to before
    `last` whose bound reaches the floor. Where a number of components has no centres, all is in the first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, floors = batch["dim"].to_numpy(), np.array([-np.inf if f is None else f for f in batch["floor"].to_pylist()])
            rows_out, centre_out = [], []
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                if dim not in balls.value:
                    if first == 0:
                        rows_out.append(rows)
                        centre_out.append(np.full(len(rows), -1))
                    continue
                centres, radii, numbers = balls.value[dim]
                for at in range(0, len(rows), 1024):
                    own = rows[at : at + 1024]
                    q = _matrix(batch["v"].take(pa.array(own)), len(own))
                    with np.errstate(over="ignore", invalid="ignore"):
                        norms = np.sqrt((q**2).sum(axis=1))[:, None]
                        bounds = q @ centres.T + norms * radii
                        bounds += 1e-9 * (np.abs(q) @ np.abs(centres.T) + norms * radii) + 1e-6 * (1 + norms)
                    bounds = np.nan_to_num(bounds, nan=np.inf)
                    order = np.argsort(-bounds, axis=1, kind="stable")[:, first:last]
                    k, c = np.nonzero(np.take_along_axis(bounds, order, 1) >= floors[own][:, None])
                    rows_out.append(own[k])
                    centre_out.append(numbers[order[k, c]])
            rows = np.concatenate(rows_out) if rows_out else np.zeros(0, np.int64)
            centre = np.concatenate(centre_out) if centre_out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows, pa.int64())).columns, pa.array(centre.astype(np.int32))], names=[*batch.schema.names, "centre"])

    return asked.mapInArrow(words.frugal(run), "query_id long, v array<double>, dim int, floor long, centre int")


def _key(score: int) -> str | None:
    """What sorts scores that a long can't hold."""
    return None if -_MOST < score < _MOST else str(score + 10**_DIGITS).rjust(_DIGITS + 1, "0")


def _search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Searches, within each cell (dim, centre, shard, block), the queries (query_id, v, floor) among the vectors (vec_id, v, times)."""

    def run(key: tuple, own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, str | None]] = []
        if own.num_rows and asked.num_rows:
            x, q = _matrix(own["v"], own.num_rows), _matrix(asked["v"], asked.num_rows)
            ids = own["vec_id"].to_numpy()
            # Of equal vectors, those with the k + 1 smallest ids, each up to k times; a pair of vector and id is there once.
            same = np.unique(x, axis=0, return_inverse=True)[1].reshape(-1) if x.shape[1] else np.zeros(len(x), np.int64)
            order = np.lexsort((ids, same))
            start = np.flatnonzero(np.diff(same[order], prepend=-1))
            rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
            kept = order[rank <= k]
            kept = np.repeat(kept, np.minimum(own["times"].to_numpy()[kept], k))
            tree = BallTree(x[kept], ids[kept], exact=_exceeds(x, q))
            found = tree.search(q, asked["query_id"].to_numpy(), np.array([-np.inf if f is None else f for f in asked["floor"].to_pylist()], dtype=object if tree.exact else float), k)
            for query, best in zip(asked["query_id"].to_pylist(), found, strict=True):
                out += [(query, i, min(max(s, -_MOST), _MOST), _key(s)) for s, i in best]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["query_id", "vec_id", "score", "beyond"])

    cell = [*_CELL, "block"]
    return vectors.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInArrow(run, "query_id long, vec_id long, score long, beyond string")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best other vectors of each vector for which is_query holds.

    vectors has vec_id and v (integers), as quantised gives it; is_query is a condition on vec_id.
    """
    small_batches(vectors.sparkSession)
    vectors = vectors.select("vec_id", F.col("v").cast("array<double>").alias("v")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times"))
    vectors = cut(vectors.withColumn("dim", F.size("v")), "vectors")
    centres = _centres(vectors, min(CENTRES, -(-vectors.count() // shard_rows)))
    placed = cut(_assigned(vectors, centres), "placed")
    balls = placed.groupBy("dim", "centre").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius"))
    splits = balls.select("dim", "centre", F.ceil(F.col("n") / shard_rows).cast("int").alias("splits"))
    known: dict[int, list] = {}
    for r in balls.filter("centre >= 0").collect():  # a row for each centre
        known.setdefault(r["dim"], []).append((r["centre"], r["radius"]))
    held = {d: (centres[d][[c for c, _ in x]], np.array([r for _, r in x]), np.array([c for c, _ in x])) for d, x in known.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(held)
    sharded = placed.join(splits, ["dim", "centre"]).select("vec_id", "v", "times", "dim", "centre", F.pmod(F.xxhash64("vec_id", "v"), F.col("splits")).alias("shard"))
    asked = cut(vectors.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")), "queries").withColumn("dim", F.size("v"))

    waves = [(0, 1), (1, 1 + NEXT), (1 + NEXT, None)]
    most = max((len(x) for x in known.values()), default=1)
    found, floors = None, None
    for first, last in (w for w in waves if w[0] < most):
        if floors is None:
            now = asked.withColumn("floor", F.lit(None).cast("long"))
        else:
            now = asked.join(floors, "query_id", "left")
        now = _targets(now.select("query_id", "v", "dim", "floor"), shared, first, last).join(splits, ["dim", "centre"])
        now = cut(now.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("splits") - 1).cast("array<long>"))).drop("splits"), "targets")
        met = now.groupBy(*_CELL).agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("blocks"))
        queries = now.join(met, _CELL).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).drop("blocks")
        cells = sharded.join(met, _CELL).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1).cast("array<long>"))).drop("blocks")
        own = _search(cells, queries, k)
        found = cut(_best(own if found is None else found.union(own), k).drop("rank"), "found")
        # A score at a long's lower end may stand for one below it, and so is no floor.
        floors = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).filter((F.col("n") == k) & (F.col("floor") > -_MOST)).select("query_id", "floor")
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

"""Hard negatives by a Voronoi-partitioned kNN join on inner products.

A component is added to every vector so that all are as long as the longest one, and to anchors a zero: then the nearest vectors
are those with the largest inner products. Vectors and anchors go to the nearest of a few pivots (of a bounded sample). Cells of
neighbouring pivots with up to GROUP_ANCHORS anchors form an anchor group; cells with more are split into blocks.

Positives: for each label and cell with anchors, the distances of the k + 1 vectors nearest to each pivot bound how far the
kth of any anchor can be, and so a reach around the pivot; a vector is sent to the groups that have a pivot within whose reach
it lies. Negatives: the positives' scores say how near and how far a negative can be, and so give each pivot a ring. In both,
a task joins one block of anchors with one shard of one cell, exactly, and the best of all tasks are merged.

Components are integers held as doubles. While all products stay under 2**52, doubles score exactly; beyond, scores are made of
Python's integers. Scores beyond a long count as the nearest long.

Defined cases: rows with a null id, label or vector, or with null or non-finite components (before or after scaling), take no
part; vectors are compared with those of as many components, also with none (their score is 0); rows that repeat count as often as
they occur; rows with the anchor's own id are no positives of it; of rows that share an anchor's id, the smallest vector, then
label, asks; ties go to the smaller id; a negative score of a positive leaves no negative; an anchor without positives, or with
no negatives within its bounds, has no row; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import words
from .storage import cut, small_batches
from .topk import _exceeds, _matrix

#: Vectors, those with the smallest hashes, that pivots are made from, pivots at most, and vectors of a cell on average.
SAMPLE_ROWS = 2_048
PIVOTS = 256
CELL_ROWS = 4_096
#: Vectors of a shard and anchors of a block at most, on average.
SHARD_ROWS = 16_384
GROUP_ANCHORS = 2_048
#: Anchors whose scores are held at once.
SCORED = 256
_MOST = (1 << 63) - 1
_CELL = ["dim", "group", "block", "cell", "sub"]


@dataclass
class Space:
    """What tasks know of the vectors with one number of components; its size is bounded by PIVOTS.

    pivots: augmented; longest: the largest squared length; group, blocks: of each cell's anchors; splits: shards of each
    cell; far: how far a cell's vectors are from its pivot at most.
    """

    pivots: np.ndarray
    longest: float
    group: np.ndarray | None = None
    blocks: np.ndarray | None = None
    splits: np.ndarray | None = None
    far: np.ndarray | None = None

    @property
    def slack(self) -> float:
        """More than rounding can take from a distance."""
        return 1e-5 * (1 + float(np.sqrt(self.longest)))

    def distances(self, x: np.ndarray, augmented: bool) -> np.ndarray:
        """Of each row to each pivot; what doubles can't hold is not a number."""
        with np.errstate(over="ignore", invalid="ignore"):
            squares = (x**2).sum(axis=1)
            last = np.sqrt(np.maximum(self.longest - squares, 0)) if augmented else np.zeros(len(x))
            within = x @ self.pivots[:, :-1].T + np.outer(last, self.pivots[:, -1])
            return np.sqrt(np.maximum((squares + last**2)[:, None] + (self.pivots**2).sum(axis=1) - 2 * within, 0))

    def between(self) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            squares = (self.pivots**2).sum(axis=1)
            return np.sqrt(np.maximum(squares[:, None] + squares - 2 * self.pivots @ self.pivots.T, 0))


def _spaces(rows: DataFrame, cell_rows: int) -> dict[int, Space]:
    """Pivots by k-means over a bounded sample, for each number of components."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    found = {r["dim"]: (r["longest"], r["n"]) for r in rows.groupBy("dim").agg(F.max(square).alias("longest"), F.count(F.lit(1)).alias("n")).collect()}
    sampled = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(SAMPLE_ROWS).select("dim", "v").toArrow()
    dims, out = sampled["dim"].to_numpy(), {}
    for dim, (longest, n) in found.items():
        own = np.flatnonzero(dims == dim)
        with np.errstate(over="ignore", invalid="ignore"):
            x = _matrix(sampled["v"].take(pa.array(own)), len(own)) if len(own) else np.zeros((1, dim))
            x = np.unique(np.column_stack([x, np.sqrt(np.maximum(longest - (x**2).sum(axis=1), 0))]), axis=0)
            pivots = x[np.linspace(0, len(x) - 1, min(PIVOTS, -(-n // cell_rows), len(x))).astype(int)]
            for _ in range(5):
                near = np.argmin(np.nan_to_num((pivots**2).sum(axis=1) - 2 * x @ pivots.T, nan=np.inf), axis=1)
                pivots = np.stack([x[near == c].mean(axis=0) for c in np.unique(near)])
        out[dim] = Space(pivots, longest)
    return out


def _by_dim(batch: pa.RecordBatch, slice_rows: int = 4_096) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of components, rows and vectors of parts of a batch."""
    dims = batch["dim"].to_numpy()
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        for at in range(0, len(rows), slice_rows):
            own = rows[at : at + slice_rows]
            yield dim, own, _matrix(batch["v"].take(pa.array(own)), len(own))


def _assigned(rows: DataFrame, spaces, augmented: bool) -> DataFrame:
    """rows with cell, the nearest pivot, and apart, its distance (infinite where doubles can't hold it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, apart = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for dim, own, x in _by_dim(batch):
                far = np.nan_to_num(spaces.value[dim].distances(x, augmented), nan=np.inf, posinf=np.inf)
                cell[own] = far.argmin(axis=1)
                apart[own] = far.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(apart)], names=[*batch.schema.names, "cell", "apart"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", cell int, apart double"
    return rows.mapInArrow(words.frugal(run), schema)


def _grouped(space: Space, anchors: np.ndarray, most: int) -> None:
    """Deals cells with anchors to groups: from pivot to nearest pivot, until a group would have more than `most` anchors."""
    n, between = len(space.pivots), np.nan_to_num(space.between(), nan=np.inf)
    space.group, space.blocks = np.full(n, -1, np.int32), np.ones(n, np.int32)
    left, now, group, held = set(np.flatnonzero(anchors).tolist()), None, -1, most + 1
    while left:
        now = min(left, key=lambda c: (between[now, c] if now is not None else 0, c))
        left.remove(now)
        if held + anchors[now] > most:
            group, held = group + 1, 0
        held += anchors[now]
        space.group[now] = group
        space.blocks[now] = -(-int(anchors[now]) // most)  # above 1 only for a cell that is a group by itself


def _nearest(placed: DataFrame, k: int) -> DataFrame:
    """dim, label, cell, vec_id and apart of the k ids of each label that are nearest to each pivot among its cell's."""
    ids = placed.groupBy("dim", "label", "cell", "vec_id").agg(F.min("apart").alias("apart"))
    return ids.withColumn("place", F.row_number().over(W.partitionBy("dim", "label", "cell").orderBy("apart", "vec_id"))).filter(F.col("place") <= k).drop("place")


def _reaches(nearest: DataFrame, anchors: DataFrame, spaces, k: int) -> DataFrame:
    """dim, label, cell and reach: how far from the cell's pivot a positive of its anchors of the label can be."""

    def run(key: tuple, near: pa.Table, own: pa.Table) -> pa.Table:
        dim, label = key[0].as_py(), key[1].as_py()
        cells, radii = own["cell"].to_numpy(), own["radius"].to_numpy()
        space = spaces.value[dim]
        between, reach = space.between(), np.full(len(cells), np.inf)
        ids, at, apart = near["vec_id"].to_numpy(), near["cell"].to_numpy(), near["apart"].to_numpy()
        for n, (cell, radius) in enumerate(zip(cells.tolist(), radii.tolist(), strict=True)):
            bound = radius + between[cell, at] + apart
            order = np.argsort(bound, kind="stable")
            first = np.sort(np.unique(ids[order], return_index=True)[1])  # of each id its least bound
            if len(first) > k:  # one of k + 1 ids may be the anchor's own
                reach[n] = bound[order][first[k]] + radius + 2 * space.slack
        reach = np.nan_to_num(reach, nan=np.inf, posinf=np.inf)
        return pa.table([pa.array([dim] * len(cells), pa.int32()), pa.array([label] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(reach)], names=["dim", "label", "cell", "reach"])

    radii = anchors.groupBy("dim", "label", "cell").agg(F.max("apart").alias("radius"))
    both = nearest.groupBy("dim", "label").cogroup(radii.groupBy("dim", "label"))
    return both.applyInArrow(run, "dim int, label string, cell int, reach double")


def _sent(rows: DataFrame, spaces, wanted: Callable) -> DataFrame:
    """vec_id, label, v, times, and the cells (_CELL) that each row is sent to.

    wanted gets a batch, the rows taken of it, their distances to all pivots and the space; it returns pairs of place in rows and
    cell of anchors that a row may serve.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch["cell"].to_numpy()
            ids = batch["vec_id"].to_numpy()
            for dim, own, x in _by_dim(batch):
                space = spaces.value[dim]
                place, cell = wanted(batch, own, space.distances(x, True), space, dim)
                pairs = np.unique(np.column_stack([place, space.group[cell], space.blocks[cell]]), axis=0) if len(place) else np.zeros((0, 3), int)
                pairs = np.repeat(pairs, pairs[:, 2], axis=0)
                ends = np.flatnonzero(np.diff(pairs[:, :2], axis=0, append=-1).any(axis=1)) if len(pairs) else np.zeros(0, int)
                starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
                block = np.arange(len(pairs)) - np.repeat(starts, ends - starts + 1)
                rows = own[pairs[:, 0]]
                sub = (words.mix(ids[rows].astype(np.int64).view(np.uint64)) % space.splits[cells[rows]].astype(np.uint64)).astype(np.int32)
                taken = batch.select(["vec_id", "label", "v", "times"]).take(pa.array(rows))
                where = [np.full(len(rows), dim), pairs[:, 1], block, cells[rows], sub]
                yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(w.astype(np.int32)) for w in where)], names=["vec_id", "label", "v", "times", *_CELL])

    return rows.mapInArrow(words.frugal(run), "vec_id long, label string, v array<double>, times long, " + ", ".join(f"{c} int" for c in _CELL))


def _asked(anchors: DataFrame, spaces: dict[int, Space], least: dict[int, np.ndarray], most: dict[int, np.ndarray]) -> DataFrame:
    """anchors, each for all cells (_CELL) that may hold something at a distance from least to most of a pivot of its group."""
    targets = []
    for dim, space in spaces.items():
        between = space.between()
        for group in range(int(space.group.max(initial=-1)) + 1):
            own = np.flatnonzero(space.group == group)
            near, far = between[own] - space.far - space.slack, between[own] + space.far + space.slack
            met = (~(near > most[dim][own, None]) & ~(far < least[dim][own, None])).any(axis=0) & (space.splits > 0)
            targets += [(dim, group, cell, sub) for cell in np.flatnonzero(met).tolist() for sub in range(space.splits[cell])]
    spark = anchors.sparkSession
    dealt = [(d, c, int(s.group[c]), int(s.blocks[c])) for d, s in spaces.items() for c in np.flatnonzero(s.group >= 0).tolist()]
    groups = spark.createDataFrame(dealt, "dim int, own int, group int, blocks int")
    anchors = anchors.withColumnRenamed("cell", "own").join(groups, ["dim", "own"])
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.col("blocks")).cast("int")).drop("own", "blocks")
    return anchors.join(spark.createDataFrame(targets, "dim int, group int, cell int, sub int"), ["dim", "group"])


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, kept within a long."""
    if not _exceeds(x, q):
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, -_MOST, _MOST).astype(np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, times: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then id, each as often as it occurs."""
    some = np.arange(len(scores))
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    some = some[np.lexsort((ids[some], -scores[some]))]
    return np.repeat(some[:k], np.minimum(times[some[:k]], k))[:k]


def _joined(sent: DataFrame, asked: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """anchor_id, bound, vec_id and score: the k best of each anchor and cell. Where anchors have bounds (scores of positives), of
    other labels and, for each bound, from low to high hundredths of it; else of the same label and other ids, with a null bound."""

    def run(key: tuple, own: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows and anchors.num_rows:
            x, q = _matrix(own["v"], own.num_rows), _matrix(anchors["v"], anchors.num_rows)
            ids, times, own_ids = own["vec_id"].to_numpy(), own["times"].to_numpy(), anchors["anchor_id"].to_pylist()
            labels = pa.concat_arrays([own["label"].combine_chunks(), anchors["label"].combine_chunks()]).dictionary_encode().indices.to_numpy()
            theirs, mine = labels[: len(x)], labels[len(x) :]
            bounds = anchors["bounds"].to_pylist()
            for at in range(0, len(q), SCORED):
                for n, scores in enumerate(_scores(q[at : at + SCORED], x), at):
                    if bounds[n] is None:
                        fit = np.flatnonzero((theirs == mine[n]) & (ids != own_ids[n]))
                        best = fit[_first(scores[fit], ids[fit], times[fit], k)]
                        out += [(own_ids[n], None, i, s) for i, s in zip(ids[best].tolist(), scores[best].tolist(), strict=True)]
                        continue
                    for bound in bounds[n]:
                        least, most = -(-low * bound // 100), high * bound // 100
                        fit = np.flatnonzero((theirs != mine[n]) & (scores >= max(least, -_MOST)) & (scores <= min(most, _MOST)))
                        best = fit[_first(scores[fit], ids[fit], times[fit], k)]
                        out += [(own_ids[n], bound, i, s) for i, s in zip(ids[best].tolist(), scores[best].tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "bound", "vec_id", "score"])

    both = sent.groupBy(*_CELL).cogroup(asked.groupBy(*_CELL))
    found = both.applyInArrow(run, "anchor_id long, bound long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("anchor_id", "bound").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, cell_rows: int = CELL_ROWS, shard_rows: int = SHARD_ROWS, group_anchors: int = GROUP_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    vectors has vec_id, label and v (integers as doubles); is_anchor is a condition on vec_id. An anchor's positives are its best
    rows of the same label, a positive's negatives the best rows of other labels that score low to high hundredths of it.
    """
    small_batches(vectors.sparkSession)
    context = vectors.sparkSession.sparkContext
    rows = vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("v").cast("array<double>").alias("v"))
    rows = cut(rows.groupBy("vec_id", "label", "v").agg(F.count(F.lit(1)).alias("times")).withColumn("dim", F.size("v")), "vectors")
    spaces = _spaces(rows, cell_rows)
    shared = context.broadcast(spaces)
    placed = cut(_assigned(rows, shared, True), "placed")
    least = F.min(F.struct("v", "label")).alias("least")
    anchors = rows.filter(is_anchor).groupBy(F.col("vec_id").alias("anchor_id")).agg(least).select("anchor_id", "least.label", "least.v")
    anchors = cut(_assigned(anchors.withColumn("dim", F.size("v")), shared, False), "anchors")

    held = {(r["dim"], r["cell"]): r for r in placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("far")).collect()}  # a row for each pivot
    asking = {(r["dim"], r["cell"]): r["n"] for r in anchors.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    for dim, space in spaces.items():
        cells = range(len(space.pivots))
        space.splits = np.array([-(-held[dim, c]["n"] // shard_rows) if (dim, c) in held else 0 for c in cells], np.int32)
        space.far = np.array([held[dim, c]["far"] if (dim, c) in held else 0.0 for c in cells])
        _grouped(space, np.array([asking.get((dim, c), 0) for c in cells]), group_anchors)
    shared = context.broadcast(spaces)

    reaches = cut(_reaches(_nearest(placed, positives + 1), anchors, shared, positives), "reaches")
    lists = reaches.groupBy("dim", "label").agg(F.collect_list(F.struct("cell", "reach")).alias("reaches"))
    none = {dim: np.full(len(s.pivots), -np.inf) for dim, s in spaces.items()}
    widest = {dim: x.copy() for dim, x in none.items()}
    for r in reaches.groupBy("dim", "cell").agg(F.max("reach").alias("reach")).collect():  # a row for each pivot
        widest[r["dim"]][r["cell"]] = r["reach"]

    def same_label(batch: pa.RecordBatch, own: np.ndarray, far: np.ndarray, space: Space, dim: int) -> tuple[np.ndarray, np.ndarray]:
        entries = batch["reaches"].take(pa.array(own))
        place = np.repeat(np.arange(len(own)), entries.value_lengths().to_numpy(zero_copy_only=False))
        flat = entries.flatten()
        cell, reach = flat.field("cell").to_numpy(), flat.field("reach").to_numpy()
        met = ~(far[place, cell] > reach)
        return place[met], cell[met]

    sent = _sent(placed.join(lists, ["dim", "label"]).select("vec_id", "label", "v", "times", "dim", "cell", "reaches"), shared, same_label)
    asked = _asked(anchors.withColumn("bounds", F.lit(None).cast("array<bigint>")), spaces, none, widest)
    best = cut(_joined(sent, asked, positives, low, high).select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # Negatives score from the least low bound to the highest positive's score, which is a ring around each anchor.
    windows = best.filter("positive_score >= 0").groupBy("anchor_id").agg(F.array_sort(F.collect_set("positive_score")).alias("bounds"))
    anchors = cut(anchors.join(windows, "anchor_id"), "windows")
    longest = F.create_map(*(x for d, s in spaces.items() for x in (F.lit(d), F.lit(s.longest)))) if spaces else F.create_map()
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) + (longest[F.col("dim")] if spaces else F.lit(0.0))
    at_score = lambda score: F.sqrt(F.greatest(square - 2 * score, F.lit(0.0)))
    farthest = at_score(F.col("bounds")[0].cast("double") * (low / 100)) + F.col("apart")
    closest = at_score(F.element_at("bounds", -1).cast("double") * (high / 100)) - F.col("apart")
    ring = {d: (x.copy(), x.copy()) for d, x in none.items()}
    for r in anchors.groupBy("dim", "cell").agg(F.min(closest).alias("near"), F.max(farthest).alias("far")).collect():  # a row for each pivot
        near, far = (float("nan") if x is None else x for x in (r["near"], r["far"]))
        slack = spaces[r["dim"]].slack
        ring[r["dim"]][0][r["cell"]] = np.nan_to_num(near, nan=-np.inf, posinf=-np.inf) - 2 * slack
        ring[r["dim"]][1][r["cell"]] = np.nan_to_num(far, nan=np.inf, posinf=np.inf) + 2 * slack
    rings = context.broadcast(ring)

    def in_ring(batch: pa.RecordBatch, own: np.ndarray, far: np.ndarray, space: Space, dim: int) -> tuple[np.ndarray, np.ndarray]:
        near, most = rings.value[dim]
        return np.nonzero(~(far > most) & ~(far < near) & (space.group >= 0) & (most > -np.inf))

    sent = _sent(placed.select("vec_id", "label", "v", "times", "dim", "cell"), shared, in_ring)
    asked = _asked(anchors, spaces, {d: r[0] for d, r in ring.items()}, {d: r[1] for d, r in ring.items()})
    found = _joined(sent, asked, negatives, low, high).select("anchor_id", F.col("bound").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return best.join(found, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON len(a.v) = len(c.v) AND (a.vec_id <> c.vec_id OR a.label <> c.label) WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
  WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

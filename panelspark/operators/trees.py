"""Trees grown level by level from histograms: honest causal forests, second-order boosting, and attributions per row.

A pass over the rows adds up, in each task, sums by tree, node, feature and bin; Spark adds up the tasks' sums, and a node's split
is chosen from its bins alone. No row is moved and none is kept: a task finds a row's nodes from the splits so far, and all draws
are hashes of the rows' keys, so that a lost task gives the same sums again.

Features are cut at exact percentiles into at most BINS bins; a row goes left where its value is at most the cut. Rows with a null
feature, outcome or treatment are left out of a fit; what can't be fitted gives None.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint
from .normalize import percentiles

BINS = 32
#: Sums of a task at once, of 8 bytes each; more trees go in more passes.
TASK_CELLS = 1 << 23
#: Sums that may be read by the driver; beyond, splits are chosen by tasks.
DRIVER_CELLS = 1 << 19
#: Rows whose nodes in all trees are held at once.
BATCH_ROWS = 2_048
#: Rows of a partition, at least, of the passes over a small table.
TASK_ROWS = 50_000

_U = np.uint64


def _draws(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Numbers from 0 to 1 from 64-bit hashes and a salt."""
    x = hashes.view(_U) ^ _U((salt * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return ((x ^ (x >> _U(33))) >> _U(11)).astype(float) / float(1 << 53)


@dataclass
class Trees:
    """Trees of a forest: node n has the children 2n + 1 (at most the cut) and 2n + 2; feature is -1 where a node isn't split."""

    features: list[str]
    cuts: list[np.ndarray]
    feature: np.ndarray
    bin: np.ndarray
    sums: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def empty(features: Sequence[str], cuts: list[np.ndarray], trees: int, depth: int) -> Trees:
        shape = (trees, 2 ** (depth + 1) - 1)
        return Trees(list(features), cuts, np.full(shape, -1, np.int16), np.zeros(shape, np.int16))

    @property
    def depth(self) -> int:
        return int(math.log2(self.feature.shape[1] + 1)) - 1

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(self.cuts)]).astype(np.int16)

    def nodes(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """Of each row (of bins) in each tree, the node after so many levels, or the leaf that it has come to before."""
        trees = np.arange(len(self.feature))
        at = np.zeros((len(bins), len(trees)), np.int32)
        rows = np.arange(len(bins))[:, None]
        for _ in range(self.depth if levels is None else levels):
            feature = self.feature[trees, at]
            right = bins[rows, np.maximum(feature, 0)] > self.bin[trees, at]
            at = np.where(feature < 0, at, 2 * at + 1 + right)
        return at


def cut_points(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Distinct exact percentiles of each feature, without the largest value; one pass for all."""
    row = percentiles(df, features, [k / bins for k in range(1, bins)]).first()
    top = df.agg(*(F.max(c).cast("double").alias(f"m{k}") for k, c in enumerate(features))).first()
    found = [np.unique([q for q in (row[f"_q_{c}"] or []) if q is not None]) for c in features] if row else [np.zeros(0)] * len(features)
    return [c[c < (top[k] if top[k] is not None else -np.inf)] for k, c in enumerate(found)]


def _matrix(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch[c].to_numpy(zero_copy_only=False) for c in columns]) if columns else np.zeros((batch.num_rows, 0))


Measure = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, Callable]]


def _adder(trees: Trees, level: int, measure: Measure, names: Sequence[str]) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], int]:
    """A function from batches to (tree, node, feature, bin and the named sums) of all nodes of a level, and how many rows that is at most.

    measure gets a batch and returns its bins, its nodes (rows by trees; -1 where a row isn't in a tree) and a function from a slice of
    trees to the values that are summed (one array, rows by these trees, for each name).
    """
    first, wide = 2**level - 1, 2**level
    count, widest = len(trees.features), max((len(c) for c in trees.cuts), default=0) + 1
    total = len(trees.feature)
    step = max(1, TASK_CELLS // (wide * count * widest * len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
            bins, nodes, values_of = measure(batch)
            for t in range(0, total, step):
                own = nodes[:, t : t + step]
                live = own >= first
                shape = (min(step, total - t), wide, count, widest)
                tree = np.broadcast_to(np.arange(own.shape[1]), own.shape)[live]
                row = np.broadcast_to(np.arange(len(own))[:, None], own.shape)[live]
                base = (tree * wide + own[live] - first) * count
                sums = held.setdefault(t, np.zeros((len(names), math.prod(shape))))
                values = [v[live] for v in values_of(slice(t, t + step))]
                for f in range(count):
                    at = (base + f) * widest + bins[row, f]
                    for k, v in enumerate(values):
                        sums[k] += np.bincount(at, v, math.prod(shape))
        for t, sums in held.items():
            at = np.flatnonzero(sums.any(axis=0))
            tree, node, feature, bin_ = np.unravel_index(at, (len(sums[0]) // (wide * count * widest), wide, count, widest))
            where = [pa.array(x.astype(np.int32)) for x in (tree + t, node + first, feature, bin_)]
            yield pa.RecordBatch.from_arrays([*where, *(pa.array(s[at]) for s in sums)], names=["tree", "node", "feature", "bin", *names])

    return run, total * wide * count * widest


def _level(rows: DataFrame, trees: Trees, level: int, measure: Measure, names: Sequence[str]) -> tuple[DataFrame, int]:
    """What _adder's function gives, added up over all tasks, and how many rows that is at most."""
    run, most = _adder(trees, level, measure, names)
    schema = "tree int, node int, feature int, bin int, " + ", ".join(f"{n} double" for n in names)
    return rows.mapInArrow(run, schema).groupBy("tree", "node", "feature", "bin").agg(*(F.sum(n).alias(n) for n in names)), most


def _choices(table: pa.Table, names: Sequence[str], width: int, choose: Callable[[np.ndarray], tuple | None]) -> list[tuple]:
    """(tree, node, *what choose returns) of all nodes of a table for which it returns something; it gets sums by name, feature and bin."""
    count, widest = width >> 16, width & 0xFFFF
    keys = np.column_stack([table["tree"].to_numpy(), table["node"].to_numpy()])
    distinct, inverse = np.unique(keys, axis=0, return_inverse=True)
    order = np.argsort(inverse.reshape(-1), kind="stable")
    edges = np.append(np.flatnonzero(np.diff(inverse.reshape(-1)[order], prepend=-1)), len(order))
    feature, bin_ = table["feature"].to_numpy(), table["bin"].to_numpy()
    values = [table[n].to_numpy() for n in names]
    out = []
    for k, (tree, node) in enumerate(distinct.tolist()):
        own = order[edges[k] : edges[k + 1]]
        grid = np.zeros((len(names), count, widest))
        for n, v in enumerate(values):
            grid[n, feature[own], bin_[own]] = v[own]
        found = choose(grid)
        if found is not None:
            out.append((tree, node, *found))
    return out


def _chosen(sums: DataFrame, most: int, names: Sequence[str], width: int, choose: Callable[[np.ndarray], tuple | None]) -> list[tuple]:
    """_choices of all nodes, by the driver if they are few, else by tasks."""
    if most <= DRIVER_CELLS:
        return _choices(sums.toArrow(), names, width, choose)

    def run(group: pa.Table) -> pa.Table:
        found = _choices(group, names, width, choose)
        return pa.table([pa.array([x[k] for x in found], pa.float64()) for k in range(len(found[0]))] if found else [pa.array([], pa.float64())] * fields, names=[f"_{k}" for k in range(fields)])

    fields = 2 + choose.fields
    return [tuple(r) for r in sums.groupBy("tree", "node").applyInArrow(run, ", ".join(f"_{k} double" for k in range(fields))).collect()]  # a row a node


def _compact(rows: DataFrame) -> DataFrame:
    """Cached, in fewer partitions where rows are few."""
    rows = rows.cache()
    return rows.coalesce(max(1, -(-rows.count() // TASK_ROWS)))


# --- Honest causal forest


@dataclass
class CausalForest:
    """Trees in little bags of `bag` trees that share a half-sample; sums has the leaves' mean moments of the half for effects."""

    trees: Trees
    bag: int
    rows: int

    def moments(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Effect of each row, its error, and what each bag adds to it (rows by bags)."""
        leaves = self.trees.nodes(self.trees.bins(x))
        own = np.arange(leaves.shape[1])
        cross, square = self.trees.sums["cross"][own, leaves], self.trees.sums["square"][own, leaves]
        scale = np.nanmean(square, axis=1)
        effect = np.nanmean(cross, axis=1) / scale
        apart = (cross - effect[:, None] * square) / scale[:, None]
        apart = np.nan_to_num(apart).reshape(len(x), -1, self.bag)
        bags = apart.mean(axis=2)
        return effect, np.sqrt(_bag_variance((bags**2).mean(axis=1), ((apart - bags[:, :, None]) ** 2).mean(axis=(1, 2)), self.bag, bags.shape[1])), bags


def _bag_variance(between, within, bag: int, bags: int):
    """Of means over bags, less what their few trees add; at least a share of the former."""
    return np.maximum(between - within / max(bag - 1, 1), between / bags)


class _CausalSplit:
    """The split whose children's effects differ most, by the sums of the half for splits; both halves have `least` rows on each side."""

    fields = 2

    def __init__(self, least: int):
        self.least = least

    def __call__(self, grid: np.ndarray) -> tuple[int, int] | None:
        n, square, cross, others = (np.cumsum(g, axis=1) for g in grid)
        if not square[0, -1] > 0:
            return None
        effect = cross[0, -1] / square[0, -1]
        gain = cross - effect * square  # of pseudo-outcomes, up to a constant; those of the right side are its negative
        left, right = n[:, :-1], n[:, -1:] - n[:, :-1]
        sound = (np.minimum(left, right) >= self.least) & (np.minimum(others[:, :-1], others[:, -1:] - others[:, :-1]) >= self.least)
        total = gain[:, -1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(sound, gain[:, :-1] ** 2 / left + (total - gain[:, :-1]) ** 2 / right, -1.0)
        best = int(score.argmax()) if score.size else 0
        if not score.size or score.flat[best] <= 1e-12 * abs(cross[0, -1] * effect):
            return None
        return best // score.shape[1], best % score.shape[1]


def _roles(hashes: np.ndarray, trees: int, bag: int, seed: int) -> np.ndarray:
    """Of each row in each tree: 0 not in its half-sample, 1 for splits, 2 for effects."""
    out = np.zeros((len(hashes), trees), np.int8)
    for t in range(trees):
        if t % bag == 0:
            drawn = _draws(hashes, 2 * (seed * 1_000_003 + t) + 1) < 0.5
        out[:, t] = np.where(drawn, 1 + (_draws(hashes, 2 * (seed * 1_000_003 + t)) < 0.5), 0)
    return out


def causal_forest(residuals: DataFrame, features: Sequence[str], keys: Sequence[str], trees: int = 500, depth: int = 5, bag: int = 4, least: int = 10, seed: int = 7, min_rows: int = 100) -> CausalForest | None:
    """A forest of effects from rows with features and residuals _d (of the treatment) and _y (of the outcome); None under min_rows.

    Each tree takes a half-sample, chooses splits on one half of it and effects on the other.
    """
    columns = [f"_x{k}" for k in range(len(features))]
    rows = residuals.select(F.xxhash64(*keys).alias("_h"), F.col("_d").cast("double"), F.col("_y").cast("double"), *(F.col(c).cast("double").alias(n) for c, n in zip(features, columns, strict=True))).na.drop()
    rows = _compact(rows)
    n = rows.count()
    if n < min_rows:
        rows.unpersist()
        return None
    trees = -(-trees // bag) * bag
    grown = Trees.empty(features, cut_points(rows, columns), trees, depth)
    width = len(features) << 16 | max((len(c) for c in grown.cuts), default=0) + 1
    names = ["n", "square", "cross", "others"]

    def measured(level: int, role: int | None) -> Callable:
        def measure(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, Callable]:
            bins = grown.bins(_matrix(batch, columns))
            roles = _roles(batch["_h"].to_numpy(), trees, bag, seed)
            d, y = batch["_d"].to_numpy(), batch["_y"].to_numpy()
            nodes = np.where(roles > 0 if role is None else roles == role, grown.nodes(bins, level), -1)

            def values(t: slice) -> list[np.ndarray]:
                first = (roles[:, t] == 1).astype(float) if role is None else np.ones((len(d), roles[:, t].shape[1]))
                return [first, first * (d * d)[:, None], first * (d * y)[:, None], 1.0 - first]

            return bins, nodes, values

        return measure

    for level in range(depth):
        sums, most = _level(rows, grown, level, measured(level, None), names)
        found = _chosen(sums, most, names, width, _CausalSplit(least))
        for tree, node, feature, cut in found:
            grown.feature[int(tree), int(node)], grown.bin[int(tree), int(node)] = feature, cut
        if not found:
            break

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, grown.feature.size))
        for batch in batches:
            _, nodes, values_of = measured(depth, 2)(batch)
            live = nodes >= 0
            at = np.broadcast_to(np.arange(trees) * grown.feature.shape[1], nodes.shape)[live] + nodes[live]
            for k, v in enumerate(values_of(slice(0, trees))[:3]):
                held[k] += np.bincount(at, v[live], grown.feature.size)
        at = np.flatnonzero(held[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(h[at]) for h in held)], names=["at", "n", "square", "cross"])

    found = rows.mapInArrow(leaves, "at long, n double, square double, cross double").groupBy("at").agg(*(F.sum(c).alias(c) for c in ("n", "square", "cross"))).toArrow()  # a row a leaf
    rows.unpersist()
    at, count = found["at"].to_numpy(), found["n"].to_numpy()
    for name in ("square", "cross"):
        grown.sums[name] = np.full(grown.feature.shape, np.nan)
        grown.sums[name].flat[at] = found[name].to_numpy() / count
    return CausalForest(grown, bag, n)


def effects(df: DataFrame, forest: CausalForest, keep: Sequence[str]) -> DataFrame:
    """The columns to keep, effect, se, ci_low and ci_high of every row; null where a feature is null."""
    columns = [f"_x{k}" for k in range(len(forest.trees.features))]
    shared = df.sparkSession.sparkContext.broadcast(forest)
    rows = df.select(*keep, *(F.col(c).cast("double").alias(n) for c, n in zip(forest.trees.features, columns, strict=True)))
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) + ", effect double, se double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            effect, se, _ = shared.value.moments(np.nan_to_num(_matrix(batch, columns).astype(float)))
            gone = np.isnan(_matrix(batch, columns).astype(float)).any(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(effect, mask=gone), pa.array(se, mask=gone)], names=[*keep, "effect", "se"])

    half = F.col("se") * F.lit(1.959963984540054)
    return rows.mapInArrow(run, schema).withColumns({"ci_low": F.col("effect") - half, "ci_high": F.col("effect") + half})


def effects_by(df: DataFrame, forest: CausalForest, group: str) -> DataFrame:
    """group, n, the mean effect of its rows, and its error from bags; rows with a null feature are left out.

    Tasks add up what bags say of each group, so that only a row for each task, group and bag is shuffled.
    """
    columns = [f"_x{k}" for k in range(len(forest.trees.features))]
    shared = df.sparkSession.sparkContext.broadcast(forest)
    rows = df.select(F.col(group).cast("string").alias("_g"), *(F.col(c).cast("double").alias(n) for c, n in zip(forest.trees.features, columns, strict=True))).na.drop(subset=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, np.ndarray] = {}
        for batch in batches:
            effect, _, bags = shared.value.moments(_matrix(batch, columns))
            coded = batch["_g"].dictionary_encode(null_encoding="encode")
            for k, name in enumerate(coded.dictionary.to_pylist()):
                own = coded.indices.to_numpy() == k
                sums = np.concatenate([[own.sum(), effect[own].sum()], bags[own].sum(axis=0)])
                held[name] = held.get(name, 0.0) + sums
        for name, sums in held.items():
            n = len(sums) - 2
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), pa.array([int(sums[0])] * n, pa.int64()), pa.array([sums[1]] * n), pa.array(sums[2:])], names=["group", "bag", "n", "effect", "apart"])

    by_bag = rows.mapInArrow(run, "group string, bag int, n long, effect double, apart double").groupBy("group", "bag").agg(*(F.sum(c).alias(c) for c in ("n", "effect", "apart")))
    apart = F.col("apart") / F.col("n")
    out = by_bag.groupBy("group").agg(F.max("n").alias("n"), F.max(F.col("effect") / F.col("n")).alias("effect"), F.sqrt(F.avg(apart * apart)).alias("se"))
    half = F.col("se") * F.lit(1.959963984540054)
    return out.withColumns({"ci_low": F.col("effect") - half, "ci_high": F.col("effect") + half})


# --- Second-order boosting


class _BoostSplit:
    """The split with the largest gain of the second-order objective, among the features drawn; and what the children weigh."""

    fields = 6

    def __init__(self, drawn: Sequence[int], penalty: float, least: float, gain: float):
        self.drawn, self.penalty, self.least, self.gain = list(drawn), penalty, least, gain

    def __call__(self, grid: np.ndarray) -> tuple[float, ...] | None:
        g, h = (np.cumsum(x, axis=1) for x in grid)
        total_g, total_h = g[0, -1], h[0, -1]
        left_g, left_h = g[:, :-1], h[:, :-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        sound = (left_h >= self.least) & (right_h >= self.least)
        sound[[f for f in range(len(g)) if f not in self.drawn]] = False
        score = left_g**2 / (left_h + self.penalty) + right_g**2 / (right_h + self.penalty) - total_g**2 / (total_h + self.penalty)
        score = np.where(sound, score, -np.inf)
        best = int(score.argmax()) if score.size else 0
        if not score.size or not score.flat[best] / 2 > self.gain + 1e-12:
            return -1, 0, total_g, total_h, 0.0, 0.0
        f, k = best // score.shape[1], best % score.shape[1]
        return f, k, total_g, total_h, left_g[f, k], left_h[f, k]


@dataclass
class Boosted:
    """Boosted trees for squared errors, a base for each model; tree r of model m is row r * models + m of trees."""

    trees: Trees
    models: int
    base: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Rows by models."""
        nodes = self.trees.nodes(self.trees.bins(x))
        values = self.trees.sums["value"][np.arange(nodes.shape[1]), nodes]
        return self.base + values.reshape(len(x), -1, self.models).sum(axis=1)


def boost(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], fold: str | None = None, rounds: int = 200, depth: int = 6, rate: float = 0.1, row_share: float = 0.8, column_share: float = 0.8, penalty: float = 1.0, least: float = 1.0, gain: float = 0.0, every: int = 10, seed: int = 7) -> Boosted | None:
    """Boosting with sampled rows and columns and regularised leaves, `rounds` trees of each model; None without rows.

    With fold (a column of numbers from 0), model k is fitted without fold k, and one more on all rows. Beyond TASK_ROWS rows all
    grow side by side, in the same passes over the rows, one for each level; predictions so far are written to the checkpoint folder
    after `every` rounds. Of fewer rows, each model is grown by a task of its own, so that they take one job instead of one a level.
    """
    columns = [f"_x{k}" for k in range(len(features))]
    rows = df.select(F.xxhash64(*keys).alias("_h"), (F.col(fold).cast("int") if fold else F.lit(-1)).alias("_fold"), F.col(label).cast("double").alias("_y"), *(F.col(c).cast("double").alias(n) for c, n in zip(features, columns, strict=True))).na.drop()
    base_rows = rows = _compact(rows)
    found = {r["_fold"]: (r["s"], r["n"]) for r in rows.groupBy("_fold").agg(F.sum("_y").alias("s"), F.count(F.lit(1)).alias("n")).collect()}  # a row a fold
    if not found:
        return None
    models = max(found) + 2
    total, n = (sum(x[k] for x in found.values()) for k in (0, 1))
    base = np.array([(total - found.get(m, (0, 0))[0]) / max(n - found.get(m, (0, 0))[1], 1) for m in range(models)])
    cuts, names = cut_points(base_rows, columns), ["g", "h"]
    width = len(features) << 16 | max((len(c) for c in cuts), default=0) + 1

    def planted(trees: int) -> Trees:
        grown = Trees.empty(features, cuts, trees, depth)
        grown.sums["value"] = np.zeros(grown.feature.shape)
        return grown

    def predicted(batch: pa.RecordBatch, bins: np.ndarray, done: Trees, count: int) -> np.ndarray:
        flat = batch["_p"].flatten().to_numpy().reshape(batch.num_rows, count)
        if not len(done.feature):
            return flat
        nodes = done.nodes(bins)
        return flat + done.sums["value"][np.arange(nodes.shape[1]), nodes].reshape(len(bins), -1, count).sum(axis=1)

    def kept(batch: pa.RecordBatch, done: Trees, count: int) -> pa.RecordBatch:
        p = predicted(batch, done.bins(_matrix(batch, columns)), done, count)
        return batch.set_column(batch.schema.get_field_index("_p"), "_p", pa.array(list(p), pa.list_(pa.float64())))

    def grow(own: np.ndarray, chosen: Callable[[Trees, int, Measure, _BoostSplit], list[tuple]], keep: Callable[[Trees], None]) -> Trees:
        """Trees of own models, round by round: chosen gives the nodes of a level with their splits, keep adds trees to the rows' predictions."""
        count, since = len(own), 0
        grown = planted(rounds * count)

        def part(first: int, last: int) -> Trees:
            some = slice(first * count, last * count)
            return Trees(grown.features, grown.cuts, grown.feature[some], grown.bin[some], {"value": grown.sums["value"][some]})

        draw = np.random.default_rng(seed)
        for r in range(rounds):
            drawn = np.sort(draw.permutation(len(features))[: max(1, round(column_share * len(features)))]).tolist()
            for level in range(depth):
                done, now = part(since, r), part(r, r + 1)

                def measure(batch: pa.RecordBatch, done=done, now=now, r=r, level=level) -> tuple[np.ndarray, np.ndarray, Callable]:
                    bins = now.bins(_matrix(batch, columns))
                    slopes = predicted(batch, bins, done, count) - batch["_y"].to_numpy()[:, None]
                    inside = (_draws(batch["_h"].to_numpy(), seed * 1_000_003 + r) < row_share)[:, None] & (batch["_fold"].to_numpy()[:, None] != own)
                    return bins, np.where(inside, now.nodes(bins, level), -1), lambda t: [slopes[:, t], np.ones(slopes[:, t].shape)]

                split = False
                for tree, node, feature, cut, g, h, left_g, left_h in chosen(now, level, measure, _BoostSplit(drawn, penalty, least, gain)):
                    at, node = r * count + int(tree), int(node)
                    grown.feature[at, node], grown.bin[at, node] = feature, cut
                    grown.sums["value"][at, node] = -rate * g / (h + penalty)
                    if feature >= 0:
                        split = True
                        grown.sums["value"][at, 2 * node + 1] = -rate * left_g / (left_h + penalty)
                        grown.sums["value"][at, 2 * node + 2] = -rate * (g - left_g) / (h - left_h + penalty)
                if not split:
                    break
            if (r + 1) % every == 0 and r + 1 < rounds:
                keep(part(since, r + 1))
                since = r + 1
        return grown

    def alone(key: tuple, group: pa.Table) -> pa.Table:
        model = key[0].as_py()
        group = group.sort_by([("_h", "ascending"), ("_y", "ascending")]).append_column("_p", pa.array([[float(base[model])]] * len(group), pa.list_(pa.float64())))
        batches = group.combine_chunks().to_batches()

        def keep(done: Trees) -> None:
            batches[:] = [kept(b, done, 1) for b in batches]

        own = grow(np.array([model]), lambda now, level, measure, choose: _choices(pa.Table.from_batches(_adder(now, level, measure, names)[0](iter(batches))), names, width, choose), keep)
        at = np.flatnonzero((own.feature >= 0) | (own.sums["value"] != 0))
        r, node = np.unravel_index(at, own.feature.shape)
        return pa.table([pa.array((r * models + model).astype(np.int32)), pa.array(node.astype(np.int32)), pa.array(own.feature.flat[at].astype(np.int32)), pa.array(own.bin.flat[at].astype(np.int32)), pa.array(own.sums["value"].flat[at])], names=["tree", "node", "feature", "bin", "value"])

    if n <= TASK_ROWS:
        by_model = rows.withColumn("_model", F.explode(F.sequence(F.lit(0), F.lit(models - 1)))).filter("_model <> _fold").repartition(models, "_model")
        nodes = by_model.groupBy("_model").applyInArrow(alone, "tree int, node int, feature int, bin int, value double").toArrow()  # a row a node
        grown, at = planted(rounds * models), (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
        grown.feature[at], grown.bin[at], grown.sums["value"][at] = (nodes[c].to_numpy() for c in ("feature", "bin", "value"))
    else:
        rows = rows.withColumn("_p", F.array(*(F.lit(float(b)) for b in base)))

        def keep(done: Trees) -> None:
            nonlocal rows
            rows = checkpoint(rows.mapInArrow(lambda batches: (kept(b, done, models) for b in batches), rows.schema))

        grown = grow(np.arange(models), lambda now, level, measure, choose: _chosen(*_level(rows, now, level, measure, names), names, width, choose), keep)
    base_rows.unpersist()
    return Boosted(grown, models, base)


def boosted_predictions(df: DataFrame, model: Boosted, keep: Sequence[str], fold: str | None = None) -> DataFrame:
    """The columns to keep and predicted: by the model without the row's fold, else by that of all rows; null with a null feature."""
    columns = [f"_x{k}" for k in range(len(model.trees.features))]
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(*keep, (F.col(fold).cast("int") if fold else F.lit(model.models - 1)).alias("_fold"), *(F.col(c).cast("double").alias(n) for c, n in zip(model.trees.features, columns, strict=True)))
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) + ", predicted double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, columns).astype(float)
            own = batch["_fold"].to_numpy(zero_copy_only=False)
            found = shared.value.predict(np.nan_to_num(x))[np.arange(len(x)), np.where(np.isnan(own.astype(float)), model.models - 1, own).astype(int)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(found, mask=np.isnan(x).any(axis=1))], names=[*keep, "predicted"])

    return rows.mapInArrow(run, schema)


# --- Attributions per row


@dataclass
class Paths:
    """Leaves of an ensemble as conditions: for each leaf its value and, for each feature on its path, the interval (low, high] in
    which a value goes its way and the share of rows, by cover, that do at the nodes of that feature."""

    features: list[str]
    leaves: list[tuple[float, list[tuple[int, float, float, float]]]]

    @property
    def base(self) -> float:
        """The prediction where no feature is known."""
        return math.fsum(value * math.prod(s for *_, s in path) for value, path in self.leaves)

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """What each feature adds to each row's prediction, its Shapley value over orders in which features get known."""
        out = np.zeros(x.shape)
        for value, path in self.leaves:
            k = len(path)
            goes = [((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, low, high, _ in path]
            for j, (f, _, _, share) in enumerate(path):
                known = np.zeros((len(x), k))  # by how many of the others are known
                known[:, 0] = 1.0
                for i, (*_, other) in enumerate(path):
                    if i != j:
                        known[:, 1:] = known[:, 1:] * other + known[:, :-1] * goes[i][:, None]
                        known[:, 0] *= other
                weights = [math.factorial(s) * math.factorial(k - s - 1) / math.factorial(k) for s in range(k)]
                out[:, f] += value * (goes[j] - share) * (known @ weights)
        return out


def paths_of(nodes: DataFrame, features: Sequence[str], weights: Sequence[float] | None = None) -> Paths:
    """Paths of trees given as rows (tree, node, feature, cut, left, right, value, cover); feature is negative in a leaf, node 0 is the root.

    The table is a model, which is held whole; weights are those of the trees.
    """
    trees: dict[int, dict[int, tuple]] = {}
    for r in nodes.collect():
        trees.setdefault(r["tree"], {})[r["node"]] = (r["feature"], r["cut"], r["left"], r["right"], r["value"], r["cover"])
    leaves = []
    for tree, own in sorted(trees.items()):
        todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while todo:
            node, path = todo.pop()
            feature, cut, left, right, value, cover = own[node]
            if feature < 0:
                leaves.append((value * (weights[tree] if weights else 1.0), [(f, *p) for f, p in path.items()]))
                continue
            low, high, share = path.get(feature, (-math.inf, math.inf, 1.0))
            for child, interval in ((left, (low, min(high, cut))), (right, (max(low, cut), high))):
                todo.append((child, path | {feature: (*interval, share * own[child][5] / cover)}))
    return Paths(list(features), leaves)


def mllib_nodes(model, folder: str) -> DataFrame:
    """Nodes of a fitted MLlib forest or boosting with continuous features, as paths_of wants them, by way of its files in a shared folder."""
    model.write().overwrite().save(folder)
    rows = SparkSession.getActiveSession().read.parquet(f"{folder}/data")
    n = F.col("nodeData")
    return rows.select(F.col("treeID").alias("tree"), n["id"].alias("node"), n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("cut"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["prediction"].alias("value"), n["rawCount"].cast("double").alias("cover"))


def boosted_nodes(df: DataFrame, model: Boosted, which: int) -> DataFrame:
    """Nodes of one of the boosted models, as paths_of wants them, with cover counted over the rows of df."""
    spark, trees = df.sparkSession, model.trees
    own = Trees(trees.features, trees.cuts, trees.feature[which :: model.models], trees.bin[which :: model.models])
    columns = [f"_x{k}" for k in range(len(trees.features))]
    rows = df.select(*(F.col(c).cast("double").alias(n) for c, n in zip(trees.features, columns, strict=True))).na.drop()
    size = own.feature.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(own.feature.size, np.int64)
        for batch in batches:
            bins = own.bins(_matrix(batch, columns))
            seen = np.full((len(bins), len(own.feature)), -1)
            for level in range(own.depth + 1):
                nodes = own.nodes(bins, level)
                new = nodes != seen  # a leaf is counted when it is reached
                held += np.bincount((np.arange(len(own.feature)) * size + nodes)[new], minlength=own.feature.size)
                seen = nodes
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["at", "n"])

    cover = np.zeros(own.feature.size)
    for r in rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row a node
        cover[r["at"]] = r["n"]
    cover = cover.reshape(own.feature.shape)
    value = trees.sums["value"][which :: model.models]
    out = []
    for t in range(len(own.feature)):
        todo = [0]
        while todo:
            n = todo.pop()
            f = int(own.feature[t, n])
            out.append((t, n, f, float(trees.cuts[f][own.bin[t, n]]) if f >= 0 else 0.0, 2 * n + 1, 2 * n + 2, float(value[t, n]), max(float(cover[t, n]), 1e-9)))
            if f >= 0:
                todo += [2 * n + 1, 2 * n + 2]
    return spark.createDataFrame(out, "tree int, node int, feature int, cut double, left int, right int, value double, cover double")


def attributions(df: DataFrame, paths: Paths, keep: Sequence[str], offset: float = 0.0) -> DataFrame:
    """The columns to keep, base, and shap_{feature} of every row: together they are its prediction; null with a null feature.

    offset is what a model adds to its trees.
    """
    columns = [f"_x{k}" for k in range(len(paths.features))]
    names = [f"shap_{c}" for c in paths.features]
    shared = df.sparkSession.sparkContext.broadcast(paths)
    rows = df.select(*keep, *(F.col(c).cast("double").alias(n) for c, n in zip(paths.features, columns, strict=True)))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.select(*keep).dtypes), *(f"`{n}` double" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, columns).astype(float)
            found, gone = shared.value.attributions(np.nan_to_num(x)), np.isnan(x).any(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *(pa.array(found[:, k], mask=gone) for k in range(len(names)))], names=[*keep, *names])

    return rows.mapInArrow(run, schema).withColumn("base", F.lit(paths.base + offset))


def mean_attributions(attributed: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature and importance: the mean size of its attributions."""
    sums = attributed.agg(*(F.avg(F.abs(F.col(f"shap_{c}"))).alias(c) for c in features))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in features))).alias("x")).select("x.*")

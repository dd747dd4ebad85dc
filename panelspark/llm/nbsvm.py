"""Quality classification by naive Bayes support vectors.

A text's features are which n-grams it holds: runs of one to three bytes, words, and pairs of words, hashed into
DIMENSIONS places. Each feature is scaled by its log-count ratio between the classes, and a linear model is fitted on the
scaled indicators with the hinge loss by dual coordinate descent. Counts are added up over the whole sample first. Training
texts are dealt, class by class, into groups of about GROUP_ROWS that all have both classes: where the rarer class has fewer
rows than groups, groups are fewer and larger. Each is fitted in a task of its own, and as all models are linear in the
indicators, their mean is the model. A logistic curve turns margins into probabilities; it is fitted on margins of each
group's texts under the mean of the other groups' models.

Defined cases: a null text is an empty one; an empty text has no feature, and its score is the curve's at the bias; with
one class only, all texts get its share of the labels, and 0.99 without any labelled text, as nothing speaks against
one; a repeated row of documents gets its score each time, but teaches once, as labelled.sample says; texts are read whole,
however long; ties of scores stay ties; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import labelled, words
from .storage import small_batches

BITS = 18
DIMENSIONS = 1 << BITS
#: Labelled documents that are used at most, and those of one fit.
SAMPLE_ROWS = 8_000
GROUP_ROWS = 1_600
EPOCHS = 12
COST = 1.0
#: Added to each count before log-count ratios are taken.
PRIOR = 1.0

_U = np.uint64


def _place(code: np.ndarray, kind: int) -> np.ndarray:
    return ((code.astype(np.uint32) + np.uint32(kind * 0x01000193)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def indicators(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted places of the n-grams that it holds."""
    seen = np.zeros(DIMENSIONS, bool)
    for _, _, data, offsets in words.pieces(texts):
        _, _, hashes, before = words.split(data, offsets, words.SPACED)
        wide = data.astype(np.uint32)
        grams = [_place(wide, 1)]
        for n in (2, 3):
            wide = (wide[:-1] << np.uint32(8)) | data[n - 1 :] if len(data) >= n else np.zeros(0, np.uint32)
            grams.append(_place(wide, n))
        single = (hashes >> _U(64 - BITS)).astype(np.int64)
        double = (words.pairs(hashes) >> _U(64 - BITS)).astype(np.int64) if len(hashes) > 1 else np.zeros(0, np.int64)
        for i in range(len(offsets) - 1):
            a, b, x, y = int(offsets[i]), int(offsets[i + 1]), int(before[i]), int(before[i + 1])
            for n, g in enumerate(grams):
                seen[g[a : max(a, b - n)]] = True
            seen[single[x:y]] = True
            seen[double[x : max(x, y - 1)]] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found.astype(np.int32)


def class_counts(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """In how many texts of each class (0, 1) each place is."""
    counts = np.zeros((2, DIMENSIONS), np.int32)
    for row, label in zip(rows, y, strict=True):
        counts[int(label > 0)][row] += 1
    return counts


def log_count_ratio(counts: np.ndarray) -> np.ndarray:
    """Of each place, the logarithm of its share of the counts in class 1 over that in the other."""
    p = counts + PRIOR
    return np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())


def solve_dual(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dual coordinate descent: weights of the scaled indicators, the bias last, for labels y of -1 and 1 under the hinge
    loss, and each row's dual variable and its upper bound.

    A row's values are divided by the square root of their number. Classes weigh the same however many rows they have.
    """
    w, bias = np.zeros(len(scale)), 0.0
    n = len(rows)
    values = [scale[r] / max(1.0, len(r)) ** 0.5 for r in rows]
    square = np.array([float(v @ v) + 1.0 for v in values])
    share = np.where(y > 0, (y > 0).mean(), (y <= 0).mean())
    limit = cost * 0.5 / np.maximum(share, 1e-9)
    alpha = np.zeros(n)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(n):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return np.append(w, bias), alpha, limit


@dataclass
class Model:
    """Weights of the plain indicators (scale and weight in one), the bias last, and the curve of the margin."""

    weights: np.ndarray
    curve: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        return labelled.logistic(margins(texts, self.weights)[:, None], self.curve)


def margins(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    return np.array([weights[r].sum() / max(1.0, len(r)) ** 0.5 + weights[-1] for r in indicators(texts)], float)


def groups_of(sampled: DataFrame, group_rows: int) -> DataFrame:
    """A bounded sample with part, its group: as many groups as rows ask for, but none without both classes, and each class dealt
    out evenly."""
    n = {bool(r["one"]): r["n"] for r in sampled.groupBy((F.col("label") > 0).alias("one")).agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = max(1, min(-(-sum(n.values()) // group_rows), n.get(True, 0), n.get(False, 0)))
    place = F.row_number().over(W.partitionBy(F.col("label") > 0).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id"))
    return sampled.withColumn("part", (place % groups).cast("int"))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, group_rows: int = GROUP_ROWS) -> Model:
    """Fits the model on at most `rows` labelled documents; what reaches the driver is a weight vector per group and a margin per row."""
    small_batches(docs.sparkSession)
    drawn = labelled.sample(docs, labels, label, rows).cache()
    sampled = groups_of(drawn, group_rows)

    def count(group: pa.Table) -> pa.Table:
        return pa.table({"counts": pa.array([class_counts(list(indicators(group["text"])), group["label"].to_numpy()).tobytes()], pa.binary())})

    total = np.zeros((2, DIMENSIONS), np.int64)
    for r in sampled.groupBy("part").applyInArrow(count, "counts binary").toLocalIterator():  # one row a group
        total += np.frombuffer(r["counts"], np.int32).reshape(2, -1)
    ratio = docs.sparkSession.sparkContext.broadcast(log_count_ratio(total).astype(np.float32))

    def fit(group: pa.Table) -> pa.Table:
        y = group["label"].to_numpy()
        found = list(indicators(group["text"]))
        if y.min() == y.max():
            return pa.table({"part": pa.array([], pa.int32()), "weights": pa.array([], pa.binary())})
        scale = ratio.value.astype(float)
        weights = solve_dual(found, scale, np.where(y > 0, 1.0, -1.0))[0]
        plain = np.append(weights[:-1] * scale, weights[-1]).astype(np.float32)
        return pa.table({"part": group["part"][:1].cast(pa.int32()), "weights": pa.array([plain.tobytes()], pa.binary())})

    fitted = {r["part"]: np.frombuffer(r["weights"], np.float32) for r in sampled.groupBy("part").applyInArrow(fit, "part int, weights binary").collect()}
    if not fitted:
        share = sampled.agg(F.avg((F.col("label") > 0).cast("double"))).first()[0]
        drawn.unpersist()
        share = 0.99 if share is None else min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(DIMENSIONS + 1, np.float32), np.array([0.0, np.log(share / (1 - share))]))
    total = np.sum(list(fitted.values()), axis=0)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch["part"].to_numpy()
            out = np.zeros(batch.num_rows)
            for p in np.unique(part):
                own = fitted.get(int(p))
                weights = (total - own) / (len(fitted) - 1) if own is not None and len(fitted) > 1 else total / len(fitted)
                at = np.flatnonzero(part == p)
                out[at] = margins(batch["text"].take(pa.array(at)), weights)
            yield pa.RecordBatch.from_arrays([pa.array(out), batch["label"]], names=["margin", "label"])

    got = sampled.select("text", "part", "label").mapInArrow(others, "margin double, label int").collect()
    drawn.unpersist()
    y = np.array([float(r["label"] > 0) for r in got])
    return Model(total / np.float32(len(fitted)), labelled.fit_logistic(np.array([[r["margin"]] for r in got]), y))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: class 1 likelier) of every row of docs. The model is of a fixed size."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(shared.value.scores(batch["text"]), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(words.frugal(run), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, that reach the threshold."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch["text"]) >= threshold))

    return docs.mapInArrow(words.frugal(run), docs.schema)

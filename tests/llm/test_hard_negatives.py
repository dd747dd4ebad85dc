"""Hard negatives against brute force: odd rows, ties, many cells and blocks, large numbers, and how far vectors are sent."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import hard_negatives, topk

SCHEMA = "vec_id long, label int, embedding array<double>, cell int, apart double, bounds string"
MOST = (1 << 63) - 1


def brute_force(rows, is_anchor, positives=5, negatives=5):
    sound = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) and np.isfinite(256.0 * x) for x in v):
            sound.append((i, str(label), [int(np.floor(256.0 * x)) for x in v]))
    anchors = {}
    for i, label, v in sorted((i, [float(x) for x in v], label) for i, label, v in sound):
        if is_anchor(i):
            anchors.setdefault(i, (v, label))
    label_of = {(i, tuple(map(float, v))): label for i, label, v in sorted(sound, reverse=True)}
    out = []
    for a in anchors:
        least = min(([float(x) for x in v], label) for i, label, v in sound if i == a)
        q, mine = [int(x) for x in least[0]], least[1]
        scored = [(max(-MOST, min(MOST, sum(x * y for x, y in zip(q, v, strict=True)))), i, label) for i, label, v in sound if len(v) == len(q)]
        own = sorted((-s, i) for s, i, label in scored if label == mine and i != a)[:positives]
        for s, p in own:
            found = sorted((-n, i) for n, i, label in scored if label != mine and 80 * -s <= 100 * n <= 100 * -s)[:negatives]
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(found, 1)]
    assert label_of
    return sorted(out)


def clustered(seed, n, dim, labels=3, centres=6):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(centres, dim)) * 3
    return [(int(i), int(rng.integers(labels)), (at[rng.integers(centres)] + 0.3 * rng.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("sizes", [(4096, 16384, 2048), (16, 10, 5), (40, 1000, 2)])
def test_equals_brute_force(spark, sizes):
    rows = clustered(1, 300, 4) + [(i, 1, rows_v) for i, rows_v in enumerate([[1.0, 0.0, 0.0, 0.0]] * 4, 1000)]
    rows += rows[3:9] + [rows[20]] * 8 + [rows[21]] * 3  # repeated rows, of anchors too
    rows += [(10, 2, [0.5] * 4), (10, 1, [0.25] * 4), (500, 0, []), (501, 0, []), (502, 1, []), (600, 0, [1.0, 2.0]), (601, 0, [2.0, 1.0]), (603, 2, [1.9, 1.0])]
    rows += [(None, 1, [1.0] * 4), (701, None, [1.0] * 4), (702, 1, None), (703, 1, [1.0, None, 0.0, 0.0]), (704, 1, [float("nan")] * 4), (705, 1, [float("inf")] * 4), (706, 1, [1e308] * 4)]
    df = spark.createDataFrame([(*r, 3, 0.5, "x") for r in rows], SCHEMA)
    got = hard_negatives.mine(topk.quantised(df, keep=["label"]), F.col("vec_id") % 10 == 0, cell_rows=sizes[0], shard_rows=sizes[1], group_anchors=sizes[2])
    got = sorted(tuple(r) for r in got.collect())
    want = brute_force(rows, lambda i: i % 10 == 0)
    assert got == want and len(want) > 100


@pytest.mark.parametrize("scale", [1e7, 1e150])
def test_large_components(spark, scale):
    """Products that doubles don't hold, and that a long doesn't."""
    rows = [(i, label, [float(np.floor(scale * x)) / 256 for x in v]) for i, label, v in clustered(2, 60, 3)]
    df = spark.createDataFrame([(*r, 3, 0.5, "x") for r in rows], SCHEMA)
    got = hard_negatives.mine(topk.quantised(df, keep=["label"]), F.col("vec_id") % 6 == 0, cell_rows=10, shard_rows=7, group_anchors=4).collect()
    want = brute_force(rows, lambda i: i % 6 == 0)
    assert sorted(tuple(r) for r in got) == want and want


def test_vectors_go_only_to_groups_that_they_may_serve(spark, monkeypatch):
    """On clusters far apart, far fewer than all pairs of vector and group are sent, and nothing is missed."""
    rng = np.random.default_rng(3)
    at = np.eye(12) * 40
    rows = [(i, int(i // 12 % 3), (at[i % 12] + 0.1 * rng.normal(size=12)).tolist()) for i in range(1200)]
    sent = []
    plain = hard_negatives._sent
    monkeypatch.setattr(hard_negatives, "_sent", lambda *a: sent.append(plain(*a)) or sent[-1])
    df = spark.createDataFrame([(*r, 3, 0.5, "x") for r in rows], SCHEMA)
    got = hard_negatives.mine(topk.quantised(df, keep=["label"]), F.col("vec_id") % 20 == 0, cell_rows=60, group_anchors=6).collect()
    assert sorted(tuple(r) for r in got) == brute_force(rows, lambda i: i % 20 == 0)
    groups = 60 // 6
    assert all(s.count() < 0.5 * groups * len(rows) for s in sent) and len(sent) == 2


def test_one_label_or_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(topk.quantised(none, keep=["label"]), F.col("vec_id") % 2 == 0).count() == 0
    one = spark.createDataFrame([(i, 1, [1.0, float(i)], 3, 0.5, "x") for i in range(20)], SCHEMA)
    assert hard_negatives.mine(topk.quantised(one, keep=["label"]), F.col("vec_id") % 2 == 0).count() == 0
    assert hard_negatives.mine(topk.quantised(one, keep=["label"]), F.col("vec_id") < 0).count() == 0
    negative = spark.createDataFrame([(i, i % 2, [1.0, -1.0] if i % 4 < 2 else [-1.0, 1.0], 3, 0.5, "x") for i in range(4)], SCHEMA)
    assert hard_negatives.mine(topk.quantised(negative, keep=["label"]), F.col("vec_id") >= 0).count() == 0


def test_groups_hold_few_anchors():
    space = hard_negatives.Space(np.random.default_rng(4).normal(size=(40, 4)), 9.0)
    anchors = np.random.default_rng(5).integers(0, 30, 40)
    anchors[7] = 250
    hard_negatives._grouped(space, anchors, 50)
    assert ((space.group >= 0) == (anchors > 0)).all() and space.blocks[7] == 5
    for group in range(space.group.max() + 1):
        own = space.group == group
        assert anchors[own].sum() <= 50 or own.sum() == 1

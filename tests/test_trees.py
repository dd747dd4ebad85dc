"""Causal forests, boosting and attributions against plain loops, known effects and all subsets of features."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from panelspark.operators import models, trees


def rows_of(spark, n, seed=1, noise=0.3):
    """A treatment whose effect is 1 where a <= 0 and 3 elsewhere."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.integers(0, 5, n).astype(float)
    t = 0.5 * b + rng.normal(size=n)
    y = np.where(a <= 0, 1.0, 3.0) * t + b + noise * rng.normal(size=n)
    part = ["low" if x <= 0 else "high" for x in a]
    return spark.createDataFrame([(i, float(a[i]), float(b[i]), float(t[i]), float(y[i]), part[i]) for i in range(n)], "id long, a double, b double, t double, y double, part string")


@pytest.fixture(scope="module")
def forest(spark):
    df = rows_of(spark, 2_000)
    residuals = models.dml_residuals(df, "y", "t", ["a", "b"], ["id"], keep=["a", "b"])
    return df, residuals, trees.causal_forest(residuals, ["a", "b"], ["id"], trees=80, depth=3)


def test_forest_recovers_a_step_effect(spark, forest):
    df, _, fitted = forest
    got = trees.effects(df.union(spark.createDataFrame([(-1, None, 1.0, None, None, None)], df.schema)), fitted, ["id", "a"]).toPandas().set_index("id")
    assert np.isnan(got.loc[-1, "effect"]) and len(got) == 2_001
    got = got.drop(-1)
    far = got[got["a"].abs() > 0.3]
    truth = np.where(far["a"] <= 0, 1.0, 3.0)
    assert np.abs(far["effect"] - truth).mean() < 0.2
    assert ((far["ci_low"] - 0.3 < truth) & (truth < far["ci_high"] + 0.3)).mean() > 0.9 and (got["se"] > 0).all()
    by = {r["group"]: r for r in trees.effects_by(df, fitted, "part").collect()}
    assert abs(by["low"]["effect"] - 1) < 0.3 and abs(by["high"]["effect"] - 3) < 0.3
    assert by["low"]["n"] + by["high"]["n"] == 2_000 and all(0 < r["se"] < 0.5 for r in by.values())
    mean = got.join(df.toPandas().set_index("id")["part"]).groupby("part")["effect"].mean()
    assert by["low"]["effect"] == pytest.approx(mean["low"])
    whole = trees.effects_by(df.withColumn("all", F.lit(1)), fitted, "all").first()
    assert abs(whole["effect"] - 2) < 0.3


def test_splits_equal_a_plain_loop(spark, forest):
    """Every split of some trees, by the sums of rows that a plain loop sends to the node."""
    _, residuals, fitted = forest
    got = residuals.select(F.xxhash64("id").alias("h"), "a", "b", "_d", "_y").toPandas()
    x, d, y = got[["a", "b"]].to_numpy(), got["_d"].to_numpy(), got["_y"].to_numpy()
    grown = fitted.trees
    roles = trees._roles(got["h"].to_numpy(), 80, 4, 7)
    assert (roles[:, 0] > 0).tolist() == (roles[:, 3] > 0).tolist() != (roles[:, 4] > 0).tolist()  # a bag shares its half-sample
    for t in (0, 5, 41):
        todo = [(0, np.flatnonzero(roles[:, t] > 0), 0)]
        while todo:
            node, own, level = todo.pop()
            ones, twos = own[roles[own, t] == 1], own[roles[own, t] == 2]
            if level == 3 or grown.feature[t, node] < 0:
                assert grown.sums["cross"][t, node] == pytest.approx((d[twos] * y[twos]).mean())
                if level == 3:
                    continue
            effect = (d[ones] * y[ones]).sum() / (d[ones] ** 2).sum()
            rho = d[ones] * (y[ones] - effect * d[ones])
            best, best_score = None, 0.0
            for f in range(2):
                for k, cut in enumerate(grown.cuts[f]):
                    left, left2 = x[ones, f] <= cut, x[twos, f] <= cut
                    if min(left.sum(), (~left).sum(), left2.sum(), (~left2).sum()) < 10:
                        continue
                    score = rho[left].sum() ** 2 / left.sum() + rho[~left].sum() ** 2 / (~left).sum()
                    if score > best_score * (1 + 1e-9):
                        best, best_score = (f, k), score
            if best is None:
                assert grown.feature[t, node] == -1
                continue
            assert (grown.feature[t, node], grown.bin[t, node]) == best
            right = x[own, best[0]] > grown.cuts[best[0]][best[1]]
            todo += [(2 * node + 1, own[~right], level + 1), (2 * node + 2, own[right], level + 1)]


def test_forest_is_the_same_by_tasks_and_in_other_partitions(spark, forest, monkeypatch):
    _, residuals, fitted = forest
    monkeypatch.setattr(trees, "DRIVER_CELLS", 0)
    monkeypatch.setattr(trees, "TASK_CELLS", 2_000)
    monkeypatch.setattr(trees, "TASK_ROWS", 300)
    again = trees.causal_forest(residuals.repartition(5), ["a", "b"], ["id"], trees=80, depth=3)
    assert (again.trees.feature == fitted.trees.feature).all() and (again.trees.bin == fitted.trees.bin).all()
    assert np.allclose(again.trees.sums["cross"], fitted.trees.sums["cross"], equal_nan=True)


def test_nothing_to_fit(spark):
    few = rows_of(spark, 60)
    assert trees.causal_forest(few.withColumns({"_d": F.col("t"), "_y": F.col("y")}), ["a"], ["id"]) is None
    assert models.dml_residuals(few.limit(0), "y", "t", ["a"], ["id"]) is None
    assert trees.boost(few.limit(0), ["a"], "y", ["id"]) is None
    constant = few.withColumns({"a": F.lit(1.0), "y": F.lit(2.0)})
    model = trees.boost(constant, ["a"], "y", ["id"], rounds=2)
    assert {r["predicted"] for r in trees.boosted_predictions(constant, model, ["id"]).collect()} == {2.0}


def test_one_boosted_tree_equals_brute_force(spark):
    df = rows_of(spark, 400, seed=3)
    model = trees.boost(df, ["a", "b", "t"], "y", ["id"], rounds=1, depth=3, row_share=1.0, column_share=1.0, rate=0.5)
    got = df.orderBy("id").toPandas()
    x, y = got[["a", "b", "t"]].to_numpy(), got["y"].to_numpy()
    grown, which = model.trees, model.models - 1
    g = model.base[which] - y
    assert model.base[which] == pytest.approx(y.mean())
    todo = [(0, np.arange(len(y)), 0)]
    while todo:
        node, own, level = todo.pop()
        score = lambda s: g[s].sum() ** 2 / (len(s) + 1)
        best, best_gain = None, 0.0
        for f in range(3):
            for k, cut in enumerate(grown.cuts[f]):
                left, right = own[x[own, f] <= cut], own[x[own, f] > cut]
                gain = score(left) + score(right) - score(own) if len(left) and len(right) else 0.0
                if gain > best_gain * (1 + 1e-9):
                    best, best_gain = (f, k), gain
        if level == 3 or best is None:
            assert grown.feature[which, node] == -1 and grown.sums["value"][which, node] == pytest.approx(-0.5 * g[own].sum() / (len(own) + 1))
            continue
        assert (grown.feature[which, node], grown.bin[which, node]) == best
        right = x[own, best[0]] > grown.cuts[best[0]][best[1]]
        todo += [(2 * node + 1, own[~right], level + 1), (2 * node + 2, own[right], level + 1)]


def test_folds_grow_side_by_side_and_predict_what_they_have_not_seen(spark):
    df = rows_of(spark, 600, seed=4).withColumn("fold", (F.col("id") % 3).cast("int"))
    args = dict(rounds=25, depth=3, every=4, keys=["id"], features=["a", "b", "t"], label="y")
    model = trees.boost(df, fold="fold", **args)
    assert model.models == 4
    held = trees.boosted_predictions(df, model, ["id", "y"], "fold").toPandas()
    fit = trees.boosted_predictions(df, model, ["id", "y"]).toPandas()
    share = lambda p: 1 - ((p["y"] - p["predicted"]) ** 2).mean() / p["y"].var(ddof=0)
    assert 0.6 < share(held) < share(fit)
    moved = df.withColumn("y", F.when(F.col("fold") == 1, 1e6).otherwise(F.col("y")))
    other = trees.boost(moved, fold="fold", **args)
    own = slice(1, None, 4)
    assert (other.trees.feature[own] == model.trees.feature[own]).all() and np.allclose(other.trees.sums["value"][own], model.trees.sums["value"][own])
    whole = trees.boost(df, **args | {"every": 1_000})
    assert whole.models == 1 and (whole.trees.feature == model.trees.feature[3::4]).all()


def test_small_tables_are_boosted_in_few_jobs_with_the_same_trees(spark, monkeypatch):
    df = rows_of(spark, 600, seed=9).withColumn("fold", (F.col("id") % 3).cast("int"))
    args = dict(rounds=12, depth=3, every=4, keys=["id"], features=["a", "b", "t"], label="y", fold="fold")
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    before = jobs()
    small = trees.boost(df, **args)
    assert jobs() - before < args["rounds"]
    monkeypatch.setattr(trees, "TASK_ROWS", 100)
    large = trees.boost(df, **args)
    assert (small.trees.feature == large.trees.feature).all() and (small.trees.bin == large.trees.bin).all()
    assert np.allclose(small.trees.sums["value"], large.trees.sums["value"]) and np.allclose(small.base, large.base)


def brute_force(nodes, weights, row, features):
    """Shapley values from the expected prediction with each subset of features known."""

    def expected(tree, node, known):
        _, _, f, cut, left, right, value, cover = tree[node]
        if f < 0:
            return value
        if f in known:
            return expected(tree, left if row[f] <= cut else right, known)
        return sum(tree[c][7] / cover * expected(tree, c, known) for c in (left, right))

    total = lambda known: sum(w * expected(t, 0, known) for t, w in zip(nodes, weights, strict=True))
    out = []
    for f in range(features):
        rest, value = [x for x in range(features) if x != f], 0.0
        for size in range(features):
            for some in itertools.combinations(rest, size):
                weight = math.factorial(size) * math.factorial(features - size - 1) / math.factorial(features)
                value += weight * (total({*some, f}) - total(set(some)))
        out.append(value)
    return out, total(set())


@pytest.mark.parametrize("kind", ["rf", "gbt", "own"])
def test_attributions_equal_all_subsets(spark, tmp_path, kind):
    features = ["a", "b", "t", "c"]
    df = rows_of(spark, 300, seed=5).withColumn("c", F.col("a") * F.col("b"))
    if kind == "own":
        model = trees.boost(df, features, "y", ["id"], rounds=4, depth=4)
        nodes, weights, offset = trees.boosted_nodes(df, model, model.models - 1), [1.0] * 4, float(model.base[-1])
        predicted = trees.boosted_predictions(df, model, ["id"]).withColumnRenamed("predicted", "p")
    else:
        vectors = VectorAssembler(inputCols=features, outputCol="x").transform(df)
        common = dict(featuresCol="x", labelCol="y", predictionCol="p", maxDepth=4, seed=1)
        fitted = (RandomForestRegressor(numTrees=4, **common) if kind == "rf" else GBTRegressor(maxIter=3, **common)).fit(vectors)
        nodes, offset = trees.mllib_nodes(fitted, str(tmp_path / kind)), 0.0
        weights = [1 / 4] * 4 if kind == "rf" else list(fitted.treeWeights)
        predicted = fitted.transform(vectors).select("id", "p")
    paths = trees.paths_of(nodes, features, weights)
    found = trees.attributions(df.union(df.limit(1).withColumns({"id": F.lit(-1).cast("long"), "a": F.lit(None).cast("double")})), paths, ["id"], offset).join(predicted, "id", "left").toPandas().set_index("id")
    assert found.loc[-1, [f"shap_{c}" for c in features]].isna().all()
    found = found.drop(-1)
    assert np.allclose(found[[f"shap_{c}" for c in features]].sum(axis=1) + found["base"], found["p"])
    by_tree = {}
    for r in nodes.collect():
        by_tree.setdefault(r["tree"], {})[r["node"]] = tuple(r)
    x = df.orderBy("id").toPandas()[features].to_numpy()
    for i in (0, 17, 123):
        want, base = brute_force([by_tree[t] for t in sorted(by_tree)], weights, x[i], 4)
        assert np.allclose(found.loc[i, [f"shap_{c}" for c in features]].to_numpy(float), want) and found.loc[i, "base"] == pytest.approx(base + offset)
    mean = {r["feature"]: r["importance"] for r in trees.mean_attributions(trees.attributions(df, paths, ["id"]), features).collect()}
    assert mean["t"] == pytest.approx(found["shap_t"].abs().mean())

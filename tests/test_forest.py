import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from geoscope.operators import forest, ml


def gini(counts):
    total = sum(counts)
    return 1 - sum((c / total) ** 2 for c in counts) if total else 0.0


@pytest.mark.parametrize("dense", [True, False])
def test_root_split_is_the_best_one(dense, monkeypatch):
    """Of a class tree and of a number tree, against all splits tried one by one; with few nodes and rows at a time."""
    monkeypatch.setattr(forest, "SUMS", 1)
    monkeypatch.setattr(forest, "TOGETHER", 7)
    monkeypatch.setattr(forest, "DENSE", 1 << 24 if dense else 0)
    rng, sizes = np.random.default_rng(4), [4, 3]
    codes = rng.integers(0, 12, 60)
    labels = ((codes // 3 >= 2) ^ (rng.random(60) < 0.2)).astype(np.uint32) + (codes % 3 == 0)
    weights = rng.integers(1, 4, 60).astype(np.uint32)
    bins = np.stack(np.unravel_index(codes, sizes), axis=1)
    tree = forest.Tree(codes, labels.astype(np.uint32), weights, sizes, 3, 2, 3, [1, 0])
    gains = {}
    for f, size in enumerate(sizes):
        for cut in range(size - 1):
            sides = [[weights[(labels == c) & ((bins[:, f] <= cut) == left)].sum() for c in range(3)] for left in (True, False)]
            whole = [a + b for a, b in zip(*sides)]
            gains[f, cut] = gini(whole) - sum(sum(s) * gini(s) for s in sides) / sum(whole)
    assert (tree.feature[0], tree.bin[0]) == max(gains, key=gains.get) and tree.gain[0] == pytest.approx(max(gains.values()))
    inner = [k for k in range(len(tree.stats)) if tree.left[k] >= 0]
    assert len(inner) > 1 and all(np.array_equal(tree.stats[k], tree.stats[tree.left[k]] + tree.stats[tree.right[k]]) for k in inner)
    y, w = labels * 1.5 + codes, weights.astype(float)
    numbers = forest.Tree(codes, None, np.stack([w, w * y, w * y * y]), sizes, None, 2, 1, [1, 0])
    variance = lambda m: np.average((y[m] - np.average(y[m], weights=w[m])) ** 2, weights=w[m]) * w[m].sum() if m.any() else 0.0
    left = {(f, cut): variance(bins[:, f] <= cut) + variance(bins[:, f] > cut) for f, size in enumerate(sizes) for cut in range(size - 1)}
    assert (numbers.feature[0], numbers.bin[0]) == min(left, key=left.get) and len(numbers.stats) == 3


def test_draws_are_those_of_rows():
    """A count of n is taken as often as n rows that are drawn one by one: on average n times, with a variance of n."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"code": [5, 5, 9], "label": [0.0, 1.0, 1.0], "n": [1, 400, 30]})
    forest.TaskContext.get, kept = staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()), forest.TaskContext.get
    try:
        drawn = [r.to_pylist()[0] for r in forest._drawer(500, 42, 2)([batch.slice(0, 1), batch.slice(1)])]
    finally:
        forest.TaskContext.get = kept
    big = [dict(zip(np.frombuffer(d["codes"], np.int64) * 2 + np.frombuffer(d["labels"], np.uint32), np.frombuffer(d["weights"], np.uint32))) for d in drawn]
    for key, n in ((10, 1), (11, 400), (19, 30)):
        found = np.array([b.get(key, 0) for b in big], float)
        assert abs(found.mean() - n) < 5 * math.sqrt(n / 500) and 0.75 * n < found.var() < 1.3 * n


def test_forest_does_not_depend_on_how_rows_lie(make_obs):
    rng = random.Random(6)
    rows = [{"reclat": rng.uniform(-80, 80), "reclong": rng.uniform(-180, 180), "mass_g": rng.uniform(1, 900), "recclass": rng.choice("ABC")} for _ in range(300)]
    for train in (ml.train_mass_model, ml.train_class_model):
        one, other = (train(make_obs(rows).repartition(n), num_trees=4, max_depth=4) for n in (1, 7))
        assert one.score == other.score and one.pipeline.stages[2].toDebugString == other.pipeline.stages[2].toDebugString.replace(
            other.pipeline.stages[2].uid, one.pipeline.stages[2].uid
        )


def test_as_good_as_the_forest_of_rows(spark):
    """Scores, sizes and importances of both on noisy rows that repeat; null-free, with a constant and a two-valued feature."""
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(1500):
        a, b = float(rng.integers(0, 40)), float(rng.integers(0, 2))
        rows.append((Vectors.dense([a, b, 3.0, rng.normal()]), float((a > 17) != (rng.random() < 0.1)), a * a / 100 + 3 * b + rng.normal()))
    frame = spark.createDataFrame(rows, ["features", "label", "number"])
    settings = {"numTrees": 20, "maxDepth": 5, "seed": 42, "maxBins": 32}
    for plain, classes, target in ((RandomForestClassifier(labelCol="label", **settings), 2, "label"), (RandomForestRegressor(labelCol="number", featureSubsetStrategy="all", **settings), None, "number")):
        models = [plain.fit(frame), forest.CountedForest(plain, classes).fit(frame)]
        error = [m.transform(frame).agg(F.avg(F.abs(F.col("prediction") - F.col(target)))).first()[0] for m in models]
        assert error[1] == pytest.approx(error[0], rel=0.1, abs=0.01)
        weights = [m.featureImportances.toArray() for m in models]
        assert np.abs(weights[0] - weights[1]).max() < 0.08 and weights[1][2] == 0
        assert type(models[0]) is type(models[1]) and models[1].getNumTrees == 20
        assert models[1].totalNumNodes == pytest.approx(models[0].totalNumNodes, rel=0.25)

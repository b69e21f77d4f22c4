"""Random forests from counted bins.

A forest looks at a row only through the bins of its features, and at its label. So rows are counted by their bins
and label first, and each tree draws how often it takes the rows of a count: the sum of their Poisson draws is one
Poisson draw of that mean, so this is the bootstrap of rows. For a number as label, a tree keeps weight, sum and
sum of squares for each combination of bins. A tree is then grown by one task from its own counts, level by level,
with numpy; no level goes over the rows again. The shuffle holds a tree's counts once: at most as many as rows, and as
combinations of bins (and classes).

Thresholds, impurities, feature subsets of a node, minimum gain, leaves and pruning are those of MLlib, and the result is
an MLlib model. Draws depend on seed, tree and counts only, not on how rows lie in tasks.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a task that counts and draws, counts that are drawn at once, and counts that a level looks at together.
TASK_ROWS, PIECE, TOGETHER = 200_000, 1 << 16, 1 << 20
#: Sums of a level's nodes held at once, and combinations of bins up to which a tree numbers them without looking.
SUMS, DENSE = 1 << 22, 1 << 24
#: Gains and impurities below are rounding.
ROUNDING = 1e-12

_DRAWN = "tree int, part int, piece int, codes binary, labels binary, weights binary"
_NODES = (
    "tree int, id int, prediction double, impurity double, stats array<double>, weight bigint, gain double, "
    "`left` int, `right` int, feature int, bin int"
)


class CountedForest(Estimator):
    """Fits the model of the given MLlib forest. ``classes``: the number of classes, or none for a regressor."""

    def __init__(self, forest, classes: int | None = None):
        super().__init__()
        self.forest, self.classes = forest, classes

    def _fit(self, dataset: DataFrame):
        forest, spark = self.forest, dataset.sparkSession
        trees, seed = forest.getNumTrees(), forest.getSeed()
        rows = dataset.select(vector_to_array(forest.getFeaturesCol()).alias("x"), F.col(forest.getLabelCol()).cast("double").alias("label"))
        total, features = rows.agg(F.count("*"), F.first(F.size("x"))).first()
        if not total:
            raise ValueError("a forest needs at least one row")
        cuts = _cuts(rows, features, forest.getMaxBins())
        thresholds = _thresholds(rows, cuts)
        sizes = [len(c) + 1 for c in cuts]
        parts = -(-total // TASK_ROWS)
        by = ["code"] if self.classes is None else ["code", "label"]
        counted = _coded(rows, cuts, sizes).repartition(parts, *by).groupBy("code", "label").agg(F.count("*").alias("n"))
        drawn = counted.sortWithinPartitions("code", "label").mapInArrow(_drawer(trees, seed, self.classes), _DRAWN)
        dealt = drawn.repartition(trees, "tree").sortWithinPartitions("tree", "part", "piece")
        subset = _subset(forest.getFeatureSubsetStrategy(), features, self.classes, trees)
        grown = dealt.mapInArrow(_grower(sizes, self.classes, subset, forest.getMaxDepth(), seed), _NODES)
        return _model(spark, forest, self.classes, features, grown, thresholds)


def _subset(strategy: str, features: int, classes: int | None, trees: int) -> int:
    """How many features a node looks at, as MLlib reads the strategy."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "onethird" if classes is None else "sqrt"
    return {"all": features, "onethird": math.ceil(features / 3), "sqrt": math.ceil(math.sqrt(features)), "log2": max(1, math.ceil(math.log2(features)))}[strategy]


def _cuts(rows: DataFrame, features: int, max_bins: int) -> list[np.ndarray]:
    """Values of each feature after which a bin ends: quantiles of all rows."""
    columns = [f"x{k}" for k in range(features)]
    steps = [i / max_bins for i in range(1, max_bins)]
    found = rows.select(*[F.col("x")[k].alias(c) for k, c in enumerate(columns)]).approxQuantile(columns, steps, 0.1 / max_bins)
    return [np.array(sorted(set(filter(math.isfinite, f))) or [0.0]) for f in found]


def _matrix(batch: pa.RecordBatch, features: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, features)


def _thresholds(rows: DataFrame, cuts: list[np.ndarray]) -> list[list[float]]:
    """The thresholds that go with the cuts: half way to the next larger value."""

    def least(batches):
        found = [np.full(len(c) + 1, np.inf) for c in cuts]
        for batch in batches:
            for k, x in enumerate(_matrix(batch, len(cuts)).T):
                np.fmin.at(found[k], np.searchsorted(cuts[k], x), x)
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(cuts)), pa.int32()), "least": pa.array([f.tolist() for f in found])})

    schema = "k int, least array<double>"
    out = [np.full(len(c) + 1, np.inf) for c in cuts]
    for k, found in rows.select("x").mapInArrow(least, schema).collect():
        out[k] = np.fmin(out[k], found)
    return [[c + (n - c) / 2 if n < np.inf else c for c, n in zip(cut.tolist(), np.fmin.accumulate(o[::-1])[::-1][1:].tolist())] for cut, o in zip(cuts, out)]


def _coded(rows: DataFrame, cuts: list[np.ndarray], sizes: list[int]) -> DataFrame:
    """The combination of bins of each row as one number."""

    def code(batches):
        for batch in batches:
            numbers = np.zeros(batch.num_rows, np.int64)
            for x, cut, size in zip(_matrix(batch, len(cuts)).T, cuts, sizes):
                numbers = numbers * size + np.searchsorted(cut, x)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), batch.column("label")], ["code", "label"])

    return rows.mapInArrow(code, "code bigint, label double")


def _pieces(batches):
    """Batches as pieces of ``PIECE`` rows, the last one shorter, however they were cut."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        while rows >= PIECE:
            whole = pa.Table.from_batches(held)
            yield whole.slice(0, PIECE)
            held, rows = whole.slice(PIECE).to_batches(), rows - PIECE
    if rows:
        yield pa.Table.from_batches(held)


def _drawer(trees: int, seed: int, classes: int | None):
    """Each tree's draws of a piece of counts."""

    def draw(batches):
        part = TaskContext.get().partitionId()
        for piece, table in enumerate(_pieces(batches)):
            codes, labels, n = (table.column(c).to_numpy() for c in ("code", "label", "n"))
            if classes is None:
                own, starts = np.unique(codes, return_index=True)
            else:
                labels = labels.astype(np.uint32)  # classes of a StringIndexer, so whole numbers
            for tree in range(trees):
                weights = np.random.default_rng([seed & 0xFFFFFFFF, tree, part, piece]).poisson(n)
                if classes is None:
                    w = weights.astype(np.float64)
                    sums = np.stack([np.add.reduceat(v, starts) for v in (w, w * labels, w * labels * labels)])
                    some = sums[0] > 0
                    out = own[some].tobytes(), b"", sums[:, some].tobytes()
                else:
                    some = weights > 0
                    out = codes[some].tobytes(), labels[some].tobytes(), weights[some].astype(np.uint32).tobytes()
                row = dict(zip(("tree", "part", "piece", "codes", "labels", "weights"), (tree, part, piece, *out)))
                kinds = [pa.int32()] * 3 + [pa.binary()] * 3
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))

    return draw


def _grower(sizes: list[int], classes: int | None, subset: int, max_depth: int, seed: int):
    def grow(batches):
        now, held = None, []

        def grown():
            codes = np.concatenate([np.frombuffer(h[0], np.int64) for h in held])
            if classes is None:
                labels, weights = None, np.concatenate([np.frombuffer(h[2]).reshape(3, -1) for h in held], axis=1)
            else:
                labels, weights = (np.concatenate([np.frombuffer(h[k], np.uint32) for h in held]) for k in (1, 2))
            held.clear()
            return _rows(now, Tree(codes, labels, weights, sizes, classes, subset, max_depth, [seed & 0xFFFFFFFF, now]))

        for batch in batches:
            for row in range(batch.num_rows):
                tree = batch.column("tree")[row].as_py()
                if held and tree != now:
                    yield grown()
                now = tree
                held.append([batch.column(c)[row].as_py() for c in ("codes", "labels", "weights")])
        if held:
            yield grown()

    return grow


class Tree:
    """A tree grown from the weights of combinations of bins (and labels)."""

    def __init__(self, codes, labels, weights, sizes: list[int], classes: int | None, subset: int, max_depth: int, seed: list[int]):
        self.labels, self.classes, self.width = labels, classes, max(sizes)
        space = math.prod(sizes)
        if space <= min(DENSE, 4 * len(codes)):
            cells, at = np.arange(space), codes.astype(np.int32)
        else:
            cells, at = np.unique(codes, return_inverse=True)
            at = at.astype(np.int32)
        self.bins = np.stack(np.unravel_index(cells, sizes), axis=1).astype(np.min_scalar_type(self.width)) if len(cells) else np.zeros((0, len(sizes)), np.uint8)
        if classes is None:
            self.weights = np.stack([np.bincount(at, w, len(cells)) for w in weights])
            self.at = None
        else:
            self.weights, self.at = weights, at
        self.rng, self.subset = np.random.default_rng(seed), subset
        self.kinds = 3 if classes is None else classes
        self.stats: list[np.ndarray] = []
        self.feature, self.bin, self.left, self.right, self.gain = [], [], [], [], []
        self._grow(max_depth)

    def _sums(self, key: np.ndarray, size: int) -> np.ndarray:
        """Sums by the key of each cell, for keys below ``size``, each for every statistic. Key ``size`` is left out."""
        if self.classes is None:
            return np.stack([np.bincount(key, w, size + 1)[:size] for w in self.weights], axis=-1)
        wide, out = key * self.kinds, np.zeros((size + 1) * self.kinds)
        for a in range(0, len(self.at), TOGETHER):
            found = wide.take(self.at[a : a + TOGETHER])
            found += self.labels[a : a + TOGETHER]
            out += np.bincount(found, self.weights[a : a + TOGETHER], len(out))
        return out[: size * self.kinds].reshape(size, self.kinds)

    def _impurity(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gini impurity or variance, and weight."""
        if self.classes is None:
            w = stats[..., 0]
            some = np.where(w > 0, w, 1.0)
            return np.where(w > 0, (stats[..., 2] - stats[..., 1] ** 2 / some) / some, 0.0), w
        w = stats.sum(axis=-1)
        some = np.where(w > 0, w, 1.0)
        return np.where(w > 0, 1.0 - np.einsum("...k,...k->...", stats, stats) / (some * some), 0.0), w

    def _add(self, stats: np.ndarray) -> int:
        self.stats.append(stats)
        for column, value in ((self.feature, -1), (self.bin, -1), (self.left, -1), (self.right, -1), (self.gain, -1.0)):
            column.append(value)
        return len(self.stats) - 1

    def _grow(self, max_depth: int) -> None:
        root = self._sums(np.zeros(len(self.bins), np.int64), 1)[0]
        frontier = [self._add(root)]
        least = ROUNDING * max(1.0, float(np.abs(root).max()) / max(float(self._impurity(root)[1]), 1.0)) if self.classes is None else ROUNDING
        if self._impurity(root)[0] <= least:
            return
        node = np.zeros(len(self.bins), np.int32)  # of each cell: its place in the frontier, or below zero
        for depth in range(max_depth):
            if not frontier:
                return
            gain, feature, cut, left, right = self._best(node, len(frontier))
            following, goes = [], np.full((len(frontier), 2), -1, np.int32)
            for k, own in enumerate(frontier):
                if not gain[k] > least:
                    continue
                self.feature[own], self.bin[own], self.gain[own] = int(feature[k]), int(cut[k]), float(gain[k])
                children = [self._add(left[k].copy()), self._add(right[k].copy())]
                self.left[own], self.right[own] = children
                for side, child in enumerate(children):
                    if depth + 1 < max_depth and self._impurity(self.stats[child])[0] > least:
                        goes[k, side] = len(following)
                        following.append(child)
            inside = np.flatnonzero(node >= 0)
            at = node[inside]
            after = (self.bins[inside, feature[at]] > cut[at]).astype(np.int64)
            node[inside] = goes[at, after]
            frontier = following

    def _best(self, node: np.ndarray, nodes: int):
        """The best split of each node of the frontier: gain, feature, last bin on the left, statistics of both sides."""
        features = self.bins.shape[1]
        asked = np.sort(np.argsort(self.rng.random((nodes, features)), axis=1)[:, : self.subset], axis=1)
        gain, feature, cut = np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        left, right = np.zeros((nodes, self.kinds)), np.zeros((nodes, self.kinds))
        flat, width = self.bins.reshape(-1), self.width
        per = max(1, SUMS // (width * self.kinds * self.subset))
        for first in range(0, nodes, per):
            until = min(nodes, first + per)
            size = (until - first) * width
            inside = np.flatnonzero((node >= first) & (node < until))
            place = node[inside]
            start, row = inside * features, (place - first) * np.int64(width)
            here = np.arange(until - first)
            for s in range(self.subset):
                key = np.full(len(node), size, np.int64)
                key[inside] = row + flat.take(start + asked[:, s].take(place))
                upto = self._sums(key, size).reshape(-1, width, self.kinds).cumsum(axis=1)
                whole, below = upto[:, -1:], upto[:, :-1]
                above = whole - below
                (i, w), (i_below, w_below), (i_above, w_above) = map(self._impurity, (whole, below, above))
                gains = i - (w_below * i_below + w_above * i_above) / np.where(w > 0, w, 1.0)
                gains = np.where((w_below >= 1) & (w_above >= 1), gains, -np.inf)
                best = gains.argmax(axis=1)
                better = np.flatnonzero(gains[here, best] > gain[first:until])
                into = first + better
                gain[into], feature[into], cut[into] = gains[better, best[better]], asked[into, s], best[better]
                left[into], right[into] = below[better, best[better]], above[better, best[better]]
        return gain, feature, cut, left, right


def _rows(number: int, tree: Tree) -> pa.RecordBatch:
    """The nodes of a tree, pruned where both leaves of a node predict the same."""
    stats = np.array(tree.stats)
    impurity, weight = tree._impurity(stats)
    if tree.classes is None:
        prediction = np.where(weight > 0, stats[:, 1] / np.where(weight > 0, weight, 1.0), 0.0)
    else:
        prediction = stats.argmax(axis=1).astype(np.float64)
    left, right = np.array(tree.left), np.array(tree.right)
    for k in range(len(left) - 1, -1, -1):  # children come after their parent
        a, b = left[k], right[k]
        if a >= 0 and left[a] < 0 and left[b] < 0 and prediction[a] == prediction[b]:
            left[k] = right[k] = -1
    kept = np.zeros(len(left), bool)
    kept[0] = True
    for k in range(len(left)):
        if kept[k] and left[k] >= 0:
            kept[left[k]] = kept[right[k]] = True
    place = np.append(np.cumsum(kept) - 1, -1)  # a leaf's -1 is the last
    inner, own = left >= 0, np.flatnonzero(kept)
    columns = [
        pa.array(np.full(len(own), number), pa.int32()),
        pa.array(place[own], pa.int32()),
        pa.array(prediction[own]),
        pa.array(np.maximum(impurity[own], 0.0)),
        pa.array(stats[own].tolist(), pa.list_(pa.float64())),
        pa.array(weight[own].astype(np.int64)),
        pa.array(np.where(inner, tree.gain, -1.0)[own]),
        pa.array(place[left[own]], pa.int32()),
        pa.array(place[right[own]], pa.int32()),
        pa.array(np.where(inner, tree.feature, -1)[own], pa.int32()),
        pa.array(np.where(inner, tree.bin, -1)[own], pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["tree", "id", "prediction", "impurity", "stats", "weight", "gain", "left", "right", "feature", "bin"])


def _model(spark: SparkSession, forest, classes: int | None, features: int, grown: DataFrame, thresholds: list[list[float]]):
    """The nodes as an MLlib model: MLlib stores a forest of two rows, its nodes are written in their place, and MLlib loads it."""
    rows = [(Vectors.dense([float(k)] * features), float(k * ((classes or 2) - 1))) for k in range(2)]
    stored = forest.fit(spark.createDataFrame(rows, [forest.getFeaturesCol(), forest.getLabelCol()]))
    folder = (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/shared").rstrip("/")
    path = f"{folder}/forest-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.deleteOnExit(place)
    stored.save(path)
    schema = spark.read.parquet(f"{path}/data").schema
    cuts = F.array(*[F.array(*map(F.lit, found)) for found in thresholds])
    inner = F.col("feature") >= 0
    at = F.when(inner, F.array(F.get(F.get(cuts, F.col("feature")), F.col("bin")))).otherwise(F.array().cast("array<double>"))
    split = F.struct(F.col("feature").alias("featureIndex"), at.alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    node = F.struct(
        "id", "prediction", "impurity", F.col("stats").alias("impurityStats"), F.col("weight").alias("rawCount"), "gain",
        F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"),
    )
    nodes = grown.select(F.col("tree").alias("treeID"), node.alias("nodeData"))
    kinds = {f.name: f.dataType for f in schema}
    nodes.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()]).write.mode("overwrite").parquet(f"{path}/data")
    loaded = (RandomForestClassificationModel if isinstance(forest, RandomForestClassifier) else RandomForestRegressionModel).load(path)
    system.delete(place, True)
    return loaded

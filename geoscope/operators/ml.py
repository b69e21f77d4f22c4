"""Models of mass, class and place, trained, stored and applied with MLlib.

Training data is split by a digest of the record id, not by a random draw: the split is the same on
every recomputation, so a lost executor cannot move a row from the test to the training side.

A store keeps versions of a model. A new one is written whole under a name of its own and then published by
one rename; readers take the newest version that loads, so neither a writer that dies half way nor a
damaged version costs more than the step back to the version before.
"""

from __future__ import annotations

import logging
import math
import uuid
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Bucketizer, IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoscope.functions import clamp, fall_code
from geoscope.operators.filters import location_problem
from geoscope.operators.forest import CountedForest

MASS_FEATURES = ["reclat", "reclong", "year", "fall_code"]
CLASS_FEATURES = ["reclat", "reclong", "mass_g", "year", "fall_code"]

NUM_TREES = 100
# Deeper trees and more bins fit closer and cost more: a level can have 2 ** depth nodes, each with
# statistics for every bin of every feature. MLlib allows a depth of 30.
MAX_DEPTH, MAX_BINS = 10, 32
SEED = 42
TRAIN_PERCENT = 80
# Training rows of a task: MLlib holds each with its 100 bootstrap counts, some 500 bytes, while it trains.
TASK_ROWS = 1_000_000

# Bounds of predictions, what stands in for none, and the blend of both fall types.
MIN_PREDICTED_MASS, MAX_PREDICTED_MASS = 0.1, 10_000_000.0
DEFAULT_MASS = 10.0
FOUND_WEIGHT, FELL_WEIGHT = 0.6, 0.4
CLUSTERS = 5


@dataclass
class FittedModel:
    """A fitted pipeline and its score on the held-out rows (RMSE of log1p mass, or accuracy)."""

    kind: str
    pipeline: PipelineModel
    score: float


def ml_frame(obs: DataFrame) -> DataFrame:
    """Observations usable for training: all features present, fall one of Fell / Found."""
    return (
        obs.withColumn("fall_code", fall_code("fall").cast("double"))
        .withColumn("year", F.col("year").cast("double"))
        .dropna(subset=["reclat", "reclong", "year", "mass_g", "fall_code"])
    )


def class_codes(obs: DataFrame) -> DataFrame:
    """``ml_frame`` with ``recclass_code``: classes numbered by name."""
    frame = ml_frame(obs)
    indexer = StringIndexer(
        inputCol="recclass", outputCol="recclass_code", stringOrderType="alphabetAsc", handleInvalid="keep"
    )
    return indexer.fit(frame).transform(frame)


def split(frame: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a digest of ``id`` and seed: any ids, however far apart, spread evenly, and a record
    is on the same side at every run."""
    digest = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100
    return frame.filter(draw < TRAIN_PERCENT), frame.filter(draw >= TRAIN_PERCENT)


def _features(columns: list[str]) -> list:
    return [
        VectorAssembler(inputCols=columns, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
    ]


def in_bin_order(train: DataFrame, columns: list[str], max_bins: int = MAX_BINS) -> DataFrame:
    """The same rows, ranged and sorted by the bins that their features fall in, then by all columns.

    A forest takes every row to a node of every tree at every level and adds it up there. Rows of one bin meet the
    same nodes, so what one has brought into the processor's caches serves the next; in any other order nearly every
    tree of every row is a miss. A task's rows don't depend on the order in which a shuffle delivers them, so a
    task that is run again draws the same bootstrap counts. Equal bins may hold most rows: ranges go on by ``id``."""
    steps = [i / max_bins for i in range(1, max_bins)]
    cuts = [sorted(set(filter(math.isfinite, found))) or [0.0] for found in train.stat.approxQuantile(columns, steps, 0.1 / max_bins)]
    bins = [f"_bin_{c}" for c in columns]
    splits = [[-math.inf, *found, math.inf] for found in cuts]
    binned = Bucketizer(inputCols=columns, outputCols=bins, splitsArray=splits).transform(train)
    tasks = max(train.sparkSession.sparkContext.defaultParallelism, -(-train.count() // TASK_ROWS))
    return binned.repartitionByRange(tasks, *bins, "id").sortWithinPartitions(*bins, *train.columns).drop(*bins)


def _fit(stages: list, train: DataFrame, columns: list[str], max_bins: int) -> PipelineModel:
    """A pipeline fitted to rows in bin order. Its steps read them several times, so they are kept on disk meanwhile."""
    ordered = in_bin_order(train, columns, max_bins).persist(StorageLevel.DISK_ONLY)
    try:
        return Pipeline(stages=stages).fit(ordered)
    finally:
        ordered.unpersist()


def train_mass_model(
    obs: DataFrame, num_trees: int = NUM_TREES, max_depth: int = MAX_DEPTH, max_bins: int = MAX_BINS, seed: int = SEED
) -> FittedModel:
    """Random forest for log1p(mass) from place, year and fall."""
    columns = [*MASS_FEATURES, "log_target"]
    train, test = split(ml_frame(obs).withColumn("log_target", F.log1p("mass_g")).select("id", *columns), seed)
    forest = RandomForestRegressor(
        labelCol="log_target", numTrees=num_trees, maxDepth=max_depth, maxBins=max_bins, featureSubsetStrategy="all", seed=seed
    )
    fitted = _fit([*_features(MASS_FEATURES), CountedForest(forest)], train, MASS_FEATURES, max_bins)
    rmse = RegressionEvaluator(labelCol="log_target", metricName="rmse").evaluate(fitted.transform(test))
    return FittedModel("mass", fitted, rmse)


def train_class_model(
    obs: DataFrame, num_trees: int = NUM_TREES, max_depth: int = MAX_DEPTH, max_bins: int = MAX_BINS, seed: int = SEED
) -> FittedModel:
    """Random forest for the class from place, mass, year and fall. Held-out rows whose class does
    not occur in training count as errors."""
    train, test = split(ml_frame(obs).select("id", "recclass", *CLASS_FEATURES), seed)
    labels = StringIndexer(
        inputCol="recclass", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep"
    ).fit(train)
    forest = RandomForestClassifier(labelCol="label", numTrees=num_trees, maxDepth=max_depth, maxBins=max_bins, seed=seed)
    names = IndexToString(inputCol="prediction", outputCol="predicted_class", labels=[*labels.labels, "__unseen"])
    fitted = _fit([*_features(CLASS_FEATURES), CountedForest(forest, len(labels.labels) + 1), names], labels.transform(train), CLASS_FEATURES, max_bins)
    scored = labels.transform(fitted.transform(test))
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(scored)
    return FittedModel("class", fitted, accuracy)


def model_report(fitted: FittedModel, spark: SparkSession) -> DataFrame:
    metric = {"mass": "rmse", "class": "accuracy"}[fitted.kind]
    return spark.createDataFrame([(fitted.kind, metric, fitted.score)], "model string, metric string, score double")


# Applying -------------------------------------------------------------------------------------------


def request_problem() -> Column:
    """Why a request (lat, lon, year, fall) cannot be predicted; null when it can."""
    return (
        F.when(F.col("lat").isNull() | F.col("lon").isNull(), "coordinates")
        .when(F.col("year").isNull(), "year")
        .when(~F.coalesce(F.col("fall").isin("Fell", "Found"), F.lit(False)), "fall")
    )


def predict_mass(model: FittedModel, requests: DataFrame, default: float | None = None) -> DataFrame:
    """Predicted mass of each request, within [0.1 g, 10 t].

    Requests that cannot be predicted are left out (see ``invalid_requests``), or get ``default``.
    """
    valid = requests.filter(request_problem().isNull())
    named = valid.withColumns(
        {
            "reclat": F.col("lat").cast("double"),
            "reclong": F.col("lon").cast("double"),
            "fall_code": fall_code("fall").cast("double"),
        }
    )
    mass = clamp(F.expm1("prediction"), MIN_PREDICTED_MASS, MAX_PREDICTED_MASS)
    predicted = model.pipeline.transform(named).select(*requests.columns, mass.alias("predicted_mass"))
    if default is None:
        return predicted
    rest = requests.filter(request_problem().isNotNull())
    return predicted.unionByName(rest.withColumn("predicted_mass", F.lit(float(default))))


def invalid_requests(requests: DataFrame) -> DataFrame:
    return requests.withColumn("reason", request_problem()).filter(F.col("reason").isNotNull())


def predict_mass_blend(model: FittedModel, locations: DataFrame, as_of_year: int) -> DataFrame:
    """Predicted mass at the horizon of each location; detection 'all' blends .6 Found and .4 Fell.

    Both predictions are made on the same row, so nothing is shuffled. Locations that are not valid (coordinates,
    horizon or detection missing or out of range) are not predicted and get ``DEFAULT_MASS``;
    ``filters.quarantine_locations`` names them with the reason.
    """
    asked = locations.withColumn("year", F.lit(as_of_year) + F.col("horizon"))
    rows = asked.filter(location_problem().isNull())
    for fall in ("Found", "Fell"):
        rows = predict_mass(model, rows.withColumn("fall", F.lit(fall))).withColumnRenamed(
            "predicted_mass", f"mass_{fall.lower()}"
        )
    found, fell = F.col("mass_found"), F.col("mass_fell")
    blended = (
        F.when(F.col("detection") == "all", FOUND_WEIGHT * found + FELL_WEIGHT * fell)
        .when(F.col("detection") == "Found", found)
        .when(F.col("detection") == "Fell", fell)
    )
    predicted = rows.select("location_id", "detection", "year", blended.alias("predicted_mass"))
    rest = asked.filter(location_problem().isNotNull()).select("location_id", "detection", "year", F.lit(None).cast("double").alias("predicted_mass"))
    return predicted.unionByName(rest).withColumn("predicted_mass", F.coalesce("predicted_mass", F.lit(DEFAULT_MASS)))


def predict_class(model: FittedModel, frame: DataFrame) -> DataFrame:
    """Adds ``predicted_class`` to rows of ``ml_frame``."""
    return model.pipeline.transform(frame).select(*frame.columns, "predicted_class")


def feature_importance(model: FittedModel, spark: SparkSession, ascending: bool = False) -> DataFrame:
    importances = model.pipeline.stages[2].featureImportances.toArray()
    names = MASS_FEATURES if model.kind == "mass" else CLASS_FEATURES
    rows = [(name, float(value)) for name, value in zip(names, importances)]
    order = F.asc("importance") if ascending else F.desc("importance")
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(order, "feature")


def fit_clusters(obs: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> KMeansModel:
    """k-means over places. Equal coordinates enter once, weighted by their number of records."""
    places = obs.groupBy("reclat", "reclong").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    points = _place_vector().transform(places)
    return KMeans(k=k, seed=seed, featuresCol="place", weightCol="weight").fit(points)


def _place_vector() -> VectorAssembler:
    return VectorAssembler(inputCols=["reclat", "reclong"], outputCol="place")


def location_clusters(obs: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> DataFrame:
    """Every observation with the number of its place cluster."""
    located = _place_vector().transform(obs)
    return fit_clusters(obs, k, seed).transform(located).drop("place").withColumnRenamed("prediction", "cluster")


# Storing ----------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(kind: str, path: str, spark: SparkSession) -> list[int]:
    """Published versions of a kind of model, newest first."""
    system, place = _folder(spark, f"{path}/{kind}")
    if not system.exists(place):
        return []
    names = [status.getPath().getName() for status in system.listStatus(place)]
    return sorted((int(name[1:]) for name in names if name[:1] == "v" and name[1:].isdigit()), reverse=True)


def save_model(model: FittedModel, path: str, spark: SparkSession) -> int:
    """Stores a model as the newest version of its kind and returns its number. The pipeline and a row of metadata
    are written aside and published together by one rename; of two writers with one number the second
    takes the next."""
    aside = f"{path}/{model.kind}/writing-{uuid.uuid4().hex}"
    model.pipeline.write().save(f"{aside}/pipeline")
    model_report(model, spark).withColumn("trained_at", F.current_timestamp()).write.json(f"{aside}/metadata")
    system, source = _folder(spark, aside)
    while True:
        number = max(versions(model.kind, path, spark), default=0) + 1
        _, target = _folder(spark, f"{path}/{model.kind}/v{number}")
        if not system.exists(target) and system.rename(source, target):
            return number


def load_version(kind: str, path: str, number: int, spark: SparkSession) -> FittedModel | None:
    """A stored version, or None when it is damaged or incomplete."""
    schema = "model string, metric string, score double, trained_at timestamp"
    place = f"{path}/{kind}/v{number}"
    try:
        stored = spark.read.schema(schema).json(f"{place}/metadata").first()
        if stored is None or stored["model"] != kind or stored["score"] is None:
            return None
        return FittedModel(kind, PipelineModel.load(f"{place}/pipeline"), stored["score"])
    except Exception as damage:  # noqa: BLE001 - a broken store shows as an error of any layer below
        logging.getLogger(__name__).warning("version %s of model %s does not load: %s", number, kind, str(damage)[:200])
        return None


def load_model(kind: str, path: str, spark: SparkSession) -> FittedModel | None:
    """The newest stored model of this kind that loads, or None when there is none."""
    found = (load_version(kind, path, number, spark) for number in versions(kind, path, spark))
    return next((model for model in found if model is not None), None)


def load_or_train(kind: str, path: str, obs: DataFrame, force: bool = False, **settings) -> FittedModel:
    """Use the stored model if there is one; otherwise, or with ``force``, train it and store it."""
    spark = obs.sparkSession
    model = None if force else load_model(kind, path, spark)
    if model is None:
        model = {"mass": train_mass_model, "class": train_class_model}[kind](obs, **settings)
        save_model(model, path, spark)
    return model

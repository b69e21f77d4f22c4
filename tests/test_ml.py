import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from geoscope.operators import ml
from geoscope.plans import model_queries

SMALL = {"num_trees": 5, "max_depth": 4}


@pytest.fixture
def signal(make_obs):
    """Mass depends on latitude, class on fall."""
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        lat, fell = rng.uniform(-80, 80), rng.random() < 0.5
        rows.append(
            {
                "reclat": lat, "reclong": rng.uniform(-180, 180), "mass_g": 10.0 if lat < 0 else 10000.0,
                "fall": "Fell" if fell else "Found", "recclass": "L6" if fell else "H5",
            }
        )
    return make_obs([*rows, {"fall": "Unknown"}])


def test_mass_model_beats_the_mean_and_survives_storage(signal, make_locations, spark, tmp_path):
    model = ml.train_mass_model(signal, **SMALL)
    assert model.score < 1.0  # the spread of log1p mass is about 3.4
    importance = ml.feature_importance(model, spark).collect()
    assert importance[0].feature == "reclat" and abs(sum(r.importance for r in importance) - 1) < 1e-9
    upwards = [r.importance for r in ml.feature_importance(model, spark, ascending=True).collect()]
    assert upwards == [r.importance for r in importance[::-1]]
    locs = make_locations([{"lat": a, "detection": d} for a in (-40.0, 40.0) for d in ("all", "Fell", "Found", "x")])
    first = {r.location_id: r for r in ml.predict_mass_blend(model, locs, 2025).collect()}
    assert set(first) == set(range(8)) and first[3].predicted_mass == first[7].predicted_mass == ml.DEFAULT_MASS
    assert first[4].predicted_mass > 50 * first[0].predicted_mass
    for k in (0, 4):
        blend = 0.6 * first[k + 2].predicted_mass + 0.4 * first[k + 1].predicted_mass
        assert first[k].predicted_mass == pytest.approx(blend)
    ml.save_model(model, str(tmp_path), spark)
    again = ml.load_or_train("mass", str(tmp_path), signal)
    assert ml.load_or_train("mass", str(tmp_path), signal, force=True, num_trees=2, max_depth=2).score != model.score
    assert again.score == model.score
    assert {r.location_id: r for r in ml.predict_mass_blend(again, locs, 2025).collect()} == first


def test_missing_store_trains_anew(signal, spark, tmp_path):
    assert ml.load_model("mass", str(tmp_path / "none"), spark) is None
    trained = ml.load_or_train("class", str(tmp_path), signal, **SMALL)
    assert ml.load_model("class", str(tmp_path), spark).score == trained.score
    assert trained.score > 0.95
    predicted = ml.predict_class(trained, ml.ml_frame(signal))
    assert predicted.filter("recclass = predicted_class").count() > 380


def test_invalid_requests_are_kept_apart_or_get_the_default(signal, spark):
    model = ml.train_mass_model(signal, **SMALL)
    rows = [(1, 1.0, 1.0, 2030, "Fell"), (2, None, 1.0, 2030, "Fell"), (3, 1.0, 1.0, None, "Found"), (4, 1.0, 1.0, 2030, "all")]
    requests = spark.createDataFrame(rows, "location_id long, lat double, lon double, year int, fall string")
    assert [r.location_id for r in ml.predict_mass(model, requests).collect()] == [1]
    filled = {r.location_id: r.predicted_mass for r in ml.predict_mass(model, requests, default=10.0).collect()}
    assert filled[2] == filled[3] == filled[4] == 10.0 and 0.1 <= filled[1] <= 1e7
    assert {r.location_id: r.reason for r in ml.invalid_requests(requests).collect()} == {
        2: "coordinates", 3: "year", 4: "fall",
    }


def test_split_is_stable_and_complete(signal):
    frame = ml.ml_frame(signal)
    train, test = ml.split(frame)
    moved_train, _ = ml.split(frame.repartition(7))
    ids = {r.id for r in train.collect()}
    assert ids == {r.id for r in moved_train.collect()}
    assert len(ids) + test.count() == frame.count() == 400


def test_split_of_far_and_of_regular_ids(spark):
    """Ids near 2**62, and ids that step by 100, spread like any others."""
    for ids in (range(2**62, 2**62 + 1000), range(0, 100_000, 100), range(-500, 500)):
        train, test = ml.split(spark.createDataFrame([(i,) for i in ids], "id long"))
        assert 750 <= train.count() <= 850 and train.count() + test.count() == 1000


def test_damaged_versions_fall_back(signal, spark, tmp_path):
    """Killed between steps, without pipeline, without metadata: the version before serves; then training does."""
    path = str(tmp_path)
    first = ml.train_mass_model(signal, num_trees=2, max_depth=2)
    second = ml.train_mass_model(signal, num_trees=3, max_depth=3)
    assert ml.save_model(first, path, spark) == 1 and ml.save_model(second, path, spark) == 2
    assert ml.load_model("mass", path, spark).score == second.score
    first.pipeline.write().save(f"{path}/mass/writing-dead/pipeline")  # a writer that never published
    assert ml.versions("mass", path, spark) == [2, 1]
    for f in (tmp_path / "mass/v2/pipeline/stages").glob("2_*/treesMetadata/*"):
        f.write_bytes(b"")
    for f in (tmp_path / "mass/v2/pipeline/stages").glob("2_*/treesMetadata/.*"):
        f.write_bytes(b"")
    assert ml.load_model("mass", path, spark).score == first.score
    (tmp_path / "mass/v3").mkdir()  # neither pipeline nor metadata
    assert ml.load_model("mass", path, spark).score == first.score
    for f in (tmp_path / "mass/v1/metadata").iterdir():
        f.write_bytes(b"")
    assert ml.load_model("mass", path, spark) is None
    trained = ml.load_or_train("mass", path, signal, **SMALL)
    assert ml.versions("mass", path, spark)[0] == 4 and ml.load_model("mass", path, spark).score == trained.score


def test_clusters_cover_every_record(make_obs):
    centres = [(0, 0), (60, 0), (-60, 0), (0, 120), (0, -120)]
    obs = make_obs([(a + i % 3, o + i % 2) for a, o in centres for i in range(20)])
    rows = ml.location_clusters(obs).collect()
    assert len(rows) == 100
    groups = {}
    for r in rows:
        groups.setdefault(r.cluster, set()).add((round(r.reclat / 60), round(r.reclong / 120)))
    assert len(groups) == 5 and all(len(g) == 1 for g in groups.values())


def test_locations_out_of_range_are_not_predicted(signal, make_locations):
    model = ml.train_mass_model(signal, **SMALL)
    locs = make_locations([{}, {"lat": 95.0}, {"lon": -181.0}, {"horizon": 0}, {"horizon": 51}, {"detection": "other"}, {"detection": None}])
    got = {r.location_id: r.predicted_mass for r in ml.predict_mass_blend(model, locs, 2025).collect()}
    assert set(got) == set(range(7)) and got[0] != ml.DEFAULT_MASS and {got[k] for k in range(1, 7)} == {ml.DEFAULT_MASS}


def test_class_check_does_not_deal_records_by_predicted_class(signal, spark, monkeypatch):
    """Nearly all records can have one predicted class; the plan of a large table is forced by the threshold."""
    model = ml.train_class_model(signal, **SMALL)
    monkeypatch.setattr(model_queries, "_model", lambda *_: model)
    monkeypatch.setattr(model_queries, "obs", lambda *_: signal)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        checked = model_queries._class_check(spark, "none")
        plan = checked._jdf.queryExecution().executedPlan().toString()
        rows = checked.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(predicted_class" not in plan
    assert len(rows) == 400 and all(r.is_known for r in rows)


@pytest.mark.parametrize("train", [ml.train_mass_model, ml.train_class_model])
def test_forests_are_trained_in_bin_order(train, make_obs, monkeypatch):
    """Rows of one bin follow one another, none is lost or added, and a spot with nearly all rows is dealt by id."""
    rng = random.Random(2)
    rows = [
        {"reclat": rng.choice([-60.0, -10.0, 5.0, 70.0]), "fall": rng.choice(["Fell", "Found"]), "recclass": rng.choice(["L6", "H5"])} for _ in range(400)
    ]
    seen, fit = [], ml.Pipeline.fit

    def spy(pipeline, rows):
        seen.append(rows.withColumn("task", F.spark_partition_id()).collect())
        return fit(pipeline, rows)

    monkeypatch.setattr(ml.Pipeline, "fit", spy)
    spots = [make_obs(rows), make_obs([{}] * 500 + [{"reclat": 1.0, "mass_g": 20.0}])]
    for obs in spots:
        train(obs, **SMALL)
    for obs, got in zip(spots, seen, strict=True):
        assert sorted(r.id for r in got) == sorted(r.id for r in ml.split(ml.ml_frame(obs))[0].collect())
        sizes = Counter(r.task for r in got)
        assert max(sizes.values()) <= 2 * len(got) / 8
        assert all(a.reclat <= b.reclat for a, b in zip(got, got[1:]))
        assert len({(a.task, a.reclat, a.fall_code) for a in got}) >= sum((a.task, a.reclat, a.fall_code) != (b.task, b.reclat, b.fall_code) for a, b in zip(got, got[1:]))

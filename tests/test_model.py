"""Model: class order, probabilities, save/load, versions, quality on the fixture."""

import pytest
from pyspark.sql import functions as F

from delayrisk import ID
from delayrisk.operators import model as mdl
from delayrisk.plans import inference as inf
from delayrisk.plans import training as tr
from delayrisk.sources.catalog import Tables

from .conftest import SF_MID


@pytest.fixture(scope="module")
def trained(spark):
    t = Tables.from_fixture(spark, SF_MID)
    model, pred = tr.fit_and_test(tr.labelled_features(t))
    return t, model, pred


def test_first_class_is_delayed(trained):
    _, model, _ = trained
    assert mdl.class_labels(model) == ["Delayed", "Not Delayed"]


def test_probabilities_sum_to_one_and_risk_in_range(trained):
    from pyspark.ml.functions import vector_to_array
    t, model, _ = trained
    out = model.transform(inf.scoring_input(t).limit(500))
    s = out.select(F.aggregate(vector_to_array("probability"), F.lit(0.0),
                               lambda a, b: a + b).alias("s"))
    assert all(abs(r["s"] - 1) < 1e-9 for r in s.collect())
    r = inf.model_scorer(model)(inf.scoring_input(t)).agg(F.min("risk_factor"),
                                                           F.max("risk_factor")).first()
    assert 0 <= r[0] <= r[1] <= 100


def test_better_than_majority_class(trained):
    _, _, pred = trained
    m = mdl.evaluate(pred).first()
    majority = pred.groupBy("actual").count().agg(F.max("count") / F.sum("count")).first()[0]
    assert m["accuracy"] > majority
    assert 0 < m["f1"] <= 1


def test_split_is_disjoint_by_id(spark):
    t = Tables.from_fixture(spark, SF_MID)
    data = tr.labelled_features(t)
    train, test = mdl.split_by_id(data)
    assert train.select(ID).intersect(test.select(ID)).count() == 0
    assert train.count() + test.count() == data.count()


def test_save_load_versions(spark, trained, tmp_path):
    t, model, _ = trained
    root = str(tmp_path / "models")
    assert mdl.latest_version(spark, "m", root) == 1
    v1 = mdl.save_model(spark, model, "m", {"accuracy": 0.5, "f1": 0.4}, root)
    v2 = mdl.save_model(spark, model, "m", {"accuracy": 0.6, "f1": 0.5}, root)
    assert (v1, v2) == (1, 2)
    assert mdl.latest_version(spark, "m", root) == 2
    si = inf.scoring_input(t)
    a = mdl.score(si, mdl.load_model(spark, "m", root=root)).orderBy(ID, "risk_factor")
    b = mdl.score(si, mdl.load_model(spark, "m", 1, root)).orderBy(ID, "risk_factor")
    c = mdl.score(si, model).orderBy(ID, "risk_factor")
    assert a.collect() == b.collect() == c.collect()


def test_versions_compare_as_integers(spark, tmp_path):
    root = str(tmp_path / "models2")
    rows = [("m", v, f"{root}/m/v={v}", *[None] * 8) for v in (2, 9, 12)]
    spark.createDataFrame(rows, mdl.RUNS_SCHEMA).write.parquet(f"{root}/model_runs")
    assert mdl.latest_version(spark, "m", root) == 12
    assert mdl.latest_version(spark, "other", root) == 1


def test_a_saved_version_is_never_overwritten(spark, tmp_path):
    """Two jobs that took the same number: the second goes to the next one."""
    root = str(tmp_path / "models4")
    model = tr.stump(spark)
    assert mdl.save_model(spark, model, "m", root=root) == 1
    model.save(f"{root}/m/v=2")          # saved by another job, its run not recorded yet
    assert mdl.save_model(spark, model, "m", root=root) == 3
    runs = spark.read.schema(mdl.RUNS_SCHEMA).parquet(f"{root}/model_runs").orderBy("version").collect()
    assert [r.version for r in runs] == [1, 3]
    assert runs[0].classes == ["Delayed", "Not Delayed"] and (runs[0].trees, runs[0].depth) == (1, 1)


def test_a_read_error_is_not_an_empty_registry(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "models5")
    mdl.save_model(spark, tr.stump(spark), "m", root=root)
    for path in (tmp_path / "models5" / "model_runs").glob("*.parquet"):
        path.write_bytes(b"damaged")
    for path in (tmp_path / "models5" / "model_runs").glob(".*.crc"):
        path.write_bytes(b"")
    with pytest.raises(Exception):
        mdl.latest_version(spark, "m", root)


def test_stump_scores_as_stated(spark):
    df = spark.createDataFrame([(1, w, 0.0, 0.0, False, 0.0) for w in (0.0, 50.0, 50.1, 900.0)],
                               "masterbill_internal_id long, total_weight double, volume_cm3 double, distance_km double,"
                               " hazardous_material_flag boolean, margin_value double")
    got = [(r.total_weight, r.delivery_delay, r.risk_factor) for r in mdl.score(df, tr.stump(spark)).collect()]
    assert got == [(0.0, "Not Delayed", 25.0), (50.0, "Not Delayed", 25.0), (50.1, "Delayed", 80.0), (900.0, "Delayed", 80.0)]


def test_train_records_run(spark, tmp_path):
    t = Tables.from_fixture(spark, "/root/testdata/sf0.001")
    root = str(tmp_path / "models3")
    model, metrics, version = tr.train(spark, t, root=root)
    assert version == 1 and set(metrics) == {"accuracy", "f1"}
    runs = spark.read.parquet(f"{root}/model_runs").collect()
    assert runs[0]["version"] == 1 and runs[0]["accuracy"] == metrics["accuracy"]


def test_pipeline_with_description_encoding(spark):
    from delayrisk.operators import features as feat
    from delayrisk.operators import impute
    from delayrisk.operators import labels as lab
    t = Tables.from_fixture(spark, "/root/testdata/sf0.001")
    bag = impute.fill_category(feat.feature_join(t), "item_description")
    bag = impute.fill_constants(bag, {"distance_km": 0.0, "volume_cm3": 0.0})
    bag = impute.fill_uniform(bag, "total_weight")
    data = mdl.training_set(bag, lab.delay_labels(t["activity"]))
    train, test = mdl.split_by_id(data)
    model = mdl.fit(train, encode=True)
    out = mdl.score(test, model)
    assert out.count() == test.count()
    assert out.filter(F.col("risk_factor").isNull()).count() == 0
    assert "item_description" in out.columns


def test_predicted_class_agrees_with_risk(trained):
    """Class 0 is 'Delayed' and risk = 100 * P(class 0), so a row is predicted
    'Delayed' exactly when its risk is above 50 (two classes, no exact ties)."""
    t, model, _ = trained
    out = inf.model_scorer(model)(inf.scoring_input(t))
    bad = out.filter((F.col("delivery_delay") == "Delayed") != (F.col("risk_factor") > 50))
    assert out.filter(F.col("risk_factor") == 50).count() == 0
    assert bad.count() == 0
    assert out.count() == inf.scoring_input(t).count()

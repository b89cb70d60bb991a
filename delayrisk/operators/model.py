"""Delay model on ``pyspark.ml``.

The reference pulls every training row to the driver and fits a
single-machine forest.  Here the split, the fit, the predictions and the
metrics are Spark jobs: ``RandomForestClassifier`` bins the features with a
sample, then grows all trees level by level with one distributed pass per
level; only the trees and a few numbers reach the driver.

Models are versioned folders ``<root>/<name>/v=<N>`` next to a ``model_runs``
parquet table with one row per saved version (name, version, path, metrics).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ID
from ..functions.draws import draw
from .features import FEATURES
from .labels import DELAYED

LABEL = "delivery_delay"

# Fixed values of the reference: forest size, depth and seed; test share.
TREES, DEPTH, SEED = 20, 3, 42
TEST_SHARE = 0.2

RUNS_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("path", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
    T.StructField("created", T.TimestampType()),
    T.StructField("trees", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("seed", T.LongType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("classes", T.ArrayType(T.StringType())),
])


def training_set(features: DataFrame, labels: DataFrame) -> DataFrame:
    """J3 + P9: labelled feature rows with the model's column types.

    Casts follow the reference (numbers to double, the flag to boolean);
    text that is not a boolean becomes null rather than failing (L6).
    """
    data = features.join(labels, ID, "inner")
    return (data.withColumn("distance_km", F.col("distance_km").cast("double"))
            .withColumn("margin_value", F.col("margin_value").cast("double"))
            .withColumn("hazardous_material_flag",
                        F.col("hazardous_material_flag").try_cast("boolean")))


def in_train(train_share: float = 1 - TEST_SHARE, salt: str = "split", key: str = ID):
    """M1: per-id side of the split; every row of one id lands on one side."""
    return (draw(salt, key) % 100) < int(round(train_share * 100))


def split_by_id(df: DataFrame, train_share: float = 1 - TEST_SHARE,
                salt: str = "split") -> tuple[DataFrame, DataFrame]:
    side = in_train(train_share, salt)
    return df.filter(side), df.filter(~side)


def make_pipeline(features=FEATURES, trees: int = TREES, depth: int = DEPTH, seed: int = SEED,
                  encode: bool = False, label: str = LABEL, bootstrap: bool = True) -> Pipeline:
    """M2 + M3 (+ M13): label index, feature vector, random forest.

    Classes are indexed alphabetically, so index 0 is 'Delayed' and the
    first probability is P(Delayed), as in the reference (L10).  With
    ``encode`` the item description is indexed and one-hot encoded too; its
    vocabulary is then part of the model on the driver, so it is for texts
    of few distinct values (``training.encode_description`` has no such bound).
    """
    stages = [StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc")]
    cols = list(features)
    if encode:
        stages += [StringIndexer(inputCol="item_description", outputCol="item_description_index",
                                 handleInvalid="keep"),
                   OneHotEncoder(inputCols=["item_description_index"],
                                 outputCols=["item_description_ohe"], handleInvalid="keep")]
        cols.append("item_description_ohe")
    stages += [VectorAssembler(inputCols=cols, outputCol="features"),
               RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees,
                                      maxDepth=depth, seed=seed, bootstrap=bootstrap)]
    return Pipeline(stages=stages)


def class_labels(model: PipelineModel) -> list[str]:
    """Class names in index order."""
    return list(model.stages[0].labels)


def score(df: DataFrame, model: PipelineModel, label: str = LABEL) -> DataFrame:
    """M4-M6: predicted class name and risk factor = 100 * P(first class).

    One ``transform`` keeps each prediction on its own row, so nothing
    needs gluing back by id (the reference's merges multiply rows, L5).
    """
    names = class_labels(model)
    if names[0] != DELAYED:
        raise ValueError(f"first class must be {DELAYED!r}, got {names}")
    keep = [c for c in df.columns if c != label]
    out = model.transform(df.select(*keep))
    pred = F.element_at(F.array(*[F.lit(n) for n in names]),
                        F.col("prediction").cast("int") + 1)
    return out.select(*keep, pred.alias(label),
                      (vector_to_array("probability")[0] * 100.0).alias("risk_factor"))


def evaluate(pred: DataFrame, actual: str = "actual", predicted: str = LABEL,
             positive: str = DELAYED) -> DataFrame:
    """M7 + M8: accuracy and F1 of the positive class, one aggregate pass.

    F1 is ``2tp / (2tp + fp + fn)`` and 0 when that is 0/0.
    """
    a, p = F.col(actual), F.col(predicted)
    tp = F.count_if((a == positive) & (p == positive))
    fp = F.count_if((a != positive) & (p == positive))
    fn = F.count_if((a == positive) & (p != positive))
    den = 2 * tp + fp + fn
    return pred.agg(
        F.avg((a == p).cast("double")).alias("accuracy"),
        F.when(den == 0, F.lit(0.0)).otherwise((2 * tp).cast("double") / den).alias("f1"))


def fit(train: DataFrame, **kw) -> PipelineModel:
    """Fit the pipeline on a training frame with the label column."""
    return make_pipeline(**kw).fit(train)


def model_root(spark: SparkSession) -> str:
    """Folder for versioned models: ``spark.delayrisk.modelRoot`` if set, else
    ``models`` under the warehouse folder, which executors of a cluster must share."""
    root = spark.conf.get("spark.delayrisk.modelRoot", None)
    if root:
        return root
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/models"
    if root.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.delayrisk.modelRoot: the warehouse is a local folder")
    return root


def _runs(spark: SparkSession, root: str) -> DataFrame | None:
    """The recorded runs; None only if nothing was recorded yet."""
    try:
        return spark.read.schema(RUNS_SCHEMA).parquet(f"{root}/model_runs")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest_version(spark: SparkSession, name: str, root: str | None = None) -> int:
    """Highest saved version as an integer (floor 1, like the reference)."""
    runs = _runs(spark, root or model_root(spark))
    if runs is None:
        return 1
    v = runs.filter(F.col("name") == name).agg(F.max("version")).first()[0]
    return max(1, v or 1)


def _next_version(spark: SparkSession, name: str, root: str) -> int:
    runs = _runs(spark, root)
    if runs is None:
        return 1
    v = runs.filter(F.col("name") == name).agg(F.max("version")).first()[0]
    return (v or 0) + 1


def save_model(spark: SparkSession, model: PipelineModel, name: str,
               metrics: dict | None = None, root: str | None = None) -> int:
    """M9 + M15: write the model as the next version and record the run.

    A version is never overwritten: should another job have taken the number,
    the next one is tried.  The run holds the metrics, the forest's
    parameters, its input columns and its classes.
    """
    root = root or model_root(spark)
    version = _next_version(spark, name, root)
    while True:
        path = f"{root}/{name}/v={version}"
        try:
            model.save(path)
            break
        except Exception as e:  # the writer has no error class for a taken path
            if "already exists" not in str(e):
                raise
            version += 1
    m, forest = metrics or {}, model.stages[-1]
    row = (name, version, path, m.get("accuracy"), m.get("f1"),
           _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None),
           forest.getNumTrees, forest.getMaxDepth(), forest.getSeed(),
           list(model.stages[-2].getInputCols()), class_labels(model))
    spark.createDataFrame([row], RUNS_SCHEMA).write.mode("append").parquet(f"{root}/model_runs")
    return version


def load_model(spark: SparkSession, name: str, version: int | None = None,
               root: str | None = None) -> PipelineModel:
    """Load a pinned version, or the latest one."""
    root = root or model_root(spark)
    v = version or latest_version(spark, name, root)
    return PipelineModel.load(f"{root}/{name}/v={v}")

"""E2 + E3: labels, training set, forest fit, metrics, versioned save."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ID
from ..operators import forest, impute
from ..operators import labels as lab
from ..operators import model as mdl
from ..operators.bag import descriptions, factorised, repeated
from ..session import ensure_checkpoint_dir
from ..staging import global_rank, stage
from .feature_table import feature_table

MODEL_NAME = "delivery_delay_model"


def labelled_features(tables, features: DataFrame | None = None,
                      labels: DataFrame | None = None) -> DataFrame:
    """Distinct feature rows of every labelled shipment (J3 + P9).

    ``features`` / ``labels`` default to building them from ``tables``;
    pass the written tables to read them back instead.
    """
    feats = features if features is not None else feature_table(tables, dedupe=True)
    labs = labels if labels is not None else lab.delay_labels(tables["activity"])
    return mdl.training_set(feats, labs)


def fit_and_test(data: DataFrame, **kw) -> tuple[PipelineModel, DataFrame]:
    """Split by id, fit on the train side, score the test side.

    The labelled set is checkpointed first (reliable checkpoint in the
    session's ``spark.checkpoint.dir``): the forest reads its input several
    times, and this cuts the feature plan's lineage so lost executors
    recompute from the checkpoint, not from the raw tables.
    """
    ensure_checkpoint_dir(data.sparkSession)
    data = data.checkpoint(eager=True)
    train, test = mdl.split_by_id(data)
    model = mdl.fit(train, **kw)
    pred = mdl.score(test.withColumnRenamed(mdl.LABEL, "actual"), model)
    return model, pred


def fit_forest(tables, features: DataFrame | None = None, **kw) -> list[forest.Node]:
    """E3 by ``operators.forest``: the node table of a forest fitted on the train side's staged rows."""
    side, _ = mdl.split_by_id(stage(labelled_features(tables, features), "training"))
    return forest.fit(side, **kw)


def train(spark: SparkSession, tables, name: str = MODEL_NAME, root: str | None = None,
          save: bool = True, **kw) -> tuple[PipelineModel, dict, int | None]:
    """Fit, evaluate on the held-out ids, save as the next version."""
    model, pred = fit_and_test(labelled_features(tables), **kw)
    m = mdl.evaluate(pred).first().asDict()
    version = mdl.save_model(spark, model, name, m, root) if save else None
    return model, m, version


def split_counts(data: DataFrame) -> DataFrame:
    """M1 check: rows and distinct ids on each side of the split."""
    side = F.when(mdl.in_train(), F.lit("train")).otherwise(F.lit("test"))
    return (data.select(ID, side.alias("split")).groupBy("split")
            .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(ID).alias("ids")))


def rule_predictions(test: DataFrame, threshold: float = 60.0) -> DataFrame:
    """A fixed rule in place of the forest (heavy shipments are late), so the
    metric arithmetic can be checked against SQL."""
    return (test.withColumnRenamed(mdl.LABEL, "actual")
            .withColumn(mdl.LABEL, F.when(F.col("total_weight") > threshold, F.lit("Delayed"))
                        .otherwise(F.lit("Not Delayed"))))


#: Fixed rows on which one tree of depth 1 splits the weight at 50: (weight, label, rows).
STUMP_ROWS = ((0.0, "Not Delayed", 3), (0.0, "Delayed", 1), (100.0, "Delayed", 4), (100.0, "Not Delayed", 1))


def stump(spark: SparkSession) -> PipelineModel:
    """A saved-model stand-in with a known outcome, through the same pipeline as the forest.

    Weights up to 50 have P(Delayed) = 1/4, others 4/5, so what scoring does
    with a fitted model can be stated in SQL.
    """
    rows = [(w, 0.0, 0.0, False, 0.0, label) for w, label, n in STUMP_ROWS for _ in range(n)]
    frame = spark.createDataFrame(rows, "total_weight double, volume_cm3 double, distance_km double,"
                                  " hazardous_material_flag boolean, margin_value double, delivery_delay string")
    return mdl.fit(frame, trees=1, depth=1, bootstrap=False)


def encode_description(tables) -> DataFrame:
    """Index and one-hot encode the filled item description.

    Descriptions are indexed by frequency, ties by text, as an indexer does;
    the one-hot vector is the pair (size, hot): ``size`` one less than the
    number of descriptions, ``hot`` the index, null for the last (all zeros).
    Descriptions are counted and indexed in the factorised bag, by the rows that hold them,
    and repeated last.  Counts are ranked by range and joined back; nothing but their number
    reaches the driver, and AQE can split a frequent description's rows.
    """
    found = descriptions(factorised(tables))
    found = stage(impute.fill_category(found, "item_description"), "descriptions")
    counts = found.groupBy("item_description").agg(F.sum("rows").alias("n"))
    ranked = global_rank(counts, [F.col("n").desc(), F.col("item_description")], "place")
    size = ranked.count() - 1
    at = F.col("place")
    index = ranked.select("item_description", at.cast("double").alias("item_description_index"),
                          F.lit(size).cast("long").alias("item_description_size"),
                          F.when(at < size, at).alias("item_description_hot"))
    return repeated(found.join(index, "item_description").select(ID, *index.columns, "rows"), "rows")

"""The pipeline's batch jobs, each ending in a table write.

    feature job   -> <out>.feature_masterbill          (E1, S4)
    label job     -> <out>.delivery_delay_labels       (E2, S4)
    training job  -> versioned model + model_runs row  (E3, M9, M15)
    scoring job   -> <out>.delivery_delay_predictions  (E4, S5)

Each job reads its inputs through a ``Tables`` resolver (catalog tables on a
cluster, the fixture adapter in tests) and the previous job's written
table, so a lost executor only recomputes from the last written table.

    python -m delayrisk.plans.jobs <sf_dir> <database>   # runs all four on the fixture
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from ..operators import labels as lab
from ..operators import model as mdl
from ..session import tune_for_skew
from ..sources import sinks
from . import inference as inf
from . import training as tr
from .feature_table import feature_table

FEATURES_TABLE = "feature_masterbill"
LABELS_TABLE = "delivery_delay_labels"
PREDICTIONS_TABLE = "delivery_delay_predictions"


def _name(db: str, table: str) -> str:
    return f"{db}.{table}" if db else table


def feature_job(spark: SparkSession, tables, db: str = "", dedupe: bool = False) -> str:
    """Write the feature table.  It is not bucketed: a bucket is one task, and
    one id may hold a large share of the rows."""
    tune_for_skew(spark)
    name = _name(db, FEATURES_TABLE)
    sinks.overwrite(feature_table(tables, dedupe=dedupe), name)
    return name


def label_job(spark: SparkSession, tables, db: str = "") -> str:
    tune_for_skew(spark)
    name = _name(db, LABELS_TABLE)
    sinks.overwrite(lab.delay_labels(tables["activity"]), name)
    return name


def training_job(spark: SparkSession, tables, db: str = "", name: str = tr.MODEL_NAME,
                 root: str | None = None) -> tuple[int, dict]:
    """Fit on the written feature and label tables; save as the next version."""
    tune_for_skew(spark)
    feats = sinks.read(spark, _name(db, FEATURES_TABLE)).distinct()  # also right over the bag
    labels = sinks.read(spark, _name(db, LABELS_TABLE))
    model, pred = tr.fit_and_test(tr.labelled_features(tables, feats, labels))
    metrics = mdl.evaluate(pred).first().asDict()
    version = mdl.save_model(spark, model, name, metrics, root)
    return version, metrics


def scoring_job(spark: SparkSession, tables, db: str = "", name: str = tr.MODEL_NAME,
                version: int | None = None, root: str | None = None) -> str:
    """Score every shipment with a saved model (latest unless pinned)."""
    tune_for_skew(spark)
    model = mdl.load_model(spark, name, version, root)
    feats = sinks.read(spark, _name(db, FEATURES_TABLE)).distinct()
    out = inf.predictions(tables, inf.model_scorer(model), features=feats)
    target = _name(db, PREDICTIONS_TABLE)
    sinks.overwrite_growing(out, target)
    return target


def run_all(spark: SparkSession, tables, db: str = "", root: str | None = None) -> dict:
    tune_for_skew(spark)
    if db:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
    # Training and scoring want distinct feature rows; the bag is for those who ask for it.
    feature_job(spark, tables, db, dedupe=True)
    label_job(spark, tables, db)
    version, metrics = training_job(spark, tables, db, root=root)
    scoring_job(spark, tables, db, version=version, root=root)
    return {"version": version, **metrics}


def main(argv: list[str]) -> None:
    from ..session import local_session
    from ..sources.catalog import Tables

    spark = local_session()
    print(run_all(spark, Tables.from_fixture(spark, argv[1]), argv[2] if len(argv) > 2 else ""))


if __name__ == "__main__":
    main(sys.argv)

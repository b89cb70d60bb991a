"""Score every shipment and enrich the result for the dashboard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ID
from ..functions.draws import draw
from ..operators import enrich, forest
from ..operators import features as feat
from ..operators import model as mdl
from ..operators.labels import DELAYED, ON_TIME
from ..staging import stage
from .feature_table import feature_table

Scorer = Callable[[DataFrame], DataFrame]


def scoring_input(tables, features: DataFrame | None = None) -> DataFrame:
    """The (distinct, L18) id spine joined to the feature rows."""
    feats = features if features is not None else feature_table(tables, dedupe=True)
    return feat.masterbill_ids(tables["masterbill"]).join(feats, ID, "inner")


def model_scorer(model: PipelineModel) -> Scorer:
    return lambda df: mdl.score(df, model)


def forest_scorer(nodes: list[forest.Node]) -> Scorer:
    """Score by a forest's node table: one Column expression."""
    return lambda df: forest.score(df, nodes)


def drawn_scorer(salt: str = "risk") -> Scorer:
    """A model stand-in for checks: risk factor from a per-id draw in [0, 100].

    Lets banding, search and KPI queries be compared with SQL without a
    forest; the class is 'Delayed' when the risk is above 50.
    """
    def run(df: DataFrame) -> DataFrame:
        risk = (draw(salt) % 10001) / F.lit(100.0)
        return (df.withColumn("risk_factor", risk)
                .withColumn(mdl.LABEL, F.when(F.col("risk_factor") > 50, DELAYED)
                            .otherwise(ON_TIME)))
    return run


def predictions(tables, scorer: Scorer, features: DataFrame | None = None,
                contiguous: bool = False) -> DataFrame:
    """Score, band, add loads and places; distinct rows.

    The scored rows are distinct, places are one row per id, and loads are
    made distinct by a partial aggregate before they fan out, so no two
    result rows are alike and no deduplication has to follow the joins.
    """
    scored = enrich.with_risk_level(scorer(scoring_input(tables, features)), contiguous)
    cols = scored.columns + ["load_id", "carrier_name", "mode", "Source", "Destination"]
    # Places are one row per id and loads may be several, so places join
    # first and the fan-out last; the reference's column order is restored.
    out = enrich.enrich_locations(scored, enrich.locations(tables["event"]))
    # The scoring input is an inner join with the spine: no id is null.
    spine = feat.masterbill_ids(tables["masterbill"])
    # Staged: the join reads their rows and their ids.
    loads = stage(tables["fact_load"].select(ID, "load_id", "carrier_name", "mode").distinct(), "loads")
    return enrich.enrich_loads(out, loads, keys=spine, null_keys=False).select(*cols)

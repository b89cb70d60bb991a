"""Counts recorded in FIXTURES.md section 5 (sf0.01), reproduced end to end."""

from pyspark.sql import functions as F

from delayrisk.functions.draws import draw
from delayrisk.functions.risk import risk_level
from delayrisk.operators import features as feat
from delayrisk.operators import labels as lab
from delayrisk.operators import model as mdl
from delayrisk.plans.feature_table import feature_table
from delayrisk.sources.catalog import Tables

from .conftest import SF_MID


def test_fixture_section_5(spark):
    t = Tables.from_fixture(spark, SF_MID)
    labels = dict(map(tuple, lab.delay_labels(t["activity"]).groupBy("delivery_delay")
                      .count().collect()))
    assert labels == {"Delayed": 6503, "Not Delayed": 8084}

    ft = feature_table(t)
    assert ft.count() == 22241
    assert ft.distinct().count() == 17978
    assert ft.select("masterbill_internal_id").distinct().count() == 15000
    fills = ft.agg(F.count_if(F.col("volume_cm3") > 0), F.count_if(F.col("distance_km") == 0),
                   F.count_if(F.col("total_weight") <= 2), F.count_if(F.col("margin_value") == 0),
                   F.count_if("hazardous_material_flag")).first()
    assert tuple(fills) == (7719, 4824, 1517, 7486, 11319)

    ids = feat.masterbill_ids(t["masterbill"])
    assert tuple(ids.agg(F.count_if(mdl.in_train()), F.count_if(~mdl.in_train())).first()) \
        == (12027, 2973)

    rf = (draw("risk") % 10001) / F.lit(100.0)
    levels = dict(map(tuple, ids.select(risk_level(rf).alias("l")).groupBy("l").count().collect()))
    assert levels == {"Normal": 7571, "Low": 2758, "Medium": 2882, "High": 1322, None: 467}

    places = F.concat_ws(", ", "city", "state", "country_code", "postal_code")
    assert t["event"].filter(places == "").count() == 2996

"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and DuckDB twins.

Every query reads the whole driver tables of ``sf_dir`` through the fixture
adapter (``sources.fixture``), so its work grows with the data.  The DuckDB
SQL for the same name lives in ``ORACLE``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ID
from .functions import risk as R
from .operators import bag, enrich, forest, impute, mart, profile
from .operators import features as feat
from .operators import labels as lab
from .operators import model as mdl
from .plans import dashboard as dash
from .plans import feature_table as ft
from .plans import inference as inf
from .plans import oracle as O
from .plans import training as tr
from .session import tune_for_size, tune_for_skew
from .sources import sinks
from .sources.catalog import INPUT_TABLES, Tables, use_namespace
from .staging import scratch, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def fx(spark: SparkSession, sf_dir: str) -> Tables:
    tune_for_skew(spark)
    tune_for_size(spark, sf_dir)
    return Tables.from_fixture(spark, sf_dir)


# S1 -- one scan per adapter table.
for _t in INPUT_TABLES:
    register(f"scan_{_t}", O.with_ctes(O.adapter(_t), f"select * from {_t}"))(
        lambda spark, sf_dir, _t=_t: fx(spark, sf_dir)[_t])


# E2 -- labels.
_LABELS_SQL = """select masterbill_internal_id,
  case when max(completion_date) > max(planned_date) then 'Delayed' else 'Not Delayed' end
    as delivery_delay
from activity
where completion_date is not null and planned_date is not null
group by masterbill_internal_id"""


@register("delay_labels", O.with_ctes(O.adapter("activity"), _LABELS_SQL))
def q_delay_labels(spark, sf_dir):
    return lab.delay_labels(fx(spark, sf_dir)["activity"])


# ---------------------------------------------------------------- E1 parts

FLAGSHIP = "feature_table"

# Oracle CTEs shared by the feature queries, written from SURVEY section 2
# and its ledger, so that they can disagree with the Spark plans.
_PARTS_SQL = [
    ("ids", "select distinct masterbill_internal_id from masterbill"),
    ("dist", "select distinct masterbill_internal_id, cast(distance_km as double) as distance_km"
             " from carrier"),
    ("dims", """select *, case when dimension_dim = 'inch' then dimension * 2.54 else dimension end
  as dimension_cm from item_dimension"""),
    ("piv", """select masterbill_internal_id,
  min(case when dimension_dim = 'height' then dimension_cm end) as height,
  min(case when dimension_dim = 'width' then dimension_cm end) as width,
  min(case when dimension_dim = 'length' then dimension_cm end) as length
from dims group by masterbill_internal_id"""),
    ("vol", "select masterbill_internal_id, height * width * length as volume_cm3 from piv"),
    ("wt", """select masterbill_internal_id, sum(cast(weight as double)) as total_weight
from item_weight where weight_type = 'actual' group by masterbill_internal_id"""),
    ("haz", """select masterbill_internal_id,
  max(cast(try_cast(hazardous_material_flag as boolean) as int)) = 1 as hazardous_material_flag
from itemgroup_line_item group by masterbill_internal_id"""),
    ("mrg", """select distinct masterbill_internal_id, cast(margin_value as double) as margin_value
from masterbill_margins where margin_type = 'CurrentMargin'"""),
    ("drp", """select distinct masterbill_internal_id, event_type from tracking_shipment_status
where event_type = 'Drop'"""),
    # Per id, the lines speak where the groups are silent (no row, or a null one).
    ("descr", """select masterbill_internal_id, description as item_description from item_group g
where description is not null or not exists (select 1 from itemgroup_line_item l
  where l.masterbill_internal_id = g.masterbill_internal_id)
union
select masterbill_internal_id, description from itemgroup_line_item l
where not exists (select 1 from item_group g where g.masterbill_internal_id = l.masterbill_internal_id
  and g.description is not null)
or exists (select 1 from item_group g where g.masterbill_internal_id = l.masterbill_internal_id
  and g.description is null)"""),
    # Every combination of an id's values; ids without a part keep nulls.
    ("bag", """select distinct masterbill_internal_id, volume_cm3, distance_km, total_weight,
  hazardous_material_flag is not null and hazardous_material_flag as hazardous_material_flag,
  case when margin_value is null then 0 else margin_value end as margin_value, item_description
from ids natural left join vol natural left join wt natural left join haz
  natural left join dist natural left join mrg natural left join descr"""),
]
_FEATURE_INPUTS = ("masterbill", "carrier", "item_dimension", "item_weight", "itemgroup_line_item",
                   "masterbill_margins", "tracking_shipment_status", "item_group")


def _fsql(body: str, upto: str = "bag") -> str:
    names = [n for n, _ in _PARTS_SQL]
    ctes = _PARTS_SQL[: names.index(upto) + 1]
    return O.with_ctes(O.adapter(*_FEATURE_INPUTS) + ctes, body)


_FILL_DESC = (f"case when item_description is null then case when {O.draw('description')} % 1000"
              f" < 500 then 'MEDICAL MATERIAL' else 'Euro Pallet' end else item_description end")
_FILL_WEIGHT = (f"case when total_weight is null then round(1 + ({O.draw('weight')} % 1001)"
                f" / 1000.0, 3) else total_weight end")


def _zero(c: str) -> str:
    return f"case when {c} is null or isnan({c}) then 0.0 else {c} end"


_FEATURE_SQL = (f"select masterbill_internal_id, {_zero('volume_cm3')} as volume_cm3,"
                f" {_zero('distance_km')} as distance_km, {_FILL_WEIGHT} as total_weight,"
                f" hazardous_material_flag, margin_value from bag")


@register("masterbill_ids", _fsql("select * from ids", "ids"))
def q_masterbill_ids(spark, sf_dir):
    return feat.masterbill_ids(fx(spark, sf_dir)["masterbill"])


@register("distance", _fsql("select * from dist", "dist"))
def q_distance(spark, sf_dir):
    return feat.distance(fx(spark, sf_dir)["carrier"])


@register("unit_convert", _fsql("select * from dims", "dims"))
def q_unit_convert(spark, sf_dir):
    return feat.convert_unit(fx(spark, sf_dir)["item_dimension"])


@register("dimension_pivot", _fsql("select * from piv", "piv"))
def q_dimension_pivot(spark, sf_dir):
    return feat.pivot_dimensions(feat.convert_unit(fx(spark, sf_dir)["item_dimension"]))


@register("item_volume", _fsql("select * from vol", "vol"))
def q_item_volume(spark, sf_dir):
    return feat.item_volume(fx(spark, sf_dir)["item_dimension"])


@register("total_weight", _fsql("select * from wt", "wt"))
def q_total_weight(spark, sf_dir):
    return feat.total_weight(fx(spark, sf_dir)["item_weight"])


@register("hazmat_flag", _fsql("select * from haz", "haz"))
def q_hazmat_flag(spark, sf_dir):
    return feat.hazmat_flag(fx(spark, sf_dir)["itemgroup_line_item"])


@register("margin_current", _fsql("select * from mrg", "mrg"))
def q_margin_current(spark, sf_dir):
    return feat.current_margin(fx(spark, sf_dir)["masterbill_margins"])


@register("drop_events", _fsql("select * from drp", "drp"))
def q_drop_events(spark, sf_dir):
    return feat.drop_events(fx(spark, sf_dir)["tracking_shipment_status"])


@register("item_description", _fsql("select * from descr", "descr"))
def q_item_description(spark, sf_dir):
    t = fx(spark, sf_dir)
    return feat.item_description(t["item_group"], t["itemgroup_line_item"])


@register("feature_join", _fsql("select * from bag"))
def q_feature_join(spark, sf_dir):
    return feat.feature_join(fx(spark, sf_dir))


@register("fill_category", _fsql(
    f"select * exclude (item_description), {_FILL_DESC} as item_description from bag"))
def q_fill_category(spark, sf_dir):
    return impute.fill_category(feat.feature_join(fx(spark, sf_dir)), "item_description")


@register("fill_uniform", _fsql(
    f"select * exclude (total_weight), {_FILL_WEIGHT} as total_weight from bag"))
def q_fill_uniform(spark, sf_dir):
    return impute.fill_uniform(feat.feature_join(fx(spark, sf_dir)), "total_weight")


@register("fill_constants", _fsql(
    f"select * exclude (distance_km, volume_cm3), {_zero('distance_km')} as distance_km,"
    f" {_zero('volume_cm3')} as volume_cm3 from bag"))
def q_fill_constants(spark, sf_dir):
    return impute.fill_constants(feat.feature_join(fx(spark, sf_dir)),
                                 {"distance_km": 0.0, "volume_cm3": 0.0})


@register("median_fill", _fsql(
    "select * exclude (distance_km), coalesce(distance_km, (select quantile_disc(distance_km, 0.5)"
    " from bag where distance_km is not null and not isnan(distance_km))) as distance_km from bag"))
def q_median_fill(spark, sf_dir):
    return bag.fill_median(bag.factorised(fx(spark, sf_dir)))


@register("null_profile", _fsql(
    "select " + ", ".join(f"cast(sum(cast({c} is null as int)) as bigint) as {c}_null_count"
                          for c in ("masterbill_internal_id", "volume_cm3", "distance_km",
                                    "total_weight", "hazardous_material_flag", "margin_value",
                                    "item_description")) + " from bag"))
def q_null_profile(spark, sf_dir):
    return bag.null_profile(bag.factorised(fx(spark, sf_dir)))


@register("unique_masterbills", _fsql(
    "select count(*) as unique_masterbills from (select distinct masterbill_internal_id from bag)"))
def q_unique_masterbills(spark, sf_dir):
    # The joined rows have the spine's ids, no more and no fewer.
    return profile.unique_ids(feat.masterbill_ids(fx(spark, sf_dir)["masterbill"]))


@register(FLAGSHIP, _fsql(_FEATURE_SQL))
def q_feature_table(spark, sf_dir):
    return ft.feature_table(fx(spark, sf_dir))


# ------------------------------------------------------ E3: training set, split, model


_LEVEL_SQL = """case when risk_factor >= 0 and risk_factor <= 50 then 'Normal'
  when risk_factor >= 51 and risk_factor <= 70 then 'Low'
  when risk_factor >= 71 and risk_factor <= 90 then 'Medium'
  when risk_factor >= 91 and risk_factor <= 100 then 'High' end"""

_E4_SQL = [
    ("feat", _FEATURE_SQL),
    ("fd", "select distinct * from feat"),
    ("labs", _LABELS_SQL),
    ("ts", "select fd.*, labs.delivery_delay from fd join labs using (masterbill_internal_id)"),
    ("si", "select fd.* from ids join fd using (masterbill_internal_id)"),
    ("sc", f"select *, ({O.draw('risk')} % 10001) / cast(100 as double) as risk_factor from si"),
    ("sc2", f"""select *, case when risk_factor > 50 then 'Delayed' else 'Not Delayed' end
  as delivery_delay, {_LEVEL_SQL} as risk_level from sc"""),
    ("ld", "select masterbill_internal_id, load_id, carrier_name, mode from fact_load"),
    ("pde", """select master_bill_internal_id, event_type,
  concat_ws(', ', city, state, country_code, postal_code) as location
from event where event_type in ('Pickup', 'Drop')"""),
    ("loc", """select master_bill_internal_id,
  min(case when event_type = 'Pickup' then location end) as Source,
  min(case when event_type = 'Drop' then location end) as Destination
from pde group by master_bill_internal_id"""),
    ("pred", """select distinct sc2.*, ld.load_id, ld.carrier_name, ld.mode, loc.Source,
  loc.Destination
from sc2 left join ld using (masterbill_internal_id)
  left join loc on sc2.masterbill_internal_id = loc.master_bill_internal_id"""),
]
_E4_INPUTS = _FEATURE_INPUTS + ("activity", "fact_load", "event")


def _esql(body: str, upto: str = "pred") -> str:
    names = [n for n, _ in _E4_SQL]
    return O.with_ctes(O.adapter(*_E4_INPUTS) + _PARTS_SQL + _E4_SQL[: names.index(upto) + 1], body)


@register("training_set", _esql("select * from ts", "ts"))
def q_training_set(spark, sf_dir):
    return tr.labelled_features(fx(spark, sf_dir))


@register("cast_training_columns", _esql(
    "select masterbill_internal_id, cast(distance_km as double) as distance_km,"
    " cast(margin_value as double) as margin_value,"
    " try_cast(hazardous_material_flag as boolean) as hazardous_material_flag from ts", "ts"))
def q_cast_training_columns(spark, sf_dir):
    return tr.labelled_features(fx(spark, sf_dir)).select(
        ID, "distance_km", "margin_value", "hazardous_material_flag")


@register("split_counts", _esql(
    f"select case when {O.draw('split')} % 100 < 80 then 'train' else 'test' end as split,"
    " count(*) as rows, count(distinct masterbill_internal_id) as ids from ts group by 1", "ts"))
def q_split_counts(spark, sf_dir):
    return tr.split_counts(tr.labelled_features(fx(spark, sf_dir)))


@register("eval_metrics", _esql(
    f"""select avg(case when delivery_delay = pred then 1.0 else 0.0 end)::double as accuracy,
  case when 2 * tp + fp + fn = 0 then 0.0 else 2.0 * tp / (2 * tp + fp + fn) end::double as f1
from (select *, count(*) filter (where delivery_delay = 'Delayed' and pred = 'Delayed') over () tp,
  count(*) filter (where delivery_delay <> 'Delayed' and pred = 'Delayed') over () fp,
  count(*) filter (where delivery_delay = 'Delayed' and pred <> 'Delayed') over () fn
  from (select *, case when total_weight > 60 then 'Delayed' else 'Not Delayed' end as pred
        from ts where {O.draw('split')} % 100 >= 80))
group by tp, fp, fn""", "ts"))
def q_eval_metrics(spark, sf_dir):
    _, test = mdl.split_by_id(tr.labelled_features(fx(spark, sf_dir)))
    return mdl.evaluate(tr.rule_predictions(test))


def _features(t: Tables) -> DataFrame:
    """The distinct feature rows, written once for all that read them."""
    return stage(ft.feature_table(t, dedupe=True), "features")


_RISK_OK = "True as risk_in_range, True as class_agrees"


def _facts(pred: DataFrame, *cols: str) -> DataFrame:
    """What SQL can say of a forest's row: the risk is a percentage, the class goes with it."""
    risk = F.col("risk_factor")
    late = F.col(mdl.LABEL) == lab.DELAYED
    agrees = F.when(F.abs(risk - 50) < 1e-9, True).otherwise(late == (risk > 50))
    return pred.select(ID, *cols, risk.between(0, 100).alias("risk_in_range"), agrees.alias("class_agrees"))


@register("train_forest", _esql(
    f"select masterbill_internal_id, delivery_delay as actual, {_RISK_OK} from ts"
    f" where {O.draw('split')} % 100 >= 80", "ts"))
def q_train_forest(spark, sf_dir):
    _, pred = tr.fit_and_test(tr.labelled_features(fx(spark, sf_dir)))
    return _facts(pred, "actual")


@register("forest_scores", _esql(f"select masterbill_internal_id, {_RISK_OK} from si", "si"))
def q_forest_scores(spark, sf_dir):
    t = fx(spark, sf_dir)
    features = _features(t)
    model, _ = tr.fit_and_test(tr.labelled_features(t, features))
    return _facts(inf.model_scorer(model)(inf.scoring_input(t, features)))


@register("class_list", _esql(
    "select cast(row_number() over (order by delivery_delay) - 1 as int) as place, delivery_delay as class"
    " from (select distinct delivery_delay from ts)", "ts"))
def q_class_list(spark, sf_dir):
    model, _ = tr.fit_and_test(tr.labelled_features(fx(spark, sf_dir)), trees=2, depth=1)
    return spark.createDataFrame(list(enumerate(mdl.class_labels(model))), "place int, class string")


def _two_versions(spark, t: Tables, features: DataFrame | None = None) -> str:
    """A new model folder with two saved versions, fitted on the table's rows."""
    root = scratch(spark, "models")
    data = stage(tr.labelled_features(t, features), "labelled")
    for trees in (2, 3):
        model, pred = tr.fit_and_test(data, trees=trees, depth=2)
        mdl.save_model(spark, model, tr.MODEL_NAME, mdl.evaluate(pred).first().asDict(), root)
    return root


@register("model_runs", _esql(
    "select 'delivery_delay_model' as name, cast(v as int) as version, cast(v + 1 as int) as trees, 2 as depth,"
    " cast(42 as bigint) as seed, 'volume_cm3,distance_km,total_weight,hazardous_material_flag,margin_value' as features,"
    " (select string_agg(distinct delivery_delay, ',' order by delivery_delay) from ts) as classes,"
    " True as metrics_in_range from range(1, 3) t(v)", "ts"))
def q_model_runs(spark, sf_dir):
    runs = spark.read.schema(mdl.RUNS_SCHEMA).parquet(_two_versions(spark, fx(spark, sf_dir)) + "/model_runs")
    return runs.select("name", "version", "trees", "depth", "seed", F.array_join("features", ",").alias("features"),
                       F.array_join("classes", ",").alias("classes"),
                       (F.col("accuracy").between(0, 1) & F.col("f1").between(0, 1)).alias("metrics_in_range"))


@register("latest_version", _esql(
    f"select masterbill_internal_id, cast(2 as int) as version, {_RISK_OK} from si", "si"))
def q_latest_version(spark, sf_dir):
    """The latest saved version, loaded again, scores every shipment."""
    t = fx(spark, sf_dir)
    features = _features(t)
    root = _two_versions(spark, t, features)
    model = mdl.load_model(spark, tr.MODEL_NAME, root=root)
    version = F.lit(mdl.latest_version(spark, tr.MODEL_NAME, root)).cast("int")
    scored = inf.model_scorer(model)(inf.scoring_input(t, features)).withColumn("version", version)
    return _facts(scored, "version")


@register("encode_description", _fsql(
    f"""select f.masterbill_internal_id, f.item_description, i.item_description_index,
  i.n - 1 as item_description_size,
  case when item_description_index < i.n - 1 then cast(item_description_index as bigint) end
    as item_description_hot
from (select masterbill_internal_id, {_FILL_DESC} as item_description from bag) f
join (select item_description,
        cast(row_number() over (order by count(*) desc, item_description) - 1 as double)
          as item_description_index, count(*) over () as n
      from (select {_FILL_DESC} as item_description from bag) group by item_description) i
  using (item_description)"""))
def q_encode_description(spark, sf_dir):
    return tr.encode_description(fx(spark, sf_dir))


# ------------------------------------------------------ E4: scoring and enrichment
def _drawn(spark, sf_dir):
    t = fx(spark, sf_dir)
    return t, inf.drawn_scorer()(inf.scoring_input(t))


@register("scoring_input", _esql("select * from si", "si"))
def q_scoring_input(spark, sf_dir):
    return inf.scoring_input(fx(spark, sf_dir))


@register("risk_level", _esql("select masterbill_internal_id, risk_factor, risk_level from sc2", "sc2"))
def q_risk_level(spark, sf_dir):
    _, sc = _drawn(spark, sf_dir)
    return enrich.with_risk_level(sc).select(ID, "risk_factor", "risk_level")


@register("enrich_loads", _esql(
    "select sc2.*, ld.load_id, ld.carrier_name, ld.mode from sc2 left join ld"
    " using (masterbill_internal_id)", "ld"))
def q_enrich_loads(spark, sf_dir):
    t, sc = _drawn(spark, sf_dir)
    # The scored rows' ids are the spine's, none of them null: planned once.
    return enrich.enrich_loads(enrich.with_risk_level(sc), t["fact_load"],
                               keys=feat.masterbill_ids(t["masterbill"]), null_keys=False)


@register("pick_drop_events", _esql("select * from pde", "pde"))
def q_pick_drop_events(spark, sf_dir):
    return enrich.pick_drop_events(fx(spark, sf_dir)["event"])


@register("locations", _esql("select * from loc", "loc"))
def q_locations(spark, sf_dir):
    return enrich.locations(fx(spark, sf_dir)["event"])


@register("enrich_locations", _esql(
    "select sc2.*, loc.Source, loc.Destination from sc2 left join loc"
    " on sc2.masterbill_internal_id = loc.master_bill_internal_id", "loc"))
def q_enrich_locations(spark, sf_dir):
    t, sc = _drawn(spark, sf_dir)
    return enrich.enrich_locations(enrich.with_risk_level(sc), enrich.locations(t["event"]))


# A fitted model with a known outcome: one tree of depth 1, split at weight 50.
_STUMP_SQL = """select masterbill_internal_id, volume_cm3, distance_km, total_weight,
  hazardous_material_flag, margin_value,
  case when total_weight <= 50 then 'Not Delayed' else 'Delayed' end as delivery_delay,
  case when total_weight <= 50 then 25.0 else 80.0 end::double as risk_factor from si"""


def _stump_sql(body: str, upto: str = "pred") -> str:
    """The scoring CTEs with the known model in place of the drawn risk."""
    names = [n for n, _ in _E4_SQL]
    ctes = [(n, _STUMP_SQL if n == "sc" else "select *, " + _LEVEL_SQL + " as risk_level from sc" if n == "sc2" else q)
            for n, q in _E4_SQL[: names.index(upto) + 1]]
    return O.with_ctes(O.adapter(*_E4_INPUTS) + _PARTS_SQL + ctes, body)


def _stump_predictions(spark, sf_dir) -> DataFrame:
    return inf.predictions(fx(spark, sf_dir), inf.model_scorer(tr.stump(spark)))


@register("score_batch", _stump_sql("select * from sc", "sc"))
def q_score_batch(spark, sf_dir):
    return inf.model_scorer(tr.stump(spark))(inf.scoring_input(fx(spark, sf_dir)))


@register("delay_predictions", _stump_sql("select * from pred"))
def q_delay_predictions(spark, sf_dir):
    return _stump_predictions(spark, sf_dir)


# The fitted forest itself: SQL fits the same 20 trees of depth 3, row by row, and walks them.
_FOREST = [("tside", f"select * from ts where {O.draw('split')} % 100 < 80"),
           *O.forest_fit("tside", feat.FEATURES, mdl.TREES, mdl.DEPTH, mdl.SEED, forest.BINS, forest.BOUNDS, forest.PER_HASH,
                         forest.CANDIDATES)]


def _forest_sql(body: str, upto: str = "pred") -> str:
    """The scoring CTEs with the fitted forest in place of the drawn risk."""
    ctes = []
    for n, q in _E4_SQL:
        if n == "sc":
            ctes += _FOREST + O.forest_walk("si", feat.FEATURES, mdl.TREES, mdl.DEPTH)
        else:
            ctes.append((n, "select *, " + _LEVEL_SQL + " as risk_level from sc" if n == "sc2" else q))
    names = [n for n, _ in ctes]
    return O.with_ctes(O.adapter(*_E4_INPUTS) + _PARTS_SQL + ctes[: names.index(upto) + 1], body)


@register("forest_nodes", _forest_sql("select tree, node, feature, cut, late, timely from nodes", "nodes"))
def q_forest_nodes(spark, sf_dir):
    """M3: the fitted forest as a table, equal on any partitioning."""
    return forest.node_table(spark, tr.fit_forest(fx(spark, sf_dir)))


@register("forest_predictions", _forest_sql("select * from pred"))
def q_forest_predictions(spark, sf_dir):
    """E3 + E4: fit on the labelled train side, then score, band and enrich every shipment."""
    t = fx(spark, sf_dir)
    features = _features(t)
    return inf.predictions(t, inf.forest_scorer(tr.fit_forest(t, features)), features)


# ------------------------------------------------------ E5: dashboard mart
_MART_COLS = ", ".join(mart.MART_COLS)
_ORDER_SQL = ", ".join(f"{c} asc nulls first" for c in mart.ORDER)
_PCT_SQL = """coalesce(
  case when try_cast(replace(replace(trim(cast(risk_factor as varchar)), '%', ''), ',', '') as double)
         is null or isnan(risk_factor) then null
       when risk_factor < 0 then 0.0 when risk_factor > 100 then 100.0 else risk_factor end,
  case when lower(trim(coalesce(risk_level, ''))) in ('high risk', 'delayed', 'delay', 'late') then 95.0
       when lower(trim(coalesce(risk_level, ''))) in ('medium', 'warning') then 80.0
       when lower(trim(coalesce(risk_level, ''))) in ('at risk', 'low') then 60.0 else 25.0 end)"""


def _cat_sql(x: str) -> str:
    t = f"lower(trim(coalesce({x}, '')))"
    return (f"case when {t} in ('high', 'high risk', 'delayed', 'delay', 'late') then 'High'"
            f" when {t} in ('medium', 'warning') then 'Medium'"
            f" when {t} in ('low', 'at risk') then 'Low' else 'Normal' end")


_MART_SQL = [
    ("m0", f"select {_MART_COLS} from pred"),
    ("m1", f"select *, {_PCT_SQL} as percent, coalesce(risk_level, 'On Time') as label from m0"),
    ("m2", f"""select *, {_cat_sql('label')} as category,
  case when coalesce(percent, 0) <= 50 then '#2ecc71' when coalesce(percent, 0) <= 70 then '#f1c40f'
       when coalesce(percent, 0) <= 90 then '#e67e22' else '#e74c3c' end as bar_color,
  cast(cast(round_even(least(greatest(coalesce(percent, 0), 0), 100), 0) as int) as varchar) || '%'
    as percent_text
from m1"""),
]


def _msql(body: str) -> str:
    return _esql("", "pred").rstrip("\n") .rstrip() + "".join(
        f",\n{n} as (\n{s}\n)" for n, s in _MART_SQL) + "\n" + body


def written_predictions(spark, sf_dir) -> DataFrame:
    """E4 on the drawn risk, written as Parquet and read back.

    The dashboard reads a written predictions table, not the scoring plan,
    so each mart query reads the columns it needs.
    """
    return stage(inf.predictions(fx(spark, sf_dir), inf.drawn_scorer()), "predictions")


_predictions = written_predictions


def _mart(spark, sf_dir):
    return dash.dashboard_mart(_predictions(spark, sf_dir))


_SEARCH_TEXT = "Nation_1"
_CHOSEN = ("High", "Medium")
_PAGE = 3


def _search_sql(src: str) -> str:
    hay = " || ' ' || ".join(f"coalesce(cast({c} as varchar), '')" for c in mart.SEARCH_FIELDS)
    return f"select * from {src} where contains(lower({hay}), '{_SEARCH_TEXT.strip().lower()}')"


@register("mart_fetch", _esql(f"select {_MART_COLS} from pred"))
def q_mart_fetch(spark, sf_dir):
    return mart.head_rows(mart.conform(_predictions(spark, sf_dir)))


@register("mart_head", _esql(f"select {_MART_COLS} from pred order by {_ORDER_SQL} limit 5000"))
def q_mart_head(spark, sf_dir):
    """The reference's fetch: a cap that its caller asks for."""
    return mart.head_rows(mart.conform(_predictions(spark, sf_dir)), n=5000)


@register("mart_percent_text", _esql(
    "select 'SHP-' || masterbill_internal_id as masterbill_internal_id, cast(null as varchar) as carrier_name,"
    " cast(risk_factor as varchar) || '%' as risk_factor,"
    " case when risk_factor is null then null else risk_factor end as percent from sc2", "sc2"))
def q_mart_percent_text(spark, sf_dir):
    """Text ids and text percents through the mart."""
    _, sc = _drawn(spark, sf_dir)
    text = enrich.with_risk_level(sc).withColumn("risk_factor", F.concat(F.col("risk_factor").cast("string"), F.lit("%"))) \
        .withColumn(ID, F.concat(F.lit("SHP-"), F.col(ID).cast("string")))
    return dash.dashboard_mart(text).select(ID, "carrier_name", "risk_factor", "percent")


def _stump_msql(body: str) -> str:
    return _stump_sql("").rstrip() + "".join(f",\n{n} as (\n{q}\n)" for n, q in _MART_SQL) + "\n" + body


@register("model_mart", _stump_msql("select * from m2"))
def q_model_mart(spark, sf_dir):
    return dash.dashboard_mart(stage(_stump_predictions(spark, sf_dir), "predictions"))


@register("conform_columns", _esql(
    "select masterbill_internal_id, volume_cm3, distance_km, total_weight, hazardous_material_flag,"
    " margin_value, delivery_delay, risk_factor, risk_level, cast(null as bigint) as load_id,"
    " cast(null as varchar) as Source, cast(null as varchar) as Destination,"
    " cast(null as varchar) as carrier_name, cast(null as varchar) as mode from sc2", "sc2"))
def q_conform_columns(spark, sf_dir):
    _, sc = _drawn(spark, sf_dir)
    return mart.conform(enrich.with_risk_level(sc))


@register("dashboard_mart", _msql("select * from m2"))
def q_dashboard_mart(spark, sf_dir):
    return _mart(spark, sf_dir)


@register("mart_percent", _msql(
    "select masterbill_internal_id, risk_factor, risk_level, percent from m2"))
def q_mart_percent(spark, sf_dir):
    return _mart(spark, sf_dir).select(ID, "risk_factor", "risk_level", "percent")


@register("mart_category", _msql(
    "select masterbill_internal_id, risk_level, label, category from m2"))
def q_mart_category(spark, sf_dir):
    return _mart(spark, sf_dir).select(ID, "risk_level", "label", "category")


@register("color_band", _msql("select masterbill_internal_id, percent, bar_color from m2"))
def q_color_band(spark, sf_dir):
    return _mart(spark, sf_dir).select(ID, "percent", "bar_color")


@register("percent_text", _msql(
    "select masterbill_internal_id, percent, percent_text from m2"))
def q_percent_text(spark, sf_dir):
    return _mart(spark, sf_dir).select(ID, "percent", "percent_text")


@register("norm_risk", _msql(
    f"select masterbill_internal_id, {_cat_sql('risk_level')} as cat_level,"
    f" {_cat_sql('delivery_delay')} as cat_delay,"
    f" {_cat_sql(chr(39) + '  ' + chr(39) + ' || upper(risk_level) || ' + chr(39) + ' ' + chr(39))}"
    " as cat_padded from m2"))
def q_norm_risk(spark, sf_dir):
    m = _mart(spark, sf_dir)
    return m.select(ID, R.norm_risk(F.col("risk_level")).alias("cat_level"),
                    R.norm_risk(F.col("delivery_delay")).alias("cat_delay"),
                    R.norm_risk(F.concat(F.lit("  "), F.upper("risk_level"), F.lit(" ")))
                    .alias("cat_padded"))


def _fb_sql(x: str) -> str:
    t = f"lower(trim(coalesce({x}, '')))"
    return (f"cast(case when {t} in ('high risk', 'delayed', 'delay', 'late') then 95.0"
            f" when {t} in ('medium', 'warning') then 80.0"
            f" when {t} in ('at risk', 'low') then 60.0 else 25.0 end as double)")


@register("fallback_percent", _msql(
    f"select masterbill_internal_id, {_fb_sql('risk_level')} as fb_level,"
    f" {_fb_sql('delivery_delay')} as fb_delay from m2"))
def q_fallback_percent(spark, sf_dir):
    m = _mart(spark, sf_dir)
    return m.select(ID, R.fallback_percent(F.col("risk_level")).alias("fb_level"),
                    R.fallback_percent(F.col("delivery_delay")).alias("fb_delay"))


def _tp_sql(text: str) -> str:
    v = f"try_cast(replace(replace(trim({text}), '%', ''), ',', '') as double)"
    return (f"case when trim({text}) = '' or {v} is null or isnan({v}) then null"
            f" when {v} < 0 then 0.0 when {v} > 100 then 100.0 else {v} end")


@register("to_percent", _msql(
    "select masterbill_internal_id, "
    + _tp_sql("(cast(risk_factor as varchar) || '%')") + " as from_pct, "
    + _tp_sql("(' ' || cast(round(margin_value) as bigint) || ' ')") + " as from_margin, "
    + _tp_sql("('-' || cast(risk_factor as varchar))") + " as from_negative, "
    + _tp_sql("case when hazardous_material_flag then '' else"
              " cast(cast(distance_km as bigint) as varchar) end") + " as from_distance, "
    + _tp_sql("coalesce(carrier_name, '')") + " as from_text from m2"))
def q_to_percent(spark, sf_dir):
    m = _mart(spark, sf_dir)
    s = lambda c: c.cast("string")
    return m.select(
        ID,
        R.to_percent(F.concat(s(F.col("risk_factor")), F.lit("%"))).alias("from_pct"),
        R.to_percent(F.concat(F.lit(" "), s(F.round("margin_value").cast("long")), F.lit(" ")))
        .alias("from_margin"),
        R.to_percent(F.concat(F.lit("-"), s(F.col("risk_factor")))).alias("from_negative"),
        R.to_percent(F.when(F.col("hazardous_material_flag"), F.lit(""))
                     .otherwise(s(F.col("distance_km").cast("long")))).alias("from_distance"),
        R.to_percent(F.coalesce(F.col("carrier_name"), F.lit(""))).alias("from_text"))


@register("filter_risk", _msql(f"select * from m2 where category in {_CHOSEN!r}"))
def q_filter_risk(spark, sf_dir):
    return mart.filter_risk(_mart(spark, sf_dir), _CHOSEN)


@register("search_shipments", _msql(_search_sql("m2")))
def q_search_shipments(spark, sf_dir):
    return mart.search(_mart(spark, sf_dir), _SEARCH_TEXT)


_FILTERED = f"({_search_sql('m2')} and category in {_CHOSEN!r})"


@register("page_info", _msql(
    f"select count(*) as rows, greatest(1, cast(ceil(count(*) / 10.0) as bigint)) as pages,"
    f" least(greatest({_PAGE}, 1), greatest(1, cast(ceil(count(*) / 10.0) as bigint))) as page"
    f" from {_FILTERED}"))
def q_page_info(spark, sf_dir):
    return mart.page_info(mart.search(mart.filter_risk(_mart(spark, sf_dir), _CHOSEN),
                                      _SEARCH_TEXT), _PAGE)


@register("page_rows", _msql(
    f"select * exclude (rn, n) from (select *, row_number() over (order by {_ORDER_SQL}) as rn,"
    f" count(*) over () as n from {_FILTERED})"
    f" where rn > (least({_PAGE}, greatest(1, ceil(n / 10.0))) - 1) * 10"
    f" and rn <= least({_PAGE}, greatest(1, ceil(n / 10.0))) * 10"))
def q_page_rows(spark, sf_dir):
    return mart.page(mart.search(mart.filter_risk(_mart(spark, sf_dir), _CHOSEN), _SEARCH_TEXT),
                     _PAGE)


@register("page_after_walk", _msql(
    "select * replace (case when mode = 'BUILDING' then null else masterbill_internal_id end"
    " as masterbill_internal_id) from m2"))
def q_page_after_walk(spark, sf_dir):
    """All rows, page after page: ids repeat across page ends, some are null."""
    rows = stage(_mart(spark, sf_dir).withColumn(ID, F.when(F.col("mode") == "BUILDING", None).otherwise(F.col(ID))), "mart")
    size = max(1, -(-rows.count() // 7))
    pages, last, seen = [], None, 0
    while True:
        part = stage(mart.page_after(rows, last, seen, size), "page")
        # The page's last row, and those of the page that are alike, make the cursor.
        tail = part.orderBy(*[F.col(c).desc() for c in mart.ORDER]).limit(1).collect()
        if not tail:
            break
        alike = part.filter(mart.at_or_after(part, tail[0], mart.ORDER)).count()
        whole = alike == part.count() and last is not None and all(tail[0][c] == last[c] for c in mart.ORDER)
        last, seen = tail[0], alike + (seen if whole else 0)
        pages.append(part)
    out = pages[0] if pages else rows
    for part in pages[1:]:
        out = out.unionByName(part)
    return out


@register("deep_page", _msql(
    f"select * exclude (rn, n) from (select *, row_number() over (order by {_ORDER_SQL}) as rn,"
    " count(*) over () as n from m2) where rn > (ceil(n / 10.0) - 1) * 10"))
def q_deep_page(spark, sf_dir):
    """The last page, asked for by a number far beyond it."""
    return mart.page(_mart(spark, sf_dir), 10**9)


@register("kpis", _msql(
    "select count(*) filter (where delivery_delay = 'Delayed') as delayed,"
    " round(avg(distance_km), 1) as avg_distance_km, round(avg(total_weight), 1) as avg_weight,"
    " count(*) filter (where hazardous_material_flag) as hazardous from m2"))
def q_kpis(spark, sf_dir):
    return mart.kpis(_mart(spark, sf_dir))


# ------------------------------------------------------ S8: keyed upsert


@register("upsert_by_key", _esql(
    """select * from (
  select fd.masterbill_internal_id, fd.volume_cm3, fd.distance_km, bw.total_weight,
    fd.hazardous_material_flag, fd.margin_value
  from fd join (select masterbill_internal_id, sum(cast(weight as double)) as total_weight
                from item_weight where weight_type = 'billed' group by masterbill_internal_id) bw
    using (masterbill_internal_id)
  union all
  select * from fd where not exists (
    select 1 from item_weight w where w.weight_type = 'billed'
      and w.masterbill_internal_id = fd.masterbill_internal_id))""", "fd"))
def q_upsert_by_key(spark, sf_dir):
    t = fx(spark, sf_dir)
    old = _features(t)
    billed = feat.total_weight(t["item_weight"], "billed")
    new = old.drop("total_weight").join(billed, ID, "inner").select(*old.columns)
    return sinks.upsert(old, new, [ID])


# ------------------------------------------------------ S4 to S8: tables written and read back


def _table(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex[:12]}"


@register("table_overwrite", O.with_ctes(O.adapter("activity"), _LABELS_SQL))
def q_table_overwrite(spark, sf_dir):
    """A table with other columns is replaced by the labels."""
    t, name = fx(spark, sf_dir), _table("s4")
    sinks.overwrite(t["masterbill"], name)
    sinks.overwrite(lab.delay_labels(t["activity"]), name)
    return spark.table(name)


@register("table_grow", O.with_ctes(O.adapter("masterbill_margins"),
    "select masterbill_internal_id, cast(null as varchar) as margin_type, margin_value, margin_value * 2 as doubled"
    " from masterbill_margins"))
def q_table_grow(spark, sf_dir):
    """The second write lacks one column and brings another."""
    margins, name = fx(spark, sf_dir)["masterbill_margins"], _table("s5")
    sinks.overwrite_growing(margins, name)
    sinks.overwrite_growing(margins.select(ID, (F.col("margin_value") * 2).alias("doubled"), "margin_value"), name)
    return spark.table(name)


@register("keyed_create", O.with_ctes(O.adapter("activity"), _LABELS_SQL))
def q_keyed_create(spark, sf_dir):
    """One row per shipment, checked."""
    name = _table("s7")
    sinks.create_keyed(lab.delay_labels(fx(spark, sf_dir)["activity"]), name, [ID])
    return spark.table(name)


@register("table_merge", O.with_ctes(O.adapter("activity", "masterbill"), f"""select masterbill_internal_id,
  coalesce(delivery_delay, 'Unknown') as delivery_delay
from (select distinct masterbill_internal_id from masterbill) left join ({_LABELS_SQL}) using (masterbill_internal_id)"""))
def q_table_merge(spark, sf_dir):
    """Every shipment as unknown, then the labels merged over them, twice."""
    t, name = fx(spark, sf_dir), _table("s8")
    sinks.merge_into(feat.masterbill_ids(t["masterbill"]).withColumn(mdl.LABEL, F.lit("Unknown")), name, [ID])
    for _ in range(2):
        sinks.merge_into(lab.delay_labels(t["activity"]), name, [ID])
    return spark.table(name)


@register("use_namespace", O.with_ctes(O.adapter("masterbill"), "select masterbill_internal_id from masterbill"))
def q_use_namespace(spark, sf_dir):
    """An unqualified name is written to, and read from, the namespace in use."""
    rows, db, before = fx(spark, sf_dir)["masterbill"], _table("ns"), spark.catalog.currentDatabase()
    spark.sql(f"CREATE DATABASE {db}")
    try:
        use_namespace(spark, db)
        sinks.overwrite(rows, "spine")
        return spark.table(f"{db}.spine")
    finally:
        use_namespace(spark, before)


@register("kpi_text", _msql(
    "select format('{:,}', delayed) as delayed_text,"
    " coalesce(printf('%.1f', avg_distance_km), '—') as avg_distance_text,"
    " coalesce(printf('%.1f', avg_weight), '—') as avg_weight_text,"
    " cast(hazardous as varchar) as hazardous_text from ("
    "select count(*) filter (where delivery_delay = 'Delayed') as delayed,"
    " round(avg(distance_km), 1) as avg_distance_km, round(avg(total_weight), 1) as avg_weight,"
    " count(*) filter (where hazardous_material_flag) as hazardous from m2)"))
def q_kpi_text(spark, sf_dir):
    return mart.kpi_text(mart.kpis(_mart(spark, sf_dir)))

"""Registered queries: (spark, folder) -> DataFrame, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from querybook.views import Views
from wardwise.functions.draws import jitter
from wardwise.functions.parse import day_first_date, pin_code
from wardwise.functions.text import title_case
from wardwise.operators import aggregates as agg, bitmaps
from wardwise.operators import anomaly, filters, forecast as fc, geo, governance as gov
from wardwise.operators import quantiles, ranking, reach, scans, similarity, workload
from wardwise.plans import reports
from wardwise.sources import audit_table, drop_folder as ingest, exports
from wardwise.sources.tables import fresh_path, settle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RANGE = ("1996-03-01", "1998-06-30")
STATES = ["NATION_3", "NATION_7", "NATION_19", "NATION_24"]
SCENARIOS = [
    (f"{model} {spike:+d}%", spike / 100.0, horizon, model)
    for model in ("Linear", "Polynomial")
    for spike in (-50, 0, 50)
    for horizon in (7, 30, 90)
]
SCENARIOS = [(f"{name} {h}d", g, h, m) for name, g, h, m in SCENARIOS]


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, folder: fn(Views(spark, folder))
    return fn


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that the last bits of float sums do not matter."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), places).alias(f.name)
            if f.dataType.typeName() == "double"
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def significant(df: DataFrame, digits: int = 10) -> DataFrame:
    """Doubles at so many significant digits, for paths of any magnitude."""
    return df.select(
        *[
            F.when(
                F.col(f.name).isNotNull(),
                F.format_string(f"%.{digits - 1}e", F.col(f.name)).cast("double"),
            ).alias(f.name)
            if f.dataType.typeName() == "double"
            else F.col(f.name)
            for f in df.schema
        ]
    )


# --- ingestion and standardization -------------------------------------------


@query
def feed_union(v):
    raw = v.raw_enrol().withColumn("_odd", F.col("age_5_17") % 2)
    first = raw.where("_odd = 0").select(
        "date", "state", "district", "pincode", "age_0_5", "age_5_17", "age_18_greater"
    ).toDF(" Date", "STATE", "District ", "pincode", "age_0_5", "AGE_5_17", "age_18_greater")
    second = raw.where("_odd = 1").select("age_5_17", "pincode", "district", "state", "date")
    return ingest.union_files([ingest.normalize_columns(p) for p in (first, second)])


@query
def bio_fallback(v):
    return ingest.simulated_bio(v.enrol())


@query
def adult_measure(v):
    return ingest.with_adult_enrolments(v.raw_enrol())


@query
def adult_measure_children_only(v):
    return ingest.with_adult_enrolments(v.raw_enrol().drop("age_18_greater"))


@query
def bio_measure(v):
    return ingest.with_bio_stress(v.raw_bio())


@query
def demo_measure(v):
    return ingest.with_update_volume(v.raw_demo())


@query
def standardized_enrol(v):
    return ingest.canonical(v.raw_enrol(), "enrol")


@query
def standardized_bio(v):
    return ingest.canonical(v.raw_bio(), "bio")


@query
def standardized_demo(v):
    return ingest.canonical(v.raw_demo(), "demo")


@query
def missing_names(v):
    return ingest.missing_name_counts(ingest.canonical(v.raw_enrol(), "enrol"))


@query
def date_parse(v):
    return v.raw_enrol().select("date", day_first_date("date").alias("parsed"))


@query
def pin_coerce(v):
    return v.raw_enrol().select("pincode", pin_code("pincode").alias("pin"))


@query
def title_case_names(v):
    return v.raw_enrol().select(
        "state", "district", title_case("state").alias("state_title"),
        title_case("district").alias("district_title"),
    )


# --- aggregates ----------------------------------------------------------------


@query
def market_share(v):
    return agg.market_share(v.enrol())


@query
def daily_totals(v):
    return agg.daily_totals(v.enrol())


@query
def daily_totals_raw(v):
    """Undated rows drop out of the series but not of other sums."""
    return agg.daily_totals(ingest.canonical(v.raw_enrol(), "enrol"))


@query
def daily_totals_by_state(v):
    return agg.daily_totals(v.enrol(), ("state",))


@query
def state_totals(v):
    return agg.totals_by(v.enrol(), ("state",))


@query
def demo_share(v):
    return agg.market_share(v.demo(), "update_volume")


@query
def district_totals(v):
    return agg.totals_by(v.enrol(), ("district",))


@query
def kpi_analytics(v):
    return agg.volume_and_reach(v.enrol())


@query
def reach_by_month(v):
    """Distinct names per month and state from stored cells."""
    cells = settle(reach.reach_cells(v.enrol()))
    return reach.reach(cells, [F.date_trunc("month", "date").cast("date").alias("month"), F.col("state")])


@query
def reach_range(v):
    """Distinct names of a date range from stored cells."""
    return reach.reach(filters.in_date_range(settle(reach.reach_cells(v.enrol())), *RANGE))


@query
def line_quantiles(v):
    """Exact quantiles of a column with many values and of one with many ties, by narrowing sketches."""
    lines = v.table("lineitem")
    found = [
        (column, share, quantiles.exact_quantile(lines, column, share, few=5_000))
        for column in ("l_extendedprice", "l_quantity") for share in (0.01, 0.5, 0.95)
    ]
    return rounded(v.spark.createDataFrame(found, "measure string, share double, value double"))


@query
def hotspot(v):
    return agg.hotspot(v.enrol())


@query
def date_extent(v):
    return agg.date_extent(v.enrol())


@query
def distinct_states(v):
    return agg.distinct_names(v.dirty_enrol(), "state")


@query
def name_counts(v):
    return agg.name_counts(v.dirty_enrol(), "district")


@query
def pin_sets(v):
    return agg.pin_pairs(v.dirty_enrol())


@query
def pin_labels(v):
    return agg.pin_labels(settle(agg.pin_pairs(v.dirty_enrol())))


@query
def pin_overlap(v):
    """Every district name against its closest names: do their PIN sets meet?"""
    dirty = v.dirty_enrol()
    pins = settle(agg.pin_pairs(dirty))
    near = similarity.closest_matches(pins.select(F.col("district").alias("name")).distinct())
    pairs = settle(near.select(F.col("name").alias("suspect"), "candidate"))
    return agg.pin_overlap(pairs, pins, "suspect", "candidate")


@query
def pin_overlap_by_bits(v):
    """The same by bitmaps, with the number of common PINs."""
    dirty = v.dirty_enrol()
    maps = settle(bitmaps.pin_bitmaps(dirty))
    names = maps.select(F.col("district").alias("name")).distinct()
    near = similarity.closest_matches(names)
    pairs = settle(near.select(F.col("name").alias("suspect"), "candidate"))
    return bitmaps.pin_overlap(pairs, maps, "suspect", "candidate")


@query
def pin_counts(v):
    """Distinct PINs per district, united from bitmaps per month."""
    months = v.enrol().withColumn("month", F.date_trunc("month", "date"))
    return bitmaps.pin_counts(bitmaps.united(settle(bitmaps.pin_bitmaps(months, ("district", "month")))))


# --- workload -------------------------------------------------------------------


@query
def workload_by_district(v):
    return workload.workload_by_district(v.enrol(), v.bio())


@query
def workload_ratio(v):
    return rounded(workload.workload_ratio(workload.workload_by_district(v.enrol(), v.bio())))


# --- filters and rankings --------------------------------------------------------


@query
def state_filter(v):
    return filters.in_states(v.enrol(), STATES)


@query
def date_range_view(v):
    return filters.in_date_range(v.enrol(), *RANGE)


@query
def top_states(v):
    return ranking.top_states(v.enrol())


@query
def watchlist(v):
    return ranking.watchlist(v.enrol())


@query
def top5_per_state(v):
    return ranking.top_districts_per_state(agg.market_share(v.enrol()))


@query
def recent_history(v):
    return ranking.recent_history(v.enrol())


@query
def market_share_page(v):
    order = [F.desc("adult_enrolments"), F.asc("state"), F.asc("district")]
    return ranking.page(agg.market_share(v.enrol()), order, 3, 10)


# --- forecast ----------------------------------------------------------------------


@query
def daily_change(v):
    return rounded(fc.daily_change(agg.daily_totals(v.enrol())))


@query
def volatility(v):
    return rounded(fc.series_state(agg.daily_totals(v.enrol())).select("days", "volatility"))


@query
def start_value(v):
    return fc.series_state(agg.daily_totals(v.enrol())).select("last_date", "start_value")


@query
def series_state_by_district(v):
    keys = ("state", "district")
    return rounded(fc.series_state(agg.daily_totals(v.enrol(), keys), keys))


@query
def forecast_drift_only(v):
    return rounded(fc.forecast(agg.daily_totals(v.enrol()), volatility=0.0, growth=0.1, horizon=90))


def _outlook(v):
    return fc.forecast(agg.daily_totals(v.enrol()))


@query
def forecast_seeded(v):
    return significant(_outlook(v))


@query
def forecast_by_state(v):
    daily = agg.daily_totals(v.enrol(), ("state",))
    return significant(fc.forecast(daily, ("state",), horizon=14, model="Polynomial"))


@query
def forecast_bands(v):
    """Quantiles of 200 seeded paths a state."""
    daily = agg.daily_totals(v.enrol(), ("state",))
    return significant(fc.quantile_bands(daily, ("state",), horizon=14, model="Polynomial"))


@query
def forecast_by_district(v):
    keys = ("state", "district")
    return significant(fc.forecast(agg.daily_totals(v.enrol(), keys), keys, horizon=7))


@query
def forecast_scenarios(v):
    return significant(fc.project(fc.series_state(agg.daily_totals(v.enrol())), (), SCENARIOS))


@query
def forecast_summary(v):
    return rounded(fc.summary(_outlook(v)))


@query
def forecast_growth(v):
    return rounded(fc.growth_kpi(_outlook(v)))


@query
def forecast_insight(v):
    return rounded(fc.insight(_outlook(v)))


@query
def insight_by_state(v):
    daily = agg.daily_totals(v.enrol(), ("state",))
    projected = fc.forecast(daily, ("state",), volatility=0.05)
    return rounded(fc.insight(projected, "Linear", ("state",)))


@query
def capacity_plan(v):
    return rounded(fc.capacity_plan(_outlook(v)))


@query
def capacity_by_state(v):
    daily = agg.daily_totals(v.enrol(), ("state",))
    projected = fc.forecast(daily, ("state",), volatility=0.05)
    return rounded(fc.capacity_plan(projected, ("state",)))


@query
def forecast_envelope(v):
    enrol = v.enrol()
    return significant(fc.envelope(enrol, fc.forecast(agg.daily_totals(enrol))))


@query
def forecast_envelope_daily(v):
    enrol = v.enrol()
    return significant(fc.envelope(enrol, fc.forecast(agg.daily_totals(enrol)), daily=True))


@query
def forecast_export(v):
    return exports.forecast_table(_outlook(v))


# --- anomalies -----------------------------------------------------------------------


@query
def anomaly_scores(v):
    scored = anomaly.anomaly_scores(agg.market_share(v.enrol()))
    return rounded(scored.drop("threshold"))


@query
def anomaly_by_pin(v):
    """Groups by PIN too: many more than the forest samples, so its pre-filter is on."""
    keys = ("state", "district", "pincode")
    scored = anomaly.anomaly_scores(agg.totals_by(v.enrol(), keys), keys=keys)
    return rounded(scored.drop("threshold"))


@query
def anomaly_threshold(v):
    scored = anomaly.anomaly_scores(agg.market_share(v.enrol()))
    return rounded(
        scored.agg(
            F.max("threshold").alias("threshold"),
            F.count(F.when(F.col("anomaly") == -1, 1)).alias("flagged"),
            F.count("*").alias("groups"),
        )
    )


def _risks(v):
    return anomaly.risk_table(agg.market_share(v.enrol()))


@query
def risk_table(v):
    return _risks(v)


@query
def top_risks(v):
    return anomaly.top_risks(_risks(v))


@query
def worst_risk(v):
    return anomaly.worst_risk(_risks(v))


@query
def risk_status(v):
    return anomaly.flag_count(_risks(v))


# --- report pages ----------------------------------------------------------------------


def _executive(v):
    cells = reports.day_cells(v.enrol())
    growth = fc.growth_kpi(fc.forecast(agg.daily_totals(cells)))
    issues = anomaly.flag_count(anomaly.risk_table(agg.market_share(cells)))
    return reports.executive_kpis(cells, v.bio(), growth, issues)


@query
def kpi_executive(v):
    return rounded(_executive(v))


@query
def format_kpis(v):
    return reports.kpi_texts(_executive(v))


@query
def regional_export(v):
    return exports.regional(v.enrol())


@query
def trend_export(v):
    return exports.trends(v.enrol())


@query
def risk_export(v):
    return exports.risk(v.enrol())


@query
def ops_export(v):
    return exports.ops(v.enrol(), v.bio())


# --- map -----------------------------------------------------------------------------------


@query
def geo_linear(v):
    return rounded(geo.map_rows(geo.geo_points(geo.depth_limited(v.enrol()), "linear")))


@query
def geo_log(v):
    return rounded(geo.map_rows(geo.geo_points(geo.depth_limited(v.dirty_enrol(), None), "log")))


@query
def geo_selected_states(v):
    return rounded(geo.map_rows(geo.geo_points(geo.depth_limited(v.enrol(), None, STATES), "linear")))


@query
def geo_jitter(v):
    names = agg.distinct_names(v.dirty_enrol(), "district")
    return rounded(
        names.select(
            "district", jitter("district").alias("lat_offset"),
            jitter(F.reverse("district")).alias("lon_offset"),
        )
    )


@query
def geo_summary(v):
    return geo.geo_summary(v.enrol(), STATES)


@query
def geo_focus(v):
    return rounded(geo.focus_points(agg.distinct_names(v.dirty_enrol(), "state")))


@query
def map_export(v):
    return rounded(geo.map_rows(geo.geo_points(geo.depth_limited(v.enrol()), "log")))


@query
def top_districts(v):
    points = geo.map_rows(geo.geo_points(geo.depth_limited(v.enrol()), "log"))
    return rounded(exports.map_top_districts(points))


@query
def top_states_geo(v):
    return exports.map_top_states(geo.depth_limited(v.enrol()))


# --- governance ------------------------------------------------------------------------------


@query
def active_patches(v):
    return gov.active_patches(v.governance_log())


@query
def active_deletions(v):
    return gov.active_deletions(v.governance_log())


@query
def apply_governance(v):
    return gov.apply_governance(v.enrol(), v.governance_log())


@query
def apply_governance_bio(v):
    return gov.apply_governance(v.bio(), v.governance_log())


@query
def apply_governance_demo(v):
    return gov.apply_governance(v.demo(), v.governance_log())


@query
def governed_market_share(v):
    return agg.market_share(gov.apply_governance(v.enrol(), v.governance_log()))


def _stamp(at: str, prefix: str, column: str):
    return {
        "at": F.lit(at).cast("timestamp_ntz"),
        "event_id": F.concat(F.lit(prefix), F.md5(F.col(column))),
    }


@query
def revert(v):
    """Take back everything one administrator did."""
    log = v.governance_log()
    ids = log.where(F.col("user") == "Admin_03").select("id")
    return gov.revert(log, ids, **_stamp("2024-02-01 08:00:00", "r", "id"))


@query
def revert_filtered(v):
    """Take back all that the audit filter shows; what stands afterwards."""
    log = v.governance_log()
    ids = gov.audit(log, "2024-01-10", "2024-01-20", ["State"]).select("id")
    return gov.entries(gov.revert(log, ids, **_stamp("2024-02-01 08:00:00", "r", "id")))


@query
def audit_page(v):
    return gov.audit_page(
        v.governance_log(), 2, start="2024-01-05", end="2024-01-20", scopes=["District"]
    )


@query
def audit_page_deep(v):
    """A page far down the audit view, read from the days that hold it."""
    path = fresh_path(v.spark)
    audit_table.write_audit(v.governance_log(), path)
    return gov.audit_display(audit_table.page(v.spark, path, 40, gov.LOG_PER_PAGE))


@query
def audit_view(v):
    return gov.audit_display(gov.audit(v.governance_log(), "2024-01-05", "2024-01-20"))


@query
def recent_log(v):
    return gov.recent_log(v.governance_log())


@query
def audit_export(v):
    return exports.audit_log(v.governance_log())


@query
def log_extent(v):
    return agg.date_extent(v.governance_log(), "ts")


@query
def state_scan(v):
    return rounded(scans.state_scan(v.dirty_enrol()))


@query
def district_scan(v):
    return rounded(scans.district_scan(v.dirty_enrol()))


@query
def district_scan_largest(v):
    return rounded(scans.district_scan(v.dirty_enrol(), pick="largest"))


@query
def closest_districts(v):
    names = agg.distinct_names(v.dirty_enrol(), "district").withColumnRenamed("district", "name")
    return rounded(similarity.closest_matches(names))


@query
def closest_suppliers(v):
    """A vocabulary that grows with its table, of names that are nearly all alike."""
    return rounded(similarity.closest_matches(v.table("supplier").select(F.col("s_name").alias("name")).distinct()))


@query
def state_scan_nations(v):
    """Suspect states against a vocabulary that comes from a table."""
    return rounded(scans.state_scan(v.dirty_enrol(), v.table("nation").select(F.col("n_name").alias("name"))))


def _issues(v, scope):
    scan = scans.state_scan if scope == "State" else scans.district_scan
    return settle(scan(v.dirty_enrol()))


@query
def pending_issues(v):
    return rounded(gov.pending(_issues(v, "State"), v.dirty_log(), "State"))


@query
def pending_district_issues(v):
    return rounded(gov.pending(_issues(v, "District"), v.dirty_log(), "District"))


@query
def issues_page(v):
    open_issues = gov.pending(_issues(v, "State"), v.dirty_log(), "State")
    return rounded(ranking.page(open_issues, [F.desc("Conf"), F.asc("Suspect")], 2, gov.ISSUES_PER_PAGE))


@query
def auto_fix(v):
    return gov.auto_fix(
        _issues(v, "State"), v.dirty_log(), "State", **_stamp("2024-02-01 09:00:00", "a", "suspect")
    )


@query
def default_actions(v):
    return gov.default_actions(_issues(v, "State"))


@query
def default_district_actions(v):
    names = agg.distinct_names(v.dirty_enrol(), "district").withColumnRenamed("district", "option")
    return gov.default_actions(_issues(v, "District"), settle(names))


def _decisions(v):
    """Proposed actions, but names with few records are deleted, not ignored."""
    issues = _issues(v, "State")
    few = issues.select(F.col("Suspect").alias("suspect"), (F.col("Suspect_Vol") < 100).alias("few"))
    action = F.when((F.col("action") == "Ignore") & F.col("few"), "Delete").otherwise(F.col("action"))
    return issues, gov.default_actions(issues).join(few, "suspect").withColumn("action", action).drop("few")


@query
def commit_decisions(v):
    _, decisions = _decisions(v)
    return gov.as_events(decisions, "State", **_stamp("2024-02-01 10:00:00", "c", "suspect"))


@query
def log_append(v):
    _, decisions = _decisions(v)
    events = gov.as_events(decisions, "State", **_stamp("2024-02-01 10:00:00", "c", "suspect"))
    return gov.append(v.dirty_log(), events)


@query
def tallies(v):
    issues, decisions = _decisions(v)
    return gov.tallies(issues, decisions)

"""Report pages as compositions of operators.

A page needs many small tables from the same facts. ``day_cells`` reduces the
facts to one row per (date, state, district) in a single scan, and every table
of the page is built from those cells: sums of sums are the same sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wardwise.functions import messages
from wardwise.operators.aggregates import (
    daily_totals,
    grand_total,
    market_share,
    volume_and_reach,
)
from wardwise.operators.anomaly import flag_count, risk_table, top_risks, worst_risk
from wardwise.operators.filters import in_date_range
from wardwise.operators.forecast import (
    capacity_plan,
    envelope,
    forecast,
    growth_kpi,
    insight,
    summary,
)
from wardwise.operators.geo import depth_limited, geo_points, geo_summary
from wardwise.operators.ranking import top_states, watchlist
from wardwise.operators.workload import workload_by_district, workload_ratio
from wardwise.schema import BIO_MEASURE, ENROL_MEASURE
from wardwise.sources import exports
from wardwise.sources.drop_folder import recent_messages
from wardwise.sources.tables import settle


def day_cells(df: DataFrame, measure: str = ENROL_MEASURE) -> DataFrame:
    """Facts at (date, state, district) grain, computed once. NULL keys are kept."""
    return settle(df.groupBy("date", "state", "district").agg(F.sum(measure).alias(measure)))


def executive_kpis(enrol_cells: DataFrame, bio: DataFrame, growth: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: total enrolments, biometric updates, risk status, projected growth."""
    return (
        grand_total(enrol_cells, ENROL_MEASURE, "total_enrolments")
        .withColumn("total_bio", grand_total(bio, BIO_MEASURE).scalar())
        .withColumn("issues", issues.select("issues").scalar())
        .withColumn("growth_pct", growth.select("growth_pct").scalar())
        .withColumn("risk_status", messages.risk_status(F.col("issues")))
    )


def kpi_texts(kpis: DataFrame) -> DataFrame:
    """The executive KPIs as shown."""
    return kpis.select(
        messages.thousands(F.col("total_enrolments")).alias("total_enrolments"),
        messages.thousands(F.col("total_bio")).alias("biometric_updates"),
        F.col("risk_status").alias("risk_monitor"),
        messages.percent(F.col("growth_pct")).alias("growth_projection"),
    )


def executive_page(
    enrol: DataFrame, bio: DataFrame, seed: int = 42, ingest_log: DataFrame | None = None
) -> dict[str, DataFrame]:
    """KPI row, risks and 30-day outlook; with an ingest log, its last ten rows."""
    cells = day_cells(enrol)
    risks = settle(risk_table(market_share(cells)))
    outlook = settle(forecast(daily_totals(cells), seed=seed))
    kpis = executive_kpis(cells, bio, growth_kpi(outlook), flag_count(risks))
    return {
        "kpis": kpis,
        "kpi_texts": kpi_texts(kpis),
        "top_risks": top_risks(risks),
        "worst_risk": worst_risk(risks),
        "outlook": outlook,
        "outlook_range": summary(outlook),
        **({} if ingest_log is None else {"ingest_log": recent_messages(ingest_log)}),
    }


def analytics_page(
    enrol: DataFrame, bio: DataFrame, start=None, end=None
) -> dict[str, DataFrame]:
    """Tables of the date-ranged page; risks and workload stay on the whole feeds."""
    view = day_cells(in_date_range(enrol, start, end))
    workload = settle(workload_by_district(enrol, bio))
    return {
        "kpis": volume_and_reach(view),
        "trend": daily_totals(view),
        "top_states": top_states(view),
        "workload": workload,
        "workload_ratio": workload_ratio(workload),
        # positive rows are a row-level condition: this one table reads the facts
        "watchlist": watchlist(in_date_range(enrol, start, end)),
        "risks": settle(risk_table(market_share(enrol))),
        "regional": exports.regional(view),
    }


def forecast_page(
    enrol: DataFrame, horizon: int = 30, growth: float = 0.0, model: str = "Linear", seed: int = 42
) -> dict[str, DataFrame]:
    cells = day_cells(enrol)
    projected = settle(forecast(daily_totals(cells), (), horizon, growth, model, seed))
    return {
        "projection": projected,
        "envelope": envelope(enrol, projected),
        "insight": insight(projected, model),
        "capacity": capacity_plan(projected),
        "table": exports.forecast_table(projected),
    }


def map_page(
    enrol: DataFrame, states: Sequence[str] | None = None, depth: int | None = 5, scale: str = "log"
) -> dict[str, DataFrame]:
    cells = settle(
        enrol.groupBy("state", "district").agg(F.sum(ENROL_MEASURE).alias(ENROL_MEASURE))
    )
    totals = settle(depth_limited(cells, depth, states))
    points = geo_points(totals, scale)
    return {
        "summary": geo_summary(cells, states),
        "points": points,
        "top_districts": exports.map_top_districts(points),
        "top_states": exports.map_top_states(totals),
    }

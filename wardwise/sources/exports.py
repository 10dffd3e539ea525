"""CSV exports of report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardwise.functions.scaling import list_text
from wardwise.operators.aggregates import daily_totals, market_share, totals_by
from wardwise.operators.anomaly import risk_order, risk_table
from wardwise.operators.forecast import display_table
from wardwise.operators.governance import entries
from wardwise.operators.ranking import NATIONAL_TOP, top_districts, top_n
from wardwise.operators.workload import workload_by_district
from wardwise.schema import ENROL_MEASURE


def export_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """Write with a header; arrays become text. ``single_file`` is for small reports.

    Without it every task writes its own part, which is the way for big tables.
    """
    flat = df.select(
        *[
            list_text(F.col(f"`{f.name}`")).alias(f.name)
            if f.dataType.typeName() == "array"
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )
    if single_file:
        flat = flat.coalesce(1)
    flat.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def regional(view: DataFrame) -> DataFrame:
    """(state, district) volumes of the date-ranged view."""
    return market_share(view)


def trends(view: DataFrame) -> DataFrame | None:
    """Daily volumes of the date-ranged view; None when it has no date column."""
    return daily_totals(view) if "date" in view.columns else None


def risk(enrol: DataFrame) -> DataFrame:
    """Anomaly table of the whole feed, not of the date-ranged view."""
    return risk_table(market_share(enrol)).orderBy(*risk_order())


def ops(enrol: DataFrame, bio: DataFrame) -> DataFrame:
    """Workload table of the whole feeds."""
    return workload_by_district(enrol, bio)


def map_top_states(totals: DataFrame, n: int = NATIONAL_TOP) -> DataFrame:
    """Largest states by the volumes shown on the map (the depth-limited table)."""
    return top_n(totals_by(totals, ("state",)), n, [F.desc(ENROL_MEASURE), F.asc("state")])


def map_top_districts(points: DataFrame) -> DataFrame:
    return top_districts(points)


def forecast_table(projected: DataFrame) -> DataFrame:
    return display_table(projected)


def audit_log(log: DataFrame) -> DataFrame:
    """The whole standing log under its report headings."""
    return entries(log).select(
        F.col("id").alias("ID"),
        F.col("ts").alias("Timestamp"),
        F.col("scope").alias("Scope"),
        F.col("action").alias("Action"),
        F.col("original").alias("Original"),
        F.col("target").alias("Target"),
        F.col("user").alias("User"),
    )

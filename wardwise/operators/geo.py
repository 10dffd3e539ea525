"""Map-ready feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardwise.functions.draws import jitter
from wardwise.functions.scaling import linear_share, list_text, log_share, rgba
from wardwise.operators.aggregates import hotspot, market_share, volume_and_reach
from wardwise.operators.filters import in_states
from wardwise.operators.ranking import PER_STATE_TOP, top_districts_per_state
from wardwise.schema import ENROL_MEASURE
from wardwise.sources.dimensions import (
    DEFAULT_FOCUS,
    DEFAULT_POINT,
    STATE_CENTROIDS,
    ZOOM_ALL,
    ZOOM_SELECTED,
    state_centroids,
)

# Fixed values of the map layers.
LINEAR_ELEVATION = 50.0
LOG_ELEVATION = 200000
BASE_RADIUS, RADIUS_RANGE = 4000, 20000


def depth_limited(
    df: DataFrame, depth: int | None = PER_STATE_TOP, states: Sequence[str] | None = None
) -> DataFrame:
    """(state, district) volumes of the selection; ``depth`` per state, None for all."""
    totals = market_share(in_states(df, states))
    return totals if depth is None else top_districts_per_state(totals, depth)


def located(totals: DataFrame) -> DataFrame:
    """Add lat and lon: the state's centre (or the default) plus a stable offset."""
    centres = state_centroids(totals.sparkSession)
    lat, lon = DEFAULT_POINT
    return totals.join(centres, "state", "left").select(
        *totals.columns,
        (F.coalesce("lat", F.lit(lat)) + jitter("district")).alias("lat"),
        (F.coalesce("lon", F.lit(lon)) + jitter(F.reverse("district"))).alias("lon"),
    )


def geo_points(totals: DataFrame, scale: str = "log") -> DataFrame:
    """Points with colour, norm, elevation and radius; ``scale`` is linear or log.

    The value range comes from a scalar subquery over the same group table, not
    from a window without partitions.
    """
    v = F.col(ENROL_MEASURE)
    span = totals.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias("r")).scalar()
    points = located(totals).withColumn("_r", span)
    lo, hi = F.col("_r.lo"), F.col("_r.hi")
    points = points.withColumn("color", rgba(linear_share(v, lo, hi)))
    if scale == "linear":
        points = points.withColumn("norm", linear_share(v, lo, hi)).withColumn(
            "elevation", v * LINEAR_ELEVATION
        )
    else:
        points = (
            points.withColumn("log_v", F.log1p(v))
            .withColumn("norm", log_share(F.col("log_v"), F.log1p(lo), F.log1p(hi)))
            .withColumn("elevation", F.col("norm") * LOG_ELEVATION)
        )
    return points.withColumn("radius", BASE_RADIUS + F.col("norm") * RADIUS_RANGE).drop("_r")


def map_rows(points: DataFrame) -> DataFrame:
    """Points with the colour as text, fit for CSV."""
    return points.withColumn("color", list_text(F.col("color")))


def geo_summary(df: DataFrame, states: Sequence[str] | None = None) -> DataFrame:
    """Visible volume, hotspot and number of districts of the selection."""
    shown = in_states(df, states)
    reach = volume_and_reach(shown).select(
        F.col("total_enrolments").alias("visible_volume"), F.col("active_districts").alias("districts")
    )
    return reach.withColumn("hotspot", hotspot(shown).select("hotspot").scalar())


def focus_points(states: DataFrame) -> DataFrame:
    """View centre and zoom for each state as the first one selected."""
    lat, lon = DEFAULT_FOCUS
    return states.join(state_centroids(states.sparkSession), "state", "left").select(
        "state",
        F.coalesce("lat", F.lit(lat)).alias("lat"),
        F.coalesce("lon", F.lit(lon)).alias("lon"),
        F.lit(ZOOM_SELECTED).alias("zoom"),
    )


def focus(spark: SparkSession, selected: Sequence[str] = ()) -> DataFrame:
    """One row ``(lat, lon, zoom)`` for a selection; the first state decides."""
    lat, lon = STATE_CENTROIDS.get(selected[0], DEFAULT_FOCUS) if selected else DEFAULT_FOCUS
    zoom = ZOOM_SELECTED if selected else ZOOM_ALL
    return spark.createDataFrame([(lat, lon, zoom)], "lat double, lon double, zoom int")

"""Sums, counts and extents over the feeds.

Every aggregate is a plain hash aggregation with map-side partial sums, so a
state or district that owns a third of all rows shrinks to one partial row per
task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wardwise.schema import ENROL_MEASURE


def totals_by(df: DataFrame, keys: Sequence[str], measure: str = ENROL_MEASURE) -> DataFrame:
    """Sum of the measure per key; rows with a NULL key belong to no group."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.sum(measure).alias(measure))


def market_share(df: DataFrame, measure: str = ENROL_MEASURE) -> DataFrame:
    """Volume per (state, district)."""
    return totals_by(df, ("state", "district"), measure)


def daily_totals(
    df: DataFrame, keys: Sequence[str] = (), measure: str = ENROL_MEASURE
) -> DataFrame:
    """Volume per day (and key); undated rows drop out."""
    return totals_by(df, (*keys, "date"), measure)


def grand_total(df: DataFrame, measure: str = ENROL_MEASURE, name: str = "total") -> DataFrame:
    """One row with the sum, 0 when there is nothing to sum."""
    return df.agg(F.coalesce(F.sum(measure), F.lit(0).cast("bigint")).alias(name))


def volume_and_reach(df: DataFrame, measure: str = ENROL_MEASURE) -> DataFrame:
    """One row: total volume, distinct states, distinct district names.

    The facts are reduced to one row per (state, district) first; the two
    distinct counts then expand groups, not facts. Groups keep NULL names so
    that the total counts every row.
    """
    groups = df.groupBy("state", "district").agg(F.sum(measure).alias(measure))
    return groups.agg(
        F.coalesce(F.sum(measure), F.lit(0).cast("bigint")).alias("total_enrolments"),
        F.count_distinct("state").alias("active_states"),
        F.count_distinct("district").alias("active_districts"),
    )


def hotspot(df: DataFrame, measure: str = ENROL_MEASURE) -> DataFrame:
    """District with the largest sum; of equals the alphabetically first."""
    totals = totals_by(df, ("district",), measure)
    order = F.struct(-F.col(measure), F.col("district"))
    return totals.agg(
        F.min_by("district", order).alias("hotspot"), F.max(measure).alias("hotspot_volume")
    )


def date_extent(df: DataFrame, column: str = "date") -> DataFrame:
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last"))


def name_counts(df: DataFrame, column: str) -> DataFrame:
    """Records (rows, not volume) per name; all names in one pass."""
    return df.dropna(subset=[column]).groupBy(column).agg(F.count("*").alias("records"))


def distinct_names(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).dropna().distinct()


def pin_pairs(df: DataFrame, column: str = "district") -> DataFrame:
    """The PIN set of every name in long form: distinct (name, pincode) rows.

    Long form keeps the set distributed; no name's set has to fit in one row.
    """
    return (
        df.where(F.col("pincode") > 0).select(column, "pincode").dropna().distinct()
    )


def pin_labels(pins: DataFrame, column: str = "district") -> DataFrame:
    """Number of PINs and the three lowest as ``"a, b, c..."`` per name."""
    from wardwise.functions.text import first_three
    from wardwise.operators.ranking import top_n_per

    low = top_n_per(pins, 3, (column,), [F.col("pincode").asc()])
    samples = low.groupBy(column).agg(F.sort_array(F.collect_list("pincode")).alias("low"))
    counts = pins.groupBy(column).agg(F.count("*").alias("n_pins"))
    return counts.join(samples, column).select(
        column,
        "n_pins",
        first_three(F.col("low").cast("array<string>"), F.col("n_pins")).alias("pins"),
    )


def pin_overlap(pairs: DataFrame, pins: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` plus evidence flags: has PINs left / right, and do the sets meet.

    The sets meet if an equi join on the PIN finds a common member; a popular
    name on one side is spread over its PINs.
    """
    names = pins.select(F.col("district").alias("_n")).distinct()
    pl = pins.select(F.col("district").alias(left), "pincode")
    pr = pins.select(F.col("district").alias(right), "pincode")
    keys = pairs.select(left, right).distinct()
    met = (
        keys.join(pl, left)
        .join(pr, [right, "pincode"], "left_semi")
        .select(left, right)
        .distinct()
        .withColumn("pins_meet", F.lit(True))
    )
    with_left = names.select(F.col("_n").alias(left), F.lit(True).alias("left_has_pins"))
    with_right = names.select(F.col("_n").alias(right), F.lit(True).alias("right_has_pins"))
    return (
        pairs.join(with_left, left, "left")
        .join(with_right, right, "left")
        .join(met, [left, right], "left")
        .fillna(False, subset=["left_has_pins", "right_has_pins", "pins_meet"])
    )

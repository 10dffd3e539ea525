"""Name scans: which state and district names look like misspellings of others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wardwise.functions.similarity import closest_of, pair_ratio
from wardwise.operators.aggregates import name_counts, pin_labels, pin_overlap, pin_pairs
from wardwise.operators.similarity import closest_in, closest_matches
from wardwise.sources.dimensions import OFFICIAL_STATES
from wardwise.sources.tables import settle, spread

# Similarity cutoffs and number of candidates looked at.
STATE_CUTOFF = 0.4
DISTRICT_CUTOFF = 0.85
DISTRICT_CANDIDATES = 5


def state_scan(df: DataFrame, official: DataFrame | Sequence[str] = OFFICIAL_STATES) -> DataFrame:
    """Non-official state names with the closest official one.

    ``(Suspect, Fix, Conf, Suspect_Vol)``; ``Unknown`` with Conf 0 when nothing
    is close. Facts are reduced to counts per name before any text work.
    ``official`` is a fixed short list, tried by character counts, or a table
    ``(name)`` of any size, which the names meet in a similarity join.
    """
    counts = name_counts(df, "state")
    if isinstance(official, DataFrame):
        words = official.select("name").dropna().distinct()
        suspects = settle(counts.join(words, F.col("state") == F.col("name"), "left_anti"))
        closest = closest_in(suspects.select(F.col("state").alias("name")), words, STATE_CUTOFF)
        found, conf = suspects.join(closest, F.col("state") == F.col("name"), "left"), pair_ratio()
        # the ratio of lower-cased texts, unlike the match itself
        ratio = conf(F.lower("state"), F.lower(F.coalesce("candidate", "state")))
        match = F.struct(
            F.coalesce("candidate", F.lit("Unknown")).alias("fix"),
            F.when(F.col("candidate").isNull(), 0.0).otherwise(ratio).alias("conf"),
        )
    else:
        found = counts.where(~F.col("state").isin(*official))
        match = closest_of(official, STATE_CUTOFF)("state")
    return (
        spread(found, "state")
        .withColumn("_m", match)
        .select(
            F.col("state").alias("Suspect"),
            F.col("_m.fix").alias("Fix"),
            F.col("_m.conf").alias("Conf"),
            F.col("records").alias("Suspect_Vol"),
        )
        .orderBy(F.desc("Conf"), "Suspect")
    )


def district_scan(df: DataFrame, pick: str = "last") -> DataFrame:
    """District names that look like a misspelling of a more frequent one.

    Of the closest names (ratio 0.85 or better), a candidate is skipped when
    both names have PINs but none in common, and accepted only with more records
    than the suspect. ``pick="last"`` takes the least similar accepted candidate,
    ``pick="largest"`` the one with the most records.

    The facts are read once, down to one row per (district, PIN).
    """
    cells = settle(
        df.where(F.col("district").isNotNull())
        .groupBy("district", "pincode")
        .agg(F.count("*").alias("records"))
    )
    counts = cells.groupBy("district").agg(F.sum("records").alias("records"))
    pins = pin_pairs(cells)
    near = closest_matches(
        counts.select(F.col("district").alias("name")), DISTRICT_CANDIDATES, DISTRICT_CUTOFF
    ).select(F.col("name").alias("suspect"), "candidate", "ratio")

    suspects = counts.select(
        F.col("district").alias("suspect"), F.col("records").alias("suspect_records")
    )
    candidates = counts.select(
        F.col("district").alias("candidate"), F.col("records").alias("candidate_records")
    )
    larger = settle(
        near.join(suspects, "suspect")
        .join(candidates, "candidate")
        .where(F.col("candidate_records") > F.col("suspect_records"))
    )
    disjoint = F.col("left_has_pins") & F.col("right_has_pins") & ~F.col("pins_meet")
    accepted = pin_overlap(larger, pins, "suspect", "candidate").where(~disjoint)
    chosen = F.struct("candidate", "candidate_records", "pins_meet")
    if pick == "last":
        best = F.min_by(chosen, F.struct("ratio", "candidate"))
    elif pick == "largest":
        best = F.max_by(chosen, F.struct("candidate_records", "ratio", "candidate"))
    else:
        raise ValueError(f"pick is 'last' or 'largest', not {pick!r}")
    picked = settle(
        accepted.groupBy("suspect", "suspect_records").agg(best.alias("_b"))
        .select("suspect", "suspect_records", "_b.*")
    )
    shown = picked.select(F.col("suspect").alias("district")).unionByName(
        picked.select(F.col("candidate").alias("district"))
    )
    labels = pin_labels(pins.join(shown.distinct(), "district", "left_semi"))
    of_suspect = labels.select(F.col("district").alias("suspect"), F.col("pins").alias("s_pins"))
    of_fix = labels.select(F.col("district").alias("candidate"), F.col("pins").alias("c_pins"))
    conf = pair_ratio()
    # the ratio runs on (suspect, fix) in lower case, unlike the match itself
    return (
        picked.withColumn("Conf", conf(F.lower("suspect"), F.lower("candidate")))
        .join(of_suspect, "suspect", "left")
        .join(of_fix, "candidate", "left")
        .select(
            F.col("suspect").alias("Suspect"),
            F.col("candidate").alias("Fix"),
            "Conf",
            F.col("suspect_records").alias("Suspect_Vol"),
            F.col("candidate_records").alias("Target_Vol"),
            F.col("pins_meet").alias("PIN_Overlap"),
            F.coalesce("s_pins", F.lit("")).alias("Suspect_PINs"),
            F.coalesce("c_pins", F.lit("")).alias("Fix_PINs"),
        )
        .orderBy(F.desc("Conf"), "Suspect")
    )

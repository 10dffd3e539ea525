"""PIN sets as bitmaps.

A name's PINs become one bitmap per 32,768 consecutive numbers, so a shuffle moves a
few compressed words per name instead of a row per PIN, and sets unite (over days,
feeds) and intersect by bits. Bitmaps are built by partial aggregation per task: a name
with a third of all rows is a few bitmaps per task before anything moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def pin_bitmaps(df: DataFrame, keys: Sequence[str] = ("district",)) -> DataFrame:
    """``(keys, bucket, bits)``: the valid PINs of every name, or of every name and day."""
    return (
        df.where(F.col("pincode") > 0)
        .dropna(subset=list(keys))
        .groupBy(*keys, F.bitmap_bucket_number("pincode").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("pincode")).alias("bits"))
    )


def united(maps: DataFrame, column: str = "district") -> DataFrame:
    """One bitmap per (name, bucket) of several, as of days, feeds or months."""
    return maps.groupBy(column, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def pin_counts(maps: DataFrame, column: str = "district") -> DataFrame:
    """Distinct PINs per name."""
    return maps.groupBy(column).agg(F.sum(F.bitmap_count("bits")).alias("n_pins"))


def shared_pins(pairs: DataFrame, maps: DataFrame, left: str, right: str) -> DataFrame:
    """``(left, right, shared)``: how many PINs the two names of each pair have in common.

    Both names' bitmaps of a bucket meet in one group of two, whose conjunction is
    counted; a name with bitmaps in many buckets is spread over them. Pairs without a
    common PIN do not appear, and neither do pairs of a name with itself.
    """
    keys = pairs.select(left, right).where(F.col(left) != F.col(right)).distinct()
    sides = F.explode(F.array(F.col(left), F.col(right))).alias("district")
    return (
        keys.select(left, right, sides)
        .join(maps, "district")
        .groupBy(left, right, "bucket")
        .agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("_names"))
        .where(F.col("_names") == 2)
        .groupBy(left, right)
        .agg(F.sum(F.bitmap_count("bits")).alias("shared"))
        .where(F.col("shared") > 0)
    )


def pin_overlap(pairs: DataFrame, maps: DataFrame, left: str, right: str) -> DataFrame:
    """``aggregates.pin_overlap`` by bits: has PINs left / right, do the sets meet, and in how many PINs.

    The pairs are of different names, as a scan's are.
    """
    names = maps.select(F.col("district").alias("_n")).distinct()
    with_left = names.select(F.col("_n").alias(left), F.lit(True).alias("left_has_pins"))
    with_right = names.select(F.col("_n").alias(right), F.lit(True).alias("right_has_pins"))
    return (
        pairs.join(with_left, left, "left")
        .join(with_right, right, "left")
        .join(shared_pins(pairs, maps, left, right), [left, right], "left")
        .withColumn("pins_meet", F.col("shared").isNotNull())
        .fillna(False, subset=["left_has_pins", "right_has_pins"])
        .fillna(0, subset=["shared"])
    )

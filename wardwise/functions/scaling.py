"""Colour buckets and min-max scaling for map tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# RGBA by share of the value range, lowest bucket first.
LOW_RGBA = (0, 255, 255, 140)
MID_RGBA = (255, 191, 0, 160)
HIGH_RGBA = (255, 0, 50, 200)
LOW_BELOW, MID_BELOW = 0.1, 0.3


def linear_share(v: Column, lo: Column, hi: Column) -> Column:
    return (v - lo).cast("double") / (hi - lo + F.lit(1)).cast("double")


def log_share(log_v: Column, lo: Column, hi: Column) -> Column:
    return (log_v - lo) / (hi - lo + F.lit(0.1))


def rgba(share: Column) -> Column:
    def literal(values):
        return F.array(*[F.lit(x) for x in values])

    return (
        F.when(share < LOW_BELOW, literal(LOW_RGBA))
        .when(share < MID_BELOW, literal(MID_RGBA))
        .otherwise(literal(HIGH_RGBA))
    )


def list_text(values: Column) -> Column:
    """``[0, 255, 255, 140]``: an array as one CSV cell."""
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ", "), F.lit("]"))

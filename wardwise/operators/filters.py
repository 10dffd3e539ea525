"""Row predicates of the report pages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, functions as F

from wardwise.schema import ENROL_MEASURE


def in_states(df: DataFrame, states: Sequence[str] | DataFrame | None) -> DataFrame:
    """Keep the selected states; an empty selection keeps everything.

    A list becomes a pushed-down ``IN``; a DataFrame ``(state)`` a semi join.
    """
    if isinstance(states, DataFrame):
        return df.join(states.select("state").distinct(), "state", "left_semi")
    return df.where(F.col("state").isin(*states)) if states else df


def in_date_range(
    df: DataFrame, start: date | str | None = None, end: date | str | None = None
) -> DataFrame:
    """Inclusive day range; unless both ends are given nothing is filtered."""
    if start is None or end is None:
        return df
    return df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def positive_rows(df: DataFrame, measure: str = ENROL_MEASURE) -> DataFrame:
    """Rows with a positive measure (before any grouping)."""
    return df.where(F.col(measure) > 0)


def valid_pins(df: DataFrame) -> DataFrame:
    """Rows with a PIN; 0 stands for none."""
    return df.where(F.col("pincode") > 0)

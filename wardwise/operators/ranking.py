"""Top-k, top-k per group and pages.

``orderBy().limit()`` becomes a per-task top-k merged at the end, and
``row_number() <= k`` is cut to k rows per group before the shuffle, so neither
sorts or moves the whole input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardwise.operators.aggregates import totals_by
from wardwise.operators.filters import positive_rows
from wardwise.schema import ENROL_MEASURE

NATIONAL_TOP = 10
WATCHLIST_SIZE = 10
RISK_TOP = 5
PER_STATE_TOP = 5
MAP_TOP = 20
RECENT_ROWS = 60
RECENT_LOG = 10


def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_n_per(
    df: DataFrame, n: int, keys: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def top_states(df: DataFrame, n: int = NATIONAL_TOP, measure: str = ENROL_MEASURE) -> DataFrame:
    """Largest states by volume; of equals the alphabetically first."""
    return top_n(
        totals_by(df, ("state",), measure), n, [F.desc(measure), F.asc("state")]
    )


def watchlist(df: DataFrame, n: int = WATCHLIST_SIZE, measure: str = ENROL_MEASURE) -> DataFrame:
    """Smallest (state, district) volumes, counting positive rows only."""
    totals = totals_by(positive_rows(df, measure), ("state", "district"), measure)
    return top_n(totals, n, [F.asc(measure), F.asc("state"), F.asc("district")])


def top_districts_per_state(
    totals: DataFrame, n: int = PER_STATE_TOP, measure: str = ENROL_MEASURE
) -> DataFrame:
    return top_n_per(totals, n, ("state",), [F.desc(measure), F.asc("district")])


def top_districts(totals: DataFrame, n: int = MAP_TOP, measure: str = ENROL_MEASURE) -> DataFrame:
    return top_n(totals, n, [F.desc(measure), F.asc("state"), F.asc("district")])


def recent_history(df: DataFrame, n: int = RECENT_ROWS, measure: str = ENROL_MEASURE) -> DataFrame:
    """The last ``n`` rows (not days) by date, in ascending order."""
    tie = [F.asc("state"), F.asc("district"), F.asc("pincode"), F.asc(measure)]
    last = top_n(df.where(F.col("date").isNotNull()), n, [F.desc("date"), *tie])
    return last.orderBy("date", *tie)

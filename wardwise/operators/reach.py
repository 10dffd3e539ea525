"""Reach over any date range from stored sketches: volumes and distinct names without the facts.

A cell is one (date, state): its volume, and one HyperLogLog sketch each of the
district names and the valid PINs seen. Cells are made in one aggregation over the
facts, appended day by day, and united over whatever range and grouping is asked
for; the facts are not read again. United sketches equal the sketch of all rows.

The relative standard error of a distinct count is ``1.04 / sqrt(2 ** precision)``
(0.8 % by default); counts up to a few thousand come out exact but for hash ties.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardwise.operators.filters import in_date_range
from wardwise.schema import ENROL_MEASURE
from wardwise.sources.tables import months_of, read_months, settle, write_canonical, write_months

PRECISION = 14  # a sketch takes at most 2 ** PRECISION bytes


def reach_cells(df: DataFrame, measure: str = ENROL_MEASURE, precision: int = PRECISION) -> DataFrame:
    """``(date, state, measure, districts, pins)``; rows without a date or state keep a cell of their own."""
    return df.groupBy("date", "state").agg(
        F.sum(measure).alias(measure),
        F.hll_sketch_agg("district", precision).alias("districts"),
        F.hll_sketch_agg(F.when(F.col("pincode") > 0, F.col("pincode")), precision).alias("pins"),
    )


def write_cells(cells: DataFrame, path: str, mode: str = "append") -> None:
    """By month, so that a range reads only the months it touches; undated cells go to ``month=0``."""
    month = F.coalesce(F.year("date") * 100 + F.month("date"), F.lit(0))
    cells.withColumn("month", month).write.mode(mode).partitionBy("month").parquet(path)


def read_cells(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    cells = spark.read.parquet(path)
    if start is not None and end is not None:
        months = [F.year(d) * 100 + F.month(d) for d in (F.to_date(F.lit(start)), F.to_date(F.lit(end)))]
        cells = in_date_range(cells.where(F.col("month").between(*months)), start, end)
    return cells.drop("month")


def load_new(new: DataFrame, table: str, cells: str, feed: str = "enrol", measure: str = ENROL_MEASURE) -> list[int]:
    """Add new canonical rows to their months, and replace the cells of those months only.

    What is read and written depends on the new rows and the months they fall in, not
    on how many other months the tables hold. Cells are made anew from the month's
    rows, so a second call of ``refresh_cells`` after a failure gives the same cells.
    Returns the months.
    """
    new = settle(new)
    months = months_of(new)
    write_canonical(new, table, "append")
    refresh_cells(new.sparkSession, table, cells, months, feed, measure)
    return months


def refresh_cells(
    spark: SparkSession, table: str, cells: str, months: Sequence[int], feed: str = "enrol", measure: str = ENROL_MEASURE
) -> None:
    """The stored cells of ``months``, made anew from the canonical table."""
    if months:
        write_months(reach_cells(read_months(spark, table, feed, list(months)), measure), cells)


def reach(cells: DataFrame, keys: Sequence = (), measure: str = ENROL_MEASURE) -> DataFrame:
    """``(keys, measure, active_states, active_districts, active_pins)`` over the given cells; states are exact."""
    count = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c))
    return cells.groupBy(*keys).agg(
        F.coalesce(F.sum(measure), F.lit(0).cast("bigint")).alias(measure),
        F.count_distinct("state").alias("active_states"),
        F.coalesce(count("districts"), F.lit(0).cast("bigint")).alias("active_districts"),
        F.coalesce(count("pins"), F.lit(0).cast("bigint")).alias("active_pins"),
    )

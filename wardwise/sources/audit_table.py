"""The audit view as a table by day, newest first, with pages of any depth.

``rows`` holds the entries, partitioned by day and sorted within it; ``days`` how many
stand per day and scope. The counts say which days a page lies in, so page 1,000 reads
the one or two days it shows, where an offset would sort all entries before it. Paging
on from the last row shown works likewise, and new entries do not shift its pages.

Entries that a Revert takes back stay in their day, marked, so a day that was written
once can be replaced whole by new events; other days are not rewritten.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wardwise.operators.governance import LOG_COLUMNS, LOG_PER_PAGE, SCOPE_COLUMNS, audit_order
from wardwise.sources.tables import settle

SCOPES = tuple(SCOPE_COLUMNS)


def _write_days(rows: DataFrame, path: str) -> None:
    """Replace the days that ``rows`` has entries of; a large day becomes several files."""
    rows = rows.select(*LOG_COLUMNS, "back", "day")
    days = rows.groupBy("day", "scope").agg(F.count(F.when(~F.col("back"), 1)).alias("n"))
    newest = [F.desc("day"), *audit_order()]
    for table, df in (("rows", rows.repartitionByRange(*newest).sortWithinPartitions(*newest)), ("days", days.repartition("day"))):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/{table}")


def marked_entries(log: DataFrame) -> DataFrame:
    """Merge and Delete entries with their day and whether a Revert of this log takes them back."""
    taken_back = F.col("action") == "Revert"
    return (
        log.where(F.col("action").isin("Merge", "Delete", "Revert"))
        .groupBy(F.when(taken_back, F.col("target")).otherwise(F.col("id")).alias("_id"))
        .agg(F.max(F.when(~taken_back, F.struct(*LOG_COLUMNS))).alias("_e"), F.bool_or(taken_back).alias("back"))
        .where(F.col("_e").isNotNull())
        .select("_e.*", "back", F.to_date("_e.ts").alias("day"))
    )


def write_audit(log: DataFrame, path: str) -> None:
    """The table of a whole log."""
    _write_days(settle(marked_entries(log)), path)


def add_events(spark: SparkSession, events: DataFrame, path: str) -> None:
    """Take a batch of events in; a Revert names an entry of this or an earlier batch.

    Only the days of the new entries and of those taken back are written; of the others
    the ids alone are read, and only to find what a Revert names.
    """
    new = settle(marked_entries(events))
    reverted = settle(events.where(F.col("action") == "Revert").select(F.col("target").alias("id")).distinct())
    old = spark.read.parquet(f"{path}/rows")
    hit = old.join(reverted, "id", "left_semi").select("day")
    days = [r.day for r in settle(hit.unionAll(new.select("day"))).distinct().collect()]  # days, not entries
    kept = (
        old.where(F.col("day").isin(days))
        .join(new.select("id"), "id", "left_anti")
        .join(reverted.withColumn("_now", F.lit(True)), "id", "left")
        .withColumn("back", F.col("back") | F.coalesce("_now", F.lit(False)))
    )
    _write_days(settle(kept.select(*new.columns).unionByName(new)), path)


def _counted(spark: SparkSession, path: str, scopes: Sequence[str]) -> DataFrame:
    """(day, n, before): standing entries of each day, and of all later days; one row a day."""
    days = spark.read.parquet(f"{path}/days").where(F.col("scope").isin(*scopes))
    later = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    return days.groupBy("day").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(later), F.lit(0)))


def _rows(spark: SparkSession, path: str, scopes: Sequence[str], first, last) -> DataFrame:
    rows = spark.read.parquet(f"{path}/rows").where(~F.col("back") & F.col("scope").isin(*scopes))
    return rows.where(F.col("day").between(F.lit(first), F.lit(last))).select(*LOG_COLUMNS)


def page(
    spark: SparkSession, path: str, number: int = 1, size: int = LOG_PER_PAGE, scopes: Sequence[str] = SCOPES
) -> DataFrame:
    """Page ``number`` (from 1) of the standing entries, newest first; only its days are read."""
    skip = (number - 1) * size
    on_page = _counted(spark, path, scopes).where((F.col("before") < skip + size) & (F.col("before") + F.col("n") > skip))
    at = on_page.agg(F.min("day").alias("first"), F.max("day").alias("last"), F.min("before").alias("before")).first()
    rows = _rows(spark, path, scopes, at["first"], at["last"])
    return rows.orderBy(*audit_order()).offset(skip - (at["before"] or 0)).limit(size)


def page_after(
    spark: SparkSession, path: str, ts: datetime, id: str, size: int = LOG_PER_PAGE, scopes: Sequence[str] = SCOPES
) -> DataFrame:
    """The ``size`` standing entries that follow the one at (``ts``, ``id``), whether or not it still stands."""
    at, counted = F.lit(ts), _counted(spark, path, scopes)
    own, earlier = F.to_date(at), F.col("day") < F.to_date(at)
    upto = F.sum(F.when(earlier, F.col("n")).otherwise(0)).over(Window.orderBy(F.desc("day")))
    days = counted.withColumn("upto", upto).agg(
        F.max(F.when(earlier & (F.col("upto") >= size), F.col("day"))).alias("enough"),
        F.min(F.when(earlier, F.col("day"))).alias("oldest"), F.max(own).alias("own"),
    ).first()
    rows = _rows(spark, path, scopes, days["enough"] or days["oldest"] or days["own"], days["own"])
    return rows.where((F.col("ts") < at) | ((F.col("ts") == at) & (F.col("id") > id))).orderBy(*audit_order()).limit(size)

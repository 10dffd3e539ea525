"""Tables on shared storage: canonical feeds and settled intermediate results."""

from __future__ import annotations

import atexit
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardwise.schema import feed_schema

#: paths settled so far, by application
SETTLED: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; without one, a folder in the session's warehouse.

    Both are shared by all executors. No machine-local folder is ever used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/") if folder else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/settled"


def release(spark: SparkSession) -> int:
    """Drop all tables settled so far; returns how many.

    For the end of a run: results that were not written or collected yet are
    lost with them. What is left when the driver ends is dropped then.
    """
    paths = SETTLED.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)


@atexit.register
def _release_at_end() -> None:
    spark = SparkSession.getActiveSession() if SparkContext._active_spark_context else None
    if spark is not None:
        release(spark)


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder, dropped by ``release``."""
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    SETTLED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and continue from a table in the shared folder.

    For results that several later steps read. The lineage is cut, a lost
    executor costs nothing already computed, and the optimizer knows the exact
    size afterwards, so it broadcasts the table only if it is really small.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash rows over all shuffle partitions, for steps whose cost is not in bytes.

    Adaptive execution merges partitions by size; a few megabytes of names can
    still be hours of text comparison, so their number is fixed here.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def month_of(column: str = "date"):
    """The partition of a row: year and month, 0 without a date."""
    return F.coalesce(F.year(column) * 100 + F.month(column), F.lit(0))


def write_canonical(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Canonical feed as Parquet, partitioned by month for date pruning.

    Rows without a date go to the ``month=0`` partition.
    """
    df.withColumn("month", month_of()).write.mode(mode).partitionBy("month").parquet(path)


def write_months(df: DataFrame, path: str) -> None:
    """Like ``write_canonical``, but only the months that ``df`` has rows of are replaced."""
    df.withColumn("month", month_of()).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("month").parquet(path)


def months_of(df: DataFrame) -> list[int]:
    """The months that ``df`` has rows of; one row a month comes to the driver."""
    return sorted(r.month for r in df.select(month_of().alias("month")).distinct().collect())


def read_months(spark: SparkSession, path: str, feed: str, months: list[int]) -> DataFrame:
    """The given months of a canonical feed; no other partition is read."""
    schema = feed_schema(feed).add("month", "integer")
    return spark.read.schema(schema).parquet(path).where(F.col("month").isin(months)).drop("month")


def read_canonical(
    spark: SparkSession, path: str, feed: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Canonical feed back, reading only the months the range touches."""
    schema = feed_schema(feed).add("month", "integer")
    df = spark.read.schema(schema).parquet(path)
    if start is not None and end is not None:
        lo, hi = F.to_date(F.lit(start)), F.to_date(F.lit(end))
        df = df.where(
            F.col("month").between(
                F.year(lo) * 100 + F.month(lo), F.year(hi) * 100 + F.month(hi)
            )
            & F.col("date").between(lo, hi)
        )
    return df.drop("month")

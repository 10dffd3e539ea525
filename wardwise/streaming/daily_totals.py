"""Daily totals kept up to date while files arrive, out of order within bounds.

A day's totals are state of the stream until the watermark, the latest date seen
less ``lateness``, has passed the day. Then they are final: written once, and their
state is dropped, so state holds the open days only, however long the stream runs.
Rows for a day that is final already are left out; ``late_rows`` counts them. In
what the watermark still allows, totals equal those of one batch over all files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wardwise.schema import ENROL_MEASURE
from wardwise.sources.drop_folder import CSV_GLOB
from wardwise.streaming.drop_folder import feed_stream

LATENESS = "7 days"


def open_totals(rows: DataFrame, keys: Sequence[str] = (), measure: str = ENROL_MEASURE, lateness: str = LATENESS) -> DataFrame:
    """Streaming ``(keys, date, measure)``; undated rows and NULL keys belong to no total."""
    return (
        rows.dropna(subset=[*keys, "date"])
        .withColumn("_at", F.col("date").cast("timestamp"))
        .withWatermark("_at", lateness)
        .groupBy(*keys, "_at")
        .agg(F.sum(measure).alias(measure))
        .select(*keys, F.to_date("_at").alias("date"), measure)
    )


def close_days(
    spark: SparkSession, folder: str, header: Sequence[str], table: str, state: str, keys: Sequence[str] = (),
    measure: str = ENROL_MEASURE, lateness: str = LATENESS, glob: str = CSV_GLOB,
) -> StreamingQuery:
    """Take in all files not seen yet, append the totals of days that became final, and stop."""
    _, rows = feed_stream(spark, folder, header, glob)
    query = (
        open_totals(rows, keys, measure, lateness)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", table)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def late_rows(query: StreamingQuery) -> int:
    """Partial totals that came after their day was final, over the batches of this run."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])

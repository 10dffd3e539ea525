"""Incremental ingestion: files that arrive later join the canonical table.

The same parsing as the batch path, run by Structured Streaming's file source.
A stream binds one header, so there is one stream per (feed, header); the source
remembers which files it has seen and every file is taken in exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wardwise.functions.text import missing_to_null
from wardwise.sources.drop_folder import CSV_GLOB, canonical, feed_of, normalize_header


def feed_stream(
    spark: SparkSession, folder: str, header: Sequence[str], glob: str = CSV_GLOB
) -> tuple[str, DataFrame]:
    """Feed name and canonical streaming DataFrame of files with this header."""
    names = normalize_header(header)
    feed = feed_of(names)
    if feed is None:
        raise ValueError(f"no feed has the columns {names}")
    raw = (
        spark.readStream.schema(", ".join(f"`{n}` string" for n in names))
        .option("header", True)
        .option("enforceSchema", False)  # another header is an error, not other columns
        .option("escape", '"')
        .option("pathGlobFilter", glob)
        .csv(folder)
    )
    return feed, canonical(raw.select(*[missing_to_null(f"`{n}`").alias(n) for n in names]), feed)


def append_new_files(
    spark: SparkSession, folder: str, header: Sequence[str], table: str, state: str,
    glob: str = CSV_GLOB,
) -> StreamingQuery:
    """Take in everything not seen yet and stop; ``state`` keeps what was seen."""
    _, rows = feed_stream(spark, folder, header, glob)
    query = (
        rows.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query

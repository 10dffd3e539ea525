"""Facts that keep arriving, under rulings that keep changing.

The governance log is a stream of its own. Its state is one entry per id with the word
whether a Revert has taken it back, in either order of arrival, so a name that is ruled
on over and over is spread over its entries. A batch writes the entries it changed, by
bucket of the name, and then what holds now for the names it touched; of the older
entries it reads the buckets of those names only.

``in_force`` is what ``governance.rulings`` says of the whole log taken in so far.
Arriving facts are governed by what is in force when their batch begins. Facts written
under earlier rulings stay as they are: keep the raw feed and use ``govern(raw,
in_force(...))`` where all of them have to follow.

Every batch replaces its own folder, so one that is run again after a failure leaves
each row once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wardwise.operators.governance import LOG_COLUMNS, govern, ruled
from wardwise.schema import GOVERNANCE_LOG
from wardwise.sources.drop_folder import CSV_GLOB
from wardwise.streaming.drop_folder import feed_stream

BUCKETS = 64
ENTRY = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in GOVERNANCE_LOG)
ENTRIES = f"{ENTRY}, back boolean, batch bigint, bucket int"
SAME_NAME = "t.scope <=> n.scope and t.original <=> n.original"
RULINGS = "scope string, original string, target string, deleted boolean, batch bigint"


def changed_entries(log: DataFrame) -> DataFrame:
    """Streaming ``(_id, entry, back)``: Merge and Delete entries with what is known of them, by id."""
    taken_back = F.col("action") == "Revert"
    return (
        log.where(F.col("action").isin("Merge", "Delete", "Revert"))
        .groupBy(F.when(taken_back, F.col("target")).otherwise(F.col("id")).alias("_id"))
        .agg(F.bool_or(taken_back).alias("back"), F.max(F.when(~taken_back, F.struct(*LOG_COLUMNS))).alias("entry"))
    )


def _write_batch(updates: DataFrame, number: int, folder: str, buckets: int) -> None:
    spark = updates.sparkSession
    bucket = F.pmod(F.xxhash64("scope", "original"), F.lit(buckets)).cast("int")
    (
        updates.where(F.col("entry").isNotNull())  # else a Revert whose entry is still to come
        .select("entry.*", "back")
        .withColumn("bucket", bucket)
        .repartition("bucket")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{folder}/entries/batch={number}")
    )
    known = spark.read.schema(ENTRIES).parquet(f"{folder}/entries").where(F.col("batch") <= number)
    touched = known.where(F.col("batch") == number).select("bucket", "scope", "original").distinct()
    latest = (
        known.alias("t").join(touched.alias("n"), (F.col("t.bucket") == F.col("n.bucket")) & F.expr(SAME_NAME), "left_semi")
        .groupBy("id")
        .agg(F.max_by(F.struct(*LOG_COLUMNS, "back"), "batch").alias("_e"))
        .select("_e.*")
    )
    now = ruled(latest.where("not back"))
    (
        touched.alias("t").join(now.alias("n"), F.expr(SAME_NAME), "left")
        .select("t.scope", "t.original", "n.target", F.coalesce("n.deleted", F.lit(False)).alias("deleted"))
        .write.mode("overwrite")
        .parquet(f"{folder}/rulings/batch={number}")
    )


def follow_log(
    spark: SparkSession, log: str, folder: str, state: str, buckets: int = BUCKETS, files_per_batch: int | None = None
) -> StreamingQuery:
    """Take in what ``governance.write_events`` appended to the log, bring ``folder`` up to date, and stop.

    ``buckets`` is fixed for the life of a folder.
    """
    reader = spark.readStream.schema(GOVERNANCE_LOG)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        changed_entries(reader.parquet(log))
        .writeStream.outputMode("update")
        .foreachBatch(lambda updates, number: _write_batch(updates, number, folder, buckets))
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def in_force(spark: SparkSession, folder: str) -> DataFrame:
    """``(scope, original, target, deleted)`` for every name a ruling stands for; none before the first batch."""
    try:
        changes = spark.read.schema(RULINGS).parquet(f"{folder}/rulings")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        changes = spark.createDataFrame([], RULINGS)
    return (
        changes.groupBy("scope", "original")
        .agg(F.max_by(F.struct("target", "deleted"), "batch").alias("_now"))
        .select("scope", "original", "_now.target", "_now.deleted")
        .where(F.col("target").isNotNull() | F.col("deleted"))
    )


def govern_new_files(
    spark: SparkSession, folder: str, header: Sequence[str], rulings: str, table: str, state: str, glob: str = CSV_GLOB
) -> StreamingQuery:
    """Take in all files not seen yet under the rulings in force, and stop; ``table`` has one folder a batch."""
    _, rows = feed_stream(spark, folder, header, glob)

    def write(batch: DataFrame, number: int) -> None:
        governed = govern(batch, in_force(batch.sparkSession, rulings))
        governed.write.mode("overwrite").parquet(f"{table}/batch={number}")

    query = (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query

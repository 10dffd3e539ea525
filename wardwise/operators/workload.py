"""New registrations against record updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardwise.functions import messages
from wardwise.operators.aggregates import totals_by
from wardwise.schema import BIO_MEASURE, ENROL_MEASURE


def workload_by_district(enrol: DataFrame, bio: DataFrame) -> DataFrame:
    """Enrolments and biometric updates per district *name*, 0 where one is missing.

    Both feeds are summed before the join, so the join sees one row per name.
    With no enrolments at all the result is empty. Whether there are any is read
    off the sums, those of rows without a name included: the scalar query and the
    join share one aggregation, so each feed is read once.
    """
    e = enrol.groupBy("district").agg(F.sum(ENROL_MEASURE).alias("Enrolments"))
    b = totals_by(bio, ("district",), BIO_MEASURE).withColumnRenamed(BIO_MEASURE, "Bio_Updates")
    any_enrolment = e.agg(F.max(F.struct("district", "Enrolments"))).scalar().isNotNull()
    return (
        e.join(b, "district", "full_outer")
        .where(F.col("district").isNotNull() & any_enrolment)
        .fillna(0, subset=["Enrolments", "Bio_Updates"])
    )


def workload_ratio(workload: DataFrame) -> DataFrame:
    """Split and ratio over all districts, with the ratio as a sentence."""
    totals = workload.agg(
        F.coalesce(F.sum("Enrolments"), F.lit(0).cast("bigint")).alias("new_enrolments"),
        F.coalesce(F.sum("Bio_Updates"), F.lit(0).cast("bigint")).alias("bio_updates"),
    )
    ratio = F.col("bio_updates") / (F.col("new_enrolments") + 1)
    return totals.withColumn("ratio", ratio).withColumn(
        "insight", F.format_string(messages.RATIO, F.col("ratio"))
    )

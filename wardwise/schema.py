"""Canonical layouts of the three feeds and of the governance log."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ("date", "state", "district", "pincode")

ENROL_MEASURE = "adult_enrolments"
BIO_MEASURE = "bio_stress"
DEMO_MEASURE = "update_volume"

MEASURE_OF = {"enrol": ENROL_MEASURE, "bio": BIO_MEASURE, "demo": DEMO_MEASURE}


def feed_schema(feed: str) -> T.StructType:
    """Schema of the canonical table of one feed (``enrol``, ``bio``, ``demo``)."""
    return T.StructType(
        [
            T.StructField("date", T.DateType()),
            T.StructField("state", T.StringType()),
            T.StructField("district", T.StringType()),
            T.StructField("pincode", T.IntegerType()),
            T.StructField(MEASURE_OF[feed], T.LongType()),
        ]
    )


INGEST_LOG = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

GOVERNANCE_LOG = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("scope", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("original", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("user", T.StringType()),
    ]
)

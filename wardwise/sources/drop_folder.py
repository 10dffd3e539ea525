"""Drop-folder ingestion: mixed CSV files, recognized by header, to typed feeds."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wardwise.functions.parse import count_or_zero, day_first_date, pin_code
from wardwise.functions.text import clean_name, missing_to_null
from wardwise.schema import (
    BIO_MEASURE,
    DEMO_MEASURE,
    ENROL_MEASURE,
    INGEST_LOG,
    KEYS,
    feed_schema,
)
from wardwise.sources.tables import settle

# The columns that make up each measure and identify each feed.
ADULT_COLUMN = "age_18_greater"
ENROL_PARTS = ("age_0_5", "age_5_17", "age_18_greater")
ENROL_MARKS = ("age_0_5", "age_18_greater")
BIO_PARTS = ("bio_age_5_17", "bio_age_17_")
DEMO_PARTS = ("demo_age_5_17", "demo_age_17_")
BIO_MARK, DEMO_MARK = "bio_age", "demo_age"
SIMULATED_SHARE = 0.4

CSV_GLOB = "*.[cC][sS][vV]"


@dataclass(frozen=True)
class Feeds:
    enrol: DataFrame
    bio: DataFrame
    demo: DataFrame
    log: DataFrame


# --- headers -----------------------------------------------------------------


def normalize_header(names: Iterable[str]) -> list[str]:
    return [str(n).lower().strip() for n in names]


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case, stripped column names; done before any union."""
    return df.toDF(*normalize_header(df.columns))


def feed_of(header: Sequence[str]) -> str | None:
    """Feed of a normalized header; the first rule that fits wins."""
    if any(BIO_MARK in name for name in header):
        return "bio"
    if any(DEMO_MARK in name for name in header):
        return "demo"
    if any(name in ENROL_MARKS for name in header):
        return "enrol"
    return None


def union_files(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts, columns matched by name, gaps NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# --- raw feed to canonical feed ----------------------------------------------


def _sum_of(df: DataFrame, parts: Sequence[str]):
    def cell(name: str):
        if isinstance(df.schema[name].dataType, T.IntegralType):
            return F.coalesce(F.col(name).cast("bigint"), F.lit(0).cast("bigint"))
        return count_or_zero(name)

    present = [cell(c) for c in parts if c in df.columns]
    return reduce(lambda a, b: a + b, present) if present else F.lit(0).cast("bigint")


def with_adult_enrolments(df: DataFrame) -> DataFrame:
    """18+ where any file of the feed has that column, else the sum of the others."""
    parts = (ADULT_COLUMN,) if ADULT_COLUMN in df.columns else ENROL_PARTS
    return df.withColumn(ENROL_MEASURE, _sum_of(df, parts))


def with_bio_stress(df: DataFrame) -> DataFrame:
    return df.withColumn(BIO_MEASURE, _sum_of(df, BIO_PARTS))


def with_update_volume(df: DataFrame) -> DataFrame:
    return df.withColumn(DEMO_MEASURE, _sum_of(df, DEMO_PARTS))


_DERIVE = {
    "enrol": with_adult_enrolments,
    "bio": with_bio_stress,
    "demo": with_update_volume,
}


def standardize(df: DataFrame, feed: str) -> DataFrame:
    """Text-typed keys to the canonical layout and types of a feed."""
    schema = feed_schema(feed)
    typed = {
        "date": day_first_date("date"),
        "state": clean_name("state"),
        "district": clean_name("district"),
        "pincode": pin_code("pincode"),
    }
    return df.select(
        *[typed.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema]
    )


def canonical(raw: DataFrame, feed: str) -> DataFrame:
    """Raw columns of one feed, any types, to its canonical table."""
    missing = [c for c in KEYS if c not in raw.columns]
    if missing:
        raise KeyError(f"{feed} feed lacks {missing}")
    return standardize(_DERIVE[feed](raw), feed)


def simulated_bio(enrol: DataFrame) -> DataFrame:
    """Stand-in for a missing biometric feed: 40 % of enrolments, flagged as such."""
    stress = (F.col(ENROL_MEASURE) * SIMULATED_SHARE).cast("bigint")
    return enrol.select(
        *KEYS, stress.alias(BIO_MEASURE), F.lit(True).alias("is_simulated")
    )


# --- files -------------------------------------------------------------------


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file) of the folder's CSV files, not recursive, any case of the suffix.

    Files of length zero hold nothing, and Spark's readers do not list them.
    """
    listing = spark.read.format("binaryFile").option("pathGlobFilter", CSV_GLOB).load(folder)
    name = F.regexp_extract("path", "[^/]+$", 0)  # contents are not read
    return listing.select(F.col("_metadata.file_path").alias("path"), name.alias("file"))


def first_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, header, quotes, broken): of every file that has a line, from one read.

    The block at offset 0 is read by one task from its start, so the first line
    that an aggregation meets there is the header. ``quotes`` counts quote signs;
    ``broken`` says that some line has an odd number, so cells may hold line breaks.
    """
    lines = spark.read.option("pathGlobFilter", CSV_GLOB).text(folder)
    at_start = F.col("_metadata.file_block_start") == 0
    signs = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return (
        lines.select(
            F.col("_metadata.file_path").alias("path"),
            F.when(at_start, F.col("value")).alias("header"), signs.alias("quotes"),
        )
        .groupBy("path")
        .agg(
            F.first("header", ignorenulls=True).alias("header"), F.sum("quotes").alias("quotes"),
            F.bool_or(F.col("quotes") % 2 == 1).alias("broken"),
        )
    )


@dataclass(frozen=True)
class Layout:
    """What the files with one header line hold."""

    header: str
    names: tuple[str, ...]
    feed: str | None
    problem: str | None


def layout_of(header: str) -> Layout:
    cells = next(csv.reader([header.lstrip("\ufeff")]), [])
    names = tuple(normalize_header(cells))
    problem = None
    if not any(names):
        problem = "the first line names no columns"
    elif len(set(names)) < len(names):
        problem = "column names repeat in the header"
    return Layout(header, names, None if problem else feed_of(names), problem)


def header_layouts(headers: DataFrame) -> DataFrame:
    """(header, names, feed, problem) of distinct ``(header)``, parsed where the headers are."""

    def parse(batches):
        for pdf in batches:
            known = [layout_of(h) for h in pdf["header"]]
            yield pd.DataFrame({
                "header": pdf["header"], "names": [list(x.names) for x in known],
                "feed": [x.feed for x in known], "problem": [x.problem for x in known],
            })

    return headers.mapInPandas(parse, "header string, names array<string>, feed string, problem string")


def cell_count(line: Column) -> Column:
    """Cells of a CSV record, from its text: commas outside quotes, and one."""
    bare = F.when(F.contains(line, F.lit('"')), F.regexp_replace(line, '"[^"]*"', "")).otherwise(line)
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def read_cells(spark: SparkSession, folder: str, width: int, across_lines: bool) -> DataFrame:
    """(path, c0..., _line): records of all files by position, without their first line.

    One column more than any header has, so a record of as many cells as any header
    or fewer, or of two more, keeps its text in ``_line``.
    """
    schema = ", ".join([*(f"c{i} string" for i in range(width + 1)), "_line string"])
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_line")
        .option("columnPruning", False)  # else records are counted by the columns asked for
        .option("multiLine", across_lines)
        .option("pathGlobFilter", CSV_GLOB)
        .csv(folder)
    )
    return rows.select(F.col("_metadata.file_path").alias("path"), *rows.columns)


def named_cells(rows: DataFrame, layouts: dict[int, Layout]) -> DataFrame:
    """Columns by name for rows of several layouts, gaps and missing tokens NULL, in one pass."""
    names = list(dict.fromkeys(n for layout in layouts.values() for n in layout.names))

    def cell(name: str) -> Column:
        value = F.lit(None).cast("string")
        for number, layout in layouts.items():
            if name in layout.names:
                value = F.when(F.col("_layout") == number, F.col(f"c{layout.names.index(name)}")).otherwise(value)
        return value

    return rows.where(F.col("_layout").isin(list(layouts))).select(*[cell(n).alias(n) for n in names]).select(
        *[missing_to_null(f"`{n}`").alias(n) for n in names]
    )


def read_feeds(spark: SparkSession, folder: str) -> Feeds:
    """All feeds of a folder, canonical and lazy, plus the ingest log.

    The number of jobs does not depend on the number of files: one read finds all
    header lines, only distinct headers of a feed come to the driver, and rows get the layout
    of their file by a join on the path. Cells are bound by position within a layout.

    A file with a record of more cells than its header, or a quote that never
    closes, contributes nothing and is named in the log; shorter records end in
    NULLs. Files with quoted line breaks are read again with records across lines
    (such files cannot be split), if there are any.
    """
    lines: list[tuple[str, str]] = []
    try:
        files = settle(list_files(spark, folder))
    except PySparkException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = None
        lines.append(("ERROR", f"No such folder: {folder}"))
    raw: dict[str, DataFrame] = {}
    skipped: DataFrame | None = None
    if files is not None:
        lines.append(("INFO", f"CSV files found: {files.count()}"))
        starts = settle(files.join(first_lines(spark, folder), "path", "left"))
        found = settle(header_layouts(starts.select("header").dropna().distinct()))
        # headers of a feed are few; a folder of files without header has one first line per file, and those stay
        ours = found.where(F.col("feed").isNotNull()).collect()
        layouts = {k: Layout(r.header, tuple(r.names), r.feed, None) for k, r in enumerate(ours)}
        numbers = spark.createDataFrame([(v.header, k) for k, v in layouts.items()], "header string, _layout int")
        about = found.join(numbers, "header", "left").select(
            "header", "_layout", F.size("names").alias("_cells"), "problem", F.col("feed").isNotNull().alias("wanted"),
        )
        known = starts.join(about, "header", "left").withColumn(
            "problem",
            F.when(F.col("problem").isNotNull(), F.col("problem")).when((F.col("quotes") % 2 == 1) & F.col("wanted"), "a quote is never closed"),
        )
        known = settle(known.select("path", "file", "_layout", "_cells", "problem", "wanted", "broken"))
        good = known.where("problem is null and wanted")
        width = max((len(v.names) for v in layouts.values() if v.feed), default=0)
        parts = [read_cells(spark, folder, width, False).join(good.where("not broken"), "path")]
        if not good.where("broken").isEmpty():
            parts.append(read_cells(spark, folder, width, True).join(good.where("broken"), "path"))
        rows = union_files(parts)
        # a record without a text of its own fills all columns
        filled = F.col(f"c{width}").isNotNull() | F.col("_line").isNull() | (cell_count(F.col("_line")) > F.col("_cells"))
        over = settle(rows.where(filled).select("path").distinct())
        rows = rows.join(over, "path", "left_anti")
        problems = known.where("problem is not null").select("file", "problem").unionByName(
            known.join(over, "path", "left_semi").select("file", F.lit("a record has more cells than the header").alias("problem"))
        )
        skipped = problems.select(F.format_string("Left out %s: %s", "file", "problem").alias("message"))
        for feed in ("enrol", "bio", "demo"):
            own = {k: v for k, v in layouts.items() if v.feed == feed}
            if own:
                raw[feed] = named_cells(rows, own)

    def table(feed: str) -> DataFrame:
        if feed in raw:
            return canonical(raw[feed], feed)
        return spark.createDataFrame([], feed_schema(feed))

    enrol, bio, demo = table("enrol"), table("bio"), table("demo")
    if "bio" not in raw and "enrol" in raw:
        lines.append(("WARN", "No biometric files: bio_stress simulated from enrolments"))
        bio = simulated_bio(enrol)
    now = datetime.now(timezone.utc)
    log = spark.createDataFrame([(now, level, text) for level, text in lines], INGEST_LOG)
    if skipped is not None:
        stamp, level = (F.lit(v).cast(log.schema[i].dataType).alias(log.columns[i]) for i, v in enumerate((now, "WARN")))
        log = log.unionAll(skipped.select(stamp, level, "message"))
    return Feeds(enrol, bio, demo, log)


def recent_messages(log: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` rows of the ingest log, newest first; rows of one moment by level and message."""
    return log.orderBy(F.desc("ts"), "level", "message").limit(n)


def missing_name_counts(df: DataFrame) -> DataFrame:
    """Rows without a state or district: they belong to no group in any report."""
    return df.agg(
        F.count(F.when(F.col("state").isNull(), 1)).alias("no_state"),
        F.count(F.when(F.col("district").isNull(), 1)).alias("no_district"),
        F.count(F.when(F.col("date").isNull(), 1)).alias("no_date"),
    )

"""Tolerant parsing of text columns: bad input becomes NULL or 0, never an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Day-first dates with an optional time of day, plain numbers.
DAY_FIRST = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:[ T].*)?$"
SHORT_YEAR = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2})(?:[ T].*)?$"
NAMED_MONTH = r"^(\d{1,2})[-/. ]*([A-Za-z]{3})[A-Za-z]*[-/., ]+(\d{4}|\d{2})(?:[ T].*)?$"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
LAST_OF_2000S = 68  # a two-digit year above it belongs to the 1900s
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def apart(col: Column, rare: Callable[[Column], Column]) -> Column:
    """``rare(col)``, evaluated outside the stage's generated method.

    For long branches of a CASE that few rows take. Spark generates one method for all
    columns of a projection, and the JVM does not compile a method beyond 8,000 bytes of
    code: one such branch too many and every row pays for it.
    """
    return F.element_at(F.transform(F.array(col), rare), 1)


def day_first_date(col: Column | str) -> Column:
    """Text to date; ``03-04-2025`` is 3 April, ISO order is understood too.

    So are two-digit years, names of months, and a time of day after the date.
    One rewrite to ISO and one ``try_cast``: no parser exception is raised per
    bad row, which is what makes trying several patterns in turn slow.
    """
    def rare(text: Column) -> Column:
        def year(pattern: str) -> Column:
            digits = F.regexp_extract(text, pattern, 3)
            century = F.when(digits.try_cast("int") > LAST_OF_2000S, F.lit("19")).otherwise(F.lit("20"))
            return F.when(F.length(digits) == 2, F.concat(century, digits)).otherwise(digits)

        at = F.instr(F.lit(MONTHS), F.lower(F.regexp_extract(text, NAMED_MONTH, 2)))
        month = F.when(at % 3 == 1, ((at + 2) / 3).cast("int").cast("string"))
        named = F.concat(year(NAMED_MONTH), F.lit("-"), month, F.lit("-"), F.regexp_extract(text, NAMED_MONTH, 1))
        short = F.concat_ws("-", year(SHORT_YEAR), *[F.regexp_extract(text, SHORT_YEAR, i) for i in (2, 1)])
        other = F.translate(F.regexp_replace(text, DAY_FIRST, "$3-$2-$1"), "/.", "--")
        return F.when(text.rlike(SHORT_YEAR), short).when(text.rlike(NAMED_MONTH), named).otherwise(other)

    text = F.trim(col)
    marks = F.concat(F.substring(text, 3, 1), F.substring(text, 6, 1))
    iso = F.when(
        (F.length(text) == 10) & marks.isin("--", "//", ".."),  # dd-MM-yyyy, by far the most
        F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2)),
    ).otherwise(apart(text, rare))
    return F.when(F.substring(iso, 5, 1) == "-", iso).try_cast("date")


def number_or_null(col: Column | str) -> Column:
    """Plain decimal text to double; anything else (``1d``, ``NaN``) is NULL."""
    col = F.col(col) if isinstance(col, str) else col
    text = col.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def pin_code(col: Column | str) -> Column:
    """PIN as int, truncated; unreadable or out-of-range values are 0 (no PIN)."""
    return F.coalesce(number_or_null(col).try_cast("int"), F.lit(0))


def count_or_zero(col: Column | str) -> Column:
    """A measure cell as bigint, 0 where missing or unreadable."""
    return F.coalesce(number_or_null(col).try_cast("bigint"), F.lit(0).cast("bigint"))

"""Name clean-up as native column expressions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The white space that Python's str.strip() removes.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Cell texts that the pandas CSV reader takes for "missing".
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

_LETTER_RUN = r"[\p{IsUppercase}\p{IsLowercase}\p{Lt}]+"
# A capital sigma inside a word that goes on after marks or punctuation is no
# final sigma; the marker would hide that from initcap.
_IGNORABLE = (
    r"[\p{Mn}\p{Me}\p{Cf}\p{Lm}\p{Sk}'.:\u00b7\u0387\u055f\u05f4\u2018\u2019\u2024"
    r"\u2027\ufe13\ufe52\ufe55\uff07\uff0e\uff1a]"
)
_INNER_SIGMA = rf"\u03a3(?={_IGNORABLE}+{_LETTER_RUN})"
_PLAIN_WORDS = "^[A-Za-z ]*( & [A-Za-z ]*)*$"
_MARK = "\u0001 "


def strip(col: Column | str) -> Column:
    """Remove white space (all Unicode kinds) from both ends."""
    return F.trim(col, F.lit(STRIP_CHARS))


def _marked_title(col: Column) -> Column:
    capital, small = F.lit("\u03a3"), "\u03c3"
    text = F.when(
        F.contains(col, capital), F.regexp_replace(col, _INNER_SIGMA, small)
    ).otherwise(col)
    marked = F.regexp_replace(text, _LETTER_RUN, _MARK + "$0")
    return F.replace(F.initcap(marked), F.lit(_MARK), F.lit(""))


def title_case(col: Column | str) -> Column:
    """Upper-case every cased letter that does not follow a cased letter.

    ``initcap`` is right for plain words only: it starts words at blanks, so
    ``o'brien-nagar`` and ``y.s.r.`` come out wrong. Other texts get a marker
    ending in a blank before every run of letters, ``initcap`` does the casing,
    and the marker is taken out again. No lambda and no Python.
    """
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col.rlike(_PLAIN_WORDS), F.initcap(col)).otherwise(_marked_title(col))


def clean_name(col: Column | str) -> Column:
    """Title case, then strip; NULL stays NULL. Plain words take the short way."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col.rlike(_PLAIN_WORDS), F.trim(F.initcap(col))).otherwise(
        strip(_marked_title(col))
    )


def missing_to_null(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.when(~col.isin(*MISSING_TOKENS), col)


def first_three(sorted_values: Column, total: Column) -> Column:
    """``"a, b, c..."``: the first three values, dots when there are more."""
    return F.concat(
        F.array_join(F.slice(sorted_values, 1, 3), ", "),
        F.when(total > 3, F.lit("...")).otherwise(F.lit("")),
    )

"""Reproducible randomness: a hash of (seed, key, step), never ``rand()``.

``rand(seed)`` depends on how rows are partitioned, so a retried or re-planned
stage would draw other numbers. A digest of the row's own identity gives the
same draw on any cluster, in any engine that has md5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

TWO_32 = 4294967296.0


def _as_text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def digest(*parts) -> Column:
    """md5 hex of the parts joined with ``|``."""
    return F.md5(F.concat_ws("|", *[_as_text(p) for p in parts]))


def hex_number(hex_text: Column, start: int) -> Column:
    """Eight hex digits from position ``start`` (1-based) as a bigint."""
    return F.conv(F.substring(hex_text, start, 8), 16, 10).cast("bigint")


def standard_normal(*parts) -> Column:
    """One N(0, 1) draw per row (Box-Muller on two halves of the digest)."""
    hex_text = digest(*parts)
    u1 = (hex_number(hex_text, 1) + F.lit(0.5)) / F.lit(TWO_32)
    u2 = (hex_number(hex_text, 9) + F.lit(0.5)) / F.lit(TWO_32)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def jitter(col: Column | str) -> Column:
    """Stable offset in [-0.15, 0.183) degrees from a text's digest."""
    col = F.col(col) if isinstance(col, str) else col
    bucket = F.pmod(hex_number(F.md5(col), 1), F.lit(1000).cast("bigint"))
    return bucket / F.lit(3000.0) - F.lit(0.15)

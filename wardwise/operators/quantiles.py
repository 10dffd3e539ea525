"""Exact quantiles of columns with many distinct values, without sorting all of them.

A mergeable sketch names two values close to the wanted rank; one pass counts the
rows on either side of them, so the rank is known to lie between them, or beside
them if the sketch was unlucky. Only what lies there is sketched again. Every step
leaves about a fiftieth of the rows, so 10**12 rows take six steps; the last
``FEW`` are sorted. The driver sees counts and single values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

FEW = 100_000
SIZE = 400  # of a sketch; its rank error is about 2.3 / SIZE ** 0.9
MARGIN = 1.5 * 2.3 / SIZE**0.9


def value_at(values: DataFrame, rank: int, few: int = FEW) -> float:
    """The value of a 0-based ``rank`` among ``values(v)``, which holds more rows than that."""
    inside, before = values, 0  # rows that still may hold it, and how many are below all of them
    while True:
        sketch = F.kll_sketch_agg_double("v", F.lit(SIZE))
        n, held = inside.agg(F.count("*"), sketch).first()
        if n <= few:
            return inside.orderBy("v").offset(rank - before).limit(1).first().v
        near = (rank - before) / n
        ends = [F.kll_sketch_get_quantile_double(F.lit(bytes(held)), F.lit(p))
                for p in (max(near - MARGIN, 0.0), min(near + MARGIN, 1.0))]
        low, high = values.sparkSession.range(1).select(*ends).first()
        below_low, to_low, below_high, to_high = (before + c for c in inside.agg(
            *[F.count_if(c) for c in (F.col("v") < low, F.col("v") <= low, F.col("v") < high, F.col("v") <= high)]
        ).first())
        if below_low <= rank < to_low:
            return low
        if below_high <= rank < to_high:
            return high
        if rank < below_low:
            inside = inside.where(F.col("v") < low)
        elif rank < below_high:
            inside, before = inside.where((F.col("v") > low) & (F.col("v") < high)), to_low
        else:
            inside, before = inside.where(F.col("v") > high), to_high


def exact_quantile(df: DataFrame, column: str, share: float, few: int = FEW) -> float | None:
    """The quantile between the two closest ranks, as ``percentile`` has it; NULL and NaN do not count.

    Values are compared as doubles. ``df`` is read some times; settle it if it is costly.
    """
    v = F.col(column).cast("double")
    values = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n = values.count()
    if n == 0:
        return None
    place = share * (n - 1)
    rank = min(math.floor(place), n - 1)
    low = value_at(values, rank, few)
    if place == rank:
        return low
    to_low, above = values.agg(F.count_if(F.col("v") <= low), F.min(F.when(F.col("v") > low, F.col("v")))).first()
    return low if to_low > rank + 1 else low + (place - rank) * (above - low)

"""Isolation-forest outliers over group volumes.

The forest is fitted the way ``pyspark.ml`` estimators are: a distributed job
reduces the data to a small model, the model then scores rows in vectorized
batches.

Fit. Every tree takes the ``sample`` groups with the smallest digest of
(seed, tree, key), a sample without replacement that no re-partitioning can change.
The per-tree top-k is cut before the shuffle, trees grow in parallel with at
most ``sample`` rows each, and all trees collapse into one step function
"volume -> summed path length" with at most ``trees * sample`` steps. Only that
step function reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from wardwise.functions import messages
from wardwise.functions.draws import digest, hex_number, TWO_32
from wardwise.schema import ENROL_MEASURE
from wardwise.sources.tables import settle

# Forest size, share of outliers, fewest groups worth scoring.
TREES, SAMPLE, SEED = 100, 256, 42
CONTAMINATION = 0.05
FEWEST_GROUPS = 10
EULER_GAMMA = 0.5772156649

MAX_STEPS = 1_000_000
KEYS = ("state", "district")


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points (Liu et al. 2008)."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


@dataclass(frozen=True)
class ForestModel:
    """Summed path length over all trees as a step function of the value."""

    starts: np.ndarray
    lengths: np.ndarray
    trees: int
    sample: int

    def score(self, value):
        """Anomaly score column in (0, 1); larger is more isolated."""
        starts, lengths = self.starts, self.lengths
        scale = self.trees * max(mean_path(self.sample), 1e-12)

        @F.pandas_udf("double")
        def score_of(values: pd.Series) -> pd.Series:
            at = np.searchsorted(starts, values.to_numpy(dtype="float64"), side="left") - 1
            return pd.Series(np.round(np.power(2.0, -lengths[at] / scale), 9))

        return score_of(value)


def draw_samples(
    totals: DataFrame, n: int, measure: str, keys: Sequence[str], trees: int, sample: int,
    seed: int = SEED, prefilter: bool = True,
) -> DataFrame:
    """``(tree, value)`` with the ``min(sample, n)`` smallest digests of each tree.

    The pre-filter keeps four times the rows a tree needs, by a bound on the digest;
    a tree that then lacks rows is noticed by ``fit_forest``.
    """
    rows = totals.select(
        *keys,
        F.col(measure).cast("double").alias("value"),
        F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"),
    ).withColumn("_digest", digest(F.lit(seed), F.col("tree"), *[F.col(k) for k in keys]))
    share = 4.0 * sample / n
    if prefilter and share < 1.0:
        rows = rows.where(hex_number(F.col("_digest"), 1) < F.lit(int(share * TWO_32)))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("_digest", *keys))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= sample).select("tree", "value")


def grow_trees(samples: DataFrame, seed: int, depth_limit: int) -> DataFrame:
    """Leaves of every tree as steps ``(start, delta)`` of its path length."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        tree = int(pdf["tree"].iloc[0])
        values = np.sort(pdf["value"].to_numpy(dtype="float64"))
        leaves = []  # (upper end, path length) from left to right
        todo = [("", 0, len(values), math.inf)]
        while todo:
            node, lo, hi, end = todo.pop()
            count = hi - lo
            low, high = (values[lo], values[hi - 1]) if count else (0.0, 0.0)
            if len(node) >= depth_limit or count <= 1 or low == high:
                c = 0.0 if count <= 1 else 1.0 if count == 2 else (
                    2.0 * (math.log(count - 1.0) + EULER_GAMMA) - 2.0 * (count - 1.0) / count
                )
                leaves.append((end, len(node) + c))
                continue
            text = hashlib.md5(f"{seed}|{tree}|{node}".encode()).hexdigest()
            cut = low + int(text[:8], 16) / 4294967296.0 * (high - low)
            middle = lo + int(np.searchsorted(values[lo:hi], cut, side="right"))
            todo.append((node + "1", middle, hi, end))
            todo.append((node + "0", lo, middle, cut))
        starts = [-math.inf] + [end for end, _ in leaves[:-1]]
        lengths = np.array([length for _, length in leaves])
        return pd.DataFrame(
            {"rows": len(values), "start": starts, "delta": np.diff(lengths, prepend=0.0)}
        )

    return samples.groupBy("tree").applyInPandas(grow, "rows int, start double, delta double")


def fit_forest(
    totals: DataFrame,
    measure: str = ENROL_MEASURE,
    keys: Sequence[str] = KEYS,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
    n: int | None = None,
) -> ForestModel:
    """Fit on one row per key; ``n`` is their number when already known.

    ``trees * sample`` is the size of the model, whatever the data; up to
    ``MAX_STEPS`` is a limit of these two parameters, not of the input.
    """
    if trees * sample > MAX_STEPS:
        raise ValueError(f"a model of {trees * sample} steps does not belong on the driver")
    n = totals.count() if n is None else n
    size = min(sample, n)
    depth_limit = math.ceil(math.log2(max(size, 2)))
    for prefilter in (True, False):
        samples = draw_samples(totals, n, measure, keys, trees, size, seed, prefilter)
        steps = (
            grow_trees(samples, seed, depth_limit)
            .groupBy("start")
            .agg(
                F.sum("delta").alias("delta"), F.min("rows").alias("rows"),
                F.count(F.when(F.col("start") == -math.inf, 1)).alias("trees"),
            )
            .toPandas()  # bounded by trees * sample, checked above
            .sort_values("start")
        )
        if len(steps) and steps["rows"].min() == size and steps["trees"].sum() == trees:
            break
    return ForestModel(
        steps["start"].to_numpy(), np.cumsum(steps["delta"].to_numpy()), trees, size
    )


def _scored(
    totals: DataFrame, n: int, measure: str, keys: Sequence[str], trees: int, sample: int,
    contamination: float, seed: int,
) -> DataFrame:
    model = fit_forest(totals, measure, keys, trees, sample, seed, n)
    scored = totals.withColumn("score", model.score(F.col(measure).cast("double")))
    cut = scored.agg(F.percentile("score", F.lit(1.0 - contamination))).scalar()
    return scored.withColumn("threshold", cut).withColumn(
        "anomaly", F.when(F.col("score") > F.col("threshold"), F.lit(-1)).otherwise(F.lit(1))
    )


def anomaly_scores(
    totals: DataFrame,
    measure: str = ENROL_MEASURE,
    keys: Sequence[str] = KEYS,
    trees: int = TREES,
    sample: int = SAMPLE,
    contamination: float = CONTAMINATION,
    seed: int = SEED,
) -> DataFrame:
    """``totals`` plus ``score``, ``threshold`` and ``anomaly`` (-1 outlier, 1 normal).

    The totals are settled, so the facts behind them are read once. The exact
    percentile is cheap at any size: a step function has few distinct values, so
    the partial aggregation buffers stay small.
    """
    totals = settle(totals.select(*keys, measure))
    n = totals.count()
    if n == 0:
        return totals.select(
            "*", *[F.lit(None).cast(t).alias(c)
                   for c, t in (("score", "double"), ("threshold", "double"), ("anomaly", "int"))]
        )
    return _scored(totals, n, measure, keys, trees, sample, contamination, seed)


def risk_order(measure: str = ENROL_MEASURE, keys: Sequence[str] = KEYS):
    return [F.desc("risk_score"), F.desc(measure), *[F.asc(k) for k in keys]]


def risk_table(
    totals: DataFrame, measure: str = ENROL_MEASURE, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Flagged groups with a score of 10 to 100, highest first.

    Fewer than ten groups are not scored: all of them come back with score 0.
    """
    totals = settle(totals.select(*keys, measure))
    n = totals.count()
    if n < FEWEST_GROUPS:
        return totals.withColumn("anomaly", F.lit(None).cast("int")).withColumn(
            "risk_score", F.lit(0)
        )
    largest = totals.agg(F.max(measure)).scalar()
    scored = _scored(totals, n, measure, keys, TREES, SAMPLE, CONTAMINATION, SEED)
    share = F.col(measure) / F.when(F.col("_max") > 0, F.col("_max")).otherwise(F.lit(1))
    risk = F.when(F.col("anomaly") == -1, share * 90 + 10).otherwise(F.lit(0.0))
    return (
        scored.withColumn("_max", largest)
        .withColumn("risk_score", risk.cast("int"))
        .where(F.col("risk_score") > 0)
        .select(*keys, measure, "anomaly", "risk_score")
        .orderBy(*risk_order(measure, keys))
    )


def flag_count(risks: DataFrame) -> DataFrame:
    """One row: number of flagged groups and its status text."""
    return risks.agg(
        F.count(F.when(F.col("risk_score") > 0, 1)).alias("issues")
    ).withColumn("status", messages.risk_status(F.col("issues")))


def top_risks(risks: DataFrame, n: int = 5) -> DataFrame:
    return risks.orderBy(*risk_order()).limit(n)


def worst_risk(risks: DataFrame) -> DataFrame:
    """The headline: the most severe group and its sentence."""
    return top_risks(risks, 1).withColumn(
        "headline", F.format_string(messages.HIGHEST_RISK, F.col("district"))
    )

"""Governance as an append-only event log.

``(id, ts, scope, action, original, target, user)`` with the actions Merge,
Delete and Revert. Nothing is ever edited: a Revert event names the id it takes
back (in ``target``), and the patches in force are derived from the log. A log
table only ever gets appended to, so two sessions cannot lose each other's work.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from wardwise.operators.ranking import page
from wardwise.sources.dimensions import OFFICIAL_STATES
from wardwise.sources.tables import settle

# Thresholds, default user, page sizes.
AUTO_FIX_ABOVE = 0.9
MERGE_ABOVE = 0.85
DEFAULT_USER = "Admin_01"
NO_TARGET = "N/A"
CHANGED_TO, DELETED = " -> ", "Del: "
ISSUES_PER_PAGE, LOG_PER_PAGE = 10, 15
SCOPE_COLUMNS = {"State": "state", "District": "district"}

LOG_COLUMNS = ("id", "ts", "scope", "action", "original", "target", "user")


def audit_order() -> list[Column]:
    return [F.desc("ts"), F.asc("id")]


# --- what the log says -------------------------------------------------------


def entries(log: DataFrame) -> DataFrame:
    """Merge and Delete entries that no Revert event takes back, in one pass.

    A Revert event and what it takes back meet under one id; ids are unique, so a
    group is one entry and the events that revert it.
    """
    taken_back = F.col("action") == "Revert"
    return (
        log.where(F.col("action").isin("Merge", "Delete", "Revert"))
        .groupBy(F.when(taken_back, F.col("target")).otherwise(F.col("id")).alias("_id"))
        .agg(
            F.bool_or(taken_back).alias("_back"),
            F.max(F.when(~taken_back, F.struct(*LOG_COLUMNS))).alias("_entry"),
        )
        .where(~F.col("_back") & F.col("_entry").isNotNull())
        .select("_entry.*")
    )


def rulings(log: DataFrame) -> DataFrame:
    """``(scope, original, target, deleted)``: what stands for every name, in one pass.

    ``target`` is the latest standing Merge (NULL if there is none). Partial
    aggregation per task keeps a name that is ruled on over and over from
    becoming a hot spot.
    """
    return ruled(entries(log))


def ruled(standing: DataFrame) -> DataFrame:
    """``rulings`` of entries that stand."""
    merged = F.col("action") == "Merge"
    return (
        standing.groupBy("scope", "original")
        .agg(
            F.max(F.when(merged, F.struct("ts", "id", "target"))).getField("target").alias("target"),
            F.bool_or(~merged).alias("deleted"),
        )
    )


def active_patches(log: DataFrame) -> DataFrame:
    """``(scope, original, target)``: the latest standing Merge per name."""
    return rulings(log).where(F.col("target").isNotNull()).drop("deleted")


def active_deletions(log: DataFrame) -> DataFrame:
    """``(scope, original)`` with a standing Delete."""
    return rulings(log).where("deleted").select("scope", "original")


# --- applying it to facts ----------------------------------------------------


def apply_governance(df: DataFrame, log: DataFrame) -> DataFrame:
    """Deletions on the raw names first (state and district), then patches.

    Patches are simultaneous: with a->b and b->c, a becomes b. Always start from
    the raw feed; patches are not stacked on patched data.

    The rulings are settled first. Their true size then decides the join: a
    small table is broadcast and the facts never move; a large one goes through
    a shuffle join whose skewed partitions adaptive execution splits.
    """
    return govern(df, settle(rulings(log)))


def govern(df: DataFrame, ruled: DataFrame) -> DataFrame:
    """``apply_governance`` with given rulings (shared by several feeds).

    Both columns are looked up by their raw name, one join each.
    """
    columns = df.columns
    for scope, column in SCOPE_COLUMNS.items():
        of_scope = ruled.where(F.col("scope") == scope).select(
            F.col("original").alias(column),
            F.col("target").alias(f"_{column}"),
            F.col("deleted").alias(f"_no_{column}"),
        )
        df = df.join(of_scope, column, "left").where(~F.coalesce(f"_no_{column}", F.lit(False)))
    patched = {c: F.coalesce(f"_{c}", c).alias(c) for c in SCOPE_COLUMNS.values()}
    return df.select(*[patched.get(c, F.col(c)) for c in columns])


# --- from issues to log entries ----------------------------------------------


def pending(issues: DataFrame, log: DataFrame, scope: str) -> DataFrame:
    """Issues whose suspect is neither patched nor deleted."""
    done = entries(log).where(F.col("scope") == scope).select(F.col("original").alias("Suspect"))
    return issues.join(done.distinct(), "Suspect", "left_anti")


def high_confidence(issues: DataFrame) -> DataFrame:
    return issues.where(F.col("Conf") > AUTO_FIX_ABOVE)


def as_events(
    decisions: DataFrame,
    scope: str,
    at: Column | None = None,
    user: str = DEFAULT_USER,
    event_id: Column | None = None,
) -> DataFrame:
    """Log entries for decisions ``(suspect, action, target)``; Ignore logs nothing."""
    return decisions.where(F.col("action").isin("Merge", "Delete")).select(
        (F.uuid() if event_id is None else event_id).alias("id"),
        (F.current_timestamp() if at is None else at).alias("ts"),
        F.lit(scope).alias("scope"),
        F.col("action"),
        F.col("suspect").alias("original"),
        F.coalesce("target", F.lit(NO_TARGET)).alias("target"),
        F.lit(user).alias("user"),
    )


def auto_fix(
    issues: DataFrame,
    log: DataFrame,
    scope: str,
    at: Column | None = None,
    user: str = DEFAULT_USER,
    event_id: Column | None = None,
) -> DataFrame:
    """Merge events for every pending issue above the auto-fix confidence."""
    decided = high_confidence(pending(issues, log, scope)).select(
        F.col("Suspect").alias("suspect"), F.lit("Merge").alias("action"),
        F.col("Fix").alias("target"),
    )
    return as_events(decided, scope, at, user, event_id)


def default_actions(issues: DataFrame, options: DataFrame | Sequence[str] = OFFICIAL_STATES) -> DataFrame:
    """Proposed ``(suspect, action, target)`` per issue.

    Merge above the threshold, else Ignore. The target is the proposed fix, or
    the first option when the fix is not among them. ``options`` is a list in
    order, or a DataFrame ``(option)`` whose first is the alphabetically first.
    """
    merge = F.col("Conf") > MERGE_ABOVE
    if isinstance(options, DataFrame):
        known = options.select(F.col("option").alias("Fix")).distinct().withColumn("_in", F.lit(True))
        first = options.agg(F.min("option")).scalar()
        issues = issues.join(known, "Fix", "left")
        offered = F.coalesce("_in", F.lit(False))
    else:
        first = F.lit(options[0])
        offered = F.col("Fix").isin(*options)
    target = F.when(offered, F.col("Fix")).otherwise(first)
    return issues.select(
        F.col("Suspect").alias("suspect"),
        F.when(merge, "Merge").otherwise("Ignore").alias("action"),
        F.when(merge, target).alias("target"),
    )


def tallies(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: pending issues, auto-fixable ones, decisions that change something."""
    changes = decisions.where(F.col("action") != "Ignore").agg(F.count("*")).scalar()
    return issues.agg(
        F.count("*").alias("issues_found"),
        F.count(F.when(F.col("Conf") > AUTO_FIX_ABOVE, 1)).alias("auto_fixable"),
    ).withColumn("changes_processed", changes)


# --- log maintenance ---------------------------------------------------------


def append(log: DataFrame, events: DataFrame) -> DataFrame:
    """The log with a batch of events added; an empty batch changes nothing."""
    return log.select(*LOG_COLUMNS).unionByName(events.select(*LOG_COLUMNS))


def write_events(events: DataFrame, path: str) -> None:
    """Append a batch to the log table on shared storage."""
    events.select(*LOG_COLUMNS).write.mode("append").parquet(path)


def revert_events(
    log: DataFrame,
    ids: DataFrame,
    at: Column | None = None,
    user: str = DEFAULT_USER,
    event_id: Column | None = None,
) -> DataFrame:
    """Revert events for the standing entries whose id is in ``ids(id)``."""
    chosen = entries(log).join(ids.select("id").distinct(), "id", "left_semi")
    return chosen.select(
        (F.uuid() if event_id is None else event_id).alias("id"),
        (F.current_timestamp() if at is None else at).alias("ts"),
        "scope",
        F.lit("Revert").alias("action"),
        "original",
        F.col("id").alias("target"),
        F.lit(user).alias("user"),
    )


def revert(log: DataFrame, ids: DataFrame, **stamp) -> DataFrame:
    """The log after taking back the given entries."""
    return append(log, revert_events(log, ids, **stamp))


def audit(
    log: DataFrame,
    start: date | str | None = None,
    end: date | str | None = None,
    scopes: Sequence[str] = ("State", "District"),
) -> DataFrame:
    """Standing entries of whole days ``start..end`` and the given scopes."""
    rows = entries(log).where(F.col("scope").isin(*scopes))
    if start is not None:
        rows = rows.where(F.to_date("ts") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.to_date("ts") <= F.lit(end).cast("date"))
    return rows


def audit_display(rows: DataFrame) -> DataFrame:
    """Time, action and change as text."""
    return rows.select(
        "id",
        F.date_format("ts", "HH:mm:ss").alias("time"),
        F.concat_ws(" ", "scope", "action").alias("action"),
        F.when(F.col("action") == "Merge", F.concat_ws(CHANGED_TO, "original", "target"))
        .otherwise(F.concat(F.lit(DELETED), F.col("original")))
        .alias("change"),
        "user",
    )


def audit_page(log: DataFrame, number: int = 1, size: int = LOG_PER_PAGE, **filters) -> DataFrame:
    """One page of the audit view, newest first."""
    return audit_display(page(audit(log, **filters), audit_order(), number, size))


def recent_log(log: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` entries, newest first."""
    return entries(log).orderBy(*audit_order()).limit(n)

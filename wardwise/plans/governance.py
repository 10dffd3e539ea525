"""Scan, decide, commit, refresh: the governance round trip."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wardwise.operators.aggregates import distinct_names
from wardwise.operators.governance import (
    as_events,
    default_actions,
    govern,
    pending,
    rulings,
    tallies,
)
from wardwise.operators.scans import district_scan, state_scan
from wardwise.sources.dimensions import OFFICIAL_STATES
from wardwise.sources.drop_folder import Feeds
from wardwise.sources.tables import settle


def review(enrol: DataFrame, log: DataFrame, scope: str) -> dict[str, DataFrame]:
    """Pending issues of one scope with the proposed decisions and their events."""
    issues = settle(state_scan(enrol) if scope == "State" else district_scan(enrol))
    open_issues = settle(pending(issues, log, scope)).orderBy(F.desc("Conf"), "Suspect")
    options: DataFrame | Sequence[str] = (
        OFFICIAL_STATES
        if scope == "State"
        else settle(distinct_names(enrol, "district").withColumnRenamed("district", "option"))
    )
    decisions = settle(default_actions(open_issues, options))
    return {
        "issues": open_issues,
        "decisions": decisions,
        "events": as_events(decisions, scope),
        "tallies": tallies(open_issues, decisions),
    }


def refresh(feeds: Feeds, log: DataFrame) -> Feeds:
    """All three raw feeds under the rulings now in force."""
    ruled = settle(rulings(log))
    return Feeds(
        govern(feeds.enrol, ruled), govern(feeds.bio, ruled), govern(feeds.demo, ruled), feeds.log
    )

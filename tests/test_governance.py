from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wardwise.operators import governance as gov
from wardwise.plans import governance as flow
from wardwise.sources.drop_folder import Feeds

LOG = "id string, ts timestamp, scope string, action string, original string, target string, user string"
FACTS = "date date, state string, district string, pincode int, adult_enrolments bigint"


def at(n):
    return datetime(2025, 1, 1, 0, 0, n)


def log_of(rows, *events):
    """(id, scope, action, original, target), one second apart."""
    return rows(LOG, *[(i, at(n), s, a, o, t, "u") for n, (i, s, a, o, t) in enumerate(events)])


def names(df):
    return sorted((r.state, r.district) for r in df.collect())


def facts(rows, *pairs):
    return rows(FACTS, *[(None, s, d, 1, 1) for s, d in pairs])


def test_patches_are_simultaneous(rows):
    log = log_of(rows, ("1", "State", "Merge", "a", "b"), ("2", "State", "Merge", "b", "c"))
    got = gov.apply_governance(facts(rows, ("a", "x"), ("b", "x"), ("c", "x")), log)
    assert names(got) == [("b", "x"), ("c", "x"), ("c", "x")]


def test_deletions_see_raw_names(rows):
    log = log_of(
        rows,
        ("1", "State", "Merge", "a", "b"),
        ("2", "State", "Delete", "b", "N/A"),
        ("3", "District", "Merge", "y", "z"),
        ("4", "District", "Delete", "y", "N/A"),
    )
    got = gov.apply_governance(facts(rows, ("a", "x"), ("b", "x"), ("c", "y")), log)
    assert names(got) == [("b", "x")]


def test_scopes_do_not_mix(rows):
    log = log_of(rows, ("1", "State", "Merge", "same", "S"), ("2", "District", "Delete", "other", "N/A"))
    got = gov.apply_governance(facts(rows, ("same", "same"), ("other", "k")), log)
    assert names(got) == [("S", "same"), ("other", "k")]


def test_null_names_survive(rows):
    log = log_of(rows, ("1", "State", "Delete", "a", "N/A"), ("2", "State", "Merge", "b", "c"))
    got = gov.apply_governance(facts(rows, (None, "x"), ("a", "x"), ("b", None)), log)
    assert sorted(map(str, ((r.state, r.district) for r in got.collect()))) == ["('c', None)", "(None, 'x')"]


def test_latest_standing_merge_wins(rows):
    log = log_of(
        rows,
        ("1", "State", "Merge", "a", "old"),
        ("2", "State", "Merge", "a", "new"),
        ("3", "State", "Merge", "a", "newest"),
        ("4", "State", "Revert", "a", "3"),
    )
    assert gov.active_patches(log).collect() == [("State", "a", "new")]


def test_one_revert_takes_back_one_deletion(rows):
    log = log_of(rows, ("1", "State", "Delete", "a", "N/A"), ("2", "State", "Delete", "a", "N/A"))
    once = gov.revert(log, rows("id string", ("1",)))
    assert gov.active_deletions(once).count() == 1
    twice = gov.revert(once, rows("id string", ("2",)))
    assert gov.active_deletions(twice).count() == 0


def test_revert_undoes_a_commit(rows, spark):
    log = log_of(rows, ("1", "State", "Merge", "a", "b"))
    decisions = rows("suspect string, action string, target string",
                     ("p", "Merge", "q"), ("r", "Delete", None), ("s", "Ignore", None))
    events = gov.as_events(decisions, "District", event_id=F.concat(F.lit("e"), "suspect"))
    assert sorted((r.original, r.action, r.target) for r in events.collect()) == [
        ("p", "Merge", "q"), ("r", "Delete", "N/A"),
    ]
    committed = gov.append(log, events)
    undone = gov.revert(committed, events.select("id"))
    assert gov.rulings(undone).collect() == gov.rulings(log).collect()
    assert gov.entries(undone).count() == 1


def test_empty_batch_is_a_no_op(rows):
    log = log_of(rows, ("1", "State", "Merge", "a", "b"))
    assert gov.append(log, log.where("false")).collect() == log.collect()


def test_events_are_stamped(rows):
    decisions = rows("suspect string, action string, target string", ("a", "Merge", "b"), ("c", "Delete", None))
    got = gov.as_events(decisions, "State").collect()
    assert len({r.id for r in got}) == 2 and all(len(r.id) == 36 for r in got)
    assert all(r.ts is not None and r.user == "Admin_01" for r in got)


ISSUES = "Suspect string, Fix string, Conf double, Suspect_Vol bigint"


def test_pending_and_auto_fix(rows):
    issues = rows(ISSUES, ("a", "A", 0.95, 1), ("b", "B", 0.9, 1), ("c", "C", 0.91, 1), ("d", "D", 0.99, 1))
    log = log_of(rows, ("1", "State", "Merge", "a", "A"), ("2", "District", "Delete", "c", "N/A"),
                 ("3", "State", "Delete", "d", "N/A"), ("4", "State", "Revert", "d", "3"))
    assert sorted(r.Suspect for r in gov.pending(issues, log, "State").collect()) == ["b", "c", "d"]
    fixes = gov.auto_fix(issues, log, "State").collect()
    assert sorted((r.original, r.target, r.action) for r in fixes) == [("c", "C", "Merge"), ("d", "D", "Merge")]


@pytest.mark.parametrize("as_frame", [False, True])
def test_default_actions(rows, as_frame):
    issues = rows(ISSUES, ("a", "Goa", 0.86, 1), ("b", "Elsewhere", 0.9, 1), ("c", "Goa", 0.85, 1))
    options = ["Assam", "Goa"]
    if as_frame:
        options = rows("option string", ("Goa",), ("Assam",))
    got = {r.suspect: (r.action, r.target) for r in gov.default_actions(issues, options).collect()}
    assert got == {"a": ("Merge", "Goa"), "b": ("Merge", "Assam"), "c": ("Ignore", None)}


def test_audit_view(rows):
    log = rows(
        LOG,
        ("1", datetime(2025, 1, 1, 0, 0, 0), "State", "Merge", "a", "b", "u"),
        ("2", datetime(2025, 1, 2, 23, 59, 59), "District", "Delete", "c", "N/A", "u"),
        ("3", datetime(2025, 1, 3, 0, 0, 0), "State", "Merge", "d", "e", "u"),
    )
    assert sorted(r.id for r in gov.audit(log, "2025-01-01", "2025-01-02").collect()) == ["1", "2"]
    assert [r.id for r in gov.audit(log, scopes=["District"]).collect()] == ["2"]
    shown = gov.audit_page(log, 1, 2).collect()
    assert [(r.id, r.time, r.action, r.change) for r in shown] == [
        ("3", "00:00:00", "State Merge", "d -> e"),
        ("2", "23:59:59", "District Delete", "Del: c"),
    ]
    assert [r.id for r in gov.audit_page(log, 2, 2).collect()] == ["1"]


def test_log_table_round_trip(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    first = log_of(rows, ("1", "State", "Merge", "a", "b"))
    gov.write_events(first, path)
    gov.write_events(first.where("false"), path)
    gov.write_events(gov.revert_events(first, rows("id string", ("1",))), path)
    log = spark.read.schema(first.schema).parquet(path)
    assert log.count() == 2 and gov.rulings(log).count() == 0


def test_round_trip_from_scan_to_clean_feeds(spark, rows):
    enrol = facts(rows, *[("Karnataka", "Mysuru")] * 5, ("Karnatak", "Mysuruu"), ("Goa", "Panaji"))
    bio = enrol.withColumnRenamed("adult_enrolments", "bio_stress")
    log = log_of(rows).where("false")
    for scope in ("State", "District"):
        review = flow.review(enrol, log, scope)
        assert review["tallies"].first() == (1, 1, 1)
        log = gov.append(log, review["events"])
    clean = flow.refresh(Feeds(enrol, bio, bio, log), log)
    assert {n for n in names(clean.enrol)} == {("Karnataka", "Mysuru"), ("Goa", "Panaji")}
    assert names(clean.bio) == names(clean.enrol)
    again = flow.review(clean.enrol, log, "District")
    assert again["issues"].count() == 0

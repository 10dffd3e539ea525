"""Pages by counts and from the last row equal the pages by offset, and read only their days."""

import shutil
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from querybook.views import Views
from wardwise.operators import governance as gov
from wardwise.schema import GOVERNANCE_LOG
from wardwise.sources import audit_table

SIZE = 15


@pytest.fixture(scope="module")
def log(spark):
    log = Views(spark, "/root/testdata/sf0.001").governance_log()
    return log.withColumn("ts", F.col("ts").cast("timestamp")).select(*gov.LOG_COLUMNS).checkpoint()


@pytest.fixture(scope="module")
def path(log, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("audit"))
    audit_table.write_audit(log, path)
    return path


def newest_first(log, scopes=audit_table.SCOPES):
    return [tuple(r) for r in gov.audit(log, scopes=scopes).orderBy(*gov.audit_order()).collect()]


def test_every_page(spark, log, path):
    wanted = newest_first(log)
    for number in (1, 2, 7, 30, len(wanted) // SIZE + 1, len(wanted) // SIZE + 2, 1000):
        got = [tuple(r) for r in audit_table.page(spark, path, number).collect()]
        assert got == wanted[(number - 1) * SIZE : number * SIZE], number
    only = newest_first(log, ["District"])
    assert [tuple(r) for r in audit_table.page(spark, path, 5, 40, ["District"]).collect()] == only[160:200]


def test_paging_on_from_a_row(spark, log, path):
    wanted = newest_first(log, ["State"])
    shown = wanted[:1]
    while len(shown) < len(wanted):
        size = 7 if len(shown) < 50 else 200
        more = audit_table.page_after(spark, path, shown[-1][1], shown[-1][0], size, ["State"]).collect()
        assert more
        shown += [tuple(r) for r in more]
    assert shown == wanted
    assert audit_table.page_after(spark, path, shown[-1][1], shown[-1][0], 5, ["State"]).isEmpty()


def test_other_days_are_not_read(spark, log, path, tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(path, copy)
    wanted = newest_first(log)[300:315]
    days = {f"day={r[1].date()}" for r in wanted}
    others = [p for p in Path(copy, "rows").glob("day=*") if p.name not in days]
    assert len(others) > 10
    for p in others:
        shutil.rmtree(p)
    assert [tuple(r) for r in audit_table.page(spark, str(copy), 21).collect()] == wanted


def test_new_events_replace_their_days(spark, log, path, tmp_path):
    copy = str(tmp_path / "copy")
    shutil.copytree(path, copy)
    standing = gov.audit(log)
    one_day = standing.where(F.to_date("ts") == F.lit(newest_first(log)[200][1].date()))
    at = datetime(2024, 3, 1)
    entry = [("n1", at, "State", "Merge", "a", "b", "u"), ("n2", at + timedelta(hours=1), "District", "Delete", "c", "N/A", "u"),
             ("n3", at, "State", "Revert", "a", "n1", "u")]
    events = spark.createDataFrame(entry, GOVERNANCE_LOG).unionByName(
        gov.revert_events(log, one_day.select("id"), at=F.lit(at), event_id=F.concat(F.lit("r"), F.col("id")))
    )
    before = {p.name: p.stat().st_mtime_ns for p in Path(copy, "rows").glob("day=*")}
    audit_table.add_events(spark, events, copy)
    after = {p.name: p.stat().st_mtime_ns for p in Path(copy, "rows").glob("day=*")}
    assert sum(after[d] != m for d, m in before.items()) == 1  # the reverted day, all of it taken back
    whole = newest_first(gov.append(log, events))
    assert whole[0][0] == "n2"
    for number in (1, 14, 20):
        got = [tuple(r) for r in audit_table.page(spark, copy, number).collect()]
        assert got == whole[(number - 1) * SIZE : number * SIZE]


def test_empty_log(spark, tmp_path):
    audit_table.write_audit(spark.createDataFrame([("r", datetime(2024, 1, 1), "State", "Merge", "a", "b", "u"),
                                                   ("s", datetime(2024, 1, 2), "State", "Revert", "a", "r", "u")], GOVERNANCE_LOG), str(tmp_path / "t"))
    assert audit_table.page(spark, str(tmp_path / "t")).isEmpty()

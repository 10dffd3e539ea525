"""Rulings kept by a stream equal the batch over the whole log, after every batch."""

from datetime import datetime, timedelta

import pytest

from querybook.views import Views
from wardwise.operators import governance as gov
from wardwise.schema import GOVERNANCE_LOG, feed_schema
from wardwise.sources import drop_folder as ingest
from wardwise.streaming import rulings as stream

HEADER = "date,state,district,pincode,age_18_greater"
START = datetime(2025, 1, 1)


def bag(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def place(spark, tmp_path):
    class Place:
        log, kept, state = (str(tmp_path / n) for n in ("log", "kept", "state"))
        count = 0

        def say(self, *events):
            """Append ``(id, scope, action, original, target)`` as one batch."""
            rows = []
            for e in events:
                self.count += 1
                rows.append((e[0], START + timedelta(hours=self.count), *e[1:], "u"))
            gov.write_events(spark.createDataFrame(rows, GOVERNANCE_LOG), self.log)

        def now(self):
            stream.follow_log(spark, self.log, self.kept, self.state, buckets=4)
            return stream.in_force(spark, self.kept)

        def all(self):
            return spark.read.schema(GOVERNANCE_LOG).parquet(self.log)

    return Place()


def test_rulings_follow_the_log(spark, place):
    batches = [
        [("1", "State", "Merge", "Goaa", "Goa"), ("2", "State", "Merge", "Goaa", "Kerala"), ("3", "District", "Delete", "X", "N/A")],
        [("4", "State", "Revert", "Goaa", "2")],  # the older Merge stands again
        [("5", "District", "Revert", "X", "3"), ("6", "State", "Merge", "Goaa", "Punjab")],  # nothing stands for X
        [("7", "State", "Revert", "Goaa", "9")],  # a Revert before its entry
        [("9", "State", "Merge", "Goaa", "Assam"), ("10", "State", "Delete", None, "N/A")],
        [("11", "State", "Revert", "any name", "6"), ("12", "State", "Ignore", "Y", "Z")],  # found by id alone
        [("13", "State", "Revert", "Goaa", "1")],
    ]
    for events in batches:
        place.say(*events)
        got = bag(place.now())
        assert got == bag(gov.rulings(place.all()))
        assert got == bag(place.now())  # nothing new, nothing changes
    assert not any("Goaa" in row for row in got)


def test_whole_log_in_small_batches(spark, tmp_path):
    log = Views(spark, "/root/testdata/sf0.001").governance_log()
    path, kept = str(tmp_path / "log"), str(tmp_path / "kept")
    log.withColumn("ts", log.ts.cast("timestamp")).select(*gov.LOG_COLUMNS).repartition(5).write.parquet(path)
    query = stream.follow_log(spark, path, kept, str(tmp_path / "state"), buckets=3, files_per_batch=1)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 5
    assert bag(stream.in_force(spark, kept)) == bag(gov.rulings(log))


def test_batch_run_again_leaves_each_row_once(spark, place):
    place.say(("1", "State", "Merge", "a", "b"), ("2", "State", "Delete", "c", "N/A"))
    before = bag(place.now())
    updates = stream.changed_entries(place.all())
    stream._write_batch(updates, 0, place.kept, 4)
    assert bag(stream.in_force(spark, place.kept)) == before


def test_arriving_facts_follow_what_is_in_force(spark, place, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    table, state = str(tmp_path / "out"), str(tmp_path / "facts")

    def arrive(name, *rows):
        """The governed rows of this batch and, from the raw feed, of all rows so far."""
        lines = [HEADER, *(f"01-03-2025,{s},{d},403001,{n}" for s, d, n in rows)]
        (folder / name).write_text("\n".join(lines) + "\n")
        stream.govern_new_files(spark, str(folder), HEADER.split(","), place.kept, table, state)
        columns = feed_schema("enrol").names
        written = spark.read.parquet(table)
        raw = ingest.read_feeds(spark, str(folder)).enrol
        return bag(written.select(*columns)), raw

    first, raw = arrive("a.csv", ("goaa", "x", 1), ("goa", "y", 2))
    assert first == bag(raw)  # no ruling yet
    place.say(("1", "State", "Merge", "Goaa", "Goa"), ("2", "District", "Delete", "Y", "N/A"))
    place.now()
    second, raw = arrive("b.csv", ("goaa", "x", 10), ("goa", "y", 20), ("", "x", 30))
    assert len(second) == len(first) + 2
    rows = [r.asDict() for r in spark.read.parquet(table).where("batch = 1").collect()]
    assert sorted((r["state"] or "", r["adult_enrolments"]) for r in rows) == [("", 30), ("Goa", 10)]
    assert bag(gov.govern(raw, stream.in_force(spark, place.kept))) == bag(gov.apply_governance(raw, place.all()))
    place.say(("3", "State", "Revert", "Goaa", "1"))
    place.now()
    third, raw = arrive("c.csv", ("goaa", "x", 100))
    assert any("Goaa" in r and "=100" in r for r in third)
    assert bag(gov.govern(raw, stream.in_force(spark, place.kept))) == bag(gov.apply_governance(raw, place.all()))


def test_a_log_that_starts_with_reverts(spark, place):
    place.say(("1", "State", "Revert", "Goaa", "2"))
    assert place.now().isEmpty()
    place.say(("2", "State", "Merge", "Goaa", "Goa"), ("3", "District", "Merge", "x", "y"))
    assert bag(place.now()) == bag(gov.rulings(place.all()))
    assert place.now().count() == 1

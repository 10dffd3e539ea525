import pytest

from wardwise.schema import feed_schema
from wardwise.operators.aggregates import daily_totals
from wardwise.sources import drop_folder as ingest
from wardwise.streaming import daily_totals as totals, drop_folder as stream

HEADER = "date,state,district,pincode,age_18_greater"


def test_new_files_are_taken_in_once(spark, tmp_path):
    folder, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def drop(name, *lines):
        (tmp_path / "in" / name).write_text("\n".join([HEADER, *lines]) + "\n")

    def load():
        stream.append_new_files(spark, folder, HEADER.split(","), table, state)
        got = spark.read.schema(feed_schema("enrol")).parquet(table)
        return sorted(r.adult_enrolments for r in got.collect())

    drop("a.csv", "01-02-2025,goa,panaji,403001,3", "bad,goa,NA,,4")
    assert load() == [3, 4]
    assert load() == [3, 4]
    drop("b.CSV", "02-02-2025,goa,panaji,403001,5")
    assert load() == [3, 4, 5]
    streamed = spark.read.schema(feed_schema("enrol")).parquet(table).collect()
    batch = ingest.read_feeds(spark, folder).enrol.collect()
    assert sorted(map(str, streamed)) == sorted(map(str, batch))


def test_unknown_header_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        stream.feed_stream(spark, str(tmp_path), ["a", "b"])


def test_daily_totals_out_of_order(spark, tmp_path):
    """Files out of order give the batch's totals for every day the watermark allows; a later row is counted."""
    folder, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    late = 0

    def arrive(name, *rows):
        nonlocal late
        lines = [HEADER, *(f"{day:02d}-03-2025,{place},x,403001,{n}" for day, place, n in rows)]
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")
        query = totals.close_days(spark, folder, HEADER.split(","), table, state, ("state",), lateness="3 days")
        late += totals.late_rows(query)
        got = spark.read.parquet(table).collect()
        assert len({(r.state, r.date) for r in got}) == len(got)  # a total is written once
        return {(r.state, r.date.day): r.adult_enrolments for r in got}

    arrive("a.csv", (3, "goa", 1), (1, "goa", 2), (4, "kerala", 5))
    arrive("b.csv", (2, "goa", 3), (5, "goa", 7), (3, "kerala", 1), (3, "goa", 4))
    arrive("c.csv", (4, "goa", 9), (9, "goa", 1), (6, "goa", 2))
    batch = daily_totals(ingest.read_feeds(spark, folder).enrol, ("state",)).collect()
    assert late == 0
    got = arrive("d.csv", (1, "goa", 100), (20, "goa", 1))
    assert late == 1  # the first of March was final
    want = {(r.state, r.date.day): r.adult_enrolments for r in batch}
    assert got == {k: v for k, v in want.items() if k[1] < 20}


def test_daily_totals_without_names_or_dates(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEADER + "\nbad,goa,x,1,5\n01-03-2025,,x,1,5\n01-03-2025,goa,x,1,\n09-03-2025,goa,x,1,1\n")
    totals.close_days(
        spark, str(tmp_path / "in"), HEADER.split(","), str(tmp_path / "out"), str(tmp_path / "state"), ("state",), lateness="1 day"
    )
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.state, r.date.day, r.adult_enrolments) for r in got] == [("Goa", 1, 0)]

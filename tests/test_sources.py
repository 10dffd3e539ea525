import csv
from datetime import date

import pytest

from wardwise.operators import aggregates as agg, geo
from wardwise.plans import reports
from wardwise.sources import drop_folder as ingest, exports, tables


@pytest.fixture
def folder(tmp_path):
    files = {
        "a.csv": "date,state,district,pincode,age_0_5,age_5_17,age_18_greater\n"
        "03-04-2025,karnataka,mysuru,570001,1,2,30\n"
        "bad,goa,panaji,,1,2,\n"
        "04-04-2025,NA,o'brien-nagar,x1,,,5\n",
        # other order, padding, case, suffix case; no child columns
        "B.CSV": " PINCODE ,District,State,Age_18_Greater,DATE\n"
        '411001,"pune, rural",MAHARASHTRA,7,05/04/2025\n',
        "c.csv": "date,state,district,pincode,bio_age_5_17,bio_age_17_\n03-04-2025,goa,panaji,403001,4,\n",
        "d d.csv": "date,state,district,pincode,demo_age_5_17,demo_age_17_\n03-04-2025,goa,panaji,403001,4,6\n",
        "e.csv": "some,other,header\n1,2,3\n",
        "f.csv": "\n",
        "g.csv": "",
        "notes.txt": "date,state,district,pincode,bio_age_5_17\n1,2,3,4,5\n",
        "sub/g.csv": "date,state,district,pincode,bio_age_5_17\n03-04-2025,deep,deep,1,5\n",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    return str(tmp_path)


def test_read_feeds(spark, folder):
    feeds = ingest.read_feeds(spark, folder)
    assert {tuple(r) for r in feeds.enrol.collect()} == {
        (date(2025, 4, 3), "Karnataka", "Mysuru", 570001, 30),
        (None, "Goa", "Panaji", 0, 0),
        (date(2025, 4, 4), None, "O'Brien-Nagar", 0, 5),
        (date(2025, 4, 5), "Maharashtra", "Pune, Rural", 411001, 7),
    }
    assert feeds.bio.collect() == [(date(2025, 4, 3), "Goa", "Panaji", 403001, 4)]
    assert feeds.demo.collect() == [(date(2025, 4, 3), "Goa", "Panaji", 403001, 10)]
    lines = [r.message for r in feeds.log.collect()]
    assert lines[0] == "CSV files found: 6"
    assert [m for m in lines if m.startswith("Left out")] == ["Left out f.csv: the first line names no columns"]
    assert ingest.missing_name_counts(feeds.enrol).first() == (1, 0, 1)


HEADER = "date,state,district,pincode,age_18_greater\n"


def test_files_that_do_not_parse(spark, tmp_path):
    """A bad file contributes no row and is named; the others are complete."""
    files = {
        "good.csv": HEADER + "03-04-2025,goa,panaji,403001,9\n04-04-2025,goa,panaji\n",
        "more.csv": HEADER + "03-04-2025,goa,north,panaji,403001,9\n03-04-2025,kerala,kochi,1,5\n",
        "empty cell.csv": HEADER + "03-04-2025,kerala,kochi,1,5,\n",
        "open.csv": HEADER + '03-04-2025,kerala,"kochi,1,5\n03-04-2025,kerala,kochi,1,5\n',
        "breaks.csv": HEADER + '03-04-2025,goa,"south\ngoa",403001,7\n03-04-2025,"a, b",c,2,8\n',
        "twice.csv": "date,state,state,district,pincode,age_18_greater\n03-04-2025,a,b,c,1,2\n",
        "other.csv": "a,b\n1,2,3\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    feeds = ingest.read_feeds(spark, str(tmp_path))
    assert sorted((r.state, r.district, r.pincode, r.adult_enrolments) for r in feeds.enrol.collect()) == [
        ("A, B", "C", 2, 8), ("Goa", "Panaji", 0, 0), ("Goa", "Panaji", 403001, 9), ("Goa", "South\nGoa", 403001, 7),
    ]
    assert sorted(r.message for r in feeds.log.collect() if r.level == "WARN" and "Left out" in r.message) == [
        "Left out empty cell.csv: a record has more cells than the header",
        "Left out more.csv: a record has more cells than the header",
        "Left out open.csv: a quote is never closed",
        "Left out twice.csv: column names repeat in the header",
    ]


def jobs(spark, group, fn):
    spark.sparkContext.setJobGroup(group, group)
    try:
        fn()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("rest", "rest")


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    for folder, n in (("few", 2), ("many", 200)):
        (tmp_path / folder).mkdir()
        for i in range(n):
            (tmp_path / folder / f"{i}.csv").write_text(HEADER + f"03-04-2025,goa,panaji,403001,{i}\n")
    few, many = (jobs(spark, f, lambda: ingest.read_feeds(spark, str(tmp_path / f)).enrol.count()) for f in ("few", "many"))
    assert 0 < many <= few
    assert ingest.read_feeds(spark, str(tmp_path / "many")).enrol.agg({"adult_enrolments": "sum"}).first()[0] == sum(range(200))


def test_feed_rules():
    assert ingest.feed_of(["x", "bio_age_5_17", "demo_age_17_"]) == "bio"
    assert ingest.feed_of(["my_demo_age", "age_0_5"]) == "demo"
    assert ingest.feed_of(["age_18_greater"]) == "enrol"
    assert ingest.feed_of(["age_5_17"]) is None
    assert ingest.normalize_header([" Date ", "STATE"]) == ["date", "state"]


def test_children_count_only_without_an_adult_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,state,district,pincode,age_0_5,age_5_17\n01-01-2025,a,b,1,2,3\n")
    assert ingest.read_feeds(spark, str(tmp_path)).enrol.first()["adult_enrolments"] == 5
    (tmp_path / "b.csv").write_text("date,state,district,pincode,age_18_greater\n01-01-2025,a,b,1,40\n")
    got = ingest.read_feeds(spark, str(tmp_path)).enrol.collect()
    assert sorted(r.adult_enrolments for r in got) == [0, 40]


def test_missing_bio_is_simulated(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,state,district,pincode,age_18_greater\n01-01-2025,a,b,1,9\n")
    feeds = ingest.read_feeds(spark, str(tmp_path))
    row = feeds.bio.first()
    assert row["bio_stress"] == 3 and row["is_simulated"] is True
    assert feeds.demo.count() == 0
    assert any("simulated" in r.message for r in feeds.log.collect())


def test_missing_folder(spark, tmp_path):
    feeds = ingest.read_feeds(spark, str(tmp_path / "nowhere"))
    assert [df.count() for df in (feeds.enrol, feeds.bio, feeds.demo)] == [0, 0, 0]
    assert feeds.enrol.columns[-1] == "adult_enrolments"
    assert feeds.log.first()["message"].startswith("No such folder")


def test_empty_folder(spark, tmp_path):
    feeds = ingest.read_feeds(spark, str(tmp_path))
    assert feeds.bio.count() == 0 and feeds.bio.columns[-1] == "bio_stress"
    assert [r.message for r in feeds.log.collect()] == ["CSV files found: 0"]


def test_missing_key_column_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,state,pincode,age_18_greater\n01-01-2025,a,1,9\n")
    with pytest.raises(KeyError):
        ingest.read_feeds(spark, str(tmp_path))


def test_canonical_table_prunes_months(spark, folder, tmp_path):
    enrol = ingest.read_feeds(spark, folder).enrol
    path = str(tmp_path / "out" / "enrol")
    tables.write_canonical(enrol, path)
    back = tables.read_canonical(spark, path, "enrol")
    assert sorted(map(str, back.collect())) == sorted(map(str, enrol.collect()))
    ranged = tables.read_canonical(spark, path, "enrol", "2025-04-04", "2025-04-30")
    assert ranged.count() == 2
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_settle_is_a_table(spark):
    df = tables.settle(spark.range(5).selectExpr("id", "id * 2 as twice"))
    assert sorted(tuple(r) for r in df.collect()) == [(i, 2 * i) for i in range(5)]
    assert "FileScan" in df._jdf.queryExecution().executedPlan().toString()
    assert tables.settle(df.where("false")).count() == 0


def test_nothing_is_left_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_folder", lambda spark: str(tmp_path / "shared"))
    tables.release(spark)
    tables.settle(spark.range(3)), tables.settle(spark.range(4))
    assert len(list((tmp_path / "shared").iterdir())) == 2
    assert tables.release(spark) == 2 and tables.release(spark) == 0
    assert list((tmp_path / "shared").iterdir()) == []


def test_shared_folder_is_never_machine_local():
    class Session:
        conf = {"spark.sql.warehouse.dir": "hdfs://shared/warehouse/"}
        sparkContext = type("Context", (), {"getCheckpointDir": lambda self: None})()

    assert tables.shared_folder(Session) == "hdfs://shared/warehouse/settled"
    Session.conf = {**Session.conf, "spark.checkpoint.dir": "hdfs://shared/checkpoints/"}
    assert tables.shared_folder(Session) == "hdfs://shared/checkpoints"


def read_csv(path):
    out = []
    for part in sorted(path.glob("part-*.csv")):
        out += list(csv.reader(part.open()))
    return out


def test_exports(spark, folder, tmp_path):
    feeds = ingest.read_feeds(spark, folder)
    exports.export_csv(exports.regional(feeds.enrol).orderBy("state"), str(tmp_path / "regional"), True)
    assert read_csv(tmp_path / "regional") == [
        ["state", "district", "adult_enrolments"],
        ["Goa", "Panaji", "0"],
        ["Karnataka", "Mysuru", "30"],
        ["Maharashtra", "Pune, Rural", "7"],
    ]
    points = geo.geo_points(agg.market_share(feeds.enrol), "linear")
    exports.export_csv(points.orderBy("state"), str(tmp_path / "map"), True)
    header, first, *_ = read_csv(tmp_path / "map")
    assert first[header.index("color")] == "[0, 255, 255, 140]"
    assert exports.trends(feeds.enrol.drop("date")) is None


def test_report_pages(spark, folder):
    feeds = ingest.read_feeds(spark, folder)
    executive = reports.executive_page(feeds.enrol, feeds.bio)
    kpis = executive["kpis"].first()
    assert (kpis.total_enrolments, kpis.total_bio, kpis.issues) == (42, 4, 0)
    assert executive["outlook"].count() == 30
    logged = reports.executive_page(feeds.enrol, feeds.bio, ingest_log=feeds.log)["ingest_log"].collect()
    assert logged == ingest.recent_messages(feeds.log).collect() and 0 < len(logged) <= 10
    many = spark.createDataFrame([(f"2025-01-{d:02d} 00:00:00", "INFO", f"{d}") for d in range(1, 31)], "ts string, level string, message string")
    assert [r.message for r in ingest.recent_messages(many).collect()] == [f"{d}" for d in range(30, 20, -1)]
    analytics = reports.analytics_page(feeds.enrol, feeds.bio, "2025-04-03", "2025-04-03")
    assert analytics["kpis"].first() == (30, 1, 1)
    assert analytics["workload"].count() == 4
    forecast = reports.forecast_page(feeds.enrol, horizon=7)
    assert forecast["table"].count() == 7 and forecast["capacity"].count() == 1
    shown = reports.map_page(feeds.enrol, states=["Goa", "Karnataka"])
    assert shown["points"].count() == 2
    assert shown["summary"].first()["hotspot"] == "Mysuru"


def test_first_lines_of_headerless_files_stay_where_they_are(spark, tmp_path, monkeypatch):
    """Only headers of a feed come to the driver, however many files start with a line of their own."""
    for i in range(40):
        (tmp_path / f"{i}.csv").write_text(f"row {i},{i}\nrow,{i}\n")
    (tmp_path / "twice.csv").write_text("a,A\n1,2\n")
    (tmp_path / "blank.csv").write_text(",,\n1,2\n")
    (tmp_path / "enrol.csv").write_text("date,state,district,pincode,age_18_greater\n01-02-2025,goa,panaji,403001,3\n")
    collected = []
    plain = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: collected.append(plain(df)) or collected[-1])
    feeds = ingest.read_feeds(spark, str(tmp_path))
    assert sum(len(rows) for rows in collected) == 1
    monkeypatch.undo()
    assert [r.adult_enrolments for r in feeds.enrol.collect()] == [3]
    said = sorted(r.message for r in feeds.log.collect() if r.message.startswith("Left out"))
    assert said == ["Left out blank.csv: the first line names no columns", "Left out twice.csv: column names repeat in the header"]

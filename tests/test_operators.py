from datetime import date

import pytest
from pyspark.sql import functions as F

from wardwise.operators import aggregates as agg, anomaly, filters, forecast as fc, geo, ranking, workload
from wardwise.schema import feed_schema

FACTS = "date date, state string, district string, pincode int, adult_enrolments bigint"
BIO = "date date, state string, district string, pincode int, bio_stress bigint"
DAY = date(2025, 1, 1)


def day(n):
    return date(2025, 1, n)


def facts(rows, *values):
    """(state, district, volume) on one day and PIN."""
    return rows(FACTS, *[(DAY, s, d, 110001, v) for s, d, v in values])


def test_null_names_form_no_group(rows):
    df = facts(rows, ("A", "x", 1), (None, "x", 2), ("A", None, 4))
    assert agg.market_share(df).collect() == [("A", "x", 1)]
    assert agg.volume_and_reach(df).first() == (7, 1, 1)


def test_null_dates_drop_from_days_only(rows):
    df = rows(FACTS, (DAY, "A", "x", 1, 5), (None, "A", "x", 1, 7))
    assert agg.daily_totals(df).collect() == [(DAY, 5)]
    assert agg.market_share(df).first()[2] == 12


def test_empty_feed(spark):
    df = spark.createDataFrame([], feed_schema("enrol"))
    assert agg.grand_total(df).first() == (0,)
    assert agg.volume_and_reach(df).first() == (0, 0, 0)
    assert agg.hotspot(df).first() == (None, None)
    assert fc.forecast(agg.daily_totals(df)).count() == 0
    assert anomaly.anomaly_scores(agg.market_share(df)).count() == 0
    assert anomaly.risk_table(agg.market_share(df)).count() == 0
    assert fc.insight(fc.forecast(agg.daily_totals(df))).first()["insight"] == "Insufficient data for insight."


def test_ties(rows):
    df = facts(rows, ("A", "y", 5), ("A", "x", 5), ("B", "z", 5), ("C", "w", 1))
    assert agg.hotspot(df).first()["hotspot"] == "x"
    assert [r.state for r in ranking.top_states(df, 2).collect()] == ["A", "B"]
    assert [r.district for r in ranking.watchlist(df, 2).collect()] == ["w", "x"]
    top = ranking.top_districts_per_state(agg.market_share(df), 1)
    assert sorted((r.state, r.district) for r in top.collect()) == [("A", "x"), ("B", "z"), ("C", "w")]


def test_watchlist_filters_rows_not_groups(rows):
    df = facts(rows, ("A", "x", 5), ("A", "x", -4), ("A", "y", 0))
    assert ranking.watchlist(df).collect() == [("A", "x", 5)]


def test_full_outer_workload(rows):
    enrol = facts(rows, ("A", "left", 3), ("A", "both", 4), ("B", "both", 6))
    bio = rows(BIO, (DAY, "A", "both", 1, 7), (DAY, "A", "right", 1, 9))
    got = {tuple(r) for r in workload.workload_by_district(enrol, bio).collect()}
    assert got == {("left", 3, 0), ("both", 10, 7), ("right", 0, 9)}
    no_bio = bio.where("false")
    assert {r[2] for r in workload.workload_by_district(enrol, no_bio).collect()} == {0}
    assert workload.workload_by_district(enrol.where("false"), bio).count() == 0
    ratio = workload.workload_ratio(workload.workload_by_district(enrol, bio)).first()
    assert ratio["ratio"] == 16 / 14
    assert "1.1 biometric updates" in ratio["insight"]


def test_filters(rows):
    df = rows(FACTS, *[(d, s, "x", 1, 1) for d in (day(1), day(2), None) for s in ("A", "B")])
    assert filters.in_date_range(df, day(1), day(1)).count() == 2
    assert filters.in_date_range(df, day(1)).count() == 6
    assert filters.in_states(df, []).count() == 6
    assert filters.in_states(df, ["A"]).count() == 3
    assert filters.in_states(df, df.select("state").where("state = 'B'")).count() == 3


def test_pages(rows):
    df = rows("n int", *[(i,) for i in range(23)])
    pages = [[r.n for r in ranking.page(df, [F.asc("n")], p, 10).collect()] for p in (1, 2, 3, 4)]
    assert pages == [list(range(10)), list(range(10, 20)), [20, 21, 22], []]


def test_recent_history_counts_rows(rows):
    df = rows(FACTS, *[(day(1 + i % 3), "A", f"d{i:02d}", 1, i) for i in range(30)], (None, "A", "x", 1, 0))
    got = ranking.recent_history(df, 15).collect()
    assert len(got) == 15
    assert [r.date for r in got] == sorted(r.date for r in got)
    assert sum(r.date == day(3) for r in got) == 10


# --- forecast


def series(rows, *values):
    return rows("date date, adult_enrolments bigint", *[(day(i + 1), v) for i, v in enumerate(values)])


def test_volatility_rules(rows):
    def state(*values):
        return fc.series_state(series(rows, *values)).first()

    assert state(10, 20, 30, 40, 50)["volatility"] == 0.05  # five days are too few
    assert state(20, 20, 20, 20, 20, 20)["volatility"] == 0.05  # no deviation
    assert state(10, 0, 20, 30, 40, 50)["volatility"] == 0.05  # from zero: infinite change
    changes = [1.0, 0.5, -0.5, 1.0, 0.25]
    mean = sum(changes) / 5
    expected = (sum((c - mean) ** 2 for c in changes) / 4) ** 0.5
    assert state(20, 40, 60, 30, 60, 75)["volatility"] == pytest.approx(expected)
    # 0 after 0 is no change at all and does not spoil the deviation
    assert state(0, 0, 0, 0, 0, 0)["volatility"] == 0.05


def test_start_value(rows):
    def start(*values):
        return fc.series_state(series(rows, *values)).first()["start_value"]

    assert start(50, 60) == 60
    assert start(50, 9) == 50
    assert start(50, 10) == 10
    assert start(7) == 7


def test_drift_only_closed_form(rows):
    got = fc.forecast(series(rows, 100), horizon=5, growth=0.1, model="Polynomial", volatility=0.0)
    values = [r for r in got.orderBy("date").collect()]
    for i, r in enumerate(values, 1):
        assert r.predicted == pytest.approx(100 * 1.005**i * (1 + 0.1 / 5) ** i)
        assert r.upper == pytest.approx(1.2 * r.predicted)
        assert r.lower == pytest.approx(0.8 * r.predicted)
        assert r.date == day(1 + i)


def test_projection_never_negative_and_reproducible(rows):
    daily = series(rows, 100, 900, 10, 800, 20, 700)
    first = fc.forecast(daily, horizon=60).orderBy("date").collect()
    second = fc.forecast(daily.repartition(5), horizon=60).orderBy("date").collect()
    assert first == second
    assert all(r.predicted >= 0 for r in first)
    assert first != fc.forecast(daily, horizon=60, seed=43).orderBy("date").collect()


def test_keyed_forecast_equals_single_ones(rows, spark):
    daily = rows(
        "state string, date date, adult_enrolments bigint",
        *[(s, day(i + 1), 100 + 7 * i * (1 + (s == "B"))) for s in "AB" for i in range(8)],
    )
    keyed = fc.forecast(daily, ("state",)).orderBy("state", "date").collect()
    for s in "AB":
        alone = fc.forecast(daily.where(F.col("state") == s), ("state",)).orderBy("date").collect()
        assert [r for r in keyed if r.state == s] == alone


def test_scenarios_share_the_path(rows):
    state = fc.series_state(series(rows, 100, 120, 90, 130, 80, 100))
    got = fc.project(state, (), [("flat", 0.0, 10, "Linear"), ("spike", 0.5, 10, "Linear")])
    by = {(r.scenario, r.date): r.predicted for r in got.collect()}
    for (name, d), value in by.items():
        if name == "spike":
            i = (d - day(6)).days
            assert value == pytest.approx(by["flat", d] * 1.05**i)


def test_insight_texts(rows):
    def text(*values):
        df = rows("date date, predicted double", *[(day(i + 1), v) for i, v in enumerate(values)])
        return fc.insight(df, "Linear").first()["insight"]

    assert text(100.0, 120.0) == (
        "**📈 Projection:** The Linear stochastic model predicts a **20.0% Growth**."
        "\n\n **Action Required:** Significant volume shift detected."
    )
    assert text(100.0, 95.0) == (
        "**📉 Projection:** The Linear stochastic model predicts a **5.0% Decline**."
        "\n\n **Status:** Operations expected to remain stable."
    )
    assert text(0.0, 95.0) == "Insufficient data for insight."


def test_capacity(rows):
    def plan(peak):
        df = rows("date date, predicted double", (day(1), peak), (day(2), 1.0))
        return fc.capacity_plan(df).first()

    small, exact, large, runaway = plan(81.0), plan(4000.0), plan(4000.5), plan(1e30)
    assert (small.operators, small.high_load, small.mean_daily_volume) == (3, False, 41)
    assert small.peak_gb_per_day == pytest.approx(81 * 5 / 1024)
    assert small.status == "✅ **Stable Load:** Projected peak of 81/day is within current capacity."
    assert (exact.operators, exact.high_load) == (100, False)
    assert (large.operators, large.high_load) == (101, True)
    assert large.status.endswith("requires significant staffing (101 operators).")
    assert runaway.high_load and runaway.operators is None


def test_display_truncates(rows):
    df = rows("date date, predicted double, upper double, lower double", (day(1), 9.99, 11.99, 7.99))
    assert fc.display_table(df).first() == (day(1), 9, 11, 7)


# --- anomalies


def groups(rows, n, outlier=None):
    values = [(f"S{i % 7}", f"D{i:04d}", 1000 + (i * 37) % 101) for i in range(n)]
    if outlier:
        values.append(("S0", "OUT", outlier))
    return rows("state string, district string, adult_enrolments bigint", *values)


def test_few_groups_come_back_unscored(rows):
    got = anomaly.risk_table(groups(rows, 9))
    assert got.count() == 9
    assert {r.risk_score for r in got.collect()} == {0}
    assert anomaly.flag_count(got).first()["issues"] == 0


def test_outlier_is_flagged(rows):
    got = anomaly.risk_table(groups(rows, 400, 50_000)).collect()
    assert got[0].district == "OUT" and got[0].risk_score == 100
    assert all(r.anomaly == -1 for r in got)
    scores = [r.risk_score for r in got]
    assert scores == sorted(scores, reverse=True)
    head = anomaly.worst_risk(anomaly.risk_table(groups(rows, 400, 50_000))).first()
    assert head["headline"] == "Flagged **OUT** as highest risk due to statistical variance."


def test_low_outlier_scores_about_ten(rows):
    got = anomaly.risk_table(groups(rows, 400, 1)).where("district = 'OUT'").first()
    assert got.risk_score == 10


def test_model_does_not_depend_on_partitioning(rows):
    df = groups(rows, 1500)
    a = anomaly.fit_forest(df.coalesce(1))
    b = anomaly.fit_forest(df.repartition(11))
    assert (a.starts == b.starts).all()
    assert abs(a.lengths - b.lengths).max() < 1e-9
    assert len(a.starts) <= 100 * 256


def test_prefilter_does_not_change_the_samples(rows):
    df = groups(rows, 3000)
    args = (df, 3000, "adult_enrolments", ("state", "district"), 5, 256)
    with_filter = anomaly.draw_samples(*args).orderBy("tree", "value").collect()
    without = anomaly.draw_samples(*args, prefilter=False).orderBy("tree", "value").collect()
    assert with_filter == without and len(without) == 5 * 256


def test_equal_volumes_are_no_outliers(rows):
    df = rows(
        "state string, district string, adult_enrolments bigint",
        *[("S", f"D{i}", 5) for i in range(20)],
    )
    assert anomaly.risk_table(df).count() == 0


def test_model_size_is_bounded(rows):
    with pytest.raises(ValueError):
        anomaly.fit_forest(groups(rows, 20), trees=10_000, sample=1000)


# --- map


def test_unknown_state_takes_the_default_point(rows):
    got = geo.located(rows("state string, district string, adult_enrolments bigint",
                           ("Goa", "x", 1), ("Nowhere", "x", 1)))
    by = {r.state: r for r in got.collect()}
    assert by["Goa"].lat - by["Nowhere"].lat == pytest.approx(15.29 - 20.0)
    assert by["Goa"].lon - by["Nowhere"].lon == pytest.approx(74.12 - 78.0)


def test_scales(rows):
    df = rows("state string, district string, adult_enrolments bigint",
              ("Goa", "a", 0), ("Goa", "b", 50), ("Goa", "c", 99))
    linear = {r.district: r for r in geo.geo_points(df, "linear").collect()}
    assert linear["b"].norm == 0.5 and linear["b"].elevation == 2500.0
    assert linear["b"].radius == 14000.0
    assert linear["a"].color == [0, 255, 255, 140] and linear["c"].color == [255, 0, 50, 200]
    log = {r.district: r for r in geo.geo_points(df, "log").collect()}
    assert log["a"].norm == 0.0 and 0 < log["b"].norm < log["c"].norm < 1
    assert log["c"].elevation == pytest.approx(200000 * log["c"].norm)


def test_focus(spark):
    assert geo.focus(spark).first() == (22.0, 79.0, 4)
    assert geo.focus(spark, ["Goa", "Bihar"]).first() == (15.29, 74.12, 6)
    assert geo.focus(spark, ["Lakshadweep"]).first() == (22.0, 79.0, 6)

from datetime import date

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from wardwise.functions import draws, messages, parse, scaling, text

NAMES = st.lists(
    st.text(
        st.sampled_from("abzABZ09 '.-&_éÉßñçøÅıſǆǅΣσςяЯª­́कカ中\t "), max_size=14
    ),
    min_size=1,
    max_size=60,
)


def column(spark, values, expression, type_="string"):
    """Values through one expression, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {type_}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


@settings(max_examples=15, deadline=None)
@given(NAMES)
def test_title_case_is_pythons(spark_module, names):
    got = column(spark_module, names, text.title_case("x"))
    assert got == [n.title() for n in names]


@settings(max_examples=15, deadline=None)
@given(NAMES)
def test_clean_name_is_pythons(spark_module, names):
    got = column(spark_module, names, text.clean_name("x"))
    assert got == [n.title().strip() for n in names]


@pytest.fixture(scope="module")
def spark_module(spark):
    return spark


def test_title_case_examples(spark):
    cases = {
        "o'brien-nagar": "O'Brien-Nagar",
        "y.s.r. 3rd": "Y.S.R. 3Rd",
        "jammu & kashmir": "Jammu & Kashmir",
        "  NORTH goa ": "  North Goa ",
        "": "",
    }
    assert column(spark, list(cases), text.title_case("x")) == list(cases.values())
    assert column(spark, [None], text.clean_name("x")) == [None]


def test_strip_covers_all_white_space():
    assert all(c.isspace() for c in text.STRIP_CHARS)
    every = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    assert sorted(text.STRIP_CHARS) == every


def test_dates(spark):
    cases = {
        "03-04-2025": date(2025, 4, 3),
        "3/4/2025": date(2025, 4, 3),
        "31.12.2024": date(2024, 12, 31),
        "2025-04-03": date(2025, 4, 3),
        "2025/4/3": date(2025, 4, 3),
        " 03-04-2025 ": date(2025, 4, 3),
        "03-04-2025 10:30": date(2025, 4, 3),
        "2025-04-03 10:30:00": date(2025, 4, 3),
        "03-04-25": date(2025, 4, 3),
        "3/4/69 08:15": date(1969, 4, 3),
        "3 Apr 2025": date(2025, 4, 3),
        "03-september-24": date(2024, 9, 3),
        "3 Apr, 2025 10:00": date(2025, 4, 3),
        "3 Abc 2025": None,
        "3 anf 2025": None,
        "2025-04-03T10:30:00Z": date(2025, 4, 3),
        "31-02-25": None,
        "31-02-2025": None,
        "13-13-2025": None,
        "not a date": None,
        "110001": None,
        "": None,
    }
    assert column(spark, list(cases), parse.day_first_date("x")) == list(cases.values())
    assert column(spark, [None], parse.day_first_date("x")) == [None]


def test_pin_codes(spark):
    cases = {
        "110001": 110001, "110001.0": 110001, "110001.9": 110001, " 400 ": 400, "1e5": 100000,
        "NA": 0, "": 0, "1d": 0, "NaN": 0, "Infinity": 0, "99999999999": 0, "-5": -5,
    }
    assert column(spark, list(cases), parse.pin_code("x")) == list(cases.values())
    assert column(spark, [None], parse.pin_code("x")) == [0]


def test_counts(spark):
    assert column(spark, ["12", "12.0", "x", None], parse.count_or_zero("x")) == [12, 12, 0, 0]


def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(2000).select(draws.standard_normal(7, F.col("id")).alias("z"), "id")
    one = {r.id: r.z for r in df.coalesce(1).collect()}
    many = {r.id: r.z for r in df.repartition(13).collect()}
    assert one == many
    values = list(one.values())
    mean = sum(values) / len(values)
    spread = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
    assert abs(mean) < 0.1 and abs(spread - 1) < 0.1


def test_jitter_range(spark):
    df = spark.range(3000).select(draws.jitter(F.col("id").cast("string")).alias("j"))
    low, high = df.agg(F.min("j"), F.max("j")).first()
    assert -0.15 <= low < -0.14 and 0.17 < high < 0.1834


def test_first_three(spark):
    df = spark.createDataFrame([(["1", "2"], 2), (["1", "2", "3"], 3), (["1", "2", "3"], 4)], "a array<string>, n int")
    got = [r[0] for r in df.select(text.first_three(F.col("a"), F.col("n"))).collect()]
    assert got == ["1, 2", "1, 2, 3", "1, 2, 3..."]


def test_colour_steps(spark):
    got = column(spark, [0.0, 0.0999, 0.1, 0.2999, 0.3, 1.0], scaling.rgba(F.col("x")), "double")
    low, mid, high = (list(c) for c in (scaling.LOW_RGBA, scaling.MID_RGBA, scaling.HIGH_RGBA))
    assert got == [low, low, mid, mid, high, high]


def test_number_texts(spark):
    assert column(spark, [1234567, 0], messages.thousands(F.col("x")), "bigint") == ["1,234,567", "0"]
    assert column(spark, [1.26, -3.0], messages.percent(F.col("x")), "double") == ["1.3%", "-3.0%"]
    assert column(spark, [0, 3], messages.risk_status(F.col("x")), "bigint") == ["✅ Healthy", "🚨 3 Issues"]


def test_growth_has_a_zero_guard(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 15.0)], "a double, b double")
    got = [r[0] for r in df.select(messages.growth_percent(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 50.0]

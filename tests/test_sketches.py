"""Sketches against exact results, within their stated errors."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from wardwise.operators import forecast as fc, quantiles, reach
from wardwise.sources import tables

FACTS = "date date, state string, district string, pincode int, adult_enrolments bigint"


def daily(spark, states=3, days=12):
    start = datetime.date(2025, 1, 1)
    return spark.createDataFrame(
        [(f"S{s}", start + datetime.timedelta(d), 100 + 13 * ((d * (s + 3)) % 7)) for s in range(states) for d in range(days)],
        "state string, date date, adult_enrolments bigint",
    )


@pytest.mark.parametrize("paths, size", [(150, 256), (4000, 64)])
def test_bands_keep_the_rank_error(spark, paths, size):
    df, keys = daily(spark), ["state"]
    got = fc.quantile_bands(df, keys, horizon=4, paths=paths, size=size).collect()
    assert len(got) == 12
    values = fc.path_values(fc.series_state(df, keys), keys, paths, 4, 0.0, "Linear", fc.DEFAULT_SEED)
    exact = {}
    for r in values.collect():
        exact.setdefault((r.state, r.date), []).append(r.value)
    allowed = 0 if paths < size else 2.3 / size**0.9
    for r in got:
        path = sorted(exact[r.state, r.date])
        assert len(path) == paths
        for rank, value in ((0.1, r.lower), (0.5, r.middle), (0.9, r.upper)):
            if not allowed:
                assert value == path[math.ceil(rank * paths) - 1]
            else:
                below = sum(x < value for x in path) / paths
                assert abs(below - rank) <= allowed + 1 / paths


def test_bands_widen_and_stay_above_zero(spark):
    rows = fc.quantile_bands(daily(spark, 1), ["state"], horizon=20, volatility=0.05).orderBy("date").collect()
    assert all(0 <= r.lower <= r.middle <= r.upper for r in rows)
    assert rows[-1].upper - rows[-1].lower > rows[0].upper - rows[0].lower
    assert fc.quantile_bands(daily(spark, 1).limit(0), ["state"]).collect() == []


@pytest.fixture(scope="module")
def facts(spark):
    n = F.col("id")
    day = F.when(n % 997 != 0, F.date_add(F.lit("2025-01-20").cast("date"), (n % 50).cast("int")))
    return spark.range(60_000).select(
        day.alias("date"), F.when(n % 101 != 0, F.concat(F.lit("S"), n % 4)).alias("state"),
        F.when(n % 103 != 0, F.concat(F.lit("D"), (n * n) % 30011)).alias("district"),
        ((n * 7) % 20_000 - 10).cast("int").alias("pincode"), (n % 5).alias("adult_enrolments"),
    )


def test_reach_over_any_range(spark, facts, tmp_path):
    path, error = str(tmp_path / "cells"), 3 * 1.04 / math.sqrt(2**reach.PRECISION)
    half = F.col("date") < "2025-02-10"
    reach.write_cells(reach.reach_cells(facts.where(half)), path)
    reach.write_cells(reach.reach_cells(facts.where(~half | F.col("date").isNull())), path)  # arrives later
    for start, end in (("2025-01-25", "2025-02-20"), ("2025-02-01", "2025-02-01"), (None, None), ("2025-02-05", "2025-03-30")):
        got = reach.reach(reach.read_cells(spark, path, start, end)).first()
        rows = facts if start is None else facts.where(F.col("date").between(start, end))
        want = rows.agg(
            F.sum("adult_enrolments"), F.count_distinct("state"), F.count_distinct("district"),
            F.count_distinct(F.when(F.col("pincode") > 0, F.col("pincode"))),
        ).first()
        assert (got[0], got[1]) == (want[0], want[1])
        assert abs(got[2] - want[2]) <= error * want[2] and abs(got[3] - want[3]) <= error * want[3]


def test_reach_reads_only_the_months_asked_for(spark, facts, tmp_path):
    path = str(tmp_path / "cells")
    reach.write_cells(reach.reach_cells(facts), path)
    plan = reach.read_cells(spark, path, "2025-02-02", "2025-02-09")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    empty = reach.reach(reach.read_cells(spark, path, "1999-01-01", "1999-01-02")).first()
    assert tuple(empty) == (0, 0, 0, 0)


@pytest.mark.parametrize("share", [0.0, 0.013, 0.5, 0.95, 0.99999, 1.0])
def test_exact_quantiles(spark, share):
    """Equal to the library's percentile, over many values, over ties, with NULL and NaN."""
    n = F.col("id")
    df = spark.range(30_000).select(
        F.when(n % 50 != 0, F.pow(n * 7919 % 30_011, F.lit(1.5))).alias("spread"),
        F.when(n % 3 == 0, 5).otherwise(n % 4).alias("tied"),
        F.when(n % 7 == 0, float("nan")).otherwise(n.cast("double")).alias("holes"),
    )
    want = df.select(
        F.percentile("spread", share), F.percentile("tied", share), F.percentile(F.when(~F.isnan("holes"), F.col("holes")), share)
    ).first()
    got = [quantiles.exact_quantile(df, c, share, few=200) for c in df.columns]
    assert got == pytest.approx(list(want), rel=1e-12)


def test_exact_quantile_of_nothing(spark):
    assert quantiles.exact_quantile(spark.range(5).selectExpr("cast(null as double) x"), "x", 0.5) is None
    assert quantiles.exact_quantile(spark.range(1), "id", 0.5) == 0.0


def test_only_touched_months_are_made_anew(spark, tmp_path):
    """New rows change the cells of their months; other months' files stay, and are not read."""
    table, cells = str(tmp_path / "table"), str(tmp_path / "cells")

    def rows(*values):
        return spark.createDataFrame(
            [(d and datetime.date.fromisoformat(d), s, s + "d", p, m) for d, s, p, m in values], FACTS
        )

    def files(folder, month):
        return {f.name: f.stat().st_mtime_ns for f in (tmp_path / folder / f"month={month}").glob("*.parquet")}

    def shown():
        got = reach.reach(reach.read_cells(spark, cells), ["date", "state"])
        return sorted(map(str, got.collect()))

    assert reach.load_new(rows(("2025-01-03", "a", 1, 5), ("2025-02-03", "a", 2, 7), (None, "b", 3, 1)), table, cells) == [0, 202501, 202502]
    before = [files(f, m) for f in ("table", "cells") for m in (0, 202501)]
    assert reach.load_new(rows(("2025-02-03", "a", 9, 10), ("2025-02-04", "b", 2, 1), ("2025-03-01", "a", 1, 1)), table, cells) == [202502, 202503]
    assert before == [files(f, m) for f in ("table", "cells") for m in (0, 202501)]
    whole = reach.reach_cells(tables.read_canonical(spark, table, "enrol"))
    assert shown() == sorted(map(str, reach.reach(whole, ["date", "state"]).collect()))
    february = tables.read_months(spark, table, "enrol", [202502])
    assert february.count() == 3
    assert {f.split("month=")[1][:6] for f in february.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]} == {"202502"}
    again = shown()
    reach.refresh_cells(spark, table, cells, [202502])
    assert shown() == again
    assert reach.load_new(rows(), table, cells) == [] and shown() == again

import pytest
from pyspark.sql import functions as F

from querybook.views import Views
from wardwise.operators import aggregates as agg, bitmaps


@pytest.fixture
def facts(rows):
    data = [(d, p) for d, ps in {
        "a": [1, 2, 32768, 32769, 855117, 2**31 - 1], "b": [32769, 7, 7], "c": [855117, 5], "d": [6], "e": [0, -4],
    }.items() for p in ps] + [(None, 5), ("c", None)]
    return rows("district string, pincode int", *data)


def test_sets_by_bits(facts):
    maps = bitmaps.pin_bitmaps(facts)
    got = {r.district: r.n_pins for r in bitmaps.pin_counts(maps).collect()}
    assert got == {r.district: r.n for r in agg.pin_pairs(facts).groupBy("district").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 6, "b": 2, "c": 2, "d": 1}


def test_overlap_equals_the_join(facts, rows):
    pairs = rows("x string, y string, other int", *[(x, y, 1) for x in "abcde" for y in "abcde" if x != y], ("a", "b", 2))
    got = bitmaps.pin_overlap(pairs, bitmaps.pin_bitmaps(facts), "x", "y")
    want = agg.pin_overlap(pairs, agg.pin_pairs(facts), "x", "y")
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert {(r.x, r.y): r.shared for r in got.where("shared > 0").collect()} == {
        ("a", "b"): 1, ("b", "a"): 1, ("a", "c"): 1, ("c", "a"): 1}


def test_union_over_days(facts):
    daily = bitmaps.pin_bitmaps(facts.withColumn("day", F.col("pincode") % 3), ("district", "day"))
    whole = {(r.district, r.bucket): bytes(r.bits) for r in bitmaps.pin_bitmaps(facts).collect()}
    assert {(r.district, r.bucket): bytes(r.bits) for r in bitmaps.united(daily).collect()} == whole


def test_no_rows(facts):
    none = bitmaps.pin_bitmaps(facts.limit(0))
    assert none.isEmpty() and bitmaps.pin_counts(none).isEmpty()


def shuffled(df) -> int:
    """Bytes that the run of ``df`` wrote for shuffles."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name in ("ShuffleQueryStageExec", "ResultQueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleBytesWritten").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_bitmaps_move_less_than_rows(spark):
    enrol = Views(spark, "/root/testdata/sf0.01").enrol().select("district", "pincode").repartition(8).checkpoint()
    by_rows = agg.pin_pairs(enrol).groupBy("district").agg(F.count("*").alias("n_pins"))
    by_bits = bitmaps.pin_counts(bitmaps.pin_bitmaps(enrol))
    assert sorted(map(tuple, by_rows.collect())) == sorted(map(tuple, by_bits.collect()))
    rows, bits = shuffled(by_rows), shuffled(by_bits)
    print("bytes shuffled by rows, by bits:", rows, bits)
    assert 0 < bits < rows

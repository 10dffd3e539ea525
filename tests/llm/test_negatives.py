import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wardwise.llm import negatives
from wardwise.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, id string, score string, g0 string, ids string"


def plainly(made, step=10, k=5, few=5, low=80, high=100):
    valid = {(i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, label, *_ in made
             if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    valid = sorted(r for r in valid if sum(x * x for x in r[2]) < 2**56)
    out = []
    for a in (r for r in valid if r[0] % step == 0):
        scored = [(-sum(x * y for x, y in zip(a[2], r[2])), *r[:2]) for r in valid if r != a and len(r[2]) == len(a[2])]
        for s, i, _ in sorted(x for x in scored if x[2] == a[1])[:k]:
            hard = sorted(x for x in scored if x[2] != a[1] and low * -s <= 100 * -x[0] <= high * -s)
            out += [(a[0], i, n + 1, x[1], -s, -x[0]) for n, x in enumerate(hard[:few])]
    return sorted(out)


def found(df, **settings):
    return sorted(map(tuple, negatives.mined(df, F.col("vec_id") % 10 == 0, **settings).collect()))


@pytest.fixture
def made():
    draw = np.random.default_rng(5)
    centers = draw.normal(size=(6, 7))
    out = [(i, [float(x) for x in centers[i % 6] * draw.choice([0.5, 1, 3]) + 0.3 * draw.normal(size=7)], int(draw.integers(4)), 1, *"abcd")
           for i in range(400)]
    same = [0.5, 0.25, -1.0, 2.0, 0.0, 0.125, 1.0]
    out += [(1000 + i, same, i % 2, 1, *"abcd") for i in range(200)] + [(1000, same, 0, 1, *"abcd")] * 30
    out += [(1000, [-x for x in same], 0, 1, *"abcd"), (1000, same, 1, 1, *"abcd"), (1010, [0.0] * 7, 0, 1, *"abcd"), (1021, [0.0] * 7, 1, 1, *"abcd")]
    out += [(2000, None, 0, 1, *"abcd"), (2010, [1.0, None] * 3 + [1.0], 0, 1, *"abcd"), (2020, [float("nan")] * 7, 0, 1, *"abcd"),
            (2030, [float("inf")] * 7, 0, 1, *"abcd"), (2040, same, None, 1, *"abcd"), (None, same, 0, 1, *"abcd"), (2050, [3e38] * 7, 0, 1, *"abcd")]
    out += [(3000 + i, [], i % 2, 1, *"abcd") for i in range(14)] + [(4000 + i, [1.0], i % 3, 1, *"abcd") for i in range(14)]
    return out + [(5000 + i, [400_000.0 * (i + 1), -300_000.0], i % 2, 1, *"abcd") for i in range(12)]


def test_against_all_pairs(rows, made, monkeypatch):
    df = rows(SCHEMA, *made)
    want = plainly(made)
    assert found(df) == want and len(want) > 500
    monkeypatch.setattr(negatives, "SHARD", 37)
    monkeypatch.setattr(negatives, "BLOCK", 5)
    monkeypatch.setattr(negatives, "TRIED", 8)
    assert found(df) == want
    assert found(df, k_positive=2, k_negative=9, low=-50, high=130) == plainly(made, k=2, few=9, low=-50, high=130)


def test_bounds_hold_and_leave_out():
    draw = np.random.default_rng(8)
    centers = draw.normal(size=(40, 24))
    vectors = np.floor(256 * (centers[draw.integers(40, size=4000)] + 0.1 * draw.normal(size=(4000, 24)))).astype("i8")
    vectors[:50], vectors[50:90] = vectors[100], 0
    angles = negatives.angles_of(vectors)
    shard = negatives.Shard(vectors, angles, np.arange(4000))
    scored = 0
    for q in range(0, 4000, 97):
        exact = vectors @ vectors[q]
        least, most = shard.bounds(np.arange(4000), angles[q], shard.length[q])
        assert (least <= exact).all() and (exact <= most).all()
        places, scores, n = shard.nearest(vectors[q], angles[q], shard.length[q], 6)
        scored += n
        assert list(zip(-scores, places)) == sorted(zip(-exact, range(4000)))[:6]
    assert scored < 0.3 * 4000 * len(range(0, 4000, 97))  # vectors in groups: most are never scored


def test_empty(rows, made):
    df = rows(SCHEMA, *made)
    assert found(df.limit(0)) == []
    assert found(df.where("vec_id = 4000")) == []
    assert found(df.where("label = 0")) == []


def test_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mined(table(spark, folder, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(negatives.ORACLE).fetchall())

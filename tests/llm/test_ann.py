import numpy as np
from pyspark.sql import functions as F

from wardwise.llm import ann
from wardwise.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"


def exact(made, k=20, step=20):
    """By all inner products in double precision."""
    ok = [(i, np.array(v, "f4").astype("f8")) for i, v in {(i, tuple(v)) for i, v, *_ in made
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}]
    out = {}
    for q, v in ok:
        if q % step == 0:
            scored = sorted((-float((w * v).sum()), i) for i, w in ok if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(result):
    out = {}
    for r in result.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got, want = found(ann.nearest(vectors, F.col("vec_id") % 20 == 0)), exact(rows)
    assert set(got) == set(want) and all(len(got[q]) == 20 for q in got)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    scores = {(q, i): s for q, found in want.items() for i, s in found}
    assert all(abs(s - scores[q, i]) < 1e-12 for q in got for i, s in got[q] if (q, i) in scores)


def test_small_cases_are_exact(rows, monkeypatch):
    draw = np.random.default_rng(3)
    made = [(i, [float(x) for x in draw.normal(size=5) * draw.choice([0.1, 1, 7])], 1, 2, "z") for i in range(200)]
    same = [3.0, 1.0, -2.0, 0.5, 9.0]
    made += [(300 + i, same, 1, 2, "z") for i in range(90)] + [(300, same, 1, 2, "z")] * 40
    made += [(500, None, 0, 0, ""), (520, [0.0] * 5, 0, 0, ""), (540, [], 0, 0, ""), (560, [1.0, None, 1.0, 1.0, 1.0], 0, 0, ""),
             (580, [float("nan")] * 5, 0, 0, ""), (600, [float("inf")] * 5, 0, 0, ""), (None, same, 0, 0, ""),
             (620, [1.0, 2.0], 0, 0, ""), (640, [2.0, 1.0], 0, 0, ""), (660, [1.0, 2.0, 3.0], 0, 0, "")]
    df = rows(SCHEMA, *made)
    monkeypatch.setattr(ann, "VERIFIED", 1.0)  # all are verified: exact
    got, want = found(ann.nearest(df, F.col("vec_id") % 20 == 0)), exact(made)
    want.pop(660)
    assert got == {q: [(i, s) for i, s in v] for q, v in want.items()}
    monkeypatch.setattr(ann, "SHARD", 50)
    monkeypatch.setattr(ann, "BLOCK", 7)
    assert found(ann.nearest(df, F.col("vec_id") % 20 == 0)) == got


def test_empty(rows):
    df = rows(SCHEMA, (20, [1.0, 2.0], 1, 1, ""))
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.nearest(df, F.col("vec_id") % 20 == 0).collect() == []

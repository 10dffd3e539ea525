import math
import re
from collections import Counter

from pyspark.sql import functions as F

from wardwise.llm import bm25
from wardwise.llm.common import table


def plainly(made, k=10, step=5):
    """Every query against every row."""
    docs = [(i, Counter(re.findall(r"\w+", (t or "").lower()))) for i, t in made if i is not None]
    n, mean = len(docs), sum(d.total() for _, d in docs) / max(len(docs), 1)
    df = Counter(w for _, d in docs for w in d)
    asked = {}
    for i, d in docs:
        if i % step == 0:
            asked.setdefault(i, set()).update(d)
    out = {}
    for q, words in asked.items():
        scored = []
        for i, d in docs:
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * d[w] * 2.2 / (d[w] + 1.2 * (0.25 + 0.75 * d.total() / mean))
                    for w in words & d.keys())
            if i != q and s > 0:
                scored.append((-round(s, 9), i))
        if scored:
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def found(result):
    out = {}
    for r in result.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 9)))
        assert r.rank == len(out[r.query_id])
    return out


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = found(bm25.top_k(docs, F.col("doc_id") % 5 == 0))
    assert got == plainly([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows_in_small_blocks(rows, monkeypatch):
    monkeypatch.setattr(bm25, "QUERIES", 3)
    monkeypatch.setattr(bm25, "WIDTH", 4)
    monkeypatch.setattr(bm25, "DENSE", 6)
    made = [(i, f"the {'cat dog'.split()[i % 2]} w{i % 7} w{i % 11} x{i}") for i in range(60)]
    made += [(100, None), (105, ""), (110, "!!"), (115, "only here"), (None, "the cat"), (1, "the dog w1 w1 x1"), (5, "the cat x5")]
    made += [(200 + i, "the same cat text") for i in range(40)] + [(205, "the same cat text")] + [(300, "the cat " * 30_000)]
    df = rows("doc_id long, text string, length int, terms string, id int", *[(*m, 1, "x", 2) for m in made])
    assert found(bm25.top_k(df, F.col("doc_id") % 5 == 0)) == plainly(made)


def test_short_queries_beside_a_very_long_one(rows):
    made = [(i, f"the w{i % 20}") for i in range(100, 140)] + [(5, "the"), (10, "w3"), (15, "w7 alone"), (20, "alone")]
    made += [(25, " ".join(f"w{i}" for i in range(20_000)))]
    assert found(bm25.top_k(rows("doc_id long, text string", *made), F.col("doc_id") % 5 == 0)) == plainly(made)


def test_empty(rows):
    df = rows("doc_id long, text string", (5, "a"))
    assert bm25.top_k(df.limit(0), F.col("doc_id") % 5 == 0).collect() == []
    assert bm25.top_k(df, F.col("doc_id") % 5 == 0).collect() == []
    assert bm25.top_k(df, F.lit(False)).collect() == []


def test_few_candidates_of_a_first_shard_are_scored(spark, monkeypatch):
    """Only sums that can be among the best are made exact, from the first shard on."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    made = bm25.bags(docs).collect()
    kinds = [bm25.pa.int64(), bm25.pa.int64(), bm25.pa.binary(), bm25.pa.binary()]
    names = ["id", "length", "terms", "counts"]
    batch = bm25.pa.RecordBatch.from_arrays([bm25.pa.array([r[n] for r in made], t) for n, t in zip(names, kinds)], names)
    terms, _ = bm25._joined(batch.column("terms"), "i8")
    df = dict(zip(*(x.tolist() for x in bm25.np.unique(terms, return_counts=True))))
    asked = [(r.id, t, df[t]) for r in made if r.id % 5 == 0 for t in bm25.np.frombuffer(r.terms, "i8").tolist()]
    block = bm25.block_of(bm25.pa.table(dict(zip(("id", "term", "df"), map(list, zip(*asked))))), len(made), 100.0)
    calls, exact = [], bm25.Shard.exact
    monkeypatch.setattr(bm25.Shard, "exact", lambda *a: calls.append(1) or exact(*a))
    best = bm25.Best(block, 10)
    best.search(bm25.Shard(block, batch))
    assert len(calls) < 12 * len(block.ids)
    assert all(q not in [i for _, i in held] for q, held in zip(block.ids.tolist(), best.found))


def test_rows_sent_do_not_grow_with_the_tasks(spark, rows, monkeypatch):
    """Tasks begin where the waves before have ended, also among equal texts; the results are the same."""
    made = [(i, f"the w{i % 7} w{i % 50} w{i % 83} w{i % 211} {'x ' * (i % 13)}") for i in range(2000)]
    made += [(i, "the w1 w2 same") for i in range(2000, 2600)] + [(i, f"only{i}") for i in range(2600, 2630)]
    df = rows("doc_id long, text string", *made).repartition(40)
    at_once = bm25.top_k(df, F.col("doc_id") % 20 == 0).collect()
    monkeypatch.setattr(bm25, "FIRST", 64, raising=False)
    monkeypatch.setattr(bm25, "QUERIES", 70)
    sent, searching = spark.sparkContext.accumulator(0), bm25._searching

    def counted(*given):
        run = searching(*given)

        def both(batches):
            for batch in run(batches):
                sent.add(batch.num_rows)
                yield batch

        return both

    monkeypatch.setattr(bm25, "_searching", counted)
    sizes = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in sizes}
    for name, value in sizes.items():
        spark.conf.set(name, value)
    try:
        got = bm25.top_k(df, F.col("doc_id") % 20 == 0).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sorted(got) == sorted(at_once)
    asked = sum(i % 20 == 0 for i, _ in made)
    assert 10 * (asked - 2) <= sent.value < 150 * asked, sent.value / asked


def _bagged(made):
    """A batch as ``bags`` makes it, of terms given by number."""
    pa, np = bm25.pa, bm25.np
    terms = [np.unique(words, return_counts=True) for _, words in made]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _ in made], pa.int64()),
            pa.array([len(words) for _, words in made], pa.int64()),
            pa.array([t.astype("i8").tobytes() for t, _ in terms], pa.binary()),
            pa.array([c.astype("i4").tobytes() for _, c in terms], pa.binary()),
        ],
        ["id", "length", "terms", "counts"],
    )


def test_queries_leave_out_shards_of_other_languages(monkeypatch):
    """Documents of one language lie in shards that queries of the other do not search; the results are the same."""
    rng = bm25.np.random.default_rng(3)
    made = [(i, bm25.np.append(rng.integers(0, 200, 30) + 1000 * (i % 2), [9000] + [8000 + i] * (i == 3) * 300)) for i in range(600)]
    batch = _bagged(made)
    df = {}
    for _, words in made:
        for w in set(words.tolist()):
            df[w] = df.get(w, 0) + 1
    asked = [(i, w, df[w]) for i, words in made if i % 5 == 0 for w in set(words.tolist())]
    block = bm25.block_of(bm25.pa.table(dict(zip(("id", "term", "df"), map(list, zip(*asked))))), len(made), 31.0)
    plain = bm25.Best(block, 10)
    plain.search(bm25.Shard(block, batch))
    ends = [held[-1] for held in plain.found]
    searched, rare = [], bm25.Shard.rare
    monkeypatch.setattr(bm25.Shard, "rare", lambda shard, places, query, queries: searched.append(queries * shard.n) or rare(shard, places, query, queries))
    monkeypatch.setattr(bm25, "SHARD", 4000)
    best, last = bm25.Best(block, 10), bm25.Best(block, 10, ends)
    shards = [bm25.Shard(block, made) for written in bm25._inverting(iter([batch])) for made in bm25.Inverted.read(written)]
    assert sorted(i for s in shards for i in s.ids.tolist()) == [i for i, _ in made] and len(shards) > 3
    for shard in shards:
        best.search(shard)
    assert best.found == plain.found
    searched.clear()
    for shard in shards:
        last.search(shard)
    assert sum(searched) <= 0.6 * len(made) * len(block.ids)
    assert [held + [end] for held, end in zip(last.found, ends)] == plain.found


def test_documents_are_inverted_once_for_all_blocks(spark, rows, monkeypatch):
    made = [(i, f"the w{i % 7} w{i % 50} w{i % 83} {'x ' * (i % 13)}") for i in range(900)]
    df = rows("doc_id long, text string", *made).repartition(6)
    at_once = bm25.top_k(df, F.col("doc_id") % 20 == 0).collect()
    monkeypatch.setattr(bm25, "QUERIES", 9)
    monkeypatch.setattr(bm25, "FIRST", 64)
    inverted, inverting = spark.sparkContext.accumulator(0), bm25._inverting

    def counted(batches):
        for batch in inverting(batches):
            inverted.add(sum(len(shard.ids) for shard in bm25.Inverted.read(batch)))
            yield batch

    monkeypatch.setattr(bm25, "_inverting", counted)
    assert sorted(bm25.top_k(df, F.col("doc_id") % 20 == 0).collect()) == sorted(at_once)
    assert inverted.value == len(made)


def test_words_of_plain_texts():
    for text in ("".join(map(chr, range(128))), "a_b  C1\x1fd-e\n", "Ünï cödé_1 x", "", "İ ſ K"):
        assert bm25.words(text) == re.findall(r"\w+", text.lower())

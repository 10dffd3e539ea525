"""The pipeline, stage by stage, against plain versions over all rows."""

import zlib

import numpy as np
import public_tokenizers as P
from test_pii import plainly as plain_pii
from test_simhash import plain_components, plain_fingerprint
from test_suffix import plainly as plain_repeats
from tokenizers import Tokenizer

import corpus_pipeline
from wardwise.llm import pii, suffix, toxicity
from wardwise.llm.common import table

SMALL = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_stages(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash", "suffix_dedup", "pii", "packing"]

    def step(name):
        nonlocal docs
        stages[name](spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        return docs.collect()

    model = toxicity.learn(docs, table(spark, SMALL, "labels"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    rows = step("toxicity")
    kept = {i: t for i, t in kept.items() if scores[i] < 0.5}
    assert {r.doc_id: r.text for r in rows} == kept and docs.columns == columns

    ids = list(kept)
    groups = plain_components([plain_fingerprint(kept[i]) for i in ids])
    kept = {i: kept[i] for k, i in enumerate(ids) if i == min(ids[j] for j in groups[k])}
    assert {r.doc_id: r.text for r in step("simhash")} == kept and docs.columns == columns

    cut = plain_repeats(kept.values(), corpus_pipeline.PASSAGE)
    kept = {i: suffix._kept(t, [{"start": a, "end": b} for a, b in runs])[0].decode("utf-8", "ignore")
            for i, (t, runs) in zip(kept, cut)}
    rows = step("suffix_dedup")
    assert {r.doc_id: r.text for r in rows} == kept and docs.columns == columns
    assert all(r.n_chars == len(r.text) for r in rows)

    rows = step("pii")
    assert set(kept) == {r.doc_id for r in rows} and docs.columns == columns
    for r in rows:
        base = plain_pii(kept[r.doc_id])
        assert all(f"<{kind}>" in r.text for kind in {k for k, *_ in base} - {"ip", "card", "phone"})
        assert pii.base_spans(r.text) == [] and r.n_chars == len(r.text)
        if not base and "@" not in r.text and not any(c.isdigit() for c in kept[r.doc_id]):
            assert r.text == kept[r.doc_id]
    kept = {r.doc_id: r.text for r in rows}

    rows, held = step("packing"), {}
    ids = {i: LIBRARY.encode(t, add_special_tokens=False).ids + [1] for i, t in kept.items()}
    assert len(rows) == sum(-(-len(v) // 4096) for v in ids.values())
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and r.length == len(part)
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) <= -(-sum(map(len, ids.values())) // 4096) + 2


def test_run(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_odd_documents(spark, rows, tmp_path):
    """Null ids and texts, repeated rows, clashing columns, an empty table: every stage keeps what is clean."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, _rejected string"
    shared = " ".join(f"word{i}" for i in range(60))
    made = [(i, f"document number {i} {chr(97 + i) * 9} " * 3 + (shared if i < 2 else ""), "en", "s", 0, 0.25, 7, "mine") for i in range(12)]
    made += [(None, None, None, None, None, 0.25, 7, "mine"), (50, None, "en", "s", 0, 0.25, 7, "mine"), (51, "", "en", "s", 0, 0.25, 7, "mine")]
    for given in (made, []):
        docs = rows(schema, *given)
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SMALL).write.parquet(str(tmp_path / f"{len(given)}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{len(given)}-{name}"))
            if name != "packing":
                assert docs.columns == [c.split()[0] for c in schema.split(", ")]
                assert {(r.score, r.predicted, r._rejected) for r in docs.collect()} == ({(0.25, 7, "mine")} if given else set())
            if name == "suffix_dedup" and given:
                assert all(shared not in (r.text or "") for r in docs.collect())
                assert len({r.doc_id for r in docs.collect()} & set(range(12))) == 12
        assert bool(docs.collect()) == bool(given)

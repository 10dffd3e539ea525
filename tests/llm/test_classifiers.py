import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from wardwise.llm import language, toxicity
from wardwise.llm.common import table

MEDIUM = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = table(spark, MEDIUM, "documents")
    got = {r.doc_id: r for r in language.predicted(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    out = [r for r in rows if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in out) and sum(r.held_out for r in got.values()) == len(out)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_held_out_quality(spark):
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows)
    hits = sum(r.predicted == 1 == r.toxic for r in rows)
    assert 2 * hits / (sum(r.predicted for r in rows) + sum(r.toxic for r in rows)) >= 0.6  # some dozens of samples
    assert sum(r.predicted == 1 and r.toxic == 0 for r in rows) <= 0.03 * len(rows)


DOCS = "doc_id long, text string, lang string, score string, predicted string, rejected string, _id long"


@pytest.fixture
def odd(rows):
    en, de = "the cat and the dog went out to the house", "der Hund und die Katze gehen aus dem Haus"
    return rows(
        DOCS, (1, en, "en", "a", "b", "c", 5), (1, en, "en", "a", "b", "c", 5), (3, de, "de", "a", "b", "c", 5),
        (4, None, "de", "a", "b", "c", 5), (5, "", "en", "a", "b", "c", 5), (6, "12 34 !", None, "a", "b", "c", 5),
        (None, de, None, "a", "b", "c", 5), (8, "x" * 300_000, None, "a", "b", "c", 5),
    )


def test_language_odd_rows(odd):
    model = language.learn(odd)
    got = language.predict(odd, model).collect()
    assert len(got) == 8
    by_text = {r.text: r for r in got}
    assert {by_text[t].lang_pred for t in (None, "", "12 34 !")} == {"und"}
    assert [r.lang_pred for r in got if r.doc_id is None] == ["de"]
    assert language.predict(odd.limit(0), model).collect() == []
    assert language.learn(odd.limit(0)) is None
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}


def test_toxicity_odd_rows(odd, rows):
    labels = rows("doc_id long, quality int, toxic int", *[(i, 1, i % 2) for i in range(1, 9)], (1, 0, 0), (2, 0, None), (None, 1, 1))
    assert toxicity.learn(odd, labels) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    bad, fine = "you utter nitwit and dolt", "a calm walk along the river"
    model = toxicity.fit([(sorted(toxicity.windows(f"{bad} {i}")), 1) for i in range(40)]
                         + [(sorted(toxicity.windows(f"{fine} {i}")), 0) for i in range(80)], 2.0)
    got = toxicity.score(odd.unionByName(odd.limit(1).withColumn("text", F.lit(bad))), model).collect()
    assert len(got) == 9
    assert [r.predicted for r in got if r.text == bad] == [1]
    assert all(r.predicted == 0 for r in got if r.text != bad)
    assert toxicity.score(odd.limit(0), model).collect() == []


def test_learning_keeps_to_its_folds(rows):
    """Rows of the held-out fold do not change the model."""
    texts = [(i, f"wort haus baum {i}" if i % 2 else f"word house tree {i}", "de" if i % 2 else "en") for i in range(40)]
    a = rows("doc_id long, text string, lang string", *texts)
    b = rows("doc_id long, text string, lang string", *[
        (i, t if zlib.crc32(str(i).encode()) % 4 != 2 else "zzz", l if zlib.crc32(str(i).encode()) % 4 != 2 else "xx") for i, t, l in texts])
    one, two = language.learn(a), language.learn(b)
    assert (one.centroids == two.centroids).all() and one.languages == two.languages


def test_language_by_all_cosines(spark):
    """Every cosine of every text, worked out plainly; the nearest centroid of any language decides."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = language.learn(docs)
    idf, centroids = model.idf.astype("f8"), model.centroids.astype("f8")
    for r in language.predict(docs, model).collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert r.lang_pred == "und"
            continue
        letters = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in r.text.lower().encode("utf-8", "replace"))
        padded, found = b" " + letters + b"  ", {}
        for at in range(len(padded) - 2):
            code = sum(c * p for c, p in zip(padded[at : at + 3], (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))) % 2**32
            code = (code ^ code >> 15) * 0x2C1B3C6D % 2**32 >> 19
            found[code] = found.get(code, 0) + 1
        weights = {c: np.log1p(n) * idf[c] for c, n in found.items()}
        norm = sum(w * w for w in weights.values()) ** 0.5
        near = [sum(w * center[c] for c, w in weights.items()) / norm for center in centroids]
        assert abs(max(near) - r.score) < 1e-4
        assert max(n for n, name in zip(near, model.languages) if name == r.lang_pred) > max(near) - 1e-4


def test_toxicity_window_by_window(spark):
    """Scores from the library called for every window of every text, without memory of earlier ones."""
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    model = toxicity.learn(docs, labels)

    def length(window, content):
        parameters = zstandard.ZstdCompressionParameters.from_level(
            12, source_size=64, dict_size=len(model.ordinary) + len(model.toxic), min_match=4,
            write_content_size=False, write_checksum=False, write_dict_id=False)
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=parameters)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=parameters).compress(window))

    rows = sorted(toxicity.score(docs, model).collect(), key=lambda r: len(r.text or ""))[:40]
    costs = {}
    for r in rows:
        found = set()
        for run in re.findall(r"\w+", (r.text or "").lower()):
            found |= {run} if len(run) <= 32 else {run[i : i + 6] for i in range(len(run) - 5)}
        total = 0.0
        for w in found:
            window = (" " + w).encode() * 5 + b" "
            if w not in costs:
                costs[w] = length(window, model.ordinary + model.toxic), length(window, model.ordinary)
            toxic, plain = costs[w]
            total += model.evidence[min(toxic, 31) * 16 + min(max(plain - toxic, -4), 11) + 4]
        strength = total / len(found) ** 0.5 if found else 0.0
        want = 1 / (1 + np.exp(min(model.slope * (model.threshold - strength), 60.0)))
        assert abs(want - r.score) < 1e-9 and r.predicted == (r.score >= 0.5)


def test_toxicity_without_blanks():
    """Insults inside runs without blanks are learnt from such runs, at any place in them."""
    rng = np.random.default_rng(3)

    def glued(extra=""):
        letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 120))
        cut = int(rng.integers(5, 100))
        return letters[:cut] + extra + letters[cut:]

    def found(*texts):
        return sorted(set().union(*map(toxicity.windows, texts)))

    samples = [(found(glued("utternitwit")), 1) for _ in range(60)] + [(found(glued()), 0) for _ in range(120)]
    model = toxicity.fit(samples, 2.0)
    cells, evidence = toxicity.Cells(model.ordinary, model.toxic), np.array(model.evidence)

    def strength(text):
        return toxicity._strength(cells.histogram(sorted(toxicity.windows(text)))[None], evidence)[0]

    assert sum(strength(glued("utternitwit")) >= model.threshold for _ in range(50)) >= 45
    assert sum(strength(glued()) >= model.threshold for _ in range(50)) <= 5

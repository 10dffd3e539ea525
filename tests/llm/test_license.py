import math
import random
import re

import duckdb
import pytest

from wardwise.llm import license
from wardwise.llm.common import table

SCHEMA = "doc_id long, text string, words string, h0 string, h1 string, score string, labels string, _key string"


def plainly(text, templates=license.TEMPLATES, threshold=license.THRESHOLD):
    """Every block against every template, all of it counted."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, base, labels, best = [], set(), set(), 0.0
    for phrase, label in license.PHRASES.items():
        wanted = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
        places += found
        base |= {label} if found else set()
    for label, written in templates:
        wanted, n = set(written.split()), len(written.split())
        width = max(license.LEAST_WIDTH, 2 ** math.ceil(math.log2(n)))
        for start in range(0, max(len(words) - width, 1), width):
            shared = len(wanted & set(words[start : start + 2 * width]))
            if shared >= math.ceil(threshold * len(wanted)):
                labels.add(label)
                best = max(best, shared / len(wanted))
    places.sort()
    ends = (places[0], places[-1]) if places else (None, None)
    return (len(words), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else best)


def texts():
    draw = random.Random(11)
    vocabulary = sorted({w for _, t in license.TEMPLATES for w in t.split()})
    made = [None, "", " ", "...", "mit", "Under the MIT License", "under the mit license " * 3, "été under the MIT  license-", "CC BY-NC",
            "under the mit\x00license apache\nlicense version 2", "cc by cc by nc", "under the mit licence", "K under the mit license"]
    for _ in range(150):
        words = []
        for _ in range(draw.randint(0, 5)):
            words += [draw.choice(["Lorem", "the", "of", "x9", "ß", "this"]) for _ in range(draw.choice([0, 1, 5, 40, 130]))]
            template = draw.choice(license.TEMPLATES)[1].split()
            words += [w for w in template if draw.random() > draw.choice([0, 0.05, 0.15, 0.3])]
            words += draw.choices(vocabulary, k=draw.choice([0, 0, 30]))
            if draw.random() < 0.3:
                draw.shuffle(words)
        made.append(draw.choice([" ", "\n", ", "]).join(words))
    return made + ["a " * 60_000 + "released under the MIT license. " + "b " * 60_000] + ["Released under the MIT license."] * 200


def test_against_all_blocks(rows):
    made = texts()
    df = rows(SCHEMA, *[(i if i % 17 else None, t, "w", "h", "h", "s", "l", "k") for i, t in enumerate(made)])
    got = license.digests(df)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = [(i if i % 17 else None, *plainly(t)) for i, t in enumerate(made)]
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    assert len({r[6] for r in want}) > 10


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_thresholds(rows, threshold):
    made = texts()[:120]
    got = license.digests(rows(SCHEMA, *[(i, t, "", "", "", "", "", "") for i, t in enumerate(made)]), threshold=threshold)
    assert sorted(map(tuple, got.collect())) == sorted((i, *plainly(t, threshold=threshold)) for i, t in enumerate(made))


def test_empty_and_bounds(rows):
    df = rows(SCHEMA, (1, "x", "", "", "", "", "", ""))
    assert license.digests(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        license.digests(df, templates=[("x", " ".join(map(str, range(license.MOST + 1))))])


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    got = license.digests(table(spark, folder, "documents"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.execute(license.ORACLE).fetchall()))


def test_no_python_in_the_plan(rows):
    plan = license.digests(rows(SCHEMA, (1, "x", "", "", "", "", "", "")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

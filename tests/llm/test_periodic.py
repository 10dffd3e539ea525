import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardwise.llm import periodic

SCHEMA = "doc_id long, text string, runs string, collapsed string, start string, n_runs string"


def lyndon_plainly(word):
    out = []
    for i in range(len(word)):
        j = i + 1
        while j < len(word) and word[j:] > word[i:]:
            j += 1
        out.append(j - i)
    return out


def runs_plainly(word, least=12):
    """Maximal stretches of equal words ``q`` apart, without those of a smaller period."""
    found = set()
    for q in range(1, len(word) // 2 + 1):
        i = 0
        while i + q < len(word):
            s = i
            while i + q < len(word) and word[i] == word[i + q]:
                i += 1
            n = i + q - s
            smaller = (d for d in range(1, q) if all(word[k] == word[k + d] for k in range(s, s + n - d)))
            if n >= max(least, 2 * q) and next(smaller, None) is None:
                found.add((s, n, q))
            i += i == s
    return sorted(found, key=lambda r: (r[0], r[2]))


def words_like(draw):
    k = draw.choice([1, 2, 2, 3, 9])
    word = [draw.randrange(k) for _ in range(draw.randint(0, 60))]
    if word and draw.random() < 0.5:
        a = draw.randrange(len(word))
        p = draw.randint(1, len(word) - a)
        word = [w if i < a else word[a + (i - a) % p] for i, w in enumerate(word)]
    if draw.random() < 0.5:
        word += [draw.randrange(k, k + 40) for _ in range(draw.randint(0, 30))] + word[: draw.randint(0, 40)]
    return word


@pytest.mark.parametrize("seed", range(4))
def test_lyndon_arrays_and_runs(seed):
    draw = random.Random(seed)
    for _ in range(300):
        word = words_like(draw)
        assert periodic.lyndon(word) == lyndon_plainly(word)
        for least in (2, 5, 12):
            assert [tuple(r) for r in periodic.runs(np.array(word, "i8"), least).tolist()] == runs_plainly(word, least)


def test_long_words():
    for word in (["a", "b"], ["a"]):
        ids = np.array([ord(w) for w in word] * 40_000)
        assert periodic.runs(ids).tolist() == [[0, len(ids), len(word)]]
    a, b = [0], [0, 1]
    while len(b) < 6000:
        a, b = b, b + a
    assert [tuple(r) for r in periodic.runs(np.array(b[:700]), 12).tolist()] == runs_plainly(b[:700], 12)
    assert len(periodic.runs(np.array(b), 2)) < len(b)


def digest_plainly(key, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_plainly(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    return (key, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def test_digests(rows):
    draw = random.Random(3)
    made = [(None, "a b " * 10), (1, None), (2, ""), (3, " \t"), (4, "x\x85y\xa0z " * 7), (5, "a " * 11), (6, "a " * 12), (6, "a " * 12),
            (7, "é ü\n" * 9 + "é"), (8, "one two three " * 4 + "tail " * 13 + "one two three " * 4)]
    made += [(i, " ".join(f"w{x}" for x in words_like(draw))) for i in range(10, 200)]
    df = rows(SCHEMA, *[(k, t, "r", "c", "s", "n") for k, t in made])
    got = periodic.digests(df.select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text")))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert dict(got.dtypes)["exponent_milli"] == "bigint"
    want = [digest_plainly(k, t) for k, t in made]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in made) > 5


def test_texts_and_empty(rows):
    df = rows(SCHEMA, (1, "to be or " * 5 + "not", "r", "c", "s", "n"))
    row = periodic.detect(df).collect()[0]
    assert [tuple(r) for r in row.runs] == [(0, 15, 3)] and row.collapsed == "to be or not"
    assert periodic.digests(df.limit(0)).collect() == []

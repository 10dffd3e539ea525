import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from wardwise.llm import packing

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def spread_out(made, counts):
    """Every piece of the plan, one by one: {sequence: [(offset, length)]}."""
    held, seen = {}, {k: set() for k in counts}
    for length, rank, n, each, first, offset in made.slots:
        for i in range(n):
            for j in range(each):
                held.setdefault(first + i, []).append((offset + j * length, length))
                assert rank + i * each + j not in seen[length]
                seen[length].add(rank + i * each + j)
    assert {k: len(v) for k, v in seen.items()} == {k: n for k, n in counts.items()}
    assert all(max(v) == counts[k] - 1 for k, v in seen.items() if v)
    return held


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=40), st.integers(1, 12))
def test_plan_is_sound(counts, groups):
    made = packing.plan(counts, 64, groups)
    held = spread_out(made, counts)
    assert set(held) == set(range(made.sequences))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_plan_is_tight():
    draw = np.random.default_rng(5)
    lengths = np.clip(draw.lognormal(6, 1.1, 30_000).astype(int), 1, 4096)
    counts = {int(k): int(n) for k, n in Counter(lengths.tolist()).items()}
    made = packing.plan(counts, 4096)
    assert made.sequences <= -(-int(lengths.sum()) // 4096) * 1.002 + 1
    assert len(made.slots) < 60_000


TEXTS = ["The cat's 12 mats.", "", None, "The cat's 12 mats.", "É " * 300, "a b\tc\x85d ́x ÉÉ", "w" * 50 + " <|endoftext|> İ", "Σας ΣΑΣ  \n\n x"]


def test_rows_against_the_library(rows):
    df = rows("doc_id long, text string, task string, nth string", *[(i, t, "x", "y") for i, t in enumerate(TEXTS)])
    got = packing.packed(df, PATH, size=64).collect()
    ids = {i: LIBRARY.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(TEXTS)}
    want = {
        (i, k): (k * 64, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        for i, whole in ids.items()
        for k, part in enumerate(whole[a : a + 64] for a in range(0, len(whole), 64))
    }
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(held) == len({k for k, v in want.items() if v[1] == 64}) + 1 or len(held) <= -(-sum(v[1] for v in want.values()) // 64) + 1


def test_empty_null_and_repeated(rows):
    df = rows("doc_id long, text string", (None, "a"), (7, "a"), (7, "a"))
    got = packing.packed(df, PATH, size=8, with_ids=True).collect()
    assert sorted((r.sequence_id, r.offset) for r in got) == [(0, 0), (0, 2), (0, 4)]
    assert {bytes(r.ids) for r in got} == {np.array([*LIBRARY.encode("a").ids, 1], "<u4").tobytes()}
    assert packing.packed(df.limit(0), PATH, size=8).collect() == []

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from wardwise.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.codec(PATH)

ODD = st.text(alphabet=st.sampled_from("abetnrs's'tréß \n\t\x1c\x85\xa0 ​0159.,!-日本語🙂́"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), ODD))
def test_ids_are_the_librarys(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(ODD, st.lists(st.tuples(st.integers(0, 80), st.integers(0, 12), ODD), max_size=4))
def test_appends_and_edits_are_exact(text, edits):
    kept, now = bpe.Text(CODEC, text), text
    assert kept.ids == LIBRARY.encode_ordinary(now)
    for at, cut, new in edits:
        a = min(at, len(now))
        b = min(a + cut, len(now))
        kept.replace(a, b, new)
        now = now[:a] + new + now[b:]
        assert kept.text == now and kept.ids == LIBRARY.encode_ordinary(now)
    kept.append(" 've done")
    assert kept.ids == LIBRARY.encode_ordinary(now + " 've done")


def test_long_pieces_and_long_texts():
    draw = random.Random(3)
    for text in ("a" * 5000, "".join(draw.choice("abcd") for _ in range(4000)), " " * 3000, "the cat " * 5000):
        assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)


def test_rows(spark, rows):
    texts = ["It's 12 o'clock", "", None, "naïve  \n café", "It's 12 o'clock"]
    df = rows("doc_id long, text string, ids string, n_tokens int", *[(i, t, "x", 7) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in bpe.round_trip(df, PATH).collect()}
    assert len(got) == 5
    for i, t in enumerate(texts):
        ids = LIBRARY.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), PATH).collect() == []
    full = bpe.encode(df, PATH).orderBy("doc_id").collect()
    assert [r.ids for r in full] == [LIBRARY.encode_ordinary(t or "") for t in texts]
    assert full[0].n_tokens == 7


def test_null_keys(rows):
    df = rows("doc_id long, text string", (None, "a b"), (None, "a b"))
    assert [r.n_tokens for r in bpe.round_trip(df, PATH).collect()] == [2, 2]


def test_vocabulary_knows_unreachable_tokens():
    small = bpe.Vocabulary({b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"ab": 4, b"abc": 5, b"abcab": 6})
    assert small.split(5) == (0, 3)
    assert small.encode_piece(b"abc") == [5]
    assert small.encode_piece(b"abab") == [4, 4]
    with pytest.raises(KeyError):
        small.ranks[b"abca"]


def test_pieces_with_a_common_head_share_its_table(monkeypatch):
    calls, vocabulary = [], bpe.Vocabulary.load(PATH)
    meets = vocabulary._meets
    monkeypatch.setattr(vocabulary, "_meets", lambda *pair: calls.append(pair) or meets(*pair))
    pieces = [b" enachsti" + bytes([a, b]) for a in range(97, 107) for b in range(97, 107)]
    expected = [LIBRARY._encode_single_piece(p) for p in pieces]
    assert [vocabulary.encode_piece(p) for p in pieces] == expected
    assert len(vocabulary.heads) and max(map(len, vocabulary.heads)) <= max(bpe.HEADS)
    first = len(calls)
    vocabulary.seams.clear()  # what is remembered of heads spares their seams
    assert [vocabulary.encode_piece(p) for p in pieces] == expected
    assert len(calls) - first < first
    monkeypatch.setattr(bpe, "HEAD_MEMORY", 2)
    monkeypatch.setattr(bpe, "SEAM_MEMORY", 2)
    assert [vocabulary.encode_piece(p) for p in pieces] == expected

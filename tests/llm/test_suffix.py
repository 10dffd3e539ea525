import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from wardwise.llm import suffix

L = suffix.LENGTH


def plainly(texts, length=L):
    """Per text: its bytes, and the runs covered by strings of ``length`` bytes that start elsewhere too."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        spans = [(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1]
        out.append((t, suffix.merged(spans)))
    return out


def expected(texts):
    rows = []
    for t, runs in plainly(texts):
        kept = suffix._kept(t, [{"start": a, "end": b} for a, b in runs])[0]
        rows.append((len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return rows


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)), max_size=60))
def test_deep_shallow_sorts(strings):
    strings = strings + [b"\x01" * 40 + s for s in strings]
    order = suffix.deep_shallow(strings)
    assert sorted(order) == list(range(len(strings)))
    assert [strings[i] for i in order] == sorted(strings)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=50).map(lambda b: b"\x07" * 33 + bytes(x % 2 for x in b)), min_size=25, max_size=40))
def test_shared_lengths(strings):
    got = suffix.shared_lengths(strings, list(range(len(strings))))
    for i, a in enumerate(strings):
        assert got[i].tolist() == [suffix.common(a, b) for b in strings]


def test_small_groups_are_sorted(monkeypatch):
    sorted_, plain = [], suffix.deep_shallow
    monkeypatch.setattr(suffix, "deep_shallow", lambda strings: sorted_.append(len(strings)) or plain(strings))
    group = [(1, 200, c.encode() * 100 + b"x" * 400 + c.encode() * 100) for c in "ab"]
    assert suffix.repeated(group, 0, 200) == [[(-100, 300)]] * 2
    assert sorted_ == [2, 2]


def test_every_string_holds_an_anchor():
    draw = random.Random(1)
    for text in (draw.randbytes(3000), b"ab" * 900, bytes(5000), draw.randbytes(400), draw.randbytes(90) * 30):
        places, keys, _ = suffix.anchors_of(text)
        for i in range(len(text) - L + 1):
            assert any(i <= p <= i + L - suffix.MER for p in places.tolist())
        again, more, _ = suffix.anchors_of(b"xyz" + text)
        assert set((places + 3).tolist()) <= set(again.tolist()) | {int(p) for p in places + 3 if p < 203 or p > len(text) - 400}


def corpus():
    """Copies, near copies, shared passages, borders of exactly 399 to 401 bytes, periods."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [prose(draw.randint(1, 400)) for _ in range(30)]
    base = prose(300)
    for _ in range(25):
        words = base.split()
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(len(words))] = word()
        texts.append(" ".join(words))
    for n in (398, 399, 400, 401, 402, 600, 800):
        passage = "".join(draw.choice("klmnopq") for _ in range(n))
        texts += [prose(40) + "<" + passage + ">" + prose(40), passage + "!" + prose(50), prose(20) + "?" + passage]
    line = prose(45)[:250]
    texts += [prose(60) + line + prose(60) for _ in range(40)]  # common, but too short
    ends = "".join(draw.choice("uvw") for _ in range(500))
    texts += [ends[:420] + prose(30), ends[80:], prose(10) + ends[50:470]]
    texts += [texts[0]] * 3 + [base] * 5 + ["abc" * 400, "bca" * 333 + "!", "z" * 2000, "", None, "short", "short", "z" * 399]
    return texts


@pytest.mark.parametrize("group", [256, 3])
def test_against_all_strings(rows, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)  # at 3 nearly every group is split by content
    texts = corpus()
    made = [(i if i % 9 else None, t, 1, "x", 2, 3) for i, t in enumerate(texts)]
    df = rows("doc_id long, text string, n int, key string, fp long, start int", *made)
    got = suffix.digests(df).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted((str(m[0]), *e) for m, e in zip(made, expected(texts)))
    kept = suffix.without_repeats(df)
    assert kept.columns == df.columns
    want = [None if t is None else suffix._kept(b, [{"start": x, "end": y} for x, y in runs])[0].decode("utf-8", "ignore")
            for t, (b, runs) in zip(texts, plainly(texts))]
    assert sorted(str(r.text) for r in kept.collect()) == sorted(map(str, want))


def test_groups_of_joined_classes_do_not_move(rows, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP", 4)
    moved, plain = [], suffix._sorted_groups

    def watched(groups):
        moved.extend(tuple(r) for r in groups.select("key", "low", "high", "size").collect())
        return plain(groups)

    monkeypatch.setattr(suffix, "_sorted_groups", watched)
    made = []
    for i in range(12):  # the 100 bytes before the anchor stand twice, what precedes them does not
        around = chr(65 + i).encode() * 100 + chr(97 + i // 2).encode() * 100 + b"." * 400
        made.append((1, i, 1, i, 600, 200, 200, bytearray(around)))
    df = rows("key long, ctx long, size long, fp long, n int, at int, left int, bytes binary", *made)
    got = {(r.fp, r.start, r.end) for r in suffix.compared(df).collect()}
    assert {i: suffix.merged((a, b) for f, a, b in got if f == i) for i in range(12)} == {i: [(100, 600)] for i in range(12)}
    open_ = {m[:3] for m in moved if m[3] == 1}
    assert moved and all(m[:3] in open_ for m in moved)


def test_documents(spark):
    from wardwise.llm.common import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    got = [tuple(r)[1:] for r in suffix.digests(docs).orderBy("doc_id").collect()]
    assert got == expected(texts)


def test_empty(rows):
    df = rows("doc_id long, text string", (1, "a"))
    assert suffix.digests(df.limit(0)).collect() == []
    assert suffix.without_repeats(df.limit(0)).collect() == []


@pytest.mark.parametrize("length", [64, 240])
def test_other_lengths(rows, length):
    texts = corpus()
    made = [(i, t, 1, "x", 2, 3) for i, t in enumerate(texts)]
    df = rows("doc_id long, text string, _text int, _fp string, _n long, _spans int", *made)
    want = []
    for i, (t, runs) in enumerate(plainly(texts, length)):
        kept = suffix._kept(t, [{"start": a, "end": b} for a, b in runs])[0].decode("utf-8", "ignore")
        want.append((i, sum(b - a for a, b in runs), kept if texts[i] is not None else None))
    got = suffix.digests(df, length=length, with_text=True)
    assert sorted((r.doc_id, r.n_removed, r.text) for r in got.collect()) == [(i, n, t or "") for i, n, t in want]
    kept = suffix.without_repeats(df, length=length)
    assert kept.columns == df.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str((i, t, 1, "x", 2, 3)) for i, _, t in want)


def test_many_copies_of_a_text(rows):
    """A task sends the anchors of a text twice at most; all copies are cut all the same."""
    draw = random.Random(2)
    text = "".join(draw.choice("abcdefgh ") for _ in range(1500))
    near = [text[:700] + chr(65 + i) + text[701:] for i in range(20)]
    texts = [text] * 300 + near + ["".join(draw.choice("xyz") for _ in range(700))]
    df = rows("doc_id long, text string", *enumerate(texts))
    sent = suffix.anchors(df.coalesce(2)).groupBy("fp", "n").count().collect()
    assert max(r["count"] for r in sent) <= 4 * len(suffix.anchors_of(text.encode())[0])
    got = sorted(tuple(r)[1:] for r in suffix.digests(df).collect())
    assert got == sorted(expected(texts))


def test_long_texts(rows):
    draw = random.Random(4)
    passage = "".join(draw.choice("klmnopqrst") for _ in range(5000))
    filler = lambda: "".join(draw.choice("abcdefghij") for _ in range(300_000))
    texts = [filler() + passage + filler(), passage + filler(), filler()]
    got = suffix.digests(rows("doc_id long, text string", *enumerate(texts))).orderBy("doc_id").collect()
    assert [(r.n_removed, r.n_spans) for r in got] == [(5000, 1), (5000, 1), (0, 0)]


def with_passages(texts, length, shorter):
    """``expected``, and the number and bytes of the runs that repeated strings of ``shorter`` bytes cover."""
    return [
        (len(t), sum(b - a for a, b in long), len(long), hashlib.sha256(suffix._kept(t, spans)[0]).hexdigest(),
         len(short), sum(b - a for a, b in short))
        for (t, long), (_, short) in zip(plainly(texts, length), plainly(texts, shorter))
        for spans in [[{"start": a, "end": b} for a, b in long]]
    ]


@pytest.mark.parametrize("group", [256, 3])
@pytest.mark.parametrize("length, shorter", [(400, 240), (100, 60), (240, 240)])
def test_passages_beside_strings(rows, monkeypatch, group, length, shorter):
    monkeypatch.setattr(suffix, "GROUP", group)
    texts = corpus()
    got = suffix.digests(rows("doc_id long, text string", *enumerate(texts)), length=length, shorter=shorter).orderBy("doc_id")
    assert [tuple(r)[1:] for r in got.collect()] == with_passages(texts, length, shorter)


def test_many_texts_share_one_place(rows, monkeypatch):
    """More than a group's worth of texts share strings of 240 bytes, none of 400."""
    monkeypatch.setattr(suffix, "GROUP", 4)
    draw = random.Random(8)
    some = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    passage = some(240)
    texts = [some(300) + passage + some(300) for _ in range(20)] + [passage + some(200), passage, some(9) + passage, some(239)]
    got = suffix.digests(rows("doc_id long, text string", *enumerate(texts)), shorter=240).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == with_passages(texts, 400, 240)
    assert [(r.n_removed, r.n_passages) for r in got] == [(0, 1)] * 23 + [(0, 0)]


def test_planted_passages(spark):
    """The query shows passages of more than 50 words that stand in several documents."""
    from wardwise.llm import queries
    from wardwise.llm.common import table

    folder = "/root/testdata/sf0.001"
    texts = [r.text for r in table(spark, folder, "documents").orderBy("doc_id").collect()]
    got = queries.op10_suffix_dedup(spark, folder).orderBy("doc_id").collect()
    want = with_passages(texts, 400, 240)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passages, r.n_passage_bytes) for r in got] == want
    assert any(n_passages and not n_removed for _, n_removed, _, _, n_passages, _ in want)

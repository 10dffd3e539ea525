import random
import re

import xxhash
from hypothesis import given, settings, strategies as st

from wardwise.llm import simhash
from wardwise.llm.common import table


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{position: positions reachable}, by comparing all pairs."""
    left, found = set(range(len(prints))), {}
    while left:
        group, open_ = set(), [left.pop()]
        while open_:
            at = open_.pop()
            group.add(at)
            near = {o for o in left if ((prints[o] ^ prints[at]) % 2**64).bit_count() <= 4}
            left -= near
            open_ += near
        found.update({i: group for i in group})
    return found


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBÉé \t\x0b\x1c\x85\xa0ſK"), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(-(2**13), 2**13), max_size=60))
def test_links_connect_what_pairs_connect(values):
    values = sorted(values)
    got = dict(simhash.links(values))
    want = plain_components(values)
    for i, v in enumerate(values):
        assert got.get(v, v) == values[min(want[i])]


def near_family(draw, words, n):
    """Copies of a text with a few words changed."""
    for _ in range(n):
        copy = list(words)
        for _ in range(draw.randint(0, 2)):
            copy[draw.randrange(len(copy))] = draw.choice("xyz")
        yield " ".join(copy)


def check(got, texts):
    prints = [plain_fingerprint(t) for _, t in texts]
    groups = plain_components(prints)
    want = sorted(
        (str(i), f"{p:016x}", str(min((texts[j][0] for j in groups[k] if texts[j][0] is not None), default=None)))
        for k, ((i, _), p) in enumerate(zip(texts, prints))
    )
    assert sorted(tuple(map(str, r)) for r in got) == want


def test_components(spark, rows, monkeypatch):
    draw = random.Random(2)
    texts = []
    for _ in range(6):
        words = [draw.choice("abcdefghij") + draw.choice("klmnop") + str(draw.randint(0, 99)) for _ in range(150)]
        texts += near_family(draw, words, 25)
    texts += ["", None, " \t", "one", "One", "a b c d", "lone text of its own", "x " * 60_000]
    texts = [(3 * i + 1, t) for i, t in enumerate(texts)] + [(1, texts[0]), (None, texts[0]), (None, "nobody else has this")]
    df = rows("doc_id long, text string, fp string, component_id string, node long", *[(i, t, "a", "b", 1) for i, t in texts])
    got = simhash.clustered(df).collect()
    check(got, texts)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r.component_id for r in got if r.component_id is not None})
    assert ids.count(None) == 2
    monkeypatch.setattr(simhash, "SHARD", 8)  # every family is dealt out in parts
    check(simhash.clustered(df).collect(), texts)


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    check(simhash.clustered(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_every_component_keeps_a_row_of_its_own(rows):
    a, b, c, d, e = (" ".join(f"{x}{i * i}" for i in range(60)) for x in "abcde")
    made = [(5, a), (7, a), (5, b), (3, b), (9, c), (9, d), (9, c), (None, e), (None, e), (None, e)]
    kept = simhash.one_of_each(rows("doc_id long, text string", *made)).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(5, a), (3, b), (9, c), (9, d), (None, e)]))


def test_empty(rows):
    df = rows("doc_id long, text string", (1, "a"))
    assert simhash.clustered(df.limit(0)).collect() == []
    assert simhash.one_of_each(df.limit(0)).collect() == []


def test_components_of_long_chains(rows):
    chain = [(i + 1, i) for i in range(200)] + [(1000, 5000), (5000, 4000), (7, 7)]
    got = {r.node: r.label for r in simhash.components(rows("u long, v long", *chain)).collect()}
    assert all(got[i] == 0 for i in range(201))
    assert {got[1000], got[4000], got[5000]} == {1000}

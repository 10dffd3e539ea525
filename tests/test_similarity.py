"""Scans and the similarity join against plain loops over the standard library."""

import random
from difflib import SequenceMatcher, get_close_matches

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from wardwise.operators import scans, similarity
from wardwise.sources.dimensions import OFFICIAL_STATES

FACTS = "date date, state string, district string, pincode int, adult_enrolments bigint"


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def brute_close(names, n=5, cutoff=0.85):
    return {
        (name, other)
        for name in names
        for other in get_close_matches(name, names, n=n, cutoff=cutoff)
        if other != name
    }


def joined(spark, names, **kw):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    return {(r.name, r.candidate) for r in similarity.closest_matches(df, **kw).collect()}


@pytest.fixture(scope="module")
def spark_module(spark):
    return spark


BASES = ["Visakhapatnam", "Ahmednagar", "aaaaaaaaaaaaaaaa", "North 24 Parganas", "Goa", "ababababab", "Y S R Kadapa"]


@st.composite
def misspelled(draw):
    """A base name after a few character edits."""
    name = list(draw(st.sampled_from(BASES)))
    for _ in range(draw(st.integers(0, 4))):
        at = draw(st.integers(0, len(name)))
        kind = draw(st.sampled_from("idr"))
        letter = draw(st.sampled_from("abgn "))
        if kind == "i":
            name.insert(at, letter)
        elif name and at < len(name):
            name[at : at + 1] = [] if kind == "d" else [letter]
    return "".join(name)


@settings(max_examples=14, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(misspelled(), min_size=2, max_size=40, unique=True), st.sampled_from([0.6, 0.75, 0.85, 0.95]), st.sampled_from([2, 3]))
def test_similar_pairs_are_all_found(spark_module, names, cutoff, q):
    names = [n for n in names if n]
    df = spark_module.createDataFrame([(n,) for n in names] or [("x",)], "name string")
    ranked = similarity.ranked_tokens(df, q)
    pairs = similarity.similar_pairs(ranked, ranked, cutoff, q).collect()
    got = {(r.name, r.candidate): r.ratio for r in pairs}
    assert len(got) == len(pairs)
    expected = {
        (a, b): ratio(b, a) for a in names for b in names if a != b and ratio(b, a) >= cutoff
    }
    assert got == expected


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(misspelled(), min_size=1, max_size=25, unique=True), st.lists(misspelled(), min_size=1, max_size=25, unique=True),
       st.sampled_from([0.4, 0.7]), st.sampled_from([(), (0.85, 0.6)]))
def test_closest_in_a_vocabulary(spark_module, names, words, cutoff, steps):
    names, words = [n for n in names if n and n not in words] or ["zz"], [w for w in words if w] or ["zy"]
    table = lambda rows: spark_module.createDataFrame([(r,) for r in rows], "name string")
    got = similarity.closest_in(table(names), table(words), cutoff, steps).collect()
    best = {n: max((ratio(w, n), w) for w in words) for n in names}
    assert sorted((r.name, r.candidate, r.ratio) for r in got) == sorted((n, w, r) for n, (r, w) in best.items() if r >= cutoff)


def test_a_popular_character_is_salted(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SALT_ROWS", 5)
    names, words = [f"aaab{i:02d}" for i in range(40)], [f"aaac{i:02d}" for i in range(40)] + ["aaa", "xyz"]
    table = lambda rows: spark.createDataFrame([(r,) for r in rows], "name string")
    got = {r.name: (r.ratio, r.candidate) for r in similarity.closest_in(table(names), table(words), 0.4).collect()}
    assert got == {n: max((ratio(w, n), w) for w in words) for n in names}


def test_closest_matches_rank_like_the_library(spark):
    names = [f"District {a}{b}" for a in "abcdefgh" for b in "abcdefgh"] + ["Goa", "Gova", "Districta"]
    assert joined(spark, names) == brute_close(names)


def test_salting_changes_nothing(spark, monkeypatch):
    names = [f"Ward Number {i:03d}" for i in range(150)]
    monkeypatch.setattr(similarity, "SALT_ROWS", 7)
    assert joined(spark, names) == brute_close(names)


def test_going_down_in_steps_changes_nothing(spark):
    names = [f"Ward Number {i:03d}" for i in range(120)]
    names += [f"Circle {a}{b}" for a in "abcd" for b in "wxyz"] + ["Mysuru", "Mysore", "Mysoru", "Nashik"]
    names += [f"A name that is much longer than the others, number {i} of all" for i in (1, 2, 11, 12, 21)]
    assert joined(spark, names) == brute_close(names)


def test_only_grams_or_only_shortened_texts(spark, monkeypatch):
    names = [f"Ward {i:02d}" for i in range(40)] + ["Mysuru", "Mysore", "Mysoru", "a", "b", "ab"]
    for left_out in (-1, 2):
        monkeypatch.setattr(similarity, "LEFT_OUT", left_out)
        assert joined(spark, names) == brute_close(names)


def test_prefix_bound_leaves_common_trigrams_out(spark):
    """Names that only share a common word are never compared."""
    names = ["Unique%s" % w for w in ("bcdfgh", "jklmnp", "qrstvw", "xzbdfh")]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    ranked = similarity.ranked_tokens(df)
    assert similarity.candidate_pairs(ranked, ranked, 0.85).count() == 0


def facts_of(spark, *rows):
    """(state, district, pincode, records)"""
    return spark.createDataFrame(
        [(None, s, d, p, 1) for s, d, p, n in rows for _ in range(n)], FACTS
    )


def brute_states(counts):
    out = set()
    for s, n in counts.items():
        if s not in OFFICIAL_STATES:
            best = get_close_matches(s, OFFICIAL_STATES, n=1, cutoff=0.4)
            fix = best[0] if best else "Unknown"
            out.add((s, fix, ratio(s.lower(), fix.lower()) if best else 0.0, n))
    return out


def test_state_scan(spark):
    counts = {"Karnatak": 3, "GOA": 2, "Tamil Nadu": 9, "Orissa": 4, "qqqq": 1, "Delhi ": 2, "Jammu And Kashmir": 5}
    df = facts_of(spark, *[(s, "d", 1, n) for s, n in counts.items()], (None, "d", 1, 1))
    got = scans.state_scan(df).collect()
    assert {tuple(r) for r in got} == brute_states(counts)
    assert [r.Conf for r in got] == sorted((r.Conf for r in got), reverse=True)


def test_state_scan_against_a_table(spark):
    """The same as against a list, whatever the vocabulary's size; its nulls and repeats count for nothing."""
    counts = {"Karnatak": 3, "GOA": 2, "Tamil Nadu": 9, "Orissa": 4, "qqqq": 1, "Delhi ": 2, "": 5}
    df = facts_of(spark, *[(s, "d", 1, n) for s, n in counts.items()], (None, "d", 1, 1))
    words = spark.createDataFrame([(n,) for n in [*OFFICIAL_STATES, "Goa", None]], "name string")
    got = scans.state_scan(df, words).collect()
    assert {tuple(r) for r in got} == brute_states(counts)
    assert scans.state_scan(df, words.limit(0)).collect()[0].Fix == "Unknown"


def brute_districts(rows, pick="last"):
    count, pins = {}, {}
    for _, d, p, n in rows:
        count[d] = count.get(d, 0) + n
        if p > 0:
            pins.setdefault(d, set()).add(p)
    out = set()
    for d in sorted(count):
        accepted = [
            m
            for m in get_close_matches(d, sorted(count), n=5, cutoff=0.85)
            if m != d
            and count[m] > count[d]
            and not (d in pins and m in pins and not pins[d] & pins[m])
        ]
        if accepted:
            best = accepted[-1] if pick == "last" else max(accepted, key=lambda m: count[m])

            def shown(name):
                low = sorted(pins.get(name, ()))
                return ", ".join(map(str, low[:3])) + ("..." if len(low) > 3 else "")

            out.add((
                d, best, ratio(d.lower(), best.lower()), count[d], count[best],
                bool(pins.get(d, set()) & pins.get(best, set())), shown(d), shown(best),
            ))
    return out


DISTRICTS = [
    ("K", "Bengaluru", 560001, 50), ("K", "Bengaluru", 560002, 10), ("K", "Bengaluru", 560003, 10),
    ("K", "Bengaluru", 560004, 10), ("K", "Bengalura", 560002, 5), ("K", "Bengaluruu", 560009, 6),
    ("K", "Bengalur", 0, 500),  # no PIN: nothing speaks against it
    ("A", "Anantapur", 515001, 5), ("A", "Ananthapur", 515001, 50), ("A", "Anantapuram", 515001, 500),
    ("G", "Goa", 0, 5), ("G", "Goah", 403001, 1), ("M", "Pune", 411001, 5), ("M", "Nashik", 422001, 5),
]


@pytest.mark.parametrize("pick", ["last", "largest"])
def test_district_scan(spark, pick):
    got = scans.district_scan(facts_of(spark, *DISTRICTS), pick)
    assert {tuple(r) for r in got.collect()} == brute_districts(DISTRICTS, pick)


def test_three_candidates_last_accepted_wins(spark):
    rows = [("S", "Chandrapur", 1, 2), ("S", "Chandrapurr", 1, 50), ("S", "Chandrapurrr", 1, 5), ("S", "Chandrapu", 1, 500)]
    last = {r.Suspect: r.Fix for r in scans.district_scan(facts_of(spark, *rows)).collect()}
    largest = {r.Suspect: r.Fix for r in scans.district_scan(facts_of(spark, *rows), "largest").collect()}
    assert last["Chandrapur"] == "Chandrapurrr" and largest["Chandrapur"] == "Chandrapu"
    assert {(s, f) for s, f in last.items()} == {(t[0], t[1]) for t in brute_districts(rows)}


def test_no_pins_and_disjoint_pins(spark):
    apart = [("S", "Nagapatnam", 1, 1), ("S", "Nagapattnam", 2, 9)]
    assert scans.district_scan(facts_of(spark, *apart)).count() == 0
    blank = [("S", "Nagapatnam", 0, 1), ("S", "Nagapattnam", 2, 9)]
    row = scans.district_scan(facts_of(spark, *blank)).first()
    assert (row.Fix, row.PIN_Overlap, row.Suspect_PINs, row.Fix_PINs) == ("Nagapattnam", False, "", "2")


def test_unknown_pick_is_refused(spark):
    with pytest.raises(ValueError):
        scans.district_scan(facts_of(spark, *DISTRICTS), "best")


def test_roughly_closest_against_exact(spark):
    """Recall of the banded search against the exact join, on misspelled names; ratios are the exact ones."""
    rng = random.Random(7)
    bases = ["".join(rng.choice("abdeghiklmnoprstuv") for _ in range(rng.randint(8, 22))) for _ in range(150)]
    names = set(bases)
    for base in bases:
        for _ in range(3):
            name = list(base)
            for _ in range(rng.randint(1, 2)):
                name[rng.randrange(len(name))] = rng.choice(["", "x", "a", "ss"])
            names.add("".join(name))
    df = spark.createDataFrame([(n,) for n in sorted(names)] + [("",)], "name string")
    exact = {(r.name, r.candidate, r.ratio) for r in similarity.closest_matches(df).collect()}
    rough = {(r.name, r.candidate, r.ratio) for r in similarity.roughly_closest(df).collect()}
    recall = len(exact & rough) / len(exact)
    print("pairs", len(exact), "recall", recall)
    assert len(exact) > 500 and recall >= 0.95
    assert all(ratio >= 0.85 for _, _, ratio in rough)
    few = {(r.name, r.candidate, r.ratio) for r in similarity.roughly_closest(df, bands=2, rows=4).collect()}
    assert len(exact & few) < len(exact & rough)  # fewer bands find less


def test_roughly_closest_salted_and_empty(spark, monkeypatch):
    names = spark.createDataFrame([(f"Supplier#{i:09d}",) for i in range(60)], "name string")
    plain = sorted(map(str, similarity.banded_pairs(similarity.min_hashes(names, 24, 2)).collect()))
    assert len(set(plain)) == len(plain)  # each pair once
    monkeypatch.setattr(similarity, "SALT_ROWS", 7)
    assert sorted(map(str, similarity.banded_pairs(similarity.min_hashes(names, 24, 2)).collect())) == plain
    assert similarity.roughly_closest(names.limit(0)).isEmpty()


def test_closest_matches_rate_few_of_many_pairs(spark):
    """Numbered names share all but one character with dozens; few of these are rated."""
    names = [f"Supplier#{i:06d}" for i in range(400)]
    rated = spark.sparkContext.accumulator(0)
    run = similarity.nearest_of(0.85, 4)

    def counted(batches):
        import difflib

        class Counting(difflib.SequenceMatcher):
            def ratio(self):
                rated.add(1)
                return super().ratio()

        plain, difflib.SequenceMatcher = difflib.SequenceMatcher, Counting
        try:
            yield from run(batches)
        finally:
            difflib.SequenceMatcher = plain

    pairs = [(a, b, 2.0 * (len(a) - 1) / (2 * len(a))) for a in names for b in names if a != b and ratio(b, a) > 0.9]
    df = spark.createDataFrame(pairs + pairs[::7], "name string, candidate string, bound double")  # some come twice
    ordered = df.repartition(3, "name").sortWithinPartitions("name", "bound", similarity.F.desc("candidate"))
    got = ordered.mapInArrow(counted, "name string, candidate string, ratio double, rank int").collect()
    assert sorted((r.name, r.candidate, round(r.ratio, 9), r["rank"]) for r in got) == sorted(
        (a, b, round(r, 9), i + 1)
        for a in names
        for i, (r, b) in enumerate(sorted(((ratio(b, a), b) for b in names if b != a), reverse=True)[:4])
    )
    assert rated.value < len(pairs) / 3


def test_shortened_texts_of_lengths_that_meet(spark):
    df = spark.createDataFrame([("Supplier#000000001", 18), ("Supplier#000000002", 18)], "name string, len int")
    assert similarity.shortened(df, 0.97, 0.91, lengths=[18]).count() <= 2 * 19
    assert similarity.shortened(df, 0.97, 0.91).count() > 4 * similarity.shortened(df, 0.97, 0.91, lengths=[18]).count()

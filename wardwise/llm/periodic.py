"""Periodic runs of words, by Lyndon roots from a suffix sorter's grouping phase.

A run is a stretch of consecutive words with smallest period ``q`` that no
neighbouring word extends, at least ``least`` words and ``2 q`` long.

1. ``lyndon`` is the first phase of Baier's suffix sorter. Groups of suffixes start
   as those of equal first words; from the highest group down, every group
   lengthens the prefix of the nearest lower suffixes to its left, which leave their
   groups for new ones just above, those lengthened more often higher up. What a
   suffix has gathered in the end is the longest Lyndon word that starts there.
2. This is done under the order of the words and under the reverse order: every run
   has a Lyndon root under one of them (the runs theorem).
3. Every root found is extended to both sides by the longest common extension of it
   and its repetition, read from tables of names of all stretches of 2^k words
   (equal names, equal words; nothing is hashed), for all roots at once.

Before that, stretches that cannot hold a run are left out: a run is at least
``least // 2`` words longer than its period, so the ``least // 2`` words from any of
its places stand twice in it, but for fewer than ``least // 2`` places in a row.

One narrow pass. Words are runs of anything but ASCII white space; a null text has
none. Memory follows the longest text. Repeated rows give repeated rows, null keys
stay null, other columns of any name are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from wardwise.llm.common import per_batch

LEAST = 12
DEPTH = 4  # times that stretches are looked through for smaller ones


def lyndon(word: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place."""
    n, length = len(word), [1] * len(word)
    alphabet = sorted(set(word))
    number = {w: g for g, w in enumerate(alphabet)}
    group = [number[w] for w in word]
    members: list[list[int]] = [[] for _ in alphabet]
    for i, g in enumerate(group):
        members[g].append(i)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    left = list(range(n))  # a finished place leads to the left, the others to themselves
    at = len(members) - 1
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]
        members[at] = []
        for i in own:
            left[i] = i - 1
        times: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and left[p] != p:
                before = left[p]
                if before >= 0:
                    left[p] = left[before]
                p = before
            left[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        leaving: dict[tuple[int, int], list[int]] = {}
        for p, k in times.items():
            leaving.setdefault((k, group[p]), []).append(p)
        for k, g in sorted(leaving, reverse=True):  # straight above the old group, under those lengthened more often
            new, moved, grown = len(members), leaving[k, g], k * length[own[0]]
            members.append(moved)
            below.append(g)
            above.append(above[g])
            below[above[g]] = above[g] = new
            for p in moved:
                group[p] = new
                length[p] += grown
        at = below[at]
    return length


class Extensions:
    """Longest common extensions to either side of two places, by names of stretches of 2^k words."""

    def __init__(self, ids: np.ndarray):
        self.n, self.names = len(ids), [np.unique(ids, return_inverse=True)[1].astype("i4")]
        while (size := 1 << len(self.names)) <= self.n:
            last = self.names[-1].astype("i8")
            half = size >> 1
            pairs = last[: self.n - size + 1] * (self.n + 1) + last[half : self.n - half + 1]
            distinct, names = np.unique(pairs, return_inverse=True)
            if len(distinct) == len(pairs):
                break  # no two stretches of this size are equal
            self.names.append(names.astype("i4"))

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from ``a`` and from ``b`` on, for ``a`` before ``b``."""
        shared = np.zeros(len(a), "i8")
        for k in range(len(self.names) - 1, -1, -1):
            names, some = self.names[k], np.flatnonzero(b + shared + (1 << k) <= self.n)
            more = some[names[a[some] + shared[some]] == names[b[some] + shared[some]]]
            shared[more] += 1 << k
        return shared

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words before ``a`` and before ``b``, for ``a`` before ``b``."""
        shared = np.zeros(len(a), "i8")
        for k in range(len(self.names) - 1, -1, -1):
            names, some = self.names[k], np.flatnonzero(a - shared >= 1 << k)
            at = shared[some] + (1 << k)
            more = some[names[a[some] - at] == names[b[some] - at]]
            shared[more] += 1 << k
        return shared


def stretches(ids: np.ndarray, least: int = LEAST, depth: int = DEPTH) -> list[tuple[int, int]]:
    """Disjoint (start, end), each run whole in one of them."""
    gram = max(least // 2, 1)
    found, open_ = [], [(0, len(ids), 0)]
    while open_:
        start, end, deep = open_.pop()
        if end - start < least:
            continue
        if deep == depth:
            found.append((start, end))
            continue
        part = ids[start:end].astype("u8")
        n = len(part) - gram + 1
        mixed = (part + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        hashed = np.zeros(n, "u8")
        for k in range(gram):
            hashed = hashed * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
        order = np.sort(hashed)
        twice = order[1:][order[1:] == order[:-1]]
        if not len(twice):
            continue
        places = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, hashed), len(twice) - 1)] == hashed)
        cuts = np.flatnonzero(np.diff(places) > gram)
        firsts, lasts = places[np.append(0, cuts + 1)], places[np.append(cuts, len(places) - 1)]
        parts = [(start + a, start + b + gram) for a, b in zip(firsts.tolist(), lasts.tolist())]
        if parts == [(start, end)]:
            found += parts
        else:
            open_ += [(a, b, deep + 1) for a, b in parts]
    return sorted(found)


def runs_within(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every run, by start and period."""
    ids = np.unique(ids, return_inverse=True)[1]
    word, places = ids.tolist(), np.arange(len(ids))
    top = len(word) and max(word)
    roots = [np.array(lyndon(w), "i8") for w in (word, [top - w for w in word])]
    start = np.concatenate([places, places[roots[0] != roots[1]]])
    period = np.concatenate([roots[0], roots[1][roots[0] != roots[1]]])
    both = Extensions(ids)
    before, after = both.left(start, start + period), both.right(start, start + period)
    length = before + period + after
    made = np.column_stack([start - before, length, period])[length >= np.maximum(least, 2 * period)]
    made = np.unique(made, axis=0)
    return made[np.lexsort((made[:, 2], made[:, 0]))]


def runs(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every run, by start and period."""
    found = [runs_within(ids[a:b], least) + np.array([a, 0, 0]) for a, b in stretches(ids, least)]
    return np.concatenate(found) if found else np.empty((0, 3), "i8")


def without_repetitions(n: int, found: np.ndarray) -> np.ndarray:
    """Places that no run contains after its first period."""
    marks = np.zeros(n + 1, "i8")
    np.add.at(marks, found[:, 0] + found[:, 2], 1)
    np.add.at(marks, found[:, 0] + found[:, 1], -1)
    return np.flatnonzero(np.cumsum(marks[:-1]) == 0)


def detect(df: DataFrame, key: str = "doc_id", column: str = "text", least: int = LEAST) -> DataFrame:
    """(key, runs, collapsed) of every row.

    ``runs``: (start, length, period) in words, by start and period; ``collapsed``: the
    words that no run contains after its first period, joined by single blanks.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kind = StructType().add("start", "long").add("length", "long").add("period", "long")
    schema = StructType([df.schema[key]]).add("runs", ArrayType(kind)).add("collapsed", "string")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        all_runs, texts = [], []
        for text in batch.column(column).cast(pa.binary()):
            words = (text.as_py() or b"").split()
            numbers: dict[bytes, int] = {}
            ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], "i8")
            found = runs(ids, least)
            if len(found):
                words = [words[i] for i in without_repetitions(len(words), found).tolist()]
            all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in found.tolist()])
            texts.append(b" ".join(words).decode("utf-8", "replace"))
        columns = [batch.column(key), pa.array(all_runs, pa.list_(run)), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    return df.select(key, column).mapInArrow(per_batch(one), schema)


def digests(df: DataFrame, key: str = "doc_id", column: str = "text", least: int = LEAST) -> DataFrame:
    """(key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every row.

    ``start`` to ``exponent_milli`` are those of the longest run, ties to the smallest
    start, then period; null without a run.
    """
    longest = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)),
        lambda best, r: F.when(r["length"] > best["length"], r).otherwise(best),  # runs come by start and period
    )
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return detect(df, key, column, least).select(
        key, F.size("runs").cast("long").alias("n_runs"), longest.alias("_l"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        key, "n_runs", "_l.start", "_l.length", "_l.period",
        F.floor(F.lit(1000) * F.col("_l.length") / F.col("_l.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def planted(key: Column, text: Column) -> Column:
    """The text, made periodic from some word on where ``crc32`` of the key is divisible by ten.

    ``g`` is a tenth of that number: of ``n`` words, word ``i >= a = g % n`` becomes
    word ``a + (i - a) % p`` with ``p = 1 + floor((n - a) / (3 + g % 8))``.
    """
    hashed = F.crc32(key.cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.floor(hashed / 10)

    def rewritten(ws: Column) -> Column:
        a = (g % F.size(ws)).cast("int")
        p = F.lit(1) + F.floor((F.size(ws) - a) / (F.lit(3) + g % 8)).cast("int")
        return F.transform(ws, lambda w, i: F.when(i >= a, F.get(ws, a + (i - a) % p)).otherwise(w))

    # as a lambda's variable the words are split once, not for every word
    made = F.transform(F.array(words), rewritten)
    return F.when(hashed % 10 == 0, F.array_join(F.get(made, F.lit(0)), " ")).otherwise(text)

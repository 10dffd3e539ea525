"""Repeated passages by suffix sorting: every byte of a string of ``length`` (400 unless
said otherwise) bytes that starts anywhere else too.

Not all suffixes are sorted, only those at anchors. A rolling hash of half a
``length`` from each position is taken; the smallest of any half a length and one
consecutive ones marks an anchor. With 400: every string of 400 bytes holds an anchor,
and the same string holds it at the same place wherever it stands. Two anchors can
share such a string only if their 200 bytes are equal, and then exactly the strings
within 200 bytes on either side of those 200 are to be compared.

1. Anchors move as hashes: of their 200 bytes, and of their whole surroundings
   (up to 600 bytes). A task sends those of a text twice at most, however many copies
   it meets: only whether something stands once or more often matters. Anchors with equal surroundings are one class; in a class of
   two or more everything in the surroundings is repeated.
2. Anchors that are alone in their class, but share their 200 bytes with other
   classes, are compared by their bytes: what follows the anchors of a group is
   sorted, deep-shallow: multikey quicksort down to ``SHALLOW`` bytes, then blind
   tries for those that still agree; what precedes them likewise, backwards.
   Common lengths on both sides say which strings of 400 bytes two of them share.
3. A group of more than ``GROUP`` classes is split by content first: strings that
   start in one half of the possible places all share a longer middle part, so its
   hash is the group of that half; and so on down to single places.

With ``shorter``, passages are found in the same pass: bytes covered by repeated strings
of that many bytes, too. Every string of ``shorter`` bytes then holds an anchor (a third
of it is hashed, which keeps anchors as sparse as above), so every string of ``length``
bytes does, in its beginning; surroundings reach ``length`` bytes ahead, and the common
lengths tell of both. A span is ``full`` if strings of ``length`` bytes cover it.

Hashes are polynomials modulo 2^64 over a table of pseudo-random bytes' values,
mixed; classes are told apart by two of them with different bases.

Only texts that hold a place in question move, one copy of each, and in the end only
those with something to cut. Which ones these may be is told by a filter of ``BITS``
bits over their hashes, a table of 8 MB at most whatever the data; a text that it
lets through by chance moves for nothing.

Texts are taken as UTF-8 bytes; null texts are empty. Texts under ``length`` bytes keep
all their bytes, long ones are treated whole. A text is known by its hash and length, so
copies, repeated rows and rows without an id are right without further ado: they
repeat each other. Other columns are kept by ``without_repeats``, whatever their
names, and ignored by ``digests``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from wardwise.llm.common import LOADED, partitions, per_batch
from wardwise.sources.tables import settle

LENGTH = 400
MER = LENGTH // 2
PASSAGE = 240  # bytes; a passage of 50 words has 270 and more
SHALLOW, CHUNK = 32, 8
GROUP = 256
BITS = 1 << 26


def _shape(length: int, shorter: int | None) -> tuple[int, int, int]:
    """(shortest strings looked for, bytes hashed at an anchor, how far before it such a string can start)."""
    least, mer = (length, length // 2) if shorter is None else (shorter, shorter // 3)
    return least, mer, least - mer


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of substrings by differences of prefix sums; powers grow as needed."""

    def __init__(self, base: int, salt: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.values = _mix(np.arange(1, 257, dtype="u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
        self.powers = self.inverses = np.ones(1, "u8")

    def prefix(self, b: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(b):
            n = 2 * len(b) + 4096
            for name, step in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(n, step, "u8")
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        sums = np.zeros(len(b) + 1, "u8")
        np.cumsum(self.values[b] * self.powers[: len(b)], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, starts, ends) -> np.ndarray:
        return _mix((sums[ends] - sums[starts]) * self.inverses[starts])


def rolling(nth: int) -> Rolling:
    base, salt = ((0xD6E8FEB86659FD93, 1), (0xA0761D6478BD642F, 7))[nth]
    return LOADED.get((__name__, nth), lambda: Rolling(base, salt))


def _sliding(values: np.ndarray, width: int, pick, filler: int) -> np.ndarray:
    """``pick`` over every ``width`` consecutive values, by blocks from both ends."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, filler, "u8")
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - width + 1], ahead[width - 1 : n])


def anchors_of(text: bytes, length: int = LENGTH, shorter: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes of the bytes there, hashes of the surroundings)."""
    n, (fewest, mer, side) = len(text), _shape(length, shorter)
    if n < fewest:
        return np.empty(0, "i8"), np.empty(0, "u8"), np.empty(0, "u8")
    b, own, other = np.frombuffer(text, "u1"), rolling(0), rolling(1)
    sums = own.prefix(b)
    mers = _mix((sums[mer:] - sums[:-mer]) * own.inverses[: n - mer + 1])
    width = side + 1
    least = _sliding(mers, width, np.minimum, (1 << 64) - 1)
    padded = np.zeros(len(least) + 2 * side, "u8")
    padded[side : side + len(least)] = least
    places = np.flatnonzero(_sliding(padded, width, np.maximum, 0) == mers)
    starts, ends = np.maximum(places - side, 0), np.minimum(places + length, n)
    around = other.of(other.prefix(b), starts, ends)
    sides = (places - starts).astype("u8") * np.uint64(1009) + (ends - places).astype("u8")
    return places, mers[places], _mix(around + sides * np.uint64(0x9E3779B97F4A7C15))


def _known(df: DataFrame, column: str, *kept: str) -> DataFrame:
    """(*kept, _text, _fp, _n): the text, never null, and its hash and length that stand for it."""
    text = F.coalesce(F.col(column), F.lit(""))
    return df.select(*kept, text.alias("_text")).select("*", F.xxhash64("_text").alias("_fp"), F.octet_length("_text").alias("_n"))


def _filter(found: DataFrame) -> DataFrame:
    """(bucket, bits): a bit for every ``fp``; at most ``BITS / 32768`` rows of 4 KB."""
    slot = _slot(F.col("fp"))
    return found.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits")
    )


def _slot(fp: Column) -> Column:
    return F.pmod(F.xxhash64(fp), F.lit(BITS)) + 1


def _told_apart(texts: DataFrame, fp: str, bits: DataFrame) -> DataFrame:
    """``texts`` with ``_may``: whether the filter has a bit for ``fp``."""
    at = F.bitmap_bit_position(_slot(F.col(fp)))
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    may = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    rows = texts.withColumn("_at", F.bitmap_bucket_number(_slot(F.col(fp))))
    return rows.join(F.broadcast(bits), F.col("_at") == F.col("_bucket"), "left").withColumn("_may", may).drop("_at", "_bucket", "_bits")


ANCHOR = "key long, ctx long, fp long, n int, at int"


def anchors(df: DataFrame, column: str = "text", length: int = LENGTH, shorter: int | None = None) -> DataFrame:
    """(key, ctx, fp, n, at) of every anchor, those of a text twice a task at most. One narrow pass."""

    def run(batches):
        sent: dict[tuple[int, int], int] = {}
        for batch in batches:
            keys, contexts, places, rows = [], [], [], []
            names = zip(batch.column("_fp").to_pylist(), batch.column("_n").to_pylist())
            for i, (text, name) in enumerate(zip(batch.column("_text").cast(pa.binary()), names)):
                sent[name] = sent.get(name, 0) + 1
                if sent[name] > 2:
                    continue
                at, key, ctx = anchors_of(text.as_py(), length, shorter)
                keys.append(key), contexts.append(ctx), places.append(at.astype("i4")), rows.append(np.full(len(at), i))
            if rows:
                keys, contexts = (pa.array(np.concatenate(x).view("i8")) for x in (keys, contexts))
                rows = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [keys, contexts, batch.column("_fp").take(rows), batch.column("_n").take(rows), pa.array(np.concatenate(places))],
                    ["key", "ctx", "fp", "n", "at"],
                )

    return _known(df, column).where(F.col("_n") >= _shape(length, shorter)[0]).mapInArrow(run, ANCHOR)


# --- deep-shallow sorting ---------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Strings by the bytes in which they part; what lies between is not looked at
    on the way down, and made good by one comparison at a leaf."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings, self.root = strings, first  # a leaf is an index, a branch (depth, {byte or -1: node})

    def _byte(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def _leaf(self, node) -> int:
        while not isinstance(node, int):
            node = next(iter(node[1].values()))
        return node

    def add(self, i: int) -> None:
        node = self.root
        while not isinstance(node, int):
            child = node[1].get(self._byte(i, node[0]))
            if child is None:
                break
            node = child
        leaf = self._leaf(node)
        shared = common(self.strings[i], self.strings[leaf])
        if shared == len(self.strings[i]) == len(self.strings[leaf]):
            shared += 1  # equal strings part one byte past their end, in the order they come
        parent, key, node = None, 0, self.root
        while not isinstance(node, int) and node[0] < shared:
            parent, key, node = node, self._byte(i, node[0]), node[1].get(self._byte(i, node[0]))
            if node is None:
                parent[1][key] = i
                return
        if not isinstance(node, int) and node[0] == shared:
            mark = self._byte(i, shared)
            while mark in node[1]:
                mark -= 1  # another equal string
            node[1][mark] = i
            return
        old = self._byte(self._leaf(node), shared)
        mine = self._byte(i, shared)
        branch = (shared, {old: node, mine if mine != old else old - 1: i})
        if parent is None:
            self.root = branch
        else:
            parent[1][key] = branch

    def ordered(self) -> list[int]:
        out, open_ = [], [self.root]
        while open_:
            node = open_.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                open_ += [node[1][k] for k in sorted(node[1], reverse=True)]
        return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """Indices in the order of the strings."""
    out, open_ = [], [(list(range(len(strings))), 0)]
    while open_:
        part, depth = open_.pop()
        if len(part) < 2:
            out += part
        elif depth >= SHALLOW:
            trie = BlindTrie(strings, part[0])
            for i in part[1:]:
                trie.add(i)
            out += trie.ordered()
        else:
            heads = {i: strings[i][depth : depth + CHUNK] for i in part}
            pivot = heads[part[len(part) // 2]]
            below, equal, above = [], [], []
            for i in part:
                (below if heads[i] < pivot else above if heads[i] > pivot else equal).append(i)
            ended = len(pivot) < CHUNK  # all of these are equal to their end
            open_ += [(above, depth), (equal, SHALLOW if ended else depth + CHUNK), (below, depth)]
    return out


_FAR = np.int32((1 << 31) - 1)


def shared_lengths(strings: list[bytes], wanted: list[int]) -> np.ndarray:
    """For each wanted string, its common length with every string."""
    order, n = deep_shallow(strings), len(strings)
    steps = np.array([common(strings[a], strings[b]) for a, b in zip(order, order[1:])], "i4")
    place = np.empty(n, "i8")
    place[order] = np.arange(n)
    at = place[wanted][:, None]
    above = np.arange(n - 1) >= at
    up = np.minimum.accumulate(np.where(above, steps, _FAR), axis=1)
    down = np.minimum.accumulate(np.where(above, _FAR, steps)[:, ::-1], axis=1)[:, ::-1]
    lines = np.empty((len(wanted), n), "i4")
    lines[:, 1:] = up
    lines[:, :-1] = np.where(above, lines[:, :-1], down)
    lines[np.arange(len(wanted)), at[:, 0]] = [len(strings[i]) for i in wanted]
    return lines[:, place]


def _runs(first: np.ndarray, last: np.ndarray, fits: np.ndarray, side: int) -> list[tuple[int, int, int]]:
    """(row, start, end), both included: what the intervals that fit cover in each row."""
    rows, width = np.nonzero(fits)[0] * (side + 2), side + 2
    size = len(fits) * width
    marks = np.bincount(rows + first[fits], minlength=size) - np.bincount(rows + last[fits] + 1, minlength=size)
    covered = np.zeros(size + 1, "i1")
    covered[1:] = np.cumsum(marks) > 0  # none reaches the last place of a row
    turns = np.flatnonzero(np.diff(covered))
    return [(a // width, a % width, b % width - 1) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist())]


def repeated(
    group: list[tuple[int, int, bytes]], low: int, high: int, length: int = LENGTH,
    shorter: int | None = None, only: int | None = None,
) -> list[list[tuple]]:
    """Per member (size of its class, bytes before the anchor, surroundings): what is
    repeated in other members, as (start, end) counted from its anchor; with ``shorter``,
    (start, end, full).

    Strings that start ``low`` to ``high`` bytes before the anchor are looked at, of
    either length or of ``only`` one.
    Members whose class has more than one are resolved already and get nothing.
    """
    least, mer, side = _shape(length, shorter)
    alone = [i for i, (size, _, _) in enumerate(group) if size == 1]
    out: list[list[tuple]] = [[] for _ in group]
    for at in range(0, len(alone), 256):  # bounds the matrices
        part = alone[at : at + 256]
        after = shared_lengths([s[left + mer :] for _, left, s in group], part)
        before = shared_lengths([s[:left][::-1] for _, left, s in group], part)
        last = np.minimum(before, high)
        last[np.arange(len(part)), part] = -1
        for size in dict.fromkeys((length, least)) if only is None else (only,):
            first = np.maximum(size - mer - after, low)
            fits = first <= last
            if fits.any():
                for row, a, b in _runs(first, last, fits, side):
                    out[part[row]].append((-b, size - a) if shorter is None else (-b, size - a, size == length))
    return out


# --- the steps on Spark -----------------------------------------------------

SPAN = "fp long, n int, start int, end int, full boolean"


def _full(length: int) -> Column:
    """Whether strings of ``length`` bytes fit a span: near an end of its text only shorter ones may."""
    return (F.col("end") - F.col("start") >= length).alias("full")


def _around(found: DataFrame, length: int, shorter: int | None) -> DataFrame:
    """The whole surroundings of anchors as spans."""
    return found.select(
        "fp", "n", F.greatest(F.col("at") - _shape(length, shorter)[2], F.lit(0)).alias("start"),
        F.least(F.col("at") + length, F.col("n")).alias("end"),
    ).select("*", _full(length))


def surroundings(
    df: DataFrame, wanted: DataFrame, column: str = "text", length: int = LENGTH, shorter: int | None = None
) -> DataFrame:
    """(key, ctx, size, fp, n, at, left, bytes) of the wanted anchors, once each."""
    (least, _, side), wanted = _shape(length, shorter), settle(wanted)
    listed = wanted.groupBy("fp", "n").agg(F.collect_list(F.struct("key", "ctx", "size", "at")).alias("anchors"))
    texts = _told_apart(_known(df, column).where(F.col("_n") >= least), "_fp", settle(_filter(wanted))).where("_may")
    texts = texts.groupBy(F.col("_fp").alias("fp"), F.col("_n").alias("n")).agg(F.any_value("_text").alias("_text"))
    schema = "key long, ctx long, size long, fp long, n int, at int, left int, bytes binary"

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, fp, n, found in zip(*(batch.column(c).to_pylist() for c in ("_text", "fp", "n", "anchors"))):
            text = text.encode("utf-8", "replace")
            for a in found:
                start = max(a["at"] - side, 0)
                rows.append((a["key"], a["ctx"], a["size"], fp, n, a["at"], a["at"] - start, text[start : a["at"] + length]))
        kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary()]
        names = ["key", "ctx", "size", "fp", "n", "at", "left", "bytes"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    cut = texts.join(listed, ["fp", "n"]).select("_text", "fp", "n", "anchors")
    return cut.mapInArrow(per_batch(one), schema)  # a class names one text and place, and a text comes once


def _halves(groups: DataFrame, length: int, least: int) -> DataFrame:
    """Each group as two, by what the strings of either half have in common; those of either length apart.

    ``same`` is a hash of all that those strings of a member can cover, ``before`` and ``reach``
    say how far from its anchor that is. The bytes stay behind, ``was`` names their group.
    """
    mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct("low", mid.alias("high")), F.struct((mid + 1).alias("low"), "high"))
    split = groups.withColumns({"_h": F.explode(halves), "was": F.col("key")}).drop("low", "high").select("*", "_h.low", "_h.high")
    each = F.when(F.col("only").isNull(), F.array(*map(F.lit, dict.fromkeys((length, least))))).otherwise(F.array("only"))
    split = split.withColumn("only", F.explode(each))
    right = F.octet_length("bytes") - F.col("left")
    whole = split.where((F.col("left") >= F.col("low")) & (right >= F.col("only") - F.col("high")))
    middle = F.expr("substring(bytes, left - low + 1, only - high + low)")
    whole = whole.withColumns({"before": F.least("left", "high"), "reach": F.least(right, F.col("only") - F.col("low"))})
    cover = F.substring("bytes", F.col("left") - F.col("before") + 1, F.col("before") + F.col("reach"))
    same = F.xxhash64("before", "reach", cover)
    return whole.withColumns({"key": F.xxhash64("key", "low", "high", "only", middle), "same": same}).drop("_h", "bytes", "left")


def compared(classes: DataFrame, length: int = LENGTH, shorter: int | None = None) -> DataFrame:
    """Spans of classes of one, from comparison within their groups.

    Splitting joins classes again: what made them differ may lie outside the half. It works on
    hashes; bytes follow for members that are still to be compared, and only those that matter.
    Groups left without a class of one are dropped before they move, whatever their size.
    """
    spans, (least, _, side) = None, _shape(length, shorter)
    only = F.lit(length if shorter is None else None).cast("int")
    groups = settle(classes.withColumns(
        {"low": F.lit(0), "high": F.lit(side), "length": F.lit(length), "shorter": F.lit(shorter).cast("int"), "only": only}
    ))
    of = ["key", "low", "high"]
    sized = lambda rows: rows.groupBy(*of).agg(F.count("*").alias("_c"), F.count_if(F.col("size") == 1).alias("_s"))
    while True:
        apart = settle(sized(groups).where(f"_s = 0 or _c > {GROUP} and low < high"))  # nothing to find, or to be split
        large = apart.where("_s > 0").select(*of)
        some = not large.isEmpty()
        found = _sorted_groups(groups.join(apart.select(*of), of, "left_anti"))
        spans = found if spans is None else spans.unionAll(found)
        if not some:
            return spans
        held = groups.join(large, of, "left_semi")
        split = settle(_halves(held, length, least))
        alike = split.groupBy(*of, "same").agg(F.sum("size").alias("total"), F.min(F.struct("fp", "n", "at")).alias("rep"))
        joined = settle(split.join(alike, [*of, "same"]))
        again = joined.where("size = 1 and total > 1").select(
            "fp", "n", (F.col("at") - F.col("before")).alias("start"),
            F.least(F.col("at") - F.col("low") + F.col("only"), "n").alias("end"), (F.col("only") == length).alias("full"),
        )
        spans = spans.unionAll(again)
        rest = joined.where(F.struct("fp", "n", "at") == F.col("rep")).withColumn("size", F.col("total"))
        if shorter is not None:  # a single string has nothing to be compared with
            rest = rest.join(sized(rest).where("_s > 0 and _c > 1").select(*of), of, "left_semi")
        rest = settle(rest.drop("same", "total", "rep", "ctx"))
        bytes_ = held.select(F.col("key").alias("was"), "ctx", "fp", "n", "at", "left", "bytes")
        bytes_ = rest.join(bytes_, ["was", "fp", "n", "at"])
        cover = F.substring("bytes", F.col("left") - F.col("before") + 1, F.col("before") + F.col("reach"))
        groups = settle(bytes_.withColumns({"bytes": cover, "left": F.col("before")}).select(*groups.columns))


def _sorted_groups(groups: DataFrame) -> DataFrame:
    """Groups arrive whole and in order; a group of single strings needs no sorting."""
    of = ["key", "low", "high"]

    def run(batches):
        held: list[tuple] = []

        def finish(rows: list[tuple]) -> list[tuple]:
            low, high, (length, shorter, only) = rows[0][1], rows[0][2], rows[0][9:]
            if len(rows) < 2 or all(r[3] > 1 for r in rows):
                return []
            if low == high:  # all of them share this very string
                return [(r[4], r[5], r[6] - low, r[6] - low + only, only == length) for r in rows if r[3] == 1]
            found = repeated([(r[3], r[7], r[8]) for r in rows], low, high, length, shorter, only)
            return [(r[4], r[5], r[6] + a, r[6] + b, *(full or (True,))) for r, spans in zip(rows, found) for a, b, *full in spans]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            columns = zip(*rows) if rows else ([], [], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["fp", "n", "start", "end", "full"])

        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*of, "size", "fp", "n", "at", "left", "bytes", "length", "shorter", "only"))):
                if held and held[-1][:3] != row[:3]:
                    out += finish(held)
                    held = []
                held.append(row)
            yield batch_of(out)
        if held:
            yield batch_of(finish(held))

    spread = groups.select(*of, "size", "fp", "n", "at", "left", "bytes", "length", "shorter", "only").repartition(partitions(groups.sparkSession), *of)
    return spread.sortWithinPartitions(*of).mapInArrow(run, SPAN)


def repeated_spans(df: DataFrame, column: str = "text", length: int = LENGTH, shorter: int | None = None) -> DataFrame:
    """(fp, n, start, end, full): spans of texts (by hash and length) that are repeated."""
    of = Window.partitionBy("key")  # anchors move once, and are written only if they share their key
    found = anchors(df, column, length, shorter).withColumns(
        {"members": F.count("*").over(of), "mixed": F.min("ctx").over(of) != F.max("ctx").over(of)}
    )
    shared = settle(found.where("members > 1").drop("members"))
    mixed = shared.where("mixed").drop("mixed")
    classes = settle(
        mixed.groupBy("key", "ctx").agg(F.count("*").alias("size"), F.min(F.struct("fp", "n", "at")).alias("_r"))
        .select("key", "ctx", "size", "_r.*")
    )
    several = classes.where("size > 1").select("key", "ctx")
    places = lambda rows: rows.select("fp", "n", "at").distinct()
    whole = _around(places(shared.where("not mixed")), length, shorter).unionAll(
        _around(places(mixed.join(several, ["key", "ctx"], "left_semi")), length, shorter)
    )
    open_ = settle(classes.where("size = 1").select("key").distinct())  # a hot key can then be split
    cut = surroundings(df, classes.join(open_, "key", "left_semi"), column, length, shorter)
    return whole.unionAll(compared(cut, length, shorter))


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or adjacent spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _with_spans(df: DataFrame, column: str, length: int, shorter: int | None, *kept: Column | str) -> DataFrame:
    """(*kept, _text, _spans): texts that may have spans meet them, the others stay where they are."""
    spans = settle(
        repeated_spans(df, column, length, shorter)
        .groupBy("fp", "n").agg(F.collect_set(F.struct("start", "end", "full")).alias("_spans"))
    )
    known = _told_apart(_known(df, column, *kept), "_fp", settle(_filter(spans)))
    none = F.lit(None).cast(spans.schema["_spans"].dataType)
    of = (F.col("_fp") == F.col("fp")) & (F.col("_n") == F.col("n"))
    met = known.where("_may").join(spans, of, "left").drop("fp", "n")
    apart = known.where("not _may").withColumn("_spans", none)
    return met.select(*apart.columns).unionAll(apart).drop("_fp", "_n", "_may")


def _kept(text: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    runs = merged((s["start"], s["end"]) for s in spans or ())
    parts, end = [], 0
    for a, b in runs:
        parts.append(text[end:a])
        end = b
    return b"".join([*parts, text[end:]]), runs


def digests(
    df: DataFrame, key: str = "doc_id", column: str = "text", length: int = LENGTH, with_text: bool = False,
    shorter: int | None = None,
) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, text][, n_passages, n_passage_bytes]) of every row.

    ``text`` is what is kept, without characters cut in two. Passages are the maximal runs
    of bytes that repeated strings of ``shorter`` bytes cover; what is kept does not depend on them.
    """
    schema = StructType([df.schema[key]]).add("n_bytes", "long").add("n_removed", "long")
    schema = schema.add("n_spans", "long").add("kept_sha256", "string")
    kinds = [pa.int64()] * 3 + [pa.string()] * (1 + with_text)
    schema = schema.add("text", "string") if with_text else schema
    if shorter is not None:
        schema, kinds = schema.add("n_passages", "long").add("n_passage_bytes", "long"), kinds + [pa.int64()] * 2

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, spans in zip(batch.column("_text").cast(pa.binary()), batch.column("_spans").to_pylist()):
            text, spans = text.as_py(), spans or ()
            kept, runs = _kept(text, [s for s in spans if s["full"]])
            shown = (kept.decode("utf-8", "ignore"),) if with_text else ()
            if shorter is not None:
                passages = merged((s["start"], s["end"]) for s in spans)
                shown += (len(passages), sum(b - a for a, b in passages))
            rows.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), *shown))
        return pa.RecordBatch.from_arrays([batch.column("_key"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], schema.names)

    return _with_spans(df, column, length, shorter, F.col(key).alias("_key")).mapInArrow(per_batch(one), schema)


def without_repeats(df: DataFrame, column: str = "text", length: int = LENGTH) -> DataFrame:
    """Same columns; repeated bytes cut from the texts, characters cut in two dropped. Null stays null."""
    names = df.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")  # under one name, which no column can clash with
    at = names.index(column)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, columns = [], batch.column("_row").flatten()
        for there, text, spans in zip(columns[at].is_valid(), batch.column("_text"), batch.column("_spans").to_pylist()):
            text = text.as_py()
            if spans:
                text = _kept(text.encode("utf-8", "replace"), spans)[0].decode("utf-8", "ignore")
            texts.append(text if there.as_py() else None)
        columns[at] = pa.array(texts, columns[at].type)
        return pa.RecordBatch.from_arrays(columns, names)

    return _with_spans(df, column, length, None, row).mapInArrow(per_batch(one), df.schema)

"""Near-duplicate documents by SimHash, with BK-trees.

Fingerprints of 64 bits that differ in at most ``RADIUS`` = 4 bits are linked.
Cut into six blocks, such a pair agrees in at least two of them, so equal values
of any of the 15 pairs of blocks bring all pairs together that count. Each
such shard becomes a BK-tree: a child hangs on the edge named by its distance to
the parent, and a search follows only the edges within the radius of its own
distance. Trees are built where their shard is; sending them to every task
would not be bounded by anything but the data.

Equal fingerprints are one node, so copies cost nothing. A shard of more than
``SHARD`` nodes is dealt out in parts, and every two parts meet in some task. A
shard yields one link per node to the smallest node it can reach there, which
connects the same nodes as all its pairs would. Components are found by
alternating large-star and small-star steps on written tables.

Null and empty texts, and those without words, have fingerprint zero and are
linked like any other. A null id joins its component but never names it; a
component of null ids only has the id null. Repeated rows give repeated rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from wardwise.llm.common import partitions, per_batch
from wardwise.sources.tables import settle

RADIUS, WORDS, SEED = 4, 4, 42
BLOCKS = (11, 11, 11, 11, 10, 10)
SHARD = 4096
ALL = (1 << 64) - 1


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bits set in over half of the hashes of the text's shingles."""
    parts = (text or "").encode("utf-8", "replace").lower().split()  # A-Z only; blanks of ASCII
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[: len(parts) - words].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())), "<u8", len(starts)
    )
    set_bits = np.zeros(64, "i8")
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view("u1").reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(0, dtype="i8")
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, fp): the fingerprint as a signed 64-bit number. One narrow pass."""
    schema = StructType([df.schema[key]]).add("fp", "long")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(column)], "u8").view("i8")
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array(found)], schema.names)

    return df.select(key, column).mapInArrow(per_batch(one), schema)


class Tree:
    """A BK-tree of distinct unsigned numbers under the Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Indices of the nodes within the radius."""
        found, open_ = [], [0] if self.values else []
        while open_:
            at = open_.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            for edge, child in self.children[at].items():
                if -radius <= edge - distance <= radius:
                    open_.append(child)
        return found

    def add(self, value: int) -> None:
        new, at = len(self.values), 0
        self.values.append(value)
        self.children.append({})
        while at != new:
            distance = (self.values[at] ^ value).bit_count()
            at = self.children[at].setdefault(distance, new)


def links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(node, smallest node it reaches among these) for distinct signed 64-bit numbers."""
    tree, top = Tree(), []

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    values = sorted(values)
    for i, value in enumerate(values):
        top.append(i)
        bits = value & ALL
        for j in tree.near(bits, radius):
            a, b = sorted((root(i), root(j)))
            top[b] = a
        tree.add(bits)
    return [(v, values[root(i)]) for i, v in enumerate(values) if root(i) != i]


def _masks() -> list[int]:
    places, at = [], 0
    for width in BLOCKS:
        places.append(((1 << width) - 1) << at)
        at += width
    masks = [a | b for a, b in combinations(places, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def shards(nodes: DataFrame) -> DataFrame:
    """(mask, part, low, high, fp): every node in each shard it belongs to."""
    parts = F.array(*[
        F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(_masks())
    ])
    dealt = nodes.select("fp", F.explode(parts).alias("s")).select("fp", "s.mask", "s.part")
    large = settle(dealt.groupBy("mask", "part").agg(F.count("*").alias("n")).where(F.col("n") > SHARD))
    own = F.pmod(F.xxhash64("fp"), F.col("shares"))
    others = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    return (
        dealt.join(large, ["mask", "part"], "left")
        .withColumn("shares", F.ceil(F.coalesce("n", F.lit(1)) / SHARD).cast("long"))
        .select("mask", "part", "fp", own.alias("own"), others.alias("other"))
        .select("mask", "part", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    )


def shard_links(dealt: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links found in the shards, u above v. Shards arrive whole and in order."""
    key = ["mask", "part", "low", "high"]

    def run(batches):
        rest: np.ndarray | None = None

        def cuts(rows: np.ndarray) -> np.ndarray:
            return np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1)) + 1

        def grouped(rows: np.ndarray) -> pa.RecordBatch:
            bounds = [0, *cuts(rows).tolist(), len(rows)]
            found = [p for a, b in zip(bounds, bounds[1:]) if b - a > 1 for p in links(rows[a:b, 4].tolist(), radius)]
            u, v = zip(*found) if found else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype("i8") for c in [*key, "fp"]])
            rows = rows if rest is None else np.concatenate([rest, rows])
            borders = cuts(rows)
            last = int(borders[-1]) if len(borders) else 0
            if last:
                yield grouped(rows[:last])
            rest = rows[last:]
        if rest is not None and len(rest):
            yield grouped(rest)

    spread = dealt.repartition(partitions(dealt.sparkSession), *key).sortWithinPartitions(*key)
    return spread.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each linked node can reach. ``edges``: (u, v)."""
    now, before = settle(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(
                now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        before = mark
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())


def _labelled(df: DataFrame, key: str, column: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """(key, fp) of every row, and (fp, first, label): its smallest id, and the fingerprint that stands for its component."""
    marked = settle(fingerprints(df, key, column))
    nodes = settle(marked.groupBy("fp").agg(F.min(key).alias("first")))
    labels = settle(components(shard_links(shards(nodes.select("fp")), radius)))
    labelled = nodes.join(labels, nodes.fp == labels.node, "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")
    )
    return marked, labelled


def clustered(df: DataFrame, key: str = "doc_id", column: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id) of every row; the smallest id names a component."""
    marked, labelled = _labelled(df, key, column, radius)
    names = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    named = settle(labelled.join(names, "label").select("fp", "component_id"))
    return marked.join(named, "fp").select(
        key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _printed(df: DataFrame, column: str) -> DataFrame:
    """With the fingerprint as ``_fp``."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(column)], "u8").view("i8")
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "_fp"])

    return df.mapInArrow(per_batch(one), StructType([*df.schema.fields]).add("_fp", "long"))


def one_of_each(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Of each component, one row with its smallest (id, fingerprint).

    Rows without an id cannot be named: one of a component's stays, too. An id that
    stands on rows of several components is decided for each of them. The ids to
    drop are joined against the texts: they are fewer than those to keep. Only rows
    of repeated or null ids are fingerprinted again.
    """
    marked, labelled = _labelled(df, key, column, RADIUS)
    labelled = settle(labelled)
    least = labelled.where("first is not null").groupBy("label").agg(F.min(F.struct("first", "fp")).alias("_b"))
    chosen = settle(least.select(F.col("_b.fp").alias("fp"), F.col("_b.first").alias("_chosen")))
    rows = marked.where(F.col(key).isNotNull()).join(chosen, "fp", "left")
    stays = F.count_if(F.col(key) == F.col("_chosen"))
    ids = settle(rows.groupBy(key).agg(F.count("*").alias("_n"), stays.alias("_stay")).where("_n > 1 or _stay = 0"))
    left = df.join(ids.where("_stay = 0").select(key), key, "left_anti").select(*df.columns)
    nameless = settle(marked.where(F.col(key).isNull()).select("fp").distinct())
    again = ids.where("_stay > 0").select(key)
    if again.isEmpty() and nameless.isEmpty():
        return left
    once = left.where(F.col(key).isNotNull()).join(again, key, "left_anti")
    pairs = chosen.select(F.col("_chosen").alias(key), F.col("fp").alias("_fp"))
    several = _printed(left.join(again, key, "left_semi").select(*df.columns), column).join(pairs, [key, "_fp"], "left_semi")
    lone = nameless.join(labelled, "fp").groupBy("label").agg(F.min("fp").alias("_fp")).select("_fp")
    unnamed = _printed(left.where(F.col(key).isNull()), column).join(lone, "_fp", "left_semi")
    kept = several.dropDuplicates([key, "_fp"]).unionByName(unnamed.dropDuplicates(["_fp"]))
    return once.select(*df.columns).unionByName(kept.select(*df.columns))

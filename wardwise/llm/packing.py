"""Best-fit packing of documents into sequences, by linear grouping.

Lengths are whole numbers up to the sequence size, so their histogram is all
the planner needs; it has at most ``size`` entries whatever the data. The plan:

1. Large lengths, in falling order, are split into groups of equal cardinality
   and rounded up to the largest of their group.
2. For these few sizes, configurations (what goes into one sequence) are chosen:
   the largest size left, with the subset of the others that fills best, as
   often as the counts allow.
3. Actual documents take the places of the rounded ones, which opens gaps.
4. Small lengths, in falling order, go where they fit best.

Sequences of equal content are planned as one run, so the plan is short too.
Documents find their place by their rank among those of equal length; ranks
come from counts per (task, length), never from a sort of the documents.

Null texts are empty texts: only the end id. Repeated rows and repeated or null
keys are packed like any others, each on its own. An empty table gives no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, StructType

from wardwise.llm.common import LOADED
from wardwise.sources.tables import settle

CHUNK_MEMORY = 250_000
WORD_MEMORY = 600_000
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: fixed by byte-level tokenizers: bytes without a sign of their own take those from 256 on
SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in SHOWN)}
GROUPS = 64
LARGE = 8  # a length over 1/8 of the size is large


class Chunks:
    """Ids of whole texts, remembering those between two blanks.

    Sound for byte-level tokenizers that drop white space before their merges, take a
    run of letters as one unit and a sign after it as another, and whose
    normalization does not reach across an ASCII blank or line break.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

        self.model, self.normalize = self.tokenizer.model, self.tokenizer.normalizer.normalize_str
        self.words: dict[str, bytes] = {}
        self.marks = {mark: self.one(mark) for mark in ".,"}

    def one(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: set[str]) -> None:
        """Ids of new chunks. A word with a full stop or comma is the word and the sign."""
        words, young, signed = self.words, self.young, {}
        if len(words) > WORD_MEMORY:
            words.clear()
        for chunk in chunks:
            mark = chunk[-1:]
            word = chunk[:-1] if mark in self.marks else chunk
            plain = word.lower() if word.isascii() else self.normalize(word)
            if word.isalpha() and plain.isalpha():  # some letters turn into letter and sign
                signed[chunk] = plain
            else:
                young[chunk] = self.one(chunk)
        new = set(signed.values()).difference(words)
        if new:
            self.learn_words(new)
        for chunk, word in signed.items():
            young[chunk] = words[word] + self.marks.get(chunk[-1], b"")

    def learn_words(self, words: set[str]) -> None:
        """A normalized word of letters is one unit of the tokenizer: its bytes' signs, merged."""
        for word in words:
            plain = word if word.isascii() else word.encode().decode("latin-1").translate(SIGNS)
            ids = [token.id for token in self.model.tokenize(plain)]
            self.words[word] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        chunks = text.replace("\n", " ").split(" ")
        young, old = self.young, self.old
        if len(young) > CHUNK_MEMORY:
            self.young, self.old = young, old = {}, young
        new = set(chunks).difference(young)
        if new:
            known = {chunk for chunk in new if chunk in old}
            young.update((chunk, old[chunk]) for chunk in known)
            self.learn(new - known)
        return b"".join(map(young.__getitem__, chunks))


def cut(
    df: DataFrame, path: str, size: int = 4096, end_id: int = 1,
    key: str = "doc_id", column: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``size`` ids: (key, piece, start, length, ids_crc32, task, nth[, ids]).

    ``nth`` counts the pieces of equal length that a task has made; the numbers
    hold only once the result is written, as a repeated task may see another order.
    """
    schema = StructType([df.schema[key]]).add("piece", "integer").add("start", "long").add("length", "long")
    schema = schema.add("ids_crc32", "long").add("task", "integer").add("nth", "long")
    if with_ids:
        schema = schema.add("ids", BinaryType())

    def run(batches):
        chunks = LOADED.get((__name__, path), lambda: Chunks(path))
        task, made, ending = TaskContext.get().partitionId(), defaultdict(int), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, taken = [], []
            for i, text in enumerate(batch.column(column)):
                ids = chunks.encode(text.as_py() or "") + ending
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    piece = ids[at : at + 4 * size]
                    length = len(piece) // 4
                    taken.append(i)
                    rows.append((k, at // 4, length, zlib.crc32(piece), task, made[length], piece))
                    made[length] += 1
            if rows:
                columns = [pa.array(c, t) for c, t in zip(
                    zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                )]
                keys = batch.column(key).take(pa.array(taken))
                yield pa.RecordBatch.from_arrays([keys, *columns[: len(schema) - 1]], schema.names)

    return df.select(key, column).mapInArrow(run, schema)


class Plan:
    """Runs of equal sequences. ``slots``: (length, first rank, sequences,
    pieces of it in each, first sequence, offset)."""

    def __init__(self, size: int):
        self.size, self.sequences, self.slots = size, 0, []
        self.gaps: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by room: (first, count)

    def open(self, count: int) -> tuple[int, int]:
        self.sequences += count
        return self.sequences - count, count

    def put(self, length: int, rank: int, count: int, each: int, first: int, room: int) -> None:
        self.slots.append((length, rank, count, each, first, self.size - room))

    def large(self, counts: dict[int, int], groups: int) -> None:
        """Steps 1 to 3."""
        total, queues, sizes = sum(counts.values()), [], []
        share, seen = max(1, -(-total // groups)), 0
        for length in sorted(counts, reverse=True):
            rank, left = 0, counts[length]
            while left:
                group = seen // share
                if group == len(queues):
                    queues.append(deque())
                    sizes.append(length)
                n = min(left, (group + 1) * share - seen)
                queues[group].append([length, rank, n])
                rank, left, seen = rank + n, left - n, seen + n
        left = [sum(n for *_, n in q) for q in queues]
        for g in range(len(queues)):
            while left[g]:
                chosen = [g, *self.fill(sizes, left, g)]
                times = min(left[h] // chosen.count(h) for h in set(chosen))
                for h in chosen:
                    left[h] -= times
                self.substitute(chosen, queues, times)

    def fill(self, sizes: list[int], left: list[int], largest: int) -> list[int]:
        """Groups that together come closest to what the largest leaves free."""
        free = self.size - sizes[largest]
        before: dict[int, tuple[int, int] | None] = {0: None}
        for g in range(largest, len(sizes)):
            have = left[g] - (g == largest)
            for _ in range(min(have, free // sizes[g])):
                more = {s + sizes[g]: (s, g) for s in before if s + sizes[g] <= free and s + sizes[g] not in before}
                if not more:
                    break
                # a sum may use a group once per round, so never more often than it has members
                before.update(more)
            if free in before:
                break
        at, chosen = max(before), []
        while before[at] is not None:
            at, g = before[at]
            chosen.append(g)
        return chosen

    def substitute(self, chosen: list[int], queues: list[deque], times: int) -> None:
        """Actual lengths for ``times`` sequences of a configuration."""
        first, _ = self.open(times)
        drawn = []  # per place, runs of (length, rank, count)
        for g in chosen:
            need, runs = times, []
            while need:
                head = queues[g][0]
                n = min(need, head[2])
                runs.append((head[0], head[1], n))
                head[1], head[2], need = head[1] + n, head[2] - n, need - n
                if not head[2]:
                    queues[g].popleft()
            drawn.append(runs)
        ends = sorted({e for runs in drawn for e in np.cumsum([n for *_, n in runs]).tolist()})
        begins = [0, *ends[:-1]]
        rooms = [self.size] * len(ends)
        for runs in drawn:
            at, k = 0, 0
            for length, rank, n in runs:
                while k < len(ends) and begins[k] < at + n:
                    self.put(length, rank + begins[k] - at, ends[k] - begins[k], 1, first + begins[k], rooms[k])
                    rooms[k] -= length
                    k += 1
                at += n
        for a, b, room in zip(begins, ends, rooms):
            self.gaps[room].append((first + a, b - a))

    def small(self, length: int, count: int) -> None:
        """Step 4 for one length: the least room that fits, as one after another would."""
        rank = 0
        for room in range(length, self.size + 1):
            while rank < count and self.gaps[room]:
                rank = self.place(length, rank, count, *self.gaps[room].pop(), room)
        if rank < count:
            need = -(-(count - rank) // (self.size // length))
            self.place(length, rank, count, *self.open(need), self.size)

    def place(self, length: int, rank: int, count: int, first: int, n: int, room: int) -> int:
        each = room // length
        full = min(n, (count - rank) // each)
        if full:
            self.put(length, rank, full, each, first, room)
            self.gaps[room - each * length].append((first, full))
            rank += full * each
        if full < n:
            rest = count - rank if count - rank < each else 0
            if rest:
                self.put(length, rank, 1, rest, first + full, room)
                self.gaps[room - rest * length].append((first + full, 1))
                rank, full = count, full + 1
            if full < n:
                self.gaps[room].append((first + full, n - full))
        return rank


def plan(counts: dict[int, int], size: int, groups: int = GROUPS) -> Plan:
    """How to pack ``counts[length]`` pieces of each length into sequences of ``size``."""
    made = Plan(size)
    border = max(1, size // LARGE)
    made.large({k: n for k, n in counts.items() if k > border}, groups)
    for length in sorted((k for k in counts if k <= border), reverse=True):
        made.small(length, counts[length])
    return made


def pack(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to written pieces; drops ``task`` and ``nth``."""
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("_n")).select(
        F.col("task").alias("_t"), F.col("length").alias("_l"), "_n"
    )
    counts = {r._l: r.n for r in per_task.groupBy("_l").agg(F.sum("_n").alias("n")).collect()}  # at most ``size`` rows
    slots = np.array(sorted(plan(counts, size).slots), "int64").reshape(-1, 6)
    ranges = slots[:, 0] << 44 | slots[:, 1]
    before = Window.partitionBy("_l").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = (
        pieces.join(offsets, (F.col("task") == F.col("_t")) & (F.col("length") == F.col("_l")))
        .withColumn("_rank", F.col("nth") + F.col("_before"))
        .drop("_t", "_l", "_before", "task", "nth")
    )
    schema = StructType([*ranked.drop("_rank").schema.fields]).add("sequence_id", "long").add("offset", "long")

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            slot = slots[np.searchsorted(ranges, length << 44 | rank, "right") - 1]
            nth = rank - slot[:, 1]
            places = [slot[:, 4] + nth // slot[:, 3], slot[:, 5] + nth % slot[:, 3] * length]
            yield pa.RecordBatch.from_arrays(
                [*batch.drop_columns(["_rank"]).columns, *map(pa.array, places)], schema.names
            )

    return ranked.mapInArrow(run, schema)


def packed(df: DataFrame, path: str, size: int = 4096, end_id: int = 1, key: str = "doc_id",
           column: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut, write the pieces, plan and place them."""
    return pack(settle(cut(df, path, size, end_id, key, column, with_ids)), size)

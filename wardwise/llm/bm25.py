"""Exact top-k search by BM25, with block-max pruning.

Documents become bags of terms once and are written; document frequencies and the
mean length are counted over all of them. The bags are inverted once, in shards of
about ``SHARD`` postings, and the shards are written. Queries are a stated set of
rows. They are dealt into blocks of bounded size, and each block is sent to all
tasks, which read the shards.

Documents that a task inverts together are laid out in groups that share frequent
terms (languages, if there are several), those between groups by themselves, each by
length. This decides where a document lies, nothing else. A shard's largest impact of
each term bounds the score of all its documents; a query searches only the shards
that can reach its current k-th best.

Of the queries that search a shard, terms are kept as a matrix if they are in so many
of these queries and of its documents that products take less than single sums; the
other postings are added up term by term. With the largest impact of each term of the
matrix in every ``WIDTH`` documents that lie together, the single sums bound a
document's score; blocks that cannot reach the k-th best are skipped, the others are
completed.

Sums in single precision choose candidates: of a shard, those above the k-th best sum
so far, in it or before it, less what rounding can take from a sum; rows that are
no result (the query's own) do not raise it. Candidates of a whole shard are scored in
double precision, every term in the same order, so equal texts score equal.
Shards use the global statistics, so the merge of their results is exact.

A block's search goes in waves over parts of the documents, picked by a digest of the
id, each ``STEP`` times the documents before it. After a wave its results are merged;
the k-th best of a query, score and id, is where the tasks of the next wave begin:
they send only what comes before it. A wave's tasks send about ``k * (STEP - 1)``
rows a query in all, however many they are; the first wave has ``TASKS`` at most.

A score is the sum over the distinct terms of the query of idf times the usual
saturated term frequency; terms are lower-case runs of letters, digits and
underscores, known by 64-bit hashes. Results are the ``k`` best rows with a score,
without the query's own id; ties go to the smaller id. Null and empty texts match
nothing; rows without an id take no part; rows repeated exactly count as rows, and are
returned once for each. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardwise.llm.common import per_batch
from wardwise.sources.tables import settle

WORD = re.compile(r"\w+")
APART = {c: " " for c in range(128) if not WORD.match(chr(c))}
K1, B = 1.2, 0.75
QUERIES, POSTINGS = 8192, 2_500_000  # of a block, on average; every shard is read once for each
DENSE, WIDTH, AT_ONCE, BLOCKS = 24, 64, 768, 8  # BLOCKS of WIDTH documents are completed at a time
SHARD, DOCS = 400_000, 8192  # postings and documents of a shard
LAYOUT, TOGETHER = 4, 8192  # shards that are laid out at a time, and documents a task has for it, at least
GROUPS, COMMON, ROUNDS = 8, 512, 4  # of documents laid out, the frequent terms they are told apart by, and how often
ALIKE, MIXED = 0.25, 0.3  # cosines of groups that are one, and of a document's second group to its first if it is between them
CELLS, SUMS = 4 << 20, 1 << 16  # of a matrix at most, and sums of rarer terms at a time
EVEN = 300  # a sum by itself takes as long as so many products of a matrix
FIRST, STEP, TASKS = 4096, 4, 4  # documents of the first wave, at least, unless there are fewer


def words(text: str) -> list[str]:
    """Terms in order; of plain texts without the expression, in less time."""
    text = text.lower()
    return text.translate(APART).split() if text.isascii() else WORD.findall(text)


def bags(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, length, terms, counts): 64-bit term hashes in order, as bytes, and 32-bit counts."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, terms, counts = [], [], []
        for text in batch.column("text"):
            found = Counter(words(text.as_py() or ""))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), "u8", len(found)).view("i8")
            order = np.argsort(hashes)
            lengths.append(found.total())
            terms.append(hashes[order].tobytes())
            counts.append(np.fromiter(found.values(), "i4", len(found))[order].tobytes())
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
            ["id", "length", "terms", "counts"],
        )

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(column).alias("text"))
    return rows.mapInArrow(per_batch(one), "id long, length long, terms binary, counts binary")


def _joined(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows one after another, and how many each row has."""
    parts = [np.frombuffer(b.as_buffer(), kind) for b in column]
    return np.concatenate(parts) if parts else np.empty(0, kind), np.array([len(p) for p in parts], "i8")


def frequencies(bagged: DataFrame) -> DataFrame:
    """(term, df). Terms are combined per shard before they move."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        term, df = np.unique(_joined(batch.column("terms"), "i8")[0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(term), pa.array(df.astype("i8"))], ["term", "df"])

    counted = bagged.select("terms").mapInArrow(per_batch(one), "term long, df long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"))


@dataclass
class Block:
    """Queries with their terms: ``vocabulary`` in order, ``starts`` into ``places``."""

    ids: np.ndarray
    starts: np.ndarray
    places: np.ndarray  # of each query's terms in the vocabulary
    vocabulary: np.ndarray
    idf: np.ndarray
    mean: float


def block_of(table: pa.Table, n: int, mean: float) -> Block:
    """From (id, term, df) rows."""
    ids, terms = table["id"].to_numpy(), table["term"].to_numpy()
    order = np.lexsort((terms, ids))
    ids, terms, df = ids[order], terms[order], table["df"].to_numpy()[order].astype("f8")
    vocabulary, first, places = np.unique(terms, return_index=True, return_inverse=True)
    queries, starts = np.unique(ids, return_index=True)
    idf = np.log(1 + (n - df[first] + 0.5) / (df[first] + 0.5))
    return Block(queries, np.append(starts, len(ids)), places, vocabulary, idf, mean)


@dataclass
class Inverted:
    """The postings of some documents, term by term; terms are in order."""

    ids: np.ndarray
    length: np.ndarray
    terms: np.ndarray
    sizes: np.ndarray  # postings of each term
    docs: np.ndarray
    counts: np.ndarray

    KINDS = ("i8", "i8", "i8", "i4", "u2")

    @classmethod
    def of(cls, bagged: pa.RecordBatch | pa.Table) -> Inverted:
        """One index of all rows."""
        return cls._sorted(bagged)[0]

    @classmethod
    def _sorted(cls, bagged: pa.RecordBatch | pa.Table) -> tuple[Inverted, np.ndarray]:
        """Also with the place of each posting's term."""
        terms, sizes = _joined(bagged.column("terms"), "i8")
        order = np.argsort(terms)
        terms = np.take(terms, order)
        docs = np.repeat(np.arange(len(sizes), dtype="u2"), sizes)[order]
        counts = np.take(_joined(bagged.column("counts"), "i4")[0], order)
        del order
        new = np.append(True, terms[1:] != terms[:-1])[: len(terms)]
        starts = np.flatnonzero(new)
        ids, length = bagged.column("id").to_numpy(), bagged.column("length").to_numpy()
        made = cls(ids, length, terms[starts], np.diff(np.append(starts, len(terms))).astype("i4"), docs, counts)
        return made, np.cumsum(new, dtype="i4") - np.int32(1)

    @classmethod
    def apart(cls, held: list[pa.RecordBatch]) -> Iterator[Inverted]:
        """Indexes of documents that share frequent terms, by length, of about ``SHARD`` postings or less each.

        What is held is given back before the first.
        """
        whole, place = cls._sorted(pa.Table.from_batches(held))
        held.clear()
        sizes = np.bincount(whole.docs, minlength=len(whole.ids))
        label = _groups(whole, place)
        order = np.lexsort((sizes, label))
        label, weight = label[order], _weights(sizes[order])
        whole_weight = np.bincount(label, weight)
        before = np.cumsum(weight) - weight - (np.cumsum(whole_weight) - whole_weight)[label]  # in its group
        piece = before * np.ceil(whole_weight / SHARD)[label] // whole_weight[label]
        cuts = np.flatnonzero((np.diff(label) != 0) | (np.diff(piece) != 0)) + 1
        new, shard = np.empty(len(order), "u2"), np.empty(len(order), "i4")
        for number, docs in enumerate(parts := np.split(order, cuts)):
            new[docs], shard[docs] = np.arange(len(docs)), number
        of_posting = shard[whole.docs]
        for number, docs in enumerate(parts):
            mine = np.flatnonzero(of_posting == number)
            held = np.bincount(place[mine], minlength=len(whole.terms))
            some = np.flatnonzero(held)
            yield cls(
                whole.ids[docs], whole.length[docs], whole.terms[some], held[some].astype("i4"),
                new[whole.docs[mine]], whole.counts[mine],
            )

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> Iterator[Inverted]:
        for row in zip(*batch.columns):
            made = cls(*(np.frombuffer(cell.as_buffer(), kind) for cell, kind in zip(row[:-1], cls.KINDS)), None)
            counts = row[-1].as_buffer()
            made.counts = np.frombuffer(counts, "u1" if counts.size == len(made.docs) else "i4")
            yield made

    def written(self) -> pa.RecordBatch:
        counts = self.counts.astype("u1" if self.counts.max(initial=0) < 256 else "i4")
        cells = (self.ids, self.length, self.terms, self.sizes, self.docs, counts)
        columns = [pa.array([cell.tobytes()], pa.binary()) for cell in cells]
        return pa.RecordBatch.from_arrays(columns, INVERTED.replace(" binary", "").split(", "))


INVERTED = "ids binary, length binary, terms binary, sizes binary, docs binary, counts binary"


def _groups(whole: Inverted, place: np.ndarray) -> np.ndarray:
    """A group for each document: by the most frequent term it has, then by the nearest mean of a group, a few times."""
    n = len(whole.ids)
    common = np.flatnonzero(whole.sizes > n / DENSE)
    common = common[np.argsort(-whole.sizes[common], kind="stable")][:COMMON]
    row = np.full(len(whole.terms), -1, "i2")
    row[common] = np.arange(len(common))
    asked = np.flatnonzero(row[place] >= 0)
    vectors = np.zeros((n, len(common)), "f4")
    vectors[whole.docs[asked], row[place[asked]]] = np.log(1 + n / whole.sizes[place[asked]])
    label, left = np.full(n, GROUPS - 1), np.ones(n, bool)
    for group in range(GROUPS - 1):
        if not left.any() or not len(common):
            break
        held = np.count_nonzero(vectors[left], 0)
        held[held > 0.9 * left.sum()] = 0  # what nearly all have tells nothing
        has = left & (vectors[:, held.argmax()] > 0)
        label[has] = group
        left &= ~has
    vectors /= np.maximum(np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), 1e-9)[:, None]
    for _ in range(ROUNDS):
        means = _means(vectors, label)
        label = (vectors @ means.T).argmax(1)
    alike = (means @ means.T > ALIKE).argmax(1)  # groups that differ little are one
    alike = alike[alike]
    near = vectors @ _means(vectors, alike[label]).T
    near.sort(1)
    label = alike[label]
    label[near[:, -2] > MIXED * near[:, -1]] = GROUPS
    return label


def _means(vectors: np.ndarray, label: np.ndarray) -> np.ndarray:
    means = (label == np.arange(GROUPS)[:, None]).astype("f4") @ vectors
    return means / np.maximum(np.sqrt((means**2).sum(1, keepdims=True)), 1e-9)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each start, as many as its size."""
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return at


class Shard:
    """The inverted index of some documents, for the terms of a block of queries."""

    def __init__(self, block: Block, made: Inverted | pa.RecordBatch):
        made = made if isinstance(made, Inverted) else Inverted.of(made)
        n, known = len(made.ids), len(block.vocabulary)
        at = np.searchsorted(block.vocabulary, made.terms)
        at[at == known] = 0
        asked = block.vocabulary[at] == made.terms if known else np.zeros(len(at), bool)
        posting = np.repeat(asked, made.sizes)
        docs, impact = made.docs[posting], made.counts[posting].astype("f8")
        place, sizes = at[asked], made.sizes[asked].astype("i8")
        low = (K1 * (1 - B + B * made.length / max(block.mean, 1e-9)))[docs]
        low += impact
        impact *= K1 + 1
        impact /= low
        impact *= np.repeat(block.idf[place], sizes)
        del posting, low
        starts = np.cumsum(sizes) - sizes
        self.n, self.ids, self.width = n, made.ids, -(-n // WIDTH) * WIDTH
        self.top = np.zeros(known, "f4")  # largest impact of each term
        if len(place):
            self.top[place] = np.maximum.reduceat(impact, starts)
        self.starts, self.sizes = np.zeros(known, "i8"), np.zeros(known, "i8")
        self.starts[place], self.sizes[place] = starts, sizes
        self.docs, self.impacts = docs, impact
        self.row = np.full(known, -1, "i4")
        self.by_doc = np.argsort(docs, kind="stable").astype("i4")  # for exact scores: terms in one order
        self.doc_starts = np.append(0, np.cumsum(np.bincount(docs, minlength=n)))
        self.places = np.repeat(place.astype("i4"), sizes)

    def bounds(self, block: Block) -> np.ndarray:
        """What no document's score for a query is above."""
        if not len(block.ids):
            return np.empty(0)
        return np.add.reduceat(np.take(self.top, block.places, mode="clip"), block.starts[:-1])

    def divide(self, places: np.ndarray, queries: int) -> None:
        """Keep those terms of some queries as a matrix that take longer one by one."""
        common = np.bincount(places, minlength=len(self.row)) * self.sizes
        dense = np.flatnonzero(common > queries * self.n / EVEN)
        if len(dense) > (most := CELLS // max(self.width, queries)):
            dense = np.sort(dense[np.argsort(-common[dense], kind="stable")[:most]])
        self.row[:] = -1
        self.row[dense] = np.arange(len(dense))
        sizes = self.sizes[dense]
        at = _ranges(self.starts[dense], sizes)
        cells = np.repeat(np.arange(len(dense)) * self.width, sizes)
        cells += np.take(self.docs, at, mode="clip")
        self.matrix = np.zeros((len(dense), self.width), "f4")
        self.matrix.reshape(-1)[cells] = np.take(self.impacts, at, mode="clip")
        self.largest = self.matrix.reshape(len(dense), -1, WIDTH).max(2)

    def rare(self, places: np.ndarray, query: np.ndarray, queries: int) -> np.ndarray:
        """What the rarer of these terms give each document, for each of some queries."""
        sums = np.empty((queries, self.width), "f4")
        asked = np.flatnonzero((self.sizes[places] > 0) & (self.row[places] < 0))
        query, starts, sizes = query[asked], self.starts[places[asked]], self.sizes[places[asked]]
        step = max(1, SUMS // self.width)
        for at in range(0, queries, step):
            part = slice(*np.searchsorted(query, (at, at + step)))
            some, postings = min(step, queries - at), _ranges(starts[part], sizes[part])
            cells = np.repeat((query[part] - at) * self.width, sizes[part])
            cells += np.take(self.docs, postings, mode="clip")
            given = np.take(self.impacts, postings, mode="clip")
            sums[at : at + some] = np.bincount(cells, given, some * self.width).reshape(some, -1)
        return sums

    def own(self, ids: np.ndarray) -> tuple[list[int], list[int]]:
        """(place in ``ids``, document) of all documents with one of these ids, which are in order."""
        at = np.searchsorted(ids, self.ids)
        at[at == len(ids)] = 0
        docs = np.flatnonzero(ids[at] == self.ids)
        return at[docs].tolist(), docs.tolist()

    def exact(self, doc: int, asked: np.ndarray) -> float:
        postings = self.by_doc[self.doc_starts[doc] : self.doc_starts[doc + 1]]
        return float(self.impacts[postings[asked[self.places[postings]]]].sum())


NONE = (0.0, float("-inf"))  # what every row with a score comes before


class Best:
    """The k best of each query so far; with ``ends``, those before its (-score, id)."""

    def __init__(self, block: Block, k: int, ends: list[tuple[float, float]] | None = None):
        self.block, self.k = block, k
        self.ends = ends or [NONE] * len(block.ids)
        self.least = np.array([-s for s, _ in self.ends])  # scores that are not above it are of no use, but for ties
        self.found: list[list[tuple[float, int]]] = [[] for _ in block.ids]  # (-score, id), in order
        self.asked = np.zeros(len(block.vocabulary), bool)

    def search(self, shard: Shard) -> None:
        # sums in single precision may fall short by this share, whatever their terms; nothing falls short of 0
        slack = (np.diff(self.block.starts) + 4) * np.finfo("f4").eps
        able = np.flatnonzero(shard.bounds(self.block) > self.least * (1 - slack))
        able = able[np.argsort(slack[able], kind="stable")]  # those of like length together
        for at in range(0, len(able), AT_ONCE):
            queries = np.sort(able[at : at + AT_ONCE])
            self._some(shard, queries, slack[queries, None])

    def _places(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the terms of some queries, and how many each has."""
        starts, sizes = self.block.starts[queries], self.block.starts[queries + 1] - self.block.starts[queries]
        return self.block.places[_ranges(starts, sizes)], sizes

    def _some(self, shard: Shard, queries: np.ndarray, slack: np.ndarray) -> None:
        places, sizes = self._places(queries)
        query = np.repeat(np.arange(len(queries)), sizes)
        shard.divide(places, len(queries))
        wanted = np.zeros((len(queries), len(shard.matrix)), "f4")
        rows = shard.row[places]
        wanted[query[rows >= 0], rows[rows >= 0]] = 1
        scores = shard.rare(places, query, len(queries))
        for i, doc in zip(*shard.own(self.block.ids[queries])):
            scores[i, doc] = -np.inf  # no result, whatever it scores
        least = (self.least[queries, None] * (1 - slack)).astype("f4")
        bounds = scores.reshape(len(queries), -1, WIDTH).max(2) + wanted @ shard.largest
        for b in range(0, bounds.shape[1], BLOCKS):
            able = bounds[:, b : b + BLOCKS] > least
            some, columns = able.any(1), able.any(0)
            if not some.any():
                continue
            # from the first block that some query needs to the last
            first = (b + columns.argmax()) * WIDTH
            last = (b + len(columns) - columns[::-1].argmax()) * WIDTH
            if some.all():
                scores[:, first:last] += wanted @ shard.matrix[:, first:last]
            else:
                scores[some, first:last] += wanted[some] @ shard.matrix[:, first:last]
        scores = scores[:, : shard.n]  # what was left out is not above ``least``
        some = np.flatnonzero(scores.max(1) > least[:, 0])
        scores, least, slack = scores[some], least[some], slack[some]
        many = np.flatnonzero(np.count_nonzero(scores > least, 1) > self.k)
        if len(many):
            # a sum that is too large by a share, and one that is too small by it
            kth = np.partition(scores[many], -self.k, 1)[:, -self.k, None]
            least[many] = np.maximum(least[many], kth * (1 - 3 * slack[many]))
        found, docs = np.nonzero(scores > least)
        ends = np.searchsorted(found, np.arange(len(some) + 1))
        for i in np.flatnonzero(np.diff(ends)).tolist():
            self._take(shard, queries[some[i]], docs[ends[i] : ends[i + 1]])

    def _take(self, shard: Shard, q: int, docs: np.ndarray) -> None:
        own = self.block.places[self.block.starts[q] : self.block.starts[q + 1]]
        self.asked[own] = True
        held = self.found[q]
        for doc in docs.tolist():
            row = (-shard.exact(doc, self.asked), int(shard.ids[doc]))
            if row < self.ends[q]:
                held.append(row)
        self.asked[own] = False
        held.sort()
        del held[self.k :]
        if len(held) == self.k:
            self.least[q] = -held[-1][0]


def top_k(df: DataFrame, is_query: Column, k: int = 10, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(query_id, rank, ``key``, score): the ``k`` best rows for each query row."""
    spark = df.sparkSession
    bagged = settle(bags(df, key, column))
    total = bagged.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    df_of = settle(frequencies(bagged))
    asking = bagged.where(F.coalesce(is_query, F.lit(False))) if key == "id" else bagged.withColumnRenamed("id", key).where(
        F.coalesce(is_query, F.lit(False))
    ).withColumnRenamed(key, "id")

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms, sizes = _joined(batch.column("terms"), "i8")
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column("id").to_numpy(), sizes)), pa.array(terms)], ["id", "term"]
        )

    terms = asking.select("id", "terms").mapInArrow(per_batch(listed), "id long, term long").distinct()
    asked = settle(terms.join(df_of, "term"))
    size = asked.agg(F.count("*").alias("n"), F.count_distinct("id").alias("q")).first()
    blocks = max(1, -(-size.q // QUERIES), -(-size.n // POSTINGS))
    asked = settle(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition("block"))
    parts, found = _waves(bagged, total.n), None
    for number in range(blocks):
        # bounded: about QUERIES queries and POSTINGS terms
        block = block_of(asked.where(F.col("block") == number).select("id", "term", "df").toArrow(), total.n, total.mean or 0.0)
        shared, best = spark.sparkContext.broadcast(block), None
        for part in parts:
            ends = spark.sparkContext.broadcast(None if best is None else _ends(block, best.where(F.col("rank") == k)))
            sent = part.mapInArrow(_searching(shared, ends, k), "query_id long, id long, score double")
            best = settle(_ranked(sent if best is None else best.drop("rank").unionAll(sent), k))
        found = best if found is None else found.unionAll(best)
    return found.select("query_id", "rank", F.col("id").alias(key), "score")


def _waves(bagged: DataFrame, n: int) -> list[DataFrame]:
    """Indexes of all rows in parts, the smaller first; they serve every block of queries."""
    steps = _steps(n)
    turn, parts = F.pmod(F.xxhash64("id"), F.lit(STEP**steps)), []
    for step in range(steps + 1):
        first, last = STEP ** (step - 1) if step else 0, STEP**step
        tasks = max(TASKS, n * (last - first) // STEP**steps // TOGETHER)
        part = bagged.where((turn >= first) & (turn < last)).coalesce(tasks)
        parts.append(settle(part.mapInArrow(_inverting, INVERTED)))
    return [parts[0].coalesce(TASKS), *parts[1:]]


def _steps(n: int) -> int:
    """How often ``n`` can be divided by ``STEP`` and leave ``FIRST``."""
    steps = 0
    while n >= FIRST * STEP ** (steps + 1):
        steps += 1
    return steps


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` best of each query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def _ends(block: Block, last: DataFrame) -> list[tuple[float, float]]:
    """(-score, id) of the last row of each query that has all its rows, ``NONE`` of the others; a row a query at most."""
    rows = last.select("query_id", "id", "score").toArrow()
    known = dict(zip(rows["query_id"].to_pylist(), zip((-s for s in rows["score"].to_pylist()), rows["id"].to_pylist())))
    return [known.get(q, NONE) for q in block.ids.tolist()]


def _weights(sizes: np.ndarray) -> np.ndarray:
    """Postings of documents, those of short ones counted as more: a shard has a bounded number of documents."""
    return np.maximum(sizes, -(-SHARD // DOCS))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Slices of about ``SHARD`` postings, or of one document with more; with their weight."""
    sizes = _weights(pc.binary_length(batch.column("terms")).to_numpy().astype("i8") // 8)
    shard = (np.cumsum(sizes) - sizes) // SHARD
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if end > start:
            yield batch.slice(start, end - start), int(sizes[start:end].sum())


def _inverting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for batch in batches:
        for part, more in _parts(batch):
            held.append(part)
            weight += more
            if weight >= LAYOUT * SHARD:
                yield from (made.written() for made in Inverted.apart(held))
                weight = 0
                pa.default_memory_pool().release_unused()
    if held:
        yield from (made.written() for made in Inverted.apart(held))


def _searching(shared, ends, k: int):
    def run(batches):
        best = Best(shared.value, k, ends.value)
        for batch in batches:
            for made in Inverted.read(batch) if len(best.block.ids) else ():
                best.search(Shard(best.block, made))
        rows = [(q, i, -s) for q, held in zip(best.block.ids.tolist(), best.found) for s, i in held]
        columns = zip(*rows) if rows else ([], [], [])
        kinds = (pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "id", "score"])

    return run

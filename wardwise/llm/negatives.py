"""Hard negatives by angular triangle filtering, on integer inner products.

For an anchor, its nearest rows of the same label are positives; hard negatives of
a pair are the nearest rows of other labels whose score lies in a window below the
positive's. Scores are inner products of whole-numbered vectors, so all comparisons
are exact.

Every vector is stored with its length and its angles to ``LINES`` reference
directions. Two vectors at angles ``a`` and ``b`` to a direction are at least
``|a - b|`` and at most ``a + b`` (and ``2 pi - a - b``) apart; the narrowest interval
over the directions, as cosines times both lengths, bounds their score. Bounds are
widened by far more than rounding can err. Of a shard's vectors, kept in the order of
their angles to each direction, an anchor looks at the shortest stretch that can
reach the scores it needs, and only those whose bounds meet them are scored:

1. positives: scores of a few vectors at about the anchor's angle give a floor;
2. negatives: the windows of all positives are known, so both ends count.

Vectors and labels of equal rows are searched once, as a group with its few smallest
ids: no more can be among an anchor's first. So a vector that a third of all rows
share moves as one row. Groups are dealt out in shards of ``SHARD``, anchors' groups
in blocks of ``BLOCK``; every shard meets every block of its label (1) or of its
dimension (2), so tasks are bounded and the work is anchors times rows, less what the
bounds leave out.

Rows without an id, label or vector, with a null or non-finite component, or with a
squared integer length of 2^56 or more (scores might not fit) take no part. Vectors
of unequal dimension do not meet. Rows repeated exactly count once; an id on
several different rows stands for each. Ties go to the smaller id. Other columns of
any name are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardwise.llm.common import per_batch
from wardwise.sources.tables import settle

LINES, SHARD, BLOCK = 16, 16384, 2048
TRIED = 64  # vectors that give the first floor
ANGLE, SCORE = 1e-7, 1e-9  # what bounds are widened by: radians, shares of the product of lengths
MOST = 2.0**56


def directions(dim: int) -> np.ndarray:
    """``LINES`` unit vectors of ``dim`` coordinates, fixed by the dimension."""
    draw = np.random.default_rng(dim)
    blocks = [np.linalg.qr(draw.normal(size=(dim, dim)))[0] for _ in range(-(-LINES // dim))]
    return np.concatenate(blocks, axis=1)[:, :LINES]


def angles_of(vectors: np.ndarray) -> np.ndarray:
    """Angles (vector, line) to the reference directions; a right angle for zero vectors."""
    vectors = vectors.astype("f8")
    length = np.sqrt((vectors * vectors).sum(1))
    return np.arccos(np.clip(vectors @ directions(vectors.shape[1]) / np.where(length > 0, length, 1)[:, None], -1, 1))


class Shard:
    """Vectors with their angles, in the order of each."""

    def __init__(self, vectors: np.ndarray, angles: np.ndarray, ids: np.ndarray):
        self.vectors, self.angles, self.ids = vectors.astype("f8"), angles.T, ids
        self.length = np.sqrt((self.vectors * self.vectors).sum(1))
        self.longest = self.length.max()
        self.order = np.argsort(self.angles, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.angles, self.order, 1)
        self.whole = vectors.astype("i8")

    def scores(self, places: np.ndarray, query: np.ndarray, length: float) -> np.ndarray:
        if length * self.longest < 2.0**52:  # no sum on the way is rounded
            return (self.vectors[places] @ query.astype("f8")).astype("i8")
        return self.whole[places] @ query

    def stretch(self, angles: np.ndarray, length: float, floor: float) -> np.ndarray:
        """Places that can score ``floor`` by their angle to one direction, the best of them."""
        reach = length * self.longest
        if floor <= SCORE * reach + 1:
            return self.order[0]
        wide = np.arccos(min(max((floor - 1) / reach - SCORE, -1.0), 1.0)) + 2 * ANGLE
        bounds = [line.searchsorted((a - wide, a + wide)) for line, a in zip(self.sorted, angles)]
        best = min(range(len(bounds)), key=lambda r: bounds[r][1] - bounds[r][0])
        return self.order[best][bounds[best][0] : bounds[best][1]]

    def bounds(self, places: np.ndarray, angles: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
        own, theirs, product = self.angles[:, places], angles[:, None], length * self.length[places]
        least = np.maximum(np.abs(own - theirs).max(0) - 2 * ANGLE, 0)
        total = own + theirs
        most = np.minimum(np.minimum(total, 2 * np.pi - total).min(0) + 2 * ANGLE, np.pi)
        slack = SCORE * product + 1
        return product * np.cos(most) - slack, product * np.cos(least) + slack

    def best(self, places: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Numbers of the ``k`` first by score, ties to the smaller id."""
        if len(scores) > k:
            some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        else:
            some = np.arange(len(scores))
        return some[np.lexsort((self.ids[places[some]], -scores[some]))[:k]]

    def nearest(self, query: np.ndarray, angles: np.ndarray, length: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores, how many were scored) of the ``k`` first."""
        n, scored = len(self.ids), 0
        places = self.order[0]
        if n > max(TRIED, k):
            at = max(min(self.sorted[0].searchsorted(angles[0]) - TRIED // 2, n - TRIED), 0)
            tried = self.scores(places[at : at + TRIED], query, length)
            scored, floor = TRIED, np.partition(tried, TRIED - k)[TRIED - k]
            places = self.stretch(angles, length, floor)
            places = places[self.bounds(places, angles, length)[1] >= floor]
        scores = self.scores(places, query, length)
        first = self.best(places, scores, k)
        return places[first], scores[first], scored + len(places)

    def between(self, query: np.ndarray, angles: np.ndarray, length: float, windows, other: np.ndarray, k: int):
        """For each (low, high): (places, scores) of the ``k`` first of ``other`` that score within; and how many were scored."""
        low, high = min(a for a, _ in windows), max(b for _, b in windows)
        places = self.stretch(angles, length, low)
        places = places[other[places]]
        least, most = self.bounds(places, angles, length)
        meets = np.zeros(len(places), bool)
        for a, b in windows:
            meets |= (most >= a) & (least <= b)
        places = places[meets]
        scores = self.scores(places, query, length)
        out = []
        for a, b in windows:
            some = np.flatnonzero((scores >= a) & (scores <= b))
            first = some[self.best(places[some], scores[some], k)]
            out.append((places[first], scores[first]))
        return out, len(places)


def rows_of(df: DataFrame, is_anchor: Column, scale: float, key: str, column: str, label: str) -> DataFrame:
    """(id, label, vector, asks): rows that take part, their components floored after scaling."""
    vector = F.transform(F.col(column), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    fits = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(column).isNotNull() & ~bad).select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), vector.alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )
    return fits.where(squares < MOST).withColumn("vector", F.col("vector").cast("array<int>"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int, kind: str) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), dim)


def groups_of(rows: DataFrame, few: int) -> DataFrame:
    """(g0, g1, dim, label, vector, ids, angles): equal vectors of a label, with their ``few`` smallest ids.

    Two 64-bit hashes stand for the group. Vectors without components count as one zero.
    """
    place = F.dense_rank().over(Window.partitionBy("vector", "label").orderBy("id"))
    smallest = rows.select("id", "label", "vector").withColumn("_r", place).where(F.col("_r") <= few)
    made = smallest.groupBy("vector", "label").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    made = made.select(*_names("vector", "label"), F.size("vector").alias("dim"), "label", "vector", "ids")
    schema = made.select("*", F.array(F.lit(0.0)).alias("angles")).schema

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        angles = np.zeros((batch.num_rows, LINES))
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            some = np.flatnonzero(dims == dim)
            angles[some] = angles_of(_matrix(batch.column("vector").take(pa.array(some)), dim, "f8")) if dim else np.pi / 2
        ends = pa.array(np.arange(0, angles.size + 1, LINES, dtype="i4"))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(angles.ravel()))], schema.names)

    return made.mapInArrow(per_batch(one), schema)


def _names(*columns: str) -> list[Column]:
    return [F.xxhash64(*columns).alias("g0"), F.xxhash64(F.lit(11), *columns).alias("g1")]


def _dealt(data: DataFrame, asked: DataFrame, space: list[str], task, schema: str) -> DataFrame:
    """``task`` over every shard of groups and every block of asking ones of its space."""
    sizes = data.groupBy(*space).agg(F.count("*").alias("_n"))
    blocks = asked.groupBy(*space).agg(F.count("*").alias("_q"))
    shape = settle(sizes.join(blocks, space).select(
        *space, F.ceil(F.col("_n") / SHARD).cast("int").alias("_shards"), F.ceil(F.col("_q") / BLOCK).cast("int").alias("_blocks")
    ))
    of, spread = [*space, "_shard", "_block"], F.xxhash64(F.lit(5), "g0", "g1")
    left = data.join(shape, space).withColumn("_shard", F.pmod(spread, F.col("_shards")).cast("int")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    ).drop("_shards", "_blocks")
    right = asked.join(shape, space).withColumn("_block", F.pmod(spread, F.col("_blocks")).cast("int")).withColumn(
        "_shard", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1))
    ).drop("_shards", "_blocks")
    right = right.select(*[F.col(c).alias(f"q_{c}") for c in right.columns])
    return left.groupBy(*of).cogroup(right.groupBy(*[f"q_{c}" for c in of])).applyInArrow(task, schema)


def _task(search, kinds: dict):
    """A cogroup function: ``search(shard, data, query row, query, angles, length)`` yields result rows."""

    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        rows = []
        if data.num_rows and asked.num_rows:
            dim = max(data["dim"][0].as_py(), 1)
            empty = not data["dim"][0].as_py()  # vectors without components: one zero each
            read = lambda c: np.zeros((len(c), 1), "i8") if empty else _matrix(c, dim, "i8")
            ids = data["ids"].combine_chunks().to_pylist()
            shard = Shard(read(data["vector"]), _matrix(data["angles"], LINES, "f8"), np.array([i[0] for i in ids]))
            queries, angles = read(asked["q_vector"]), _matrix(asked["q_angles"], LINES, "f8")
            lengths = np.sqrt((queries.astype("f8") ** 2).sum(1))
            labels = data["label"].to_numpy()
            names = [c for c in asked.column_names if c not in ("q_vector", "q_angles", "q_ids")]
            for row, q, a, n in zip(asked.select(names).to_pylist(), queries, angles, lengths.tolist()):
                rows += search(shard, labels, ids, data, row, q, a, n)
        columns = zip(*rows) if rows else [[] for _ in kinds]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds))

    return run


LONG, LONGS = pa.int64(), pa.list_(pa.int64())
POSITIVE = {"q0": LONG, "q1": LONG, "f0": LONG, "f1": LONG, "ids": LONGS, "score": LONG}
NEGATIVE = {"q0": LONG, "q1": LONG, "positive_score": LONG, "ids": LONGS, "score": LONG}


def positives(groups: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(q0, q1, f0, f1, id, score): the ``k`` first rows of its label of every asking group."""

    def search(shard, labels, ids, data, row, query, angles, length):
        places, scores, _ = shard.nearest(query, angles, length, k)
        named = data.select(["g0", "g1"]).take(pa.array(places)).to_pylist()
        for at, score, g in zip(places.tolist(), scores.tolist(), named):
            yield row["q_g0"], row["q_g1"], g["g0"], g["g1"], ids[at], score

    found = _dealt(
        groups, asked, ["dim", "label"], _task(search, POSITIVE),
        "q0 long, q1 long, f0 long, f1 long, ids array<long>, score long",
    )
    return _first(found.select("q0", "q1", "f0", "f1", F.explode("ids").alias("id"), "score"), ["q0", "q1"], ["id", "f0", "f1"], k).drop("rank")


def negatives(groups: DataFrame, asked: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """(q0, q1, positive_score, id, score, rank) for the ``wanted`` positive scores of asking groups."""

    def search(shard, labels, ids, data, row, query, angles, length):
        windows = {p: (-(-low * p // 100), high * p // 100) for p in row["q_wanted"]}
        windows = {p: w for p, w in windows.items() if w[0] <= w[1]}
        other = labels != row["q_label"]
        if windows and other.any():
            found, _ = shard.between(query, angles, length, list(windows.values()), other, k)
            for p, (places, scores) in zip(windows, found):
                for at, score in zip(places.tolist(), scores.tolist()):
                    yield row["q_g0"], row["q_g1"], p, ids[at], score

    found = _dealt(
        groups, asked, ["dim"], _task(search, NEGATIVE), "q0 long, q1 long, positive_score long, ids array<long>, score long"
    )
    rows = found.select("q0", "q1", "positive_score", F.explode("ids").alias("id"), "score")
    return _first(rows, ["q0", "q1", "positive_score"], ["id"], k)


def _first(rows: DataFrame, of: list[str], ties: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("score"), *ties))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def mined(
    df: DataFrame, is_anchor: Column, k_positive: int = 5, k_negative: int = 5, low: int = 80, high: int = 100,
    scale: float = 256.0, key: str = "vec_id", column: str = "embedding", label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    The first ``k_negative`` rows of other labels that score from ``low`` to ``high``
    hundredths of the positive's score, for each of an anchor's ``k_positive``.
    """
    rows = rows_of(df, is_anchor, scale, key, column, label)
    groups = settle(groups_of(rows, max(k_positive + 1, k_negative)))
    anchors = settle(rows.where("asks").select(F.col("id").alias("anchor_id"), *_names("vector", "label")).distinct())
    asked = groups.join(anchors.select("g0", "g1").distinct(), ["g0", "g1"], "left_semi")
    nearest = settle(positives(groups, asked, k_positive + 1))
    wanted = nearest.groupBy(F.col("q0").alias("g0"), F.col("q1").alias("g1")).agg(F.collect_set("score").alias("wanted"))
    hard = settle(negatives(groups, asked.join(wanted, ["g0", "g1"]), k_negative, low, high))
    own = (F.col("id") == F.col("anchor_id")) & (F.col("f0") == F.col("g0")) & (F.col("f1") == F.col("g1"))
    pairs = anchors.join(nearest, (F.col("g0") == F.col("q0")) & (F.col("g1") == F.col("q1"))).where(~own)
    few = _first(pairs, ["anchor_id", "g0", "g1"], ["id", "f0", "f1"], k_positive).select(
        "anchor_id", "g0", "g1", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    hard = hard.select(F.col("q0").alias("g0"), F.col("q1").alias("g1"), "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return few.join(hard, ["g0", "g1", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


ORACLE = """
with v as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), a as (select * from v where vec_id % 100 = 0),
s as (
  select a.vec_id as anchor_id, a.label = v.label as same, v.vec_id, list_inner_product(a.v, v.v)::bigint as score
  from a join v on len(a.v) = len(v.v) and a.vec_id <> v.vec_id
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id,
  row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::integer as rank,
  vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5
"""

"""Approximate nearest neighbours by collision counting, for the inner product.

Vectors are scaled to length one at most and given one more coordinate that makes
up the rest, queries to length one with a zero there: nearest then means largest
inner product. Each shard keeps, for each of ``LINES`` directions (orthonormal by
groups), its projections in one sorted array. A query counts in how many lines a
vector lies within its window, a window being centred on the query's own
projection. Windows widen by ``STEP`` (virtual rehashing: only what a window gains
is counted) until ``VERIFIED`` of the shard, and ``TIMES`` the wanted number, have
collided in ``COLLISIONS`` of the lines. All those are verified by their inner
products, in single precision first; what that cannot rule out is decided in
double precision on the original vectors.

Equal vectors are searched once. Of their ids only the ``k + 1`` smallest can be
among the ``k`` nearest of a query that leaves itself out, so a vector that a
third of all rows share moves as that many. Every distinct vector is indexed.
Shards hold ``SHARD`` vectors, and query blocks ``BLOCK``, so tasks are bounded.

Vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do rows without an id. Rows repeated exactly count once; an id with
several vectors stands for each. Vectors of unequal dimension do not meet. Ties
go to the smaller id. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wardwise.sources.tables import settle

LINES, SHARD, BLOCK = 64, 12288, 4096
FIRST, STEP = 1.4, 1.08  # of a projection's deviation
COLLISIONS, VERIFIED, TIMES = 0.8, 0.06, 10


def directions(dim: int) -> np.ndarray:
    """``LINES`` unit vectors of ``dim`` coordinates, fixed by the dimension."""
    draw = np.random.default_rng(dim)
    blocks = [np.linalg.qr(draw.normal(size=(dim, dim)))[0][:, :LINES] for _ in range(-(-LINES // dim))]
    return np.concatenate(blocks, axis=1)[:, :LINES].astype("f4")


class Lines:
    """A shard's sorted projections."""

    def __init__(self, vectors: np.ndarray, longest: float):
        self.vectors, self.short, self.longest = vectors, vectors.astype("f4"), longest
        unit = (vectors / longest).astype("f4")
        rest = np.sqrt(np.maximum(1 - (unit * unit).sum(1), 0))
        self.axes = directions(vectors.shape[1] + 1)
        projected = (np.column_stack([unit, rest]) @ self.axes).T
        self.order = np.argsort(projected, axis=1).astype("i4")
        self.sorted = np.take_along_axis(projected, self.order, 1)

    def candidates(self, center: np.ndarray, wanted: int) -> np.ndarray:
        """Places that collide often enough with a query at these projections."""
        n, most = len(self.vectors), int((1 - COLLISIONS) * LINES + 1e-9)
        width = FIRST / np.sqrt(len(self.axes))
        bounds: list[tuple[int, int]] = []

        def counted(slices) -> np.ndarray:
            return np.bincount(np.concatenate(list(slices)), minlength=n)

        while True:
            before, bounds = bounds, [
                line.searchsorted((c - width, c + width)).tolist() for line, c in zip(self.sorted, center)
            ]
            if before:
                misses -= counted(
                    part for order, (a, b), (low, high) in zip(self.order, before, bounds) for part in (order[low:a], order[b:high])
                )
            else:  # windows begin wide: what they leave out is less to count
                misses = counted(part for order, (low, high) in zip(self.order, bounds) for part in (order[:low], order[high:]))
            found = np.flatnonzero(misses <= most)
            if len(found) >= min(n, TIMES * wanted + VERIFIED * n) or len(found) == n:
                return found
            width *= STEP

    def nearest(self, queries: np.ndarray, k: int, ids: np.ndarray):
        """Per query (places, scores) of the ``k`` best, ties to the smaller id."""
        units = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        centers = np.column_stack([units, np.zeros(len(units))]).astype("f4") @ self.axes
        for query, center in zip(queries, centers):
            found = self.candidates(center, k)
            if len(found) > k:
                rough = self.short[found] @ query.astype("f4")
                bound = np.partition(rough, len(rough) - k)[len(rough) - k]
                slack = 1e-5 * self.longest * np.linalg.norm(query)  # far above what single precision can err
                found = found[rough >= bound - slack]
            scores = (self.vectors[found] * query).sum(1)
            best = np.lexsort((ids[found], -scores))[:k]
            yield found[best], scores[best]


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and of finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def distinct_vectors(valid: DataFrame, k: int) -> DataFrame:
    """(vector, rep, ids, dim): distinct vectors with their ``k + 1`` smallest ids."""
    place = F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))
    few = valid.select("id", "vector").withColumn("_r", place).where(F.col("_r") <= k + 1)
    return few.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(
        "vector", F.col("ids")[0].alias("rep"), "ids", F.size("vector").alias("dim")
    )


def _search(k: int):
    def run(key, data: pa.Table, asked: pa.Table) -> pa.Table:
        names, kinds = ["query_rep", "ids", "score"], [pa.int64(), pa.list_(pa.int64()), pa.float64()]
        if not data.num_rows or not asked.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds)})
        dim = key[0].as_py()
        matrix = lambda column: column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)
        reps, lists = data["rep"].to_numpy(), data["ids"].combine_chunks()
        lines = Lines(matrix(data["vector"]), data["longest"][0].as_py())
        places, scores, counts = [], [], []
        for found, values in lines.nearest(matrix(asked["q_vector"]), k + 1, reps):
            places.append(found), scores.append(values), counts.append(len(found))
        return pa.table([
            pa.array(np.repeat(asked["q_rep"].to_numpy(), counts)), lists.take(pa.array(np.concatenate(places))),
            pa.array(np.concatenate(scores)),
        ], names).cast(pa.schema(list(zip(names, kinds))))

    return run


def nearest(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, ``key``, score): the ``k`` nearest found of each query row."""
    valid = df.select(F.col(key).cast("long").alias("id"), F.col(column).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    valid = valid.where(F.col("id").isNotNull() & usable(F.col("vector")))
    reps = settle(distinct_vectors(valid, k))
    asked = settle(
        valid.where("asks").select("id", "vector").join(reps.select("vector", "rep"), "vector").select("id", "rep").distinct()
    )
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sizes = reps.groupBy("dim").agg(F.count("*").alias("n"), F.max(length).alias("longest"))
    blocks = asked.select("rep").distinct().join(reps, "rep").groupBy("dim").agg(F.count("*").alias("q"))
    shape = settle(sizes.join(blocks, "dim").select(
        "dim", "longest", F.ceil(F.col("n") / SHARD).cast("int").alias("shards"), F.ceil(F.col("q") / BLOCK).cast("int").alias("blocks")
    ))
    placed = reps.join(shape, "dim")
    of = ["dim", "shard", "block"]
    data = placed.withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).select(*of, "rep", "ids", "vector", "longest")
    queries = placed.join(asked.select("rep").distinct(), "rep", "left_semi").withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    ).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(*[F.col(c).alias(f"q_{c}") for c in (*of, "rep", "vector")])
    found = data.groupBy(*of).cogroup(queries.groupBy(*[f"q_{c}" for c in of])).applyInArrow(
        _search(k), "query_rep long, ids array<long>, score double"
    )
    best = F.row_number().over(Window.partitionBy("query_rep").orderBy(F.desc("score"), "id"))
    few = settle(found.select("query_rep", "score", F.explode("ids").alias("id")).withColumn("_n", best).where(F.col("_n") <= k + 1).drop("_n"))
    pairs = asked.select(F.col("id").alias("query_id"), F.col("rep").alias("query_rep")).join(few, "query_rep").where("id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")

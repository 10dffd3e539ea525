"""What the operators share: loading, shipping the package, written steps."""

from __future__ import annotations

import gc
import os
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


BATCH_BYTES = 8 << 20


def importable(spark: SparkSession) -> None:
    """Let Python workers on this installation path import the package, in batches of bounded size.

    A cluster has it installed or shipped with ``--py-files``; this covers a
    session that was started from another folder. Batches of texts are bounded by
    bytes, as thousands of long ones are far more than a worker needs at once.
    """
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(batch).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(batch, str(BATCH_BYTES))
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, have]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(column: str, parts: int):
    """crc32 of the id's decimal text, modulo ``parts``: the fold of a row."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """A ``mapInArrow`` function from one that maps a single batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        LOADED.leave(fn.__module__)
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return run


class Memo(dict):
    """Bounded memory of computed values: two generations, the older is dropped.

    Only saves work; a value that was dropped is computed again. What is
    remembered is looked up as in any dictionary.
    """

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Loaded:
    """A few heavy read-only objects per worker process, by key.

    A key's first part names its operator. Workers outlive a stage; when another
    operator's objects are loaded, the former one's are given back first.
    """

    def __init__(self, limit: int = 4):
        self.limit, self.held = limit, OrderedDict()

    def leave(self, operator: str) -> None:
        """Give back what other operators have loaded."""
        if any(k[0] != operator for k in self.held):
            self.held.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()

    def get(self, key: tuple, make: Callable):
        self.leave(key[0])
        if key not in self.held:
            while len(self.held) >= self.limit:
                self.held.popitem(last=False)
            self.held[key] = make()
        return self.held[key]


LOADED = Loaded()

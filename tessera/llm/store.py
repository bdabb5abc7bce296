"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: a lost executor
costs only the tasks it ran, never a whole chain of stages.  Tables that a result
still reads go when the application ends, all others as soon as they can.
"""

from __future__ import annotations

import contextlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, scratch_folder


class Scratch:
    """Tables of one operator run; ``drop`` removes those not named in ``keep``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = scratch_folder(spark, name)
        self.names: list[str] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *keep: str) -> None:
        for name in self.names:
            if name not in keep:
                delete(self.spark, f"{self.path}/{name}")
        self.names = [x for x in self.names if x in keep]


def release() -> None:
    """Gives freed memory back to the system, where the C library can: workers live on after a task, beside the next stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """A function for mapInArrow that releases memory at the end of its partition."""

    def own(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return own


#: Bytes of one Arrow batch between the JVM and a Python worker: bounds what both hold beside their heaps.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit for an Arrow batch where it is above BATCH_BYTES (texts can be long)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, f"{64 << 20}b").lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    if int(now.rstrip("kmg")) << unit > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def fold(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones (of any name) never clash."""
    bound_batches(docs.sparkSession)
    return docs.select(*[docs[f"`{c}`"] for c in columns])


#: Rows of a few numbers that may be broadcast (under 20 MB); larger tables are joined by a shuffle.
SMALL_ROWS = 300_000


def if_small(df: DataFrame) -> DataFrame:
    """Marks a written, narrow table for broadcasting if a count shows that it is small."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


#: Bits of a Bloom filter at most (64 MB).  It has 128 for each key and tests four: about one other key in a million passes.
BITS = 1 << 29
_PER_KEY, _SHIFTS = 128, (0, 17, 31, 35)
_PAGE = 1 << 15  # bits in one group of bitmap_construct_agg


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of 64-bit hashes, sized by their number.

    It only spares work: what passes by shared bits is for a join to drop.  From
    about four million keys on it stops growing (every worker holds it) and lets more
    pass.
    """
    count = keys.count()
    bits = _PAGE
    while bits < min(_PER_KEY * count, BITS):
        bits *= 2
    at = F.explode(F.array(*[F.shiftrightunsigned(F.col(column), s).bitwiseAND(F.lit(bits - 1).cast("long")) for s in _SHIFTS]))
    pages = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / _PAGE).cast("int").alias("page"))
    out = np.zeros(bits // 8, np.uint8)
    size = _PAGE // 8
    for r in pages.agg(F.expr(f"bitmap_construct_agg(at % {_PAGE})").alias("bits")).toLocalIterator():
        out[r["page"] * size : (r["page"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the uint64 keys all of whose bits are set."""
    places, mask = np.arange(len(keys)), np.uint64(8 * len(bits) - 1)
    for s in _SHIFTS:
        at = (keys >> np.uint64(s)) & mask
        on = np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
        places, keys = places[on], keys[on]
    return places

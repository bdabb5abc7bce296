"""Best-fit-decreasing packing of token sequences.

Documents longer than a sequence are cut into full sequences, the first piece
taking the remainder.  Best-fit decreasing only sees lengths, and there are at
most ``capacity`` of them, so the driver packs the histogram of lengths: a
segment tree over remaining capacities finds the tightest open bin in
logarithmic time, and a run of equal lengths moves whole ranges of equal bins at
once.  The outcome is that of placing the documents one by one; its size depends
on the capacity, not on the corpus.  Executors then place each piece by its rank
among the pieces of its length.

Nulls, empties, repeats: a null or empty text is the end id alone; repeated ids
are separate pieces; an empty table packs into no sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Scratch, fold, trimmed
from .tokens import blocks_of, encoder


class CapacityTree:
    """Which remaining capacities have open bins; finds the least one >= a length."""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.on = [False] * (2 * self.n)

    def set(self, at: int, on: bool) -> None:
        i = at + self.n
        self.on[i] = on
        while i > 1:
            i //= 2
            self.on[i] = self.on[2 * i] or self.on[2 * i + 1]

    def least_from(self, at: int) -> int | None:
        i = at + self.n
        if self.on[i]:
            return at
        while i > 1:
            if i % 2 == 0 and self.on[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.on[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return None


def plan(lengths: Iterable[tuple[int, int]], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over (length, count) pairs.

    Returns rows (length, first rank, first sequence, pieces per sequence, offset)
    and the number of sequences: the piece of rank q of that length goes to
    sequence first + (q - rank) // per at offset + (q - rank) % per * length.
    """
    tree, open_bins, rows, bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)], [], 0

    def keep(left: int, lo: int, hi: int) -> None:
        if left and hi > lo:
            open_bins[left].append((lo, hi))
            tree.set(left, True)

    for size, count in sorted(lengths, reverse=True):
        rank = 0
        while rank < count:
            left = tree.least_from(size)
            if left is None:  # none fits: open as many as the rest of this length needs
                left, per = capacity, capacity // size
                lo, hi = bins, bins + -(-(count - rank) // per)
                bins = hi
            else:
                per = left // size
                lo, hi = open_bins[left].pop()
                tree.set(left, bool(open_bins[left]))
            full = min(hi - lo, (count - rank) // per)
            rows.append((size, rank, lo, per, capacity - left))
            rank += full * per
            keep(left - per * size, lo, lo + full)
            lo += full
            if lo < hi and rank < count:  # the last bin of this length takes the rest
                keep(left - (count - rank) * size, lo, lo + 1)
                rank, lo = count, lo + 1
            keep(left, lo, hi)
    return np.array(rows, np.int64).reshape(-1, 5), bins


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: the first is the remainder."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return list(zip(starts, [first] + [capacity] * (len(starts) - 1), strict=True))


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            doc, texts, rows = batch.column(0).to_pylist(), batch.column(1), []
            for a, b in blocks_of(texts):
                values, offsets = enc.encode_block(texts.slice(a, b - a), end_id)
                for d, x, y in zip(doc[a:b], offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    rows += [(d, k, s, n, zlib.crc32(values[x + s : x + s + n])) for k, (s, n) in enumerate(cut(y - x, capacity))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    src = fold(docs, id_col, text_col).select(F.col(id_col).cast("long"), F.col(text_col))
    return src.mapInArrow(trimmed(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def shares_of(counts: list[tuple[int, int]], partitions: int, most: int = 1_000_000) -> dict[int, int]:
    """How many shares the pieces of each length are dealt to: none holds more than an eighth of an even task's pieces, nor ``most``."""
    total = sum(n for _, n in counts)
    each = max(1, min(most, total // (8 * max(1, partitions))))
    return {size: -(-n // each) for size, n in counts}


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...).

    A piece's rank among those of its length is counted in hashed shares, whose
    number follows from the counts, so that a length with a third of all pieces is
    no single task's work.
    """
    counts = [(int(r["length"]), int(r["n"])) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()]  # at most `capacity` rows
    table, _ = plan(counts, capacity)
    of = {int(s): table[table[:, 0] == s] for s in np.unique(table[:, 0])}
    shares = shares_of(counts, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    listed = F.array(*[F.lit(shares.get(i, 1)) for i in range(1, capacity + 1)])
    pieces = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(listed, F.col("length").cast("int"))).cast("int"))
    totals = pieces.groupBy("length", "share").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(inside) - 1).join(totals, ["length", "share"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("share", "base")
    names = ranked.columns

    def run(batches):
        for batch in batches:
            size, rank = (batch.column(names.index(c)).to_numpy() for c in ("length", "rank"))
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                on = np.flatnonzero(size == s)
                t = of[int(s)]
                hit = t[np.searchsorted(t[:, 1], rank[on], side="right") - 1]
                step = rank[on] - hit[:, 1]
                seq[on] = hit[:, 2] + step // hit[:, 3]
                off[on] = hit[:, 4] + step % hit[:, 3] * s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.mapInArrow(trimmed(run), f"{schema}, sequence_id long, offset long").drop("rank")


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Texts are encoded once; the pieces (no ids) are written to the shared folder,
    and all later passes read those.
    """
    pieces = Scratch(spark, "packing").save(token_pieces(docs, vocabulary, end_id, capacity, id_col, text_col), "pieces")
    return place(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

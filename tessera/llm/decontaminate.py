"""Benchmark decontamination by a prefix-filtered set join.

Every run of ``window`` consecutive item words (an item with fewer words: the
item) is a window, and a window is the set of its ``width``-word shingles.  To be
contained in a document all shingles must occur, so under any fixed order one
shingle is a sufficient prefix; shingles are ordered by document frequency over
the whole corpus and the rarest is taken.  Documents are scanned for prefix
shingles, places are joined on them, the shingle's place in the window gives the
one possible start (positional bound), which must leave room for the window
(length bound).  The candidates of a document then meet its text, and the
item-sized run of document words is compared word by word.

The scan consults a bitmap of the prefix shingles; false positives fall to the
join, so the size of the benchmark changes no result.  A place travels as a hash
and a position; a text travels once, if its document has a candidate.

Nulls, empties, repeats: a null text has no words.  Repeated rows each get their
(equal) result; a repeated id with another text is a row of its own.  An item
without words has no window; repeated items count by distinct item id; an item
without an id is counted as none.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytes_np import ALNUM, chunks, windows, words
from .store import Scratch, bitmap, fold, if_small, in_bitmap, trimmed


def _shingles(texts: list[bytes | None], widths: list[int]):
    """For each width: (width, word arrays, shingle hashes as int64, first word of each)."""
    buf, starts, ends, doc, h = words(texts, ALNUM)
    return buf, starts, ends, doc, [(w, windows(h, doc, w)) for w in widths]


def item_windows(items: DataFrame, window: int, width: int) -> DataFrame:
    """(item_id, words, size, shingles, width): one row for each window of each item; its words are joined by spaces."""

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for i, t in zip(ids, batch.column(1).to_pylist(), strict=True):
                if i is None:
                    continue
                buf, starts, ends, doc, h = words([t], ALNUM)
                low, n = buf.tobytes().lower(), len(starts)
                w = [low[a:b] for a, b in zip(starts, ends, strict=True)]
                size = min(n, window)
                if n:
                    k = min(size, width)
                    sh = windows(h, doc, k)[0].view(np.int64)
                    out += [(i, b" ".join(w[a : a + size]), size, sh[a : a + size - k + 1].tolist(), k) for a in range(n - size + 1)]
            for at in range(0, len(out), 10_000):
                cols = list(zip(*out[at : at + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.int32()), strict=True)], ["item_id", "words", "size", "shingles", "width"])

    return items.mapInArrow(trimmed(run), "item_id long, words binary, size int, shingles array<long>, width int")


def document_frequency(spark: SparkSession, docs: DataFrame, bits, widths: list[int]) -> DataFrame:
    """(shingle, n): how many documents hold each shingle whose bit is set."""
    shared = spark.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                _, _, _, doc, found = _shingles(texts[a:b], widths)
                for _, (h, at) in found:
                    on = in_bitmap(shared.value, h)
                    own = np.unique(np.stack([h[on], doc[at[on]].astype(np.uint64)]), axis=1)[0]
                    keys, n = np.unique(own, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])

    return docs.mapInArrow(trimmed(run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _scan(docs: DataFrame, bits, widths: list[int]) -> DataFrame:
    """Per document row: doc_id, text_hash, n_words, its places (shingle, first word), and its text if it has any."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    kinds = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("shingles", pa.list_(pa.int64())), ("at", pa.list_(pa.int64())), ("text", pa.binary())]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                _, _, _, doc, found = _shingles(texts[a:b], widths)
                count = np.bincount(doc, minlength=b - a)
                begin = np.concatenate([[0], np.cumsum(count)])
                own, keys, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for _, (h, at) in found:
                    on = in_bitmap(shared.value, h)
                    own.append(doc[at[on]])
                    keys.append(h[on].view(np.int64))
                    places.append(at[on] - begin[own[-1]])
                order = np.argsort(np.concatenate(own), kind="stable")
                ends = np.searchsorted(np.concatenate(own)[order], np.arange(b - a + 1)).astype(np.int32)
                listed = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x)[order])) for x in (keys, places)]
                kept = pa.array([t if n else None for t, n in zip(texts[a:b], np.diff(ends), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(count.astype(np.int64)), *listed, kept], schema=pa.schema(kinds))

    return docs.mapInArrow(trimmed(run), "doc_id long, text_hash long, n_words long, shingles array<long>, at array<long>, text binary")


def _verify(texts: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_hit, words: the windows that occur) from text and candidates (array of start, size, words)."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                text, candidates = batch.column(2)[row].as_py(), batch.column(3)[row].as_py()
                buf, starts, ends, _, _ = words([text], ALNUM, need_hash=False)
                low = buf.tobytes().lower()
                own = [low[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                hit, seen = np.zeros(len(own), bool), set()
                for c in candidates:
                    a, z = c["start"], c["start"] + c["size"]
                    if b" ".join(own[a:z]) == c["words"]:
                        hit[a:z] = True
                        seen.add(c["words"])
                if seen:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array([int(hit.sum())]), pa.array([sorted(seen)], pa.list_(pa.binary()))], ["doc_id", "text_hash", "n_hit", "words"])

    return texts.mapInArrow(trimmed(run), "doc_id long, text_hash long, n_hit long, words array<binary>")


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 13, width: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, text_hash, n_words, n_hit, n_items, items (array of strings, sorted)."""
    scratch = Scratch(spark, "decontaminate")
    src = fold(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("text_hash"))
    items = fold(benchmark, item_col, item_text_col).select(F.col(item_col).cast("long"), F.col(item_text_col).cast("binary"))
    every = scratch.save(item_windows(items, window, width), "windows")
    widths = sorted(r["width"] for r in every.select("width").distinct().collect())  # 1 to `width`
    shingles = scratch.save(every.select(F.explode("shingles").alias("shingle")).distinct(), "shingles")
    counts = document_frequency(spark, src, bitmap(shingles, "shingle"), widths)
    counts = scratch.save(shingles.join(counts, "shingle", "left").select("shingle", F.coalesce("n", F.lit(0)).alias("n")), "counts")
    distinct = scratch.save(every.groupBy("words").agg(F.first("shingles").alias("shingles"), F.first("size").alias("size")), "distinct")
    placed = distinct.select("words", "size", F.posexplode("shingles").alias("offset", "shingle")).join(if_small(counts), "shingle")
    # A shingle in no document rules its window out; of the rest the rarest, then the first, is the prefix.
    rarest = placed.groupBy("words", "size").agg(F.min(F.struct("n", "offset", "shingle")).alias("best")).filter("best.n > 0")
    prefix = scratch.save(rarest.select("words", "size", "best.shingle", F.col("best.offset").alias("offset")), "prefix")
    scanned = scratch.save(_scan(src, bitmap(prefix, "shingle"), widths), "scanned")
    own = ["doc_id", "text_hash"]
    found = scanned.filter(F.size("at") > 0).select(*own, "n_words", F.explode(F.arrays_zip("shingles", "at")).alias("c")).select(*own, "n_words", F.col("c.shingles").alias("shingle"), F.col("c.at").alias("at")).join(if_small(prefix), "shingle")
    found = found.withColumn("start", F.col("at") - F.col("offset")).filter("start >= 0 AND start + size <= n_words")
    found = found.groupBy(*own).agg(F.collect_set(F.struct("start", "size", "words")).alias("candidates"))  # one document's
    found = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "candidates")
    texts = scanned.filter("text is not null").select(*own, "text").dropDuplicates(own)
    met = texts.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select(*own, "text", "candidates")
    hits = scratch.save(_verify(met), "hits")
    of = hits.select(*own, F.explode("words").alias("words")).join(every.select("words", F.col("item_id").cast("string").alias("item")).distinct(), "words").groupBy(*own).agg(F.array_sort(F.collect_set("item")).alias("items"))
    of = of.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "items")
    both = hits.join(of, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("d", "h", "n_hit", "items")
    both = scratch.save(both, "both")
    scratch.drop("scanned", "both")
    all_docs = scanned.select(*own, "n_words").join(both, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    empty = F.array().cast("array<string>")
    items_of = F.coalesce("items", empty)
    return all_docs.select(*own, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"))


def is_contaminated(n_hit, n_words):
    """The contract's rule: some hit, and hit words at least a twentieth of all."""
    return (n_hit > 0) & (20 * n_hit >= n_words)

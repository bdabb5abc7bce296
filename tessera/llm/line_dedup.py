"""Line deduplication across documents.

Lines are exploded to (key hash, document) pairs; keys found in at least
``min_docs`` documents lose all their lines except in the largest document id
holding them, and documents are put together again by position.  Only hashes
travel until then: a document's text moves once, to meet its list of keys to
drop.  Keys are 128-bit hashes; a frequent key held by a third of all documents is
counted map-side first, and its join is a plain equi-join that adaptive execution
splits.

Nulls, empties, repeats: a null or empty text is one empty line.  Rows that share
a document id count as one document.  A row without an id counts as no document:
it never saves a line, and loses its frequent ones; such rows are told apart by a
hash of their text.  An empty table gives an
empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, fold, trimmed

#: The bytes stripped at both ends of a line.
SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the normalised line, or None if it is too short to be a key."""
    key = line.strip(SPACE)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())  # bytes.lower folds A-Z only


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows, keys = batch.slice(at, 512), [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    own = {line_key(x, min_chars) for x in (t or b"").split(b"\n")}
                    own.discard(None)
                    keys += own
                    rows += [i] * len(own)
                rows = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), part.column(0).take(rows), part.column(2).take(rows)], ["key", "doc_id", "row"])

    return docs.mapInArrow(trimmed(run), "key binary, doc_id long, row long")


def _rebuild(docs: DataFrame, min_chars: int, carry: tuple[str, ...]) -> DataFrame:
    names = ["doc_id", "kept", "n_lines", "n_dropped", *carry]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, kept, lines, lost = batch.slice(at, 512), [], [], []
                for t, drop in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    all_lines = (t or b"").split(b"\n")
                    gone = set(drop or ())
                    stay = [x for x in all_lines if line_key(x, min_chars) not in gone] if gone else all_lines
                    kept.append(b"\n".join(stay))
                    lines.append(len(all_lines))
                    lost.append(len(all_lines) - len(stay))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), pa.array(lines, pa.int64()), pa.array(lost, pa.int64()), *part.columns[3:]], names)

    kinds = "".join(f", `{c}` {docs.schema[f'carried_{c}'].dataType.simpleString()}" for c in carry)
    return docs.mapInArrow(trimmed(run), f"doc_id long, kept binary, n_lines long, n_dropped long{kinds}")


def dedup_lines(spark: SparkSession, docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, kept (binary, UTF-8), n_lines, n_dropped, and the columns of ``carry``."""
    scratch = Scratch(spark, "line-dedup")
    carried = [f"carried_{c}" for c in carry]
    src = fold(docs, id_col, text_col, *carry).toDF("doc_id", "text", *carried).withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("binary")})
    src = src.withColumn("row", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long")))
    pairs = _keys(src.select("doc_id", "text", "row"), min_chars)
    # Rows bound documents from above: what is rarer than min_docs by rows needs no exact count.
    often = scratch.save(pairs.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("key"), "often")
    hits = scratch.save(pairs.join(often, "key").distinct(), "hits")
    frequent = hits.groupBy("key").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("holder")).filter(F.col("n") >= min_docs)
    frequent = scratch.save(frequent.select("key", "holder"), "frequent")
    lost = hits.join(frequent, "key").filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
    drops = scratch.save(lost.groupBy("doc_id", "row").agg(F.collect_list("key").alias("drop")), "drops").toDF("d", "r", "drop")
    scratch.drop("drops")
    joined = src.join(drops, src.doc_id.eqNullSafe(drops.d) & (src.row == drops.r), "left").select("doc_id", "text", "drop", *carried)
    return _rebuild(joined, min_chars, carry)

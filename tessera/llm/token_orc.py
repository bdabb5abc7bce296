"""Token-ID output as ORC.

Documents are range-partitioned and sorted by id, encoded, and written as one
ORC file per partition: the ids of a document are one ``array<int>`` whose values
ORC stores with integer run-length encoding, beside its row number in the file.  Row indexes and a Bloom filter on
the document id let a point lookup skip stripes and row groups; a stripe is the
unit of parallel reading.

Nulls, empties, repeats: a null text is an empty one (only the end id); a null
document id sorts first; repeated ids stay as separate rows, ordered by text, and
their starts follow the rows of the file; an empty table gives an empty result.  Extra columns of the input are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Scratch, fold, trimmed
from .tokens import blocks_of, encoder


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, ids): the text's token ids and ``end_id``, in the order of the input's rows, numbered in each partition."""

    def run(batches):
        enc, done = encoder(vocabulary), 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in blocks_of(texts):
                values, offsets = enc.encode_block(texts.slice(a, b - a), end_id)
                row, done = pa.array(np.arange(done, done + b - a)), done + b - a
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), row, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view("<i4")))], ["doc_id", "row", "ids"])

    return fold(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "doc_id long, row long, ids array<int>")


def write_token_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 64 << 20, row_stride: int = 10_000) -> None:
    """Writes the ids of all documents below ``path``, ascending by id over all files."""
    placed = fold(docs, id_col, text_col).repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col, text_col)
    (
        encode_documents(placed, vocabulary, end_id, id_col, text_col)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, row, ids) from the files; given ids are pushed down to stripe and row-group metadata."""
    df = spark.read.schema("doc_id long, row long, ids array<int>").orc(path)
    return df if doc_ids is None else df.filter(F.col("doc_id").isin(doc_ids))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Files follow each other in ascending ids, so a document's start is the sum of
    the files before its own (one row a file) and a running sum inside the file.
    """

    def run(batches):
        for batch in batches:
            part, doc, row, ids = batch.columns
            at, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part, doc, row, pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["part", "doc_id", "row", "n_tokens", "ids_crc32"])

    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    rows = read_token_ids(spark, path).select(part.alias("part"), "doc_id", "row", "ids").mapInArrow(trimmed(run), "part int, doc_id long, row long, n_tokens long, ids_crc32 long")
    rows = Scratch(spark, "token-index").save(rows, "rows")  # the ids are read once
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("run", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(files, "part").select("doc_id", (F.col("base") + F.col("run")).alias("start"), "n_tokens", "ids_crc32")

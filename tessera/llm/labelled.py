"""Bounded samples of labelled documents, drawn by a hash of the document id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fold


def held_out(doc_id, share: int = 5, rest: int = 0) -> Column:
    """True for the part of documents that nothing may be learned from: crc32 of the id's text mod ``share`` is ``rest``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % share == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, sample: int, id_col: str = "doc_id", text_col: str = "text", share: int = 5, rest: int = 0) -> DataFrame:
    """(doc_id, label, text): about ``sample`` labelled documents that aren't held out, at most twice as many."""
    known = fold(labels, id_col, label_col).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", share, rest))
    rate = sample / max(1, known.count())
    draw = F.pmod(F.xxhash64("doc_id", F.lit(label_col)), F.lit(1 << 40)) / float(1 << 40)
    drawn = known.filter(draw < rate).limit(2 * sample)
    texts = fold(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "label", "text")  # 2 * sample rows of two numbers at most

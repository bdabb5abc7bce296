"""A training-corpus pipeline over ``documents``: five stages, each one operator.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it
kept, and returns a DataFrame that is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of ``documents``.

Learned stages cannot be expressed in SQL, so ORACLE_SQL is None and the tests
compare every stage with a brute-force version.

Nulls, empties, repeats: rows are judged by id and text.  A row without an id is a
document like any other; rows that share an id are one document to the line counts
and each its own to every other stage.  Null, empty and blank texts have no language
and go in the first stage; where one is left (its lines went), it is no duplicate of
anything and holds no passage.  Of exact repeats one row stays.  Empty tables pass
through all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import contamination, is_contaminated
from tessera.llm.labelled import held_out
from tessera.llm.language_id import UNKNOWN, fit, identify
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.near_dup import near_groups
from tessera.llm.packing import pack
from tessera.llm.store import Scratch, if_small
from tessera.llm.tokens import public_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text of so many bytes has a language if one holds half of the probability or more; a shorter one tells too little.
LEAST_SCORE, LEAST_BYTES = 0.5, 32


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those without a letter, and those in which the network finds no language that holds half of the probability.

    Without a labelled document to learn from, only those without a letter go.
    """
    model = fit(docs.filter(~held_out("doc_id")))
    if model is None:
        return docs.filter(F.regexp_like("text", F.lit(r"\p{L}"))).select(*COLUMNS)
    found = identify(spark, docs, model, carry=("text", "lang", "source", "n_chars"))
    clear = (F.col("score") >= LEAST_SCORE) | (F.octet_length("text") < LEAST_BYTES)
    return found.filter((F.col("lang_pred") != UNKNOWN) & clear).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three or more documents stay in one of them; all documents stay."""
    found = dedup_lines(spark, docs, carry=("lang", "source"))
    text = F.col("kept").cast("string")
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def _same_row() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("h"))


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate texts one row stays: the one of least id (rows without an id come last)."""
    scratch = Scratch(spark, "near-dup-stage")
    found = near_groups(spark, docs, link_ids=False).filter("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k")
    several = scratch.save(found.groupBy("group").agg(first, F.count("*").alias("n")).filter("n > 1").select("group", F.col("k.doc_id").alias("d"), F.col("k.text_hash").alias("h")), "several")
    members = found.join(if_small(several), "group")
    stays = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
    gone = if_small(scratch.save(members.filter(~stays).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct(), "gone"))
    again = members.filter(stays).groupBy("d", "h").agg(F.count("*").alias("n")).filter("n > 1").select("d", "h")
    again = if_small(scratch.save(again, "again"))  # kept rows that are there more than once
    kept = docs.select(*COLUMNS).join(gone, _same_row(), "left_anti")
    if not again.limit(1).count():
        return kept
    rest = F.min(F.struct("lang", "source", "n_chars")).alias("r")
    once = kept.join(again, _same_row(), "left_semi").groupBy("doc_id", "text").agg(rest).select("doc_id", "text", "r.*")
    return kept.join(again, _same_row(), "left_anti").unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages (a twentieth of their words or more) go."""
    found = contamination(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.filter(is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct()
    gone = if_small(Scratch(spark, "contaminated").save(gone, "gone"))
    kept = docs.select(*COLUMNS)
    return kept.join(gone, _same_row(), "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest, packed into sequences of at most 1024 tokens."""
    return pack(spark, docs, public_path(), capacity=1024, end_id=2)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dup", near_dup),
    ("decontaminate", decontaminate),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(name)
    return docs

"""Corpus pipeline: from raw documents to sharded training data.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonlake.llm.common import Scratch, packed, table, unpacked
from axonlake.llm.op3_mixing import mixed
from axonlake.llm.op4_sharding import shard_by_bytes
from axonlake.llm.op6_language import UNDETERMINED, fit, held_out, predict
from axonlake.llm.op9_ngram_join import one_of_each
from axonlake.llm.op10_decontaminate import without_leaks

#: Documents whose language is less sure than this are rejected: texts in two languages are kept, noise goes.
LEAST_SURE = 0.35
#: Words of a shingle and least similarity in per cent of near duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with some certainty: those without letters go, as do null and empty texts.

    Repeated rows stay or go alike, columns of any name stay, an empty table gives none, and where no language is taught nothing is left.
    """
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    told = predict(packed(docs, text=F.col("text")), model, ("row",))
    return unpacked(told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SURE)), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of similar documents the one of smallest doc_id; see one_of_each() for repeated ids, nulls and texts without words."""
    return one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark. Null and empty texts stay, repeated rows stay or go alike, an empty table gives none."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that domain tokens meet the target weights. Null and empty texts have a rate like any other, repeated

    rows are alike, without labels every row stays once, an empty table gives none.
    """
    return mixed(docs, table(spark, sf_dir, "labels"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts each document into one of 16 shards of near equal bytes. Null texts have no bytes, repeated rows share a shard, an empty table gives none."""
    return shard_by_bytes(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: SQL can't express these stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch() as scratch:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            was, docs = docs, scratch.saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
            scratch.drop(was)
        return STAGES[-1][1](spark, docs, sf_dir)  # what it still needs of docs is checkpointed

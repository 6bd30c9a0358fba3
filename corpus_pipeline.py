"""A corpus from raw documents to packed training sequences, stage by stage.

1. language ID: documents that it rejects go.
2. SimHash near-dedup: one document of each group stays, that of the smallest id.
3. suffix-array dedup: bytes of passages that occur twice go; a document may end up empty, and stays.
4. mixing: documents come as often as their source's target weight asks for.
5. best-fit packing: the tokens of all documents, cut and placed into sequences.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partloom.llm import langid, mixing, packing, queries, repeats, simhash
from partloom.llm.common import discard, kept, table, workspace


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.trim(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.tokenizer())


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing_to_weights", mixing_to_weights),
    ("best_fit_packing", best_fit_packing),
]

#: Hashing, sequential rounding and packing are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's own tables go when its result is written, and so does what it has read."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with workspace(spark):
            docs = kept(stage(spark, before, sf_dir), name)
        discard(before)
    return docs

"""A training-data pipeline over ``documents``: language ID, near-dedup, repeated strings, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, packing, repeats, shingles
from tidemark.llm.common import fold, materialize, table
from tidemark.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which is written to ``lang``; those that are null or have no letter go."""
    model = langid.fit(docs, fold(F.col("doc_id"), 4) != 2)
    told = langid.identify(docs, model, carry=docs.columns, names=("_tidemark_lang", "_tidemark_score"))
    told = told.where(F.col("_tidemark_lang") != langid.UNDETERMINED)
    return told.select(*[F.col("_tidemark_lang").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by 0.8 of five-word shingles: SimHash candidates, verified."""
    return shingles.keep_one_of_each_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes or more that start earlier in the corpus too; emptied ones go."""
    return repeats.drop_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers that their source's target weight asks for."""
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    out = packing.pack(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    return out.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("cut_repeats", cut_repeats),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]

#: SQL has no string kernels, SimHash or byte-pair encoding; tests/llm hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

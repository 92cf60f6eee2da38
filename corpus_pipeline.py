"""The training-data pipeline: rejects, exact copies, near copies and repeated passages go, the rest is packed.

Each stage takes the session, the rows its predecessor left (with the columns of ``documents``) and the
data folder, and returns the rows that it leaves. run() writes each stage's rows as Parquet in the
shared folder and reads them back for the next.

Defined cases of every stage: an empty table stays empty; extra columns pass through, whatever their names, but
for the last stage, which ignores them; rows with a null id or text are documents like any other.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import exact_dedup, near_dedup, packing, quality, substring_dedup
from attestor.runtime import materialise, read


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it is fitted on the labelled rows of the documents given.

    A null text is judged as an empty one. Repeated rows are judged alike. Without labels nothing is rejected.
    """
    tag = f"_q{uuid.uuid4().hex[:8]}"  # no column of docs
    scored = quality.classify(docs, read(spark, sf_dir, "labels"), out=tag)
    return scored.where(F.col(f"{tag}_predicted") == 1).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id; null and empty texts are one group."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id; texts without words are in no group."""
    return near_dedup.drop_near_copies(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has; n_chars is that of the text left.

    A document of which only white space is left goes: all of it stands in others. One that was blank before stays.
    """
    left = substring_dedup.drop_repeats(docs)
    kept = left.where((F.col("n_removed") == 0) | (F.trim(F.coalesce("text", F.lit(""))) != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1,024 ids; a null or empty text has the end id alone, repeated rows are packed each."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the chunking; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from the documents of a data folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

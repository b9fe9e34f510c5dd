"""From raw documents to training windows: five stages, each written as Parquet and read again by the next.

A lost executor costs the running stage's tasks only; a lost driver can start again at the last stage written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlas.llm import disclosure, mixing, packing, quality, simhash
from atlas.llm.tokens import default_vocabulary
from atlas.session import fresh_path


def quality_gate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality discriminant rejects go. Null and empty texts and repeated rows are scored like
    others; an empty table, here and in every stage, gives no rows, and other columns may bear any names."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: fingerprints of 3-word shingles that link at 2 differing
    bits, the rule of ``op5_...``. The smallest id stays, then the smallest digest of text and row; null and empty
    texts are one group; two texts under one id, or without one, stay apart unless they are near duplicates."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are replaced; the character count follows the text. Null
    texts stay null and have no count; repeated rows are treated alike."""
    clean = disclosure.sanitise(docs, everywhere=True)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for. A null source is a source; null and empty texts have
    size 0, and each repeated row takes its own copies, by its id's draw."""
    return mixing.mix(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training windows. A null or empty text is the end token alone; repeated rows are
    packed each."""
    return packing.pack(docs, default_vocabulary())


STAGES = [
    ("quality", quality_gate),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packing", windows),
]

ORACLE_SQL = None  # the classifier, the fingerprints and the tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

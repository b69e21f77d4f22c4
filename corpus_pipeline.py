"""A corpus pipeline of operators of ``geoscope.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Each
stage's rows are written to the shared folder and read again as the next one's ``docs``, so every stage
is judged on all that its predecessor kept, and a lost executor costs one stage at most. All stages but
the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoscope.llm import files, packing, queries, simhash, suffix, toxicity


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below one half. The model learns from labelled rows of ``docs`` that are not
    held out."""
    files.bounded_batches(spark)
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model, 0.5)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates."""
    files.bounded_batches(spark)
    return simhash.keep_one(docs, queries.SHINGLE_WORDS, queries.SIMHASH_DISTANCE)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without what stands elsewhere too; ``n_chars`` follows the text."""
    files.bounded_batches(spark)
    cleaned = suffix.cleaned(docs, queries.REPEATED_BYTES)
    if "n_chars" not in docs.columns:
        return cleaned
    changed = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return cleaned.withColumn("n_chars", changed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    files.bounded_batches(spark)
    return packing.pack(docs, queries.WORD_BPE, queries.END_ID, queries.CAPACITY)


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]

#: Trained models, hashes of shingles and tokenizers have no SQL; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the filters keep of ``documents``."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = files.written(stage(spark, docs, sf_dir), name)
    return docs

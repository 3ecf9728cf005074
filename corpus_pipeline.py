"""The corpus pipeline: five operators over ``documents``, each on what the one before it kept.

Every stage's result is written as Parquet in the shared folder and read again. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontam, langid, mixing, simhash, substring
from tidelog.llm.storage import remove, written


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language profiles accept: texts without letters, and long ones like no language, go."""
    langs, prototypes = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    return langid.predict(docs, langs, prototypes).where("accepted").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates the document with the smallest doc_id."""
    return simhash.keep_first(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words or more that an earlier document has; emptied documents go."""
    return substring.remove_repeats(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; single benchmark passages are cut out of the others."""
    return decontam.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in a training order that follows the sources' target weights."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", cut_benchmark_passages),
    ("source_mixing", mix_sources),
]

#: No stage but the third and fourth can be put in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        done = written(stage(spark, docs, sf_dir), name)
        if k:
            remove(docs)
        docs = done
    return docs

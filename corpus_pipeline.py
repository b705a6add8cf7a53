"""From documents to token ids: language, near duplicates, benchmark passages, personal data, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, decontaminate, language_id, near_dedup, pii
from strandloom.llm.common import written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with two that are hardly told apart, go."""
    model = language_id.fit(docs.where(language_id.learnable()))
    found = language_id.predict(docs, model, keep=tuple(docs.columns), prefix="__")
    return found.where((F.col("__lang_pred") != language_id.UNDETERMINED) & ~F.col("__ambiguous")).select(docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: that of the least id."""
    return near_dedup.kept(docs, near_dedup.near_classes(docs)).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.search(docs, bench, keep=tuple(docs.columns), prefix="__").where(~F.col("__contaminated")).select(docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; no document goes."""
    return pii.redacted(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens of every document."""
    coded = bpe.encode(docs, keep=("doc_id", "lang", "source"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language_stage), ("near_dedup", dedup_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("bpe", bpe_stage)]

#: Language ID is a trained model, and classes of near duplicates are components: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

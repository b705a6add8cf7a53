"""Queries that keep arriving, searched batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.plans.options import SearchOptions
from strandloom.plans.search import search
from strandloom.sources.fasta import parse


def fasta_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of queries (query_id, residues) from FASTA files that appear in a folder."""
    raw = spark.readStream.schema("value string").option("lineSep", "\n>").text(folder)
    return parse(raw).select(F.col("subject_id").alias("query_id"), F.upper("residues").alias("residues"))


def search_stream(queries: DataFrame, subjects: DataFrame, out: str, checkpoint: str, options: SearchOptions | None = None) -> StreamingQuery:
    """Searches every batch; results are written under the batch's number, so a batch that is tried again replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        found = search(batch.sparkSession, batch, subjects, options)
        found.drop("script").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()

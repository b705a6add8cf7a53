"""Screens arriving documents for passages of a standing set of queries, and keeps a ranked report up to date.

    spark-submit jobs/screen_arrivals.py --documents DIR --queries DIR --out DIR --checkpoint DIR [--config jobs/screen_arrivals.json]

Documents are a stream of Parquet files: each run takes the files that are new since the last one (the
stream's checkpoint is the mark) and ends when all are done.  Every micro-batch is searched by the
library's seeds and islands, and its hits go to a partition of their own, which a batch that is tried again replaces.
The report is made anew from all hits so far.

    OUT/hits/queries=<fingerprint>/batch=<number>/    one row for each passage of a query in a document
    OUT/report/part=<number>/                         the best documents of each query, ranked

The fingerprint stands for the query set and the search settings.  If either changes, so does the fingerprint, and with it
hits and checkpoint: everything is searched again, and the report has no hits of the old set.  A run without new files changes nothing.
Null or empty texts have no passages.  A document that arrives twice with the same text counts once.
"""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobs.common import command_line
from strandloom.operators import ranges, words
from strandloom.sources import catalog

log = logging.getLogger("screen_arrivals")
HITS = "query_id {q}, oid {o}, diag int, q_start int, s_start int, length int, n_seeds long"


@dataclass(frozen=True)
class Settings:
    #: Residues of a seed, and of a passage that counts.
    word_size: int = 8
    least_length: int = 12
    #: Documents reported for each query.
    top: int = 25
    #: New files that one micro-batch takes.
    files_per_batch: int = 64
    #: Partitions of the report.
    parts: int = 8
    doc_id: str = "doc_id"
    query_id: str = "item_id"
    text: str = "text"


def fingerprint(queries: DataFrame, s: Settings) -> str:
    """A name for a query set (whatever its order) and for what decides which hits are found."""
    total = queries.agg(F.sum(F.xxhash64("query_id", "residues").cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).first()
    return f"{int(total['h'] or 0) % (1 << 64):016x}-{total['n']}-{s.word_size}-{s.least_length}"


def passages(docs: DataFrame, queries: DataFrame, s: Settings) -> DataFrame:
    """Runs of exact seeds, from the least length on."""
    subjects = catalog.subjects_of(docs, oid=s.doc_id, text=s.text).select("oid", "residues")
    found = words.islands(words.seeds(queries, subjects, s.word_size), s.word_size).where(F.col("length") >= s.least_length)
    return found.select("query_id", "oid", "diag", "q_start", "s_start", F.col("length").cast("int").alias("length"), F.col("n_seeds").cast("long").alias("n_seeds"))


def ranked(hits: DataFrame, queries: DataFrame, s: Settings) -> DataFrame:
    """(query_id, oid, rank, longest, passages, covered, share): the best documents of each query by residues covered."""
    once = hits.select("query_id", "oid", "diag", "q_start", "s_start", "length").distinct()
    sides = once.select("query_id", "oid", "length", "q_start", (F.col("q_start") + F.col("length")).alias("q_end"))
    pairs = sides.groupBy("query_id", "oid").agg(F.max("length").alias("longest"), F.count("*").alias("passages"))
    pairs = pairs.join(ranges.coverage(sides, queries), ["query_id", "oid"])
    best = W.partitionBy("query_id").orderBy(F.desc("covered"), F.desc("longest"), F.desc("passages"), "oid")
    rows = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= s.top)
    return rows.select("query_id", "oid", "rank", "longest", "passages", "covered", F.round("share", 6).alias("share"))


def run(spark: SparkSession, documents: str, queries: str, out: str, checkpoint: str, settings: Settings | None = None) -> DataFrame:
    """One run; the report as it stands after it."""
    s = settings or Settings()
    known = catalog.queries_of(spark.read.parquet(queries), query_id=s.query_id, text=s.text)
    name = fingerprint(known, s)
    hits_at, report_at = f"{out}/hits/queries={name}", f"{out}/report"
    table = spark.read.parquet(documents)
    kinds = HITS.format(q=known.schema["query_id"].dataType.simpleString(), o=table.schema[s.doc_id].dataType.simpleString())
    # Which columns the files have is read once; the stream takes only those that it needs.
    arriving = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", s.files_per_batch).parquet(documents).select(s.doc_id, s.text)

    def each(batch: DataFrame, number: int) -> None:
        found = passages(batch, known, s).withColumn("batch", F.lit(number))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(hits_at)
        log.info("batch %d searched", number)

    stream = arriving.writeStream.option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).foreachBatch(each).start()
    stream.awaitTermination()
    log.info("read %d new documents of %s in %d batches", sum(p.numInputRows for p in stream.recentProgress), documents, sum(1 for p in stream.recentProgress if p.numInputRows))

    # A batch without hits leaves no folder, so a first run may leave none at all.
    spark.createDataFrame([], f"{kinds}, batch int").write.mode("append").partitionBy("batch").parquet(hits_at)
    every = spark.read.schema(f"{kinds}, batch int").parquet(hits_at)
    report = ranked(every, known, s).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(s.parts)).cast("int"))
    report.repartition("part").sortWithinPartitions("query_id", "rank").write.mode("overwrite").partitionBy("part").parquet(report_at)
    back = spark.read.schema(report.schema).parquet(report_at)
    log.info("wrote %d rows of %d queries to %s", back.count(), back.select("query_id").distinct().count(), report_at)
    return back


PATHS = {"documents": "folder of Parquet files that grows, or a pattern of files", "queries": "Parquet table of the queries", "out": "folder for hits and report", "checkpoint": "folder for the stream's marks"}

if __name__ == "__main__":
    sys.exit(command_line("screen_arrivals", __doc__.split("\n", 1)[0], PATHS, Settings, run))

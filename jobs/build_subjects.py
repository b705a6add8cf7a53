"""Builds a non-redundant subject database from a table of texts, in volumes sorted by length.

    spark-submit jobs/build_subjects.py --documents DIR --out DIR [--excluded DIR] [--config jobs/build_subjects.json]

Equal sequences become one subject, that of the least id, which counts its members; ids of a list are left out first.
Subjects go to volumes of about equal residues in the order of their ids, each volume sorted by length, with hash, taxid and the ranges
of lower-case residues as soft masks.

    OUT/subjects/volume=<number>/   oid, subject_id, residues, length, hash, taxid, members, masks
    OUT/ids/bucket=<number>/        subject_id (of every member), oid: which subject an id is in
    OUT/volumes/                    a row for each volume: subjects, residues, shortest, longest

All three are overwritten as a whole, so a run gives the same tables whatever stood there, and one that broke off is run again.
Texts without a letter, and null ids, give no subject.  Where an id repeats, its texts are sequences of their own under one id, unless they are equal.
"""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line
from strandloom.operators import ranges
from strandloom.sources import catalog
from strandloom.sources.shared import written

log = logging.getLogger("build_subjects")


@dataclass(frozen=True)
class Settings:
    #: Residues of a volume.
    volume_residues: int = 100_000
    #: Shortest sequence that is taken.
    least_length: int = 1
    #: Shortest lower-case range that is kept as a mask.
    least_mask: int = 12
    #: Buckets of the table of ids.
    buckets: int = 16
    doc_id: str = "doc_id"
    text: str = "text"
    #: Column whose trailing number is the taxid, or none.
    taxid_from: str = "source"


def subjects(docs: DataFrame, excluded: DataFrame | None, s: Settings) -> DataFrame:
    """(oid, subject_id, residues, length, hash, taxid, cased) of the texts with letters that are not left out."""
    taxid = F.regexp_extract(F.col(s.taxid_from), "([0-9]+)$", 1).try_cast("int") if s.taxid_from else F.lit(None).cast("int")
    cased = F.regexp_replace(F.coalesce(F.col(s.text), F.lit("")), "[^A-Za-z]+", "")
    rows = docs.where(F.col(s.doc_id).isNotNull()).select(F.col(s.doc_id).alias("oid"), F.col(s.doc_id).cast("string").alias("subject_id"), cased.alias("cased"), F.coalesce(taxid, F.lit(0)).alias("taxid"))
    rows = rows.withColumn("residues", F.upper("cased")).withColumn("length", F.length("residues")).where(F.col("length") >= max(1, s.least_length))
    return catalog.with_hash(catalog.restricted(rows, exclude=excluded))


def representatives(rows: DataFrame) -> DataFrame:
    """(hash, oid, members): of equal sequences the one of the least id.  Only hashes and ids are grouped."""
    return rows.groupBy("hash").agg(F.min("oid").alias("oid"), F.count("*").alias("members"))


def run(spark: SparkSession, documents: str, out: str, excluded: str | None = None, settings: Settings | None = None) -> DataFrame:
    """One run; the subject table as written."""
    s = settings or Settings()
    docs = spark.read.parquet(documents)
    left_out = spark.read.parquet(excluded).select(F.col(s.doc_id).cast("string").alias("subject_id")) if excluded else None
    rows = subjects(docs, left_out, s)
    # Hashes, ids and lengths say which row is which subject, and where; letters are gathered once for them and once for the table itself.
    known = written(rows.select("oid", "subject_id", "hash", F.col("length").cast("long").alias("len")), "sequences")
    heads = representatives(known)

    # Volumes follow from ids and lengths; rows that repeat an id and its text are one subject.
    own = known.join(heads, ["hash", "oid"]).groupBy("oid", "hash").agg(F.max("len").alias("len"), F.max("members").alias("members"))
    placed = ranges.numbered(own, "oid", "hash", weight="len")
    placed = placed.select("oid", "hash", "members", F.floor(F.col("before") / s.volume_residues).cast("int").alias("volume"))
    whole = rows.select("oid", "hash", "cased", "taxid").join(placed, ["oid", "hash"])
    whole = whole.groupBy("oid", "hash").agg(F.min(F.struct("cased", "taxid")).alias("x"), F.first("members").alias("members"), F.first("volume").alias("volume"))
    whole = ranges.with_lower_case(whole.select("oid", "hash", "x.*", "members", "volume"), least=s.least_mask)
    whole = whole.select("*", F.col("oid").cast("string").alias("subject_id"), F.upper("cased").alias("residues"), F.length("cased").alias("length"))
    table = whole.select("oid", "subject_id", "residues", "length", "hash", "taxid", "members", "masks", "volume")
    table.repartition("volume").sortWithinPartitions("volume", "length", "oid").write.mode("overwrite").partitionBy("volume").parquet(f"{out}/subjects")
    back = spark.read.schema(table.schema).parquet(f"{out}/subjects")

    ids = known.select("subject_id", "hash").distinct().join(heads.select("hash", "oid"), "hash").select("subject_id", "oid", "hash")
    ids = ids.withColumn("bucket", F.pmod(F.xxhash64("subject_id"), F.lit(s.buckets)).cast("int"))
    ids.repartition("bucket").sortWithinPartitions("bucket", "subject_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/ids")
    volumes = back.groupBy("volume").agg(F.count("*").alias("subjects"), F.sum("length").alias("residues"), F.min("length").alias("shortest"), F.max("length").alias("longest"))
    volumes.coalesce(1).write.mode("overwrite").parquet(f"{out}/volumes")

    told = spark.read.schema(volumes.schema).parquet(f"{out}/volumes").agg(F.count("*").alias("v"), F.sum("subjects").alias("n"), F.sum("residues").alias("r")).first()
    log.info("read %d documents of %s", docs.count(), documents)
    log.info("wrote %d subjects of %d residues in %d volumes, %d ids to %s", told["n"] or 0, told["r"] or 0, told["v"], spark.read.schema(ids.schema).parquet(f"{out}/ids").count(), out)
    return back


PATHS = {"documents": "Parquet table of texts", "out": "folder for the database", "excluded": "[optional] Parquet table of ids to leave out"}

if __name__ == "__main__":
    sys.exit(command_line("build_subjects", __doc__.split("\n", 1)[0], PATHS, Settings, run))

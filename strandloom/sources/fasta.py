"""FASTA files: reading, writing and splitting."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.residues import defline_id, defline_title
from strandloom.operators.ranges import numbered


def parse(records: DataFrame, value: str = "value") -> DataFrame:
    """(subject_id, title, residues, length, defline) of raw records, with or without the leading mark.

    Records without residues are left out.
    """
    raw = F.regexp_replace(F.replace(F.col(value), F.lit("\r"), F.lit("")), "^>", "")
    line = F.substring_index(raw, "\n", 1)
    body = F.when(F.instr(raw, "\n") > 0, F.substring(raw, F.instr(raw, "\n") + 1, F.length(raw))).otherwise("")
    rows = records.select(line.alias("defline"), F.regexp_replace(body, r"[\s>]", "").alias("residues"))
    return rows.where(F.length("residues") > 0).select(defline_id(F.col("defline")).alias("subject_id"), defline_title(F.col("defline")).alias("title"), "residues", F.length("residues").alias("length"), "defline")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA files; large files are split between tasks at record marks."""
    return parse(spark.read.option("lineSep", "\n>").text(path))


_PROTEIN_ONLY = "[EFILPQZ]"


def checked_molecule(records: DataFrame, molecule: str) -> DataFrame:
    """``records`` of the declared molecule; others are left out.  A record is protein if a letter says so that no base code has."""
    protein = F.upper("residues").rlike(_PROTEIN_ONLY) | (F.length(F.regexp_replace(F.upper("residues"), "[^ACGTUN]", "")) < 0.9 * F.length("residues"))
    return records.where(protein if molecule == "protein" else ~protein)


def checked_input(spark: SparkSession, path: str, molecule: str) -> DataFrame:
    """Records of FASTA files that are there, have records, and are of the declared molecule; else an error says which of these fails.

    Single records of the other molecule are left out; a file in which they are the most is taken for the wrong one.
    """
    if molecule not in ("protein", "nucleotide"):
        raise ValueError("molecule is protein or nucleotide")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place):
        raise FileNotFoundError(path)
    records = read_fasta(spark, path)
    fits = checked_molecule(records, molecule)
    n, good = records.count(), fits.count()
    if not n:
        raise ValueError(f"no records in {path}")
    if 2 * good < n:
        raise ValueError(f"{path} is declared {molecule}, and {n - good} of {n} records are not")
    return fits


def render(defline: Column, residues: Column, width: int = 60, eol: str = "\n") -> Column:
    """FASTA text of a record (without the last line's end)."""
    lines = F.regexp_extract_all(residues, F.lit(f".{{1,{width}}}"), F.lit(0)) if width else F.array(residues)
    return F.concat(F.lit(">"), defline, F.lit(eol), F.array_join(lines, eol))


def write_fasta(records: DataFrame, path: str, *, width: int = 60, per_file: int = 0) -> None:
    """Writes records (subject_id, title, residues) in the order of their partitions."""
    head = F.trim(F.concat_ws(" ", "subject_id", "title"))
    writer = records.select(render(head, F.col("residues"), width).alias("value")).write
    (writer.option("maxRecordsPerFile", per_file) if per_file else writer).text(path)


def record_size(defline: Column, residues: Column, measure: str = "bytes", width: int = 60, eol: int = 1) -> Column:
    """What a record counts in a split: its bytes in a file, its residues, or one."""
    if measure == "count":
        return F.lit(1).cast("long")
    if measure == "residues":
        return F.length(residues).cast("long")
    lines = F.ceil(F.length(residues) / width) if width else F.lit(1)
    return (F.length(residues) + F.length(defline) + 1 + eol * (1 + lines)).cast("long")


def split_parts(records: DataFrame, parts: int, *, order: str = "ord", measure: str = "bytes", width: int = 60) -> DataFrame:
    """(ord, size, part): records in at most ``parts`` contiguous parts of about equal size.

    A record that crosses a boundary goes to the side where more of it lies, so the part
    follows from its middle, and no task needs the records before it.
    """
    sized = numbered(records.withColumn("size", record_size(F.col("defline"), F.col("residues"), measure, width)).select(order, "size"), order, weight="size")
    total = sized.agg(F.sum("size")).first()[0] or 1
    middle = F.col("before") + F.col("size") / 2
    return sized.select(order, "size", F.least(F.floor(middle * parts / F.lit(total)) + 1, F.lit(parts)).cast("int").alias("part"))


def write_parts(records: DataFrame, path: str, parts: int, *, order: str = "ord", measure: str = "bytes", width: int = 60) -> None:
    """Records (ord, subject_id, title, residues) as FASTA files in a folder for each part, in their order."""
    head = F.trim(F.concat_ws(" ", "subject_id", "title"))
    named = records.withColumn("defline", head)
    dealt = named.join(split_parts(named, parts, order=order, measure=measure, width=width).select(order, "part"), order)
    dealt = dealt.repartition("part").sortWithinPartitions("part", order)
    dealt.select("part", render(F.col("defline"), F.col("residues"), width).alias("value")).write.partitionBy("part").text(path)


def split_by_size(records: DataFrame, most: int, **how) -> DataFrame:
    """(ord, size, part): parts of about ``most`` each."""
    order = how.get("order", "ord")
    sized = records.withColumn("size", record_size(F.col("defline"), F.col("residues"), how.get("measure", "bytes"), how.get("width", 60)))
    total = sized.agg(F.sum("size")).first()[0] or 1
    return split_parts(records, max(1, math.ceil(total / most)), order=order, **{k: v for k, v in how.items() if k != "order"})

"""Subject tables: building, reading, restricting, describing."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.residues import letters, with_letters
from strandloom.operators.ranges import numbered


def subjects_of(docs: DataFrame, *, oid: str = "doc_id", text: str = "text") -> DataFrame:
    """(oid, subject_id, residues, length) of the letters of texts; empty ones are left out."""
    rows = docs.where(with_letters(F.col(text))).select(F.col(oid).alias("oid"), F.col(oid).cast("string").alias("subject_id"), letters(F.col(text)).alias("residues"))
    return rows.withColumn("length", F.length("residues"))


def gathered(docs: DataFrame, *, oid: str = "doc_id", text: str = "text") -> DataFrame:
    """(oid, residues) like ``subjects_of``: letters of many texts at a time, from their bytes, for what reads all of them."""
    rows = docs.where(with_letters(F.col(text))).select(F.col(oid).alias("oid"), F.col(text).alias("residues"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("residues")
            if not len(column):
                continue
            at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            # In UTF-8 no byte of another character looks like an ASCII letter.
            raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] & 0xDF
            kept = (raw >= ord("A")) & (raw <= ord("Z"))
            ends = np.concatenate([[0], np.cumsum(kept)])[at - at[0]].astype(np.int32)
            made = pa.StringArray.from_buffers(len(column), pa.py_buffer(ends), pa.py_buffer(raw[kept]))
            yield pa.RecordBatch.from_arrays([b.column("oid"), made], ["oid", "residues"])

    return rows.mapInArrow(run, f"oid {rows.schema['oid'].dataType.simpleString()}, residues string")


def queries_of(items: DataFrame, *, query_id: str = "item_id", text: str = "text") -> DataFrame:
    rows = items.select(F.col(query_id).alias("query_id"), letters(F.coalesce(F.col(text), F.lit(""))).alias("residues"))
    return rows.where(F.length("residues") > 0)


def with_oids(records: DataFrame, *order: str) -> DataFrame:
    """``records`` numbered from 0 in an order."""
    return numbered(records, *order).withColumnRenamed("rn", "oid")


def with_taxids(subjects: DataFrame, taxid: int | None = None, taxids: DataFrame | None = None) -> DataFrame:
    """One taxid for all, or those of a map (subject_id, taxid), the least of repeated ids; without either, 0."""
    if taxid is not None and taxids is not None:
        raise ValueError("give a taxid or a map of them, not both")
    if taxids is None:
        return subjects.withColumn("taxid", F.lit(taxid or 0))
    return subjects.join(taxids.groupBy("subject_id").agg(F.min("taxid").alias("taxid")), "subject_id", "left").withColumn("taxid", F.coalesce("taxid", F.lit(0)))


def with_hash(subjects: DataFrame) -> DataFrame:
    return subjects.withColumn("hash", F.md5("residues"))


def duplicate_ids(subjects: DataFrame, *, within: tuple[str, ...] = ()) -> DataFrame:
    """(id, n) of ids that occur more than once, whatever their case."""
    return subjects.groupBy(*within, F.upper("subject_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1")


def write_subjects(subjects: DataFrame, path: str, *, sort_by_length: bool = True, per_file: int = 0) -> None:
    """Parquet in one directory for each volume, by ascending length (then oid) within it."""
    out = subjects.repartition("volume")
    out = out.sortWithinPartitions("volume", "length", "oid") if sort_by_length else out.sortWithinPartitions("volume", "oid")
    writer = out.write.partitionBy("volume")
    (writer.option("maxRecordsPerFile", per_file) if per_file else writer).parquet(path)


def read_subjects(spark: SparkSession, path: str, *, needed: tuple[str, ...] = ("oid", "residues")) -> DataFrame:
    table = spark.read.parquet(path)
    if missing := set(needed) - set(table.columns):
        raise ValueError(f"no subject table, columns are missing: {sorted(missing)}")
    return table


def only(subjects: DataFrame, ids: DataFrame, key: str = "subject_id") -> DataFrame:
    return subjects.join(ids.select(key).distinct(), key, "left_semi")


def without(subjects: DataFrame, ids: DataFrame, key: str = "subject_id") -> DataFrame:
    return subjects.join(ids.select(key).distinct(), key, "left_anti")


def warned_if_empty(subjects: DataFrame) -> DataFrame:
    """``subjects``, with a warning (not a failure) if nothing is left."""
    if subjects.isEmpty():
        warnings.warn("no subject is left after the restriction", stacklevel=2)
    return subjects


def restricted(subjects: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None, oids: tuple[int, int] | None = None) -> DataFrame:
    """Subjects of a list, or not of one (not both), within a range of oids."""
    if include is not None and exclude is not None:
        raise ValueError("a list of subjects is to keep or to leave out, not both")
    out = only(subjects, include) if include is not None else without(subjects, exclude) if exclude is not None else subjects
    return out.where(F.col("oid").between(oids[0], oids[1] - 1)) if oids else out


def stats(subjects: DataFrame) -> DataFrame:
    """n, residues, longest, shortest, mean (whole number) of the lengths."""
    n = F.length("residues")
    return subjects.agg(F.count("*").alias("n"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("residues"), F.max(n).alias("longest"), F.min(n).alias("shortest")).withColumn("mean", F.floor(F.col("residues") / F.greatest("n", F.lit(1))).cast("long"))


def oid_at(subjects: DataFrame, residue: int) -> DataFrame:
    """The first oid from which on at least ``residue`` residues lie before."""
    rows = numbered(subjects.select("oid", F.length("residues").cast("long").alias("len")), "oid", weight="len")
    return rows.where(F.col("before") + F.col("len") > residue).agg(F.min("oid").alias("oid"))


def user_columns(subjects: DataFrame) -> list[str]:
    """Columns beyond the engine's own."""
    return [c for c in subjects.columns if c not in ("oid", "subject_id", "title", "residues", "length", "taxid", "volume", "masks", "hash")]


# ------------------------------------------------------------------ look-ups


def totals(subjects: DataFrame, **which) -> DataFrame:
    """``stats`` of the subjects that ``restricted`` leaves: totals over what is included."""
    return stats(restricted(subjects, **which))


def oids_of(subjects: DataFrame, ids: DataFrame, by: str = "subject_id") -> DataFrame:
    """(by, oid) of ids (a column ``by``): accessions, hashes, or any other column of subjects; ids in any case, every oid of an id, null for those that are not there."""
    key = F.upper(F.col(by).cast("string"))
    asked = ids.select(by).distinct().withColumn("__k", key)
    known = subjects.select(key.alias("__k"), "oid")
    if by == "subject_id":
        # An accession may have a version behind a dot; without one it stands for every version.
        bare = known.select(F.regexp_replace("__k", r"\.[0-9]+$", "").alias("__k"), "oid")
        known = known.unionByName(bare).distinct()
    return asked.join(known, "__k", "left").select(by, "oid")


def sequences_of(subjects: DataFrame, oids: DataFrame) -> DataFrame:
    """(oid, residues) of a list of oids; those that are not there are left out."""
    return subjects.join(oids.select("oid").distinct(), "oid", "left_semi").select("oid", "residues")


# ------------------------------------------------------------------ user columns and aliases

_META = "strandloom.user"


def with_user_column(subjects: DataFrame, blobs: DataFrame, name: str, about: dict[str, str] | None = None) -> DataFrame:
    """``subjects`` with a column of their own from blobs (oid, and the column), and what is said about it as metadata that Parquet keeps."""
    if name in subjects.columns:
        raise ValueError(f"there is a column {name}")
    out = subjects.join(blobs.select("oid", F.col(name)).dropDuplicates(["oid"]), "oid", "left")
    return out.withMetadata(name, {_META: about or {}})


def about_columns(subjects: DataFrame) -> dict[str, dict[str, str]]:
    """What is said about each user column."""
    return {f.name: dict(f.metadata[_META]) for f in subjects.schema.fields if _META in f.metadata}


def write_alias(spark: SparkSession, path: str, tables: list[str], title: str = "", ids: str | None = None) -> None:
    """A name for several subject tables: one row of JSON with their paths, and a table of ids (subject_id) that alone count."""
    spark.createDataFrame([(title, tables, ids)], "title string, tables array<string>, ids string").coalesce(1).write.mode("overwrite").json(path)


def read_alias(spark: SparkSession, path: str) -> DataFrame:
    """The subjects of all tables of an alias, with the volume that each comes from; tables may have further columns, and may be aliases themselves."""

    def opened(at: str, seen: tuple[str, ...]) -> list[DataFrame]:
        if at in seen:
            raise ValueError(f"an alias that names itself: {at}")
        row = spark.read.schema("title string, tables array<string>, ids string").json(at).first()
        found: list[DataFrame] = []
        for t in row["tables"]:
            found += opened(t, (*seen, at)) if t.endswith(".alias") else [read_subjects(spark, t).withColumn("from_table", F.lit(t))]
        return [only(f, spark.read.parquet(row["ids"])) for f in found] if row["ids"] else found

    first, *rest = opened(path, ())
    for more in rest:
        first = first.unionByName(more, allowMissingColumns=True)
    return first

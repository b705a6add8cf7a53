"""Intervals: merging, chunks of long subjects, masks, coverage, balanced splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.sources.shared import written


def merged(ranges: DataFrame, *, key: str = "oid", gap: int = 0, pad: int = 0) -> DataFrame:
    """(key, from, to): ranges widened by ``pad`` and merged where at most ``gap`` lies between them."""
    r = ranges.select(key, F.greatest(F.col("from") - pad, F.lit(0)).alias("from"), (F.col("to") + pad).alias("to"))
    w = W.partitionBy(key).orderBy("from", "to")
    far = F.max("to").over(w.rowsBetween(W.unboundedPreceding, -1))
    r = r.withColumn("new", F.when(F.col("from") <= far + gap, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return r.groupBy(key, "run").agg(F.min("from").alias("from"), F.max("to").alias("to")).drop("run")


def chunks(subjects: DataFrame, size: int, overlap: int) -> DataFrame:
    """(oid, chunk, start, residues): long subjects in pieces that overlap; coordinates shift back by ``start``."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length("residues") - overlap) / step) - 1, F.lit(0)).cast("int")
    pieces = subjects.where(F.length("residues") > 0).select("oid", "residues", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    start = F.col("chunk") * step
    return pieces.select("oid", "chunk", start.alias("start"), F.substring("residues", start + 1, F.lit(size)).alias("residues"))


def clipped(masks: DataFrame, pieces: DataFrame, size: int) -> DataFrame:
    """(oid, chunk, from, to): masks in the coordinates of the chunks that they touch."""
    p = pieces.select("oid", "chunk", "start", F.length("residues").alias("n"))
    j = masks.join(p, "oid").where((F.col("to") > F.col("start")) & (F.col("from") < F.col("start") + F.col("n")))
    return j.select("oid", "chunk", F.greatest(F.col("from") - F.col("start"), F.lit(0)).alias("from"), F.least(F.col("to") - F.col("start"), F.col("n")).alias("to"))


def fetched(subjects: DataFrame, ranges: DataFrame, *, gap: int = 0, pad: int = 0) -> DataFrame:
    """(oid, from, to, residues) of parts of subjects: ranges padded, cut at the end, and merged where the gap is small."""
    parts = merged(ranges, gap=gap, pad=pad).join(subjects.select("oid", "residues"), "oid")
    to = F.least(F.col("to"), F.length("residues"))
    rows = parts.where(F.col("from") < F.length("residues"))
    return rows.select("oid", "from", to.alias("to"), F.substring("residues", F.col("from") + 1, to - F.col("from")).alias("residues"))


def coverage(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, oid, covered, share): residues of a query that the hits of a subject cover, counted once."""
    r = hits.select(F.struct("query_id", "oid").alias("k"), F.col("q_start").alias("from"), F.col("q_end").alias("to"))
    return shares(merged(r, key="k").groupBy("k").agg(F.sum(F.col("to") - F.col("from")).alias("covered")).select("k.query_id", "k.oid", "covered"), queries)


def shares(covered: DataFrame, queries: DataFrame) -> DataFrame:
    """``covered`` (query_id, oid, covered) with the share of the query's residues."""
    return covered.join(queries.select("query_id", F.length("residues").alias("n")), "query_id").select("query_id", "oid", "covered", (F.col("covered") / F.col("n")).alias("share"))


def lower_case_masks(seqs: DataFrame, *, key: str = "oid", text: str = "text") -> DataFrame:
    """(key, from, to) of the runs of lower-case letters among the letters of a text."""
    only = F.regexp_replace(F.col(text), "[^A-Za-z]", "")
    # Pieces of alternating case; their lengths add up to positions.
    parts = F.regexp_extract_all(only, F.lit("[a-z]+|[A-Z]+"), F.lit(0))
    w = W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    rows = seqs.select(key, F.posexplode(parts).alias("i", "part")).withColumn("from", F.coalesce(F.sum(F.length("part")).over(w), F.lit(0)).cast("int"))
    return rows.where(F.col("part").rlike("^[a-z]")).select(key, "from", (F.col("from") + F.length("part")).alias("to"))


def with_lower_case(rows: DataFrame, *, text: str = "cased", least: int = 1) -> DataFrame:
    """``rows`` with the runs of at least so many lower-case letters of a text of ASCII letters, as an array ``masks`` of (from, to): made where the row is, without a row for each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(text)
            at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
            lower = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] >= ord("a")
            at = at - at[0]
            edge = np.zeros(len(lower) + 1, bool)
            edge[at] = True
            edge[1:-1] |= lower[1:] != lower[:-1]
            cut = np.flatnonzero(edge)
            begin, end = cut[:-1], cut[1:]
            kept = lower[begin] & (end - begin >= least)
            begin, end = begin[kept], end[kept]
            own = np.searchsorted(at, begin, "right") - 1
            found = pa.StructArray.from_arrays([pa.array((x - at[own]).astype(np.int32)) for x in (begin, end)], ["from", "to"])
            masks = pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, at).astype(np.int32)), found)
            yield pa.RecordBatch.from_arrays([*b.columns, masks], [*b.schema.names, "masks"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, masks array<struct<from:int,to:int>>")


def attached(subjects: DataFrame, masks: DataFrame) -> DataFrame:
    """``subjects`` with masks (oid, algorithm_id, from, to) as an array, checked against the lengths.

    A range out of bounds fails the job that reads the result.
    """
    whole = masks.groupBy("oid").agg(F.array_sort(F.collect_list(F.struct("algorithm_id", "from", "to"))).alias("masks"))
    out = subjects.join(whole, "oid", "left").withColumn("masks", F.coalesce("masks", F.array().cast("array<struct<algorithm_id:int,from:int,to:int>>")))
    good = F.forall("masks", lambda r: (r["from"] >= 0) & (r["from"] <= r["to"]) & (r["to"] <= F.length("residues")))
    return out.withColumn("masks", F.when(good, F.col("masks")).otherwise(F.raise_error(F.concat(F.lit("mask out of bounds in "), F.col("oid").cast("string"))).cast("array<struct<algorithm_id:int,from:int,to:int>>")))


def hard_masked(subjects: DataFrame, masks: DataFrame) -> DataFrame:
    """``subjects`` with X in place of every residue within a mask (oid, from, to)."""
    m = merged(masks).groupBy("oid").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("m"))
    r = F.col("residues")
    piece = lambda x, i: F.concat(F.substring(r, F.when(i == 0, F.lit(1)).otherwise(F.get("m", i - 1)["to"] + 1), x["from"] - F.when(i == 0, F.lit(0)).otherwise(F.get("m", i - 1)["to"])), F.repeat(F.lit("X"), x["to"] - x["from"]))
    rest = F.substring(r, F.element_at("m", -1)["to"] + 1, F.length(r))
    return subjects.join(m, "oid", "left").withColumn("residues", F.when(F.col("m").isNull(), r).otherwise(F.concat(F.array_join(F.transform("m", piece), ""), rest))).drop("m")


# ------------------------------------------------------------------ splits over the whole table


def numbered(rows: DataFrame, *order: str, weight: str | None = None, into: int | None = None) -> DataFrame:
    """``rows`` with ``rn`` (from 0) and, with ``weight``, ``before`` (its sum over earlier rows), in a global order.

    Rows are dealt by range of the order, sorted and written once, with the range and place of
    each; a second reading would sample other bounds.  Only one count (and sum) for each range is
    added up.  There are as many ranges as the session has shuffle partitions.
    """
    into = into or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()  # the range above 33 bits, the place in it below
    dealt = rows.repartitionByRange(into, *order).sortWithinPartitions(*order).withColumn("__at", place)
    local = written(dealt, "numbered").withColumn("__p", F.shiftright("__at", 33)).withColumn("__n", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    amount = F.col(weight) if weight else F.lit(0)
    totals = local.groupBy("__p").agg(F.count("*").alias("c"), F.sum(amount).alias("t"))
    o = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    base = totals.select("__p", F.coalesce(F.sum("c").over(o), F.lit(0)).alias("bc"), F.coalesce(F.sum("t").over(o), F.lit(0)).alias("bt"))
    if weight:
        earlier = W.partitionBy("__p").orderBy("__n").rowsBetween(W.unboundedPreceding, -1)
        local = local.withColumn("__s", F.coalesce(F.sum(amount).over(earlier), F.lit(0)))
    out = local.join(F.broadcast(base), "__p").withColumn("rn", F.col("__n") + F.col("bc"))
    if weight:
        out = out.withColumn("before", F.col("__s") + F.col("bt")).drop("__s")
    return out.drop("__at", "__p", "__n", "bc", "bt")


def length_groups(subjects: DataFrame, size: int) -> DataFrame:
    """(grp, n, longest, residues): groups of ``size`` subjects by ascending length (oid breaks ties)."""
    rows = numbered(subjects.select("oid", F.length("residues").cast("long").alias("len")), "len", "oid")
    return rows.groupBy(F.floor(F.col("rn") / size).cast("long").alias("grp")).agg(F.count("*").alias("n"), F.max("len").alias("longest"), F.sum("len").alias("residues"))


def balanced(subjects: DataFrame, parts: int) -> DataFrame:
    """(oid, part): contiguous parts of about equal residues, in the order of oid."""
    rows = numbered(subjects.select("oid", F.length("residues").cast("long").alias("len")), "oid", weight="len")
    total = rows.agg(F.sum("len")).first()[0] or 1
    return rows.select("oid", F.least(F.floor(F.col("before") * parts / F.lit(total)), F.lit(parts - 1)).cast("int").alias("part"))


def query_batches(queries: DataFrame, limit: int) -> DataFrame:
    """``queries`` with a batch number: a new one whenever the residues so far pass a multiple of ``limit``."""
    rows = numbered(queries.withColumn("len", F.length("residues").cast("long")), "query_id", weight="len")
    return rows.withColumn("batch", F.floor(F.col("before") / limit).cast("int")).drop("rn", "before", "len")


def volumes(subjects: DataFrame, limit: int, *, measure: str = "residues") -> DataFrame:
    """``subjects`` with a volume number: a new one whenever what came before passes a multiple of ``limit``, in residues or in bytes of the rows' text."""
    size = F.length("residues").cast("long")
    if measure == "bytes":
        size = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) for f in subjects.schema.fields if f.dataType.simpleString() == "string"), F.lit(0)).cast("long")
    elif measure != "residues":
        raise ValueError("measure is residues or bytes")
    rows = numbered(subjects.withColumn("len", F.coalesce(size, F.lit(0))), "oid", weight="len")
    return rows.withColumn("volume", F.floor(F.col("before") / limit).cast("int")).drop("rn", "before", "len")

"""Reports: rows of chosen columns as tab-separated text, CSV or JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _columns() -> dict[str, Column]:
    """The names that a column list may have, by the public manual of tabular reports."""
    c = F.col
    return {
        "qseqid": c("query_id").cast("string"), "sseqid": c("oid").cast("string"), "pident": F.format_string("%.2f", c("identity")), "length": c("align_length").cast("string"),
        "mismatch": (c("align_length") - c("gaps") - c("identities")).cast("string"), "gapopen": c("gap_opens").cast("string"), "gaps": c("gaps").cast("string"), "nident": c("identities").cast("string"),
        "qstart": (c("q_start") + 1).cast("string"), "qend": c("q_end").cast("string"), "sstart": (c("s_start") + 1).cast("string"), "send": c("s_end").cast("string"),
        "evalue": F.format_string("%.2e", c("evalue")), "bitscore": F.format_string("%.1f", c("bits")), "score": c("score").cast("string"),
        "stitle": c("title"), "staxid": c("taxid").cast("string"), "sacc": c("subject_id"),
    }


STANDARD = "qseqid sseqid pident length mismatch gapopen qstart qend sstart send evalue bitscore"


def tabular(hsps: DataFrame, spec: str = STANDARD) -> DataFrame:
    """The columns of a space-delimited list (``std`` stands for the usual twelve), as text, one-based and inclusive."""
    known, names = _columns(), []
    for name in spec.split():
        names += STANDARD.split() if name == "std" else [name]
    if bad := [n for n in names if n not in known]:
        raise ValueError(f"no such columns: {bad}")
    return hsps.select(*[known[n].alias(n) for n in dict.fromkeys(names)])


def enriched(hsps: DataFrame, subjects: DataFrame, *columns: str) -> DataFrame:
    """``hsps`` with columns of their subjects (title, taxid, ...), nulls where a subject has gone.

    Only the subjects that were hit are looked up: their ids go first, as hits are few beside subjects.
    """
    names = columns or tuple(c for c in ("subject_id", "title", "taxid") if c in subjects.columns)
    hit = subjects.join(hsps.select("oid").distinct(), "oid", "left_semi").select("oid", *names)
    return hsps.join(hit, "oid", "left")


def write_report(hsps: DataFrame, path: str, *, form: str = "tabular", spec: str = STANDARD) -> None:
    """tabular (6), csv (10) or json; sorted by query, rank of the subject and score."""
    ordered = hsps.orderBy("query_id", "rank", F.desc("score"), "q_start", "s_start")
    rows = tabular(ordered, spec)
    if form == "json":
        rows.write.json(path)
    elif form in ("tabular", "csv"):
        rows.write.option("sep", "\t" if form == "tabular" else ",").csv(path)
    else:
        raise ValueError(f"no such format: {form}")


def merged_files(spark, paths: list[str], out: str) -> None:
    """Report files of query parts as one report, in the order of the parts, without their comment lines."""
    found = merged_reports([spark.read.text(p).withColumn("__n", F.monotonically_increasing_id()) for p in paths])
    found.orderBy("part", "__n").select("value").write.mode("overwrite").text(out)


def merged_reports(parts: list[DataFrame]) -> DataFrame:
    """Reports of query parts as one, in the order of the parts; comment lines (#) go."""
    out = None
    for i, p in enumerate(parts):
        rows = p.where(~F.col("value").startswith("#")).withColumn("part", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out

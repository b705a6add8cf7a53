"""The jobs as registered queries: each runs twice over the whole tables into a folder of its own and returns its output, and the SQL of the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import build_subjects, screen_arrivals
from strandloom.plans.registry import hits_sql
from strandloom.sources.shared import shared_dir


def job1_screen_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the best documents of each benchmark item."""
    place = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        # A stream's path is a folder or a pattern; the table may be one file.
        report = screen_arrivals.run(spark, f"{sf_dir}/documents.parque[t]", f"{sf_dir}/benchmark.parquet", f"{place}/out", f"{place}/checkpoint")
    return report.drop("part")


def job2_build_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject table of all documents, without the residues themselves."""
    place = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        table = build_subjects.run(spark, f"{sf_dir}/documents.parquet", place)
    masked = F.aggregate("masks", F.lit(0), lambda a, m: a + m["to"] - m["from"])
    return table.select("volume", "oid", "subject_id", "length", "hash", "taxid", "members", F.size("masks").alias("masks"), masked.cast("int").alias("masked"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_screen_arrivals, job2_build_subjects)}


_REPORT = """, hit AS (SELECT * FROM hsp WHERE q_end - q_start >= 12),
o AS (SELECT *, max(q_end) OVER (PARTITION BY query_id, oid ORDER BY q_start, q_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM hit),
r AS (SELECT *, sum(CASE WHEN q_start <= far THEN 0 ELSE 1 END) OVER (PARTITION BY query_id, oid ORDER BY q_start, q_end ROWS UNBOUNDED PRECEDING) AS run FROM o),
u AS (SELECT query_id, oid, run, max(q_end) - min(q_start) AS n FROM r GROUP BY query_id, oid, run),
cov AS (SELECT query_id, oid, CAST(sum(n) AS BIGINT) AS covered FROM u GROUP BY query_id, oid),
p AS (SELECT query_id, oid, CAST(max(q_end - q_start) AS INT) AS longest, count(*) AS passages FROM hit GROUP BY query_id, oid),
k AS (SELECT p.*, covered, round(covered / length(q.residues), 6) AS share, CAST(row_number() OVER (PARTITION BY query_id ORDER BY covered DESC, longest DESC, passages DESC, oid) AS INT) AS rank FROM p JOIN cov USING (query_id, oid) JOIN q USING (query_id))
SELECT query_id, oid, rank, longest, passages, covered, share FROM k WHERE rank <= 25"""

_SUBJECTS = """
WITH t AS (SELECT doc_id AS oid, regexp_replace(text, '[^A-Za-z]', '', 'g') AS cased, coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) AS taxid FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT *, md5(upper(cased)) AS hash FROM t WHERE length(cased) > 0),
head AS (SELECT hash, min(oid) AS oid, count(*) AS members FROM s GROUP BY hash),
own AS (SELECT oid, hash, min(cased) AS cased, arg_min(taxid, (cased, taxid)) AS taxid, any_value(members) AS members FROM s JOIN head USING (hash, oid) GROUP BY oid, hash),
v AS (SELECT *, sum(length(cased)) OVER (ORDER BY oid, hash ROWS UNBOUNDED PRECEDING) - length(cased) AS before FROM own),
mask AS (SELECT oid, hash, count(*) AS masks, sum(length(p)) AS masked FROM (SELECT oid, hash, unnest(regexp_extract_all(cased, '[a-z]+')) AS p FROM own) WHERE length(p) >= 12 GROUP BY oid, hash)
SELECT CAST(floor(before / 100000) AS INT) AS volume, oid, CAST(oid AS VARCHAR) AS subject_id, CAST(length(cased) AS INT) AS length, hash, taxid, members,
       CAST(coalesce(masks, 0) AS INT) AS masks, CAST(coalesce(masked, 0) AS INT) AS masked
FROM v LEFT JOIN mask USING (oid, hash)"""


def oracle_sql() -> dict[str, str]:
    return {"job1_screen_arrivals": hits_sql() + _REPORT, "job2_build_subjects": _SUBJECTS}

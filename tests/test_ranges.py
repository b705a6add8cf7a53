"""Global orders over more rows than one sample sees, and the guard of the entry."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandloom.operators import ranges
from strandloom.sources import catalog, fasta

N = 600_000


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """600,000 subjects in no order, of 1 to 97 residues, with a payload."""
    path = str(tmp_path_factory.mktemp("many") / "t")
    i = F.col("id")
    rows = spark.range(0, N, 1, 12).select((i * 7919 % N).alias("oid"), F.expr("repeat('A', cast(id * 31 % 97 + 1 as int))").alias("residues"), F.md5(i.cast("string")).alias("payload"))
    rows.write.parquet(path)
    return spark.read.parquet(path)


def plain(many):
    """(oid, length, residues before) in order of oid."""
    at, out = 0, {}
    for r in sorted(many.select("oid", F.length("residues").alias("n")).collect()):
        out[r["oid"]] = (r["n"], at)
        at += r["n"]
    return out, at


def test_global_orders(many):
    want, total = plain(many)
    rows = ranges.numbered(many.withColumn("len", F.length("residues").cast("long")), "oid", weight="len")
    assert rows.columns == ["oid", "residues", "payload", "len", "rn", "before"]
    for r in rows.select("oid", "rn", "before").collect():
        assert (r["rn"], r["before"]) == (r["oid"], want[r["oid"]][1])
    assert {r["oid"]: r["volume"] for r in ranges.volumes(many, 1_000_000).select("oid", "volume").collect()} == {i: b // 1_000_000 for i, (_, b) in want.items()}
    batches = ranges.query_batches(many.withColumnRenamed("oid", "query_id"), 500_000)
    assert {r["query_id"]: r["batch"] for r in batches.select("query_id", "batch").collect()} == {i: b // 500_000 for i, (_, b) in want.items()}
    assert {r["oid"]: r["part"] for r in ranges.balanced(many, 7).collect()} == {i: min(6, b * 7 // total) for i, (_, b) in want.items()}
    assert catalog.oid_at(many, total // 2).first()["oid"] == min(i for i, (n, b) in want.items() if b + n > total // 2)


def test_orders_of_several_columns(many):
    lengths = sorted(n for n, _ in plain(many)[0].values())
    groups = {r["grp"]: (r["n"], r["longest"], r["residues"]) for r in ranges.length_groups(many, 1000).collect()}
    assert groups == {k: (1000, lengths[1000 * k + 999], sum(lengths[1000 * k : 1000 * k + 1000])) for k in range(N // 1000)}
    numbers = catalog.with_oids(many.drop("oid").withColumnRenamed("payload", "subject_id"), "subject_id").select("subject_id", "oid").collect()
    assert [r["oid"] for r in sorted(numbers)] == list(range(N))


def test_split_parts(many):
    records = many.select(F.col("oid").alias("ord"), F.lit("x").alias("defline"), "residues")
    want, total = plain(many)
    found = {r["ord"]: r["part"] for r in fasta.split_parts(records, 5, measure="residues").collect()}
    assert found == {i: min(5, int((b + n / 2) * 5 / total) + 1) for i, (n, b) in want.items()}


def test_repeated_taxids_take_the_least(spark):
    subjects = spark.createDataFrame([("a",), ("b",)], "subject_id string")
    taxids = spark.createDataFrame([("a", 7), ("a", 3), ("c", 1)], "subject_id string, taxid int")
    assert sorted(map(tuple, catalog.with_taxids(subjects, taxids=taxids).collect())) == [("a", 3), ("b", 0)]


def test_entry_works_without_the_libraries_of_the_text_operators():
    root = str(Path(__file__).resolve().parents[1])
    code = "import sys; sys.modules['tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op1') for n in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert out.stdout.split()[1:] == ["False", "True"] and int(out.stdout.split()[0]) >= 53, out.stderr


def test_lower_case_runs_where_the_rows_are(spark):
    texts = ["aB", "abc", "ABC", "aabbCCddE", "x" * 40 + "Y" + "z" * 12, "Zz", "z"]
    rows = spark.createDataFrame(list(enumerate(texts)), "oid long, cased string").repartition(2)
    for least in (1, 2, 12):
        want = {(r["oid"], r["from"], r["to"]) for r in ranges.lower_case_masks(rows, text="cased").collect() if r["to"] - r["from"] >= least}
        got = ranges.with_lower_case(rows, least=least).collect()
        assert {(r["oid"], m["from"], m["to"]) for r in got for m in r["masks"]} == want
        assert {(r["oid"], r["cased"]) for r in got} == set(enumerate(texts))
    assert ranges.with_lower_case(rows.where("false")).count() == 0

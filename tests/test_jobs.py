"""The jobs: growing input, repeated and broken-off runs, SQL of their registered queries."""

import json
import logging
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import build_subjects, registered, screen_arrivals
from jobs.common import settings
from strandloom.sources import catalog


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["job1_screen_arrivals", "job2_build_subjects"])
def test_registered_queries_give_the_rows_of_their_sql(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    own = lambda: {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql.")}
    before = own()
    found = registered.queries()[name](spark, sf)
    cols = ", ".join(found.columns)
    assert rows_of(found) == sorted(con.execute(f"select {cols} from ({registered.oracle_sql()[name]})").fetchall(), key=str)
    assert before == own()


# ---------------------------------------------------------------- arrivals


class Place:
    def __init__(self, spark, sf, tmp):
        self.spark, self.tmp = spark, tmp
        self.docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").cache()
        self.items = f"{sf}/benchmark.parquet"
        (tmp / "in").mkdir()

    def arrive(self, name, rows):
        rows.coalesce(1).write.parquet(f"{self.tmp}/new-{name}")
        part = next((self.tmp / f"new-{name}").glob("part-*.parquet"))
        shutil.move(part, self.tmp / "in" / f"{name}.parquet")

    def run(self, out="out", items=None, **how):
        return screen_arrivals.run(self.spark, f"file://{self.tmp}/in", items or self.items, f"file://{self.tmp}/{out}", f"file://{self.tmp}/mark-{out}", screen_arrivals.Settings(**how))

    def batches(self, out="out"):
        return sorted(p.name for p in self.tmp.glob(f"{out}/hits/*/batch=*"))


@pytest.fixture
def place(spark, sf, tmp_path):
    return Place(spark, sf, tmp_path)


def test_two_runs_over_growing_input(place, caplog):
    half = F.col("doc_id") % 2 == 0
    place.arrive("a", place.docs.where(half))
    with caplog.at_level(logging.INFO, "screen_arrivals"):
        first = rows_of(place.run())
        assert first and {r[1] % 2 for r in first} == {0}
        assert f"read {place.docs.where(half).count()} new documents" in caplog.text
        caplog.clear()
        place.arrive("b", place.docs.where(~half))
        second = rows_of(place.run())
        assert f"read {place.docs.where(~half).count()} new documents" in caplog.text  # only what is new
        assert len(place.batches()) == 2
        caplog.clear()
        # Nothing new: nothing is read, and the report is the same.
        assert rows_of(place.run()) == second and "read 0 new documents" in caplog.text
    # The same as all at once.
    assert rows_of(place.run("whole")) == second != first


def test_a_batch_that_broke_off_is_replaced(place):
    place.arrive("a", place.docs)
    expected = rows_of(place.run())
    # As if the run had ended after its hits were written and before its mark was.
    for p in place.tmp.glob("mark-out/*/commits/*"):
        if p.name.strip(".").split(".")[0].isdigit():
            p.unlink()
    assert rows_of(place.run()) == expected and len(place.batches()) == 1


def test_small_batches_and_a_document_that_comes_twice(place):
    place.arrive("a", place.docs.where("doc_id < 90"))
    place.arrive("b", place.docs.where("doc_id >= 60"))
    assert rows_of(place.run(files_per_batch=1)) == rows_of(place.run("whole", files_per_batch=10))


def test_a_changed_query_set_starts_anew(place, spark):
    place.arrive("a", place.docs)
    old = place.run()
    items = spark.read.parquet(place.items)
    items.where("item_id % 2 = 0").write.parquet(f"{place.tmp}/fewer")
    expected = rows_of(old.where("query_id % 2 = 0"))
    assert rows_of(place.run(items=f"file://{place.tmp}/fewer")) == expected and expected
    assert len(list(place.tmp.glob("out/hits/queries=*"))) == 2


def test_fingerprint_goes_by_content(spark):
    s = screen_arrivals.Settings()
    q = spark.createDataFrame([(1, "AAA"), (2, "CCC")], "query_id long, residues string")
    assert screen_arrivals.fingerprint(q, s) == screen_arrivals.fingerprint(q.orderBy(F.desc("query_id")), s)
    assert screen_arrivals.fingerprint(q, s) != screen_arrivals.fingerprint(q.withColumn("residues", F.lower("residues")), s)


def test_arrivals_without_hits(place, spark):
    place.arrive("a", spark.createDataFrame([(1, None, None), (2, "", None), (None, "x y", "s")], "doc_id long, text string, source string"))
    assert place.run().count() == 0 and place.run().count() == 0


# ---------------------------------------------------------------- subjects


def test_subject_database(spark, tmp_path):
    texts = [(1, "abc DEF", "src7"), (2, "ABCdef", "src8"), (3, None, None), (4, "", "src1"), (5, "12 3", "s"), (6, "xxxxxxxxxxxxxxxxYY", None), (7, "bad one", "src2"), (7, "bad one", "src2"), (8, "z" * 30, "none"), (8, "other", "src3"), (None, "no id", "s1")]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(7,), (9,)], "doc_id long").write.parquet(f"{tmp_path}/bad")
    how = build_subjects.Settings(volume_residues=20, least_mask=5)
    run = lambda: build_subjects.run(spark, f"file://{tmp_path}/docs", f"file://{tmp_path}/db", f"file://{tmp_path}/bad", how)
    rows = {(r["oid"], r["residues"]): r for r in run().collect()}
    assert set(rows) == {(1, "ABCDEF"), (6, "X" * 16 + "YY"), (8, "Z" * 30), (8, "OTHER")}
    assert rows[1, "ABCDEF"]["members"] == 2 and rows[1, "ABCDEF"]["taxid"] == 7 and rows[8, "Z" * 30]["taxid"] == 0
    assert [tuple(m) for m in rows[6, "X" * 16 + "YY"]["masks"]] == [(0, 16)]
    ids = {(r["subject_id"], r["oid"]) for r in spark.read.parquet(f"{tmp_path}/db/ids").collect()}
    assert ids == {("1", 1), ("2", 1), ("6", 6), ("8", 8)}
    first = rows_of(spark.read.parquet(f"{tmp_path}/db/subjects"))
    assert rows_of(run()) is not None and rows_of(spark.read.parquet(f"{tmp_path}/db/subjects")) == first
    # The library reads it as its own.
    assert catalog.read_subjects(spark, f"{tmp_path}/db/subjects").count() == 4


def test_volumes_of_a_smaller_input_leave_none_behind(spark, sf, tmp_path):
    how = build_subjects.Settings(volume_residues=20_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.where("doc_id < 20").write.parquet(f"{tmp_path}/few")
    build_subjects.run(spark, f"{sf}/documents.parquet", f"{tmp_path}/db", settings=how)
    many = len(list((tmp_path / "db/subjects").glob("volume=*")))
    table = build_subjects.run(spark, f"{tmp_path}/few", f"{tmp_path}/db", settings=how)
    volumes = spark.read.parquet(f"{tmp_path}/db/volumes")
    assert len(list((tmp_path / "db/subjects").glob("volume=*"))) == volumes.count() < many
    assert volumes.agg(F.sum("residues")).first()[0] == table.agg(F.sum("length")).first()[0]
    lengths = [r["length"] for f in sorted((tmp_path / "db/subjects/volume=0").glob("*.parquet")) for r in spark.read.parquet(str(f)).collect()]
    assert lengths == sorted(lengths)


def test_empty_input(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").where("false").write.parquet(f"{tmp_path}/none")
    assert build_subjects.run(spark, f"{tmp_path}/none", f"{tmp_path}/db").count() == 0


# ---------------------------------------------------------------- command lines


def test_settings_files(tmp_path):
    assert settings(screen_arrivals.Settings, None) == screen_arrivals.Settings()
    for job in (screen_arrivals, build_subjects):
        assert settings(job.Settings, job.__file__.replace(".py", ".json")) == job.Settings()
    (tmp_path / "bad.json").write_text(json.dumps({"topp": 1}))
    with pytest.raises(ValueError, match="topp"):
        settings(screen_arrivals.Settings, str(tmp_path / "bad.json"))


def test_command_line_parses_paths(monkeypatch):
    from jobs import common

    seen = {}

    class Session:
        def stop(self):
            seen["stopped"] = True

    class Builder:
        appName = lambda self, _: self
        getOrCreate = lambda self: Session()

    monkeypatch.setattr(common.SparkSession, "builder", Builder())
    run = lambda spark, documents, out, excluded, settings: seen.update(documents=documents, out=out, excluded=excluded, settings=settings)
    assert common.command_line("x", "y", build_subjects.PATHS, build_subjects.Settings, run, ["--documents", "a", "--out", "b"]) == 0
    assert seen == {"documents": "a", "out": "b", "excluded": None, "settings": build_subjects.Settings(), "stopped": True}

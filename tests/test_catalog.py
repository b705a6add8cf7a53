"""Look-ups, user columns, aliases, encodings, volumes by bytes, written parts, merged reports, checked inputs."""

import pytest
from pyspark.sql import functions as F

from strandloom.functions import residues as R
from strandloom.operators import ranges
from strandloom.sources import catalog, fasta, report


@pytest.fixture(scope="module")
def subjects(spark):
    rows = [(0, "P1.1", "one", "MKV"), (1, "P1.2", "two", "MKVL"), (2, "q9", None, "GGGGG"), (3, "Q9", "four", "MKV")]
    return spark.createDataFrame(rows, "oid long, subject_id string, title string, residues string")


def test_oids_of_accessions_and_hashes(spark, subjects):
    ids = spark.createDataFrame([("P1",), ("p1.2",), ("Q9",), ("none",)], "subject_id string")
    found = sorted((r["subject_id"], -1 if r["oid"] is None else r["oid"]) for r in catalog.oids_of(subjects, ids).collect())
    assert found == [("P1", 0), ("P1", 1), ("Q9", 2), ("Q9", 3), ("none", -1), ("p1.2", 1)]
    hashed = catalog.with_hash(subjects)
    one = hashed.where("oid = 0").select("hash")
    assert sorted(r["oid"] for r in catalog.oids_of(hashed, one, "hash").collect()) == [0, 3]


def test_sequences_and_totals(spark, subjects):
    oids = spark.createDataFrame([(1,), (1,), (9,)], "oid long")
    assert [tuple(r) for r in catalog.sequences_of(subjects, oids).collect()] == [(1, "MKVL")]
    r = catalog.totals(subjects, oids=(1, 4)).first()
    assert (r["n"], r["residues"], r["longest"], r["shortest"], r["mean"]) == (3, 12, 5, 3, 4)
    none = catalog.totals(subjects, include=spark.createDataFrame([], "subject_id string")).first()
    assert (none["n"], none["residues"], none["mean"]) == (0, 0, 0)


def test_user_columns_keep_what_is_said_about_them(spark, subjects, tmp_path):
    blobs = spark.createDataFrame([(0, bytearray(b"\x00\x01")), (0, bytearray(b"x")), (2, bytearray(b""))], "oid long, blob binary").limit(3)
    out = catalog.with_user_column(subjects, blobs.where("octet_length(blob) <> 1"), "blob", {"unit": "bits", "by": "me"})
    out.write.parquet(f"{tmp_path}/t")
    back = catalog.read_subjects(spark, f"{tmp_path}/t")
    assert catalog.about_columns(back) == {"blob": {"unit": "bits", "by": "me"}} and catalog.user_columns(back) == ["blob"]
    assert {r["oid"]: None if r["blob"] is None else bytes(r["blob"]) for r in back.collect()} == {0: b"\x00\x01", 1: None, 2: b"", 3: None}
    with pytest.raises(ValueError):
        catalog.with_user_column(out, blobs, "blob")


def test_aliases_join_tables(spark, subjects, tmp_path):
    at = lambda x: f"{tmp_path}/{x}"
    subjects.where("oid < 2").write.parquet(at("a"))
    subjects.where("oid >= 2").withColumn("taxid", F.lit(7)).write.parquet(at("b"))
    subjects.where("oid in (1, 2)").select("subject_id").write.parquet(at("ids"))
    catalog.write_alias(spark, at("all.alias"), [at("a"), at("b")], "both")
    catalog.write_alias(spark, at("some.alias"), [at("all.alias")], ids=at("ids"))
    assert sorted((r["oid"], r["taxid"]) for r in catalog.read_alias(spark, at("all.alias")).collect() if r["taxid"]) == [(2, 7), (3, 7)]
    assert sorted(r["oid"] for r in catalog.read_alias(spark, at("some.alias")).collect()) == [1, 2]
    catalog.write_alias(spark, at("loop.alias"), [at("loop.alias")])
    with pytest.raises(ValueError, match="itself"):
        catalog.read_alias(spark, at("loop.alias"))


def test_encodings(spark):
    row = spark.createDataFrame([(bytearray([0x12, 0x48, 0xF0]), bytearray([10, 0, 1, 22, 27, 99]), "mk u*")], "four binary, std binary, eaa string")
    assert list(row.select(R.from_4na(F.col("four"), F.lit(5)), R.from_stdaa(F.col("std")), R.from_eaa(F.col("eaa"))).first()) == ["ACGTN", "K-AYJX", "MKU*"]


def test_volumes_by_bytes(spark):
    rows = spark.createDataFrame([(i, "id" * 5, "é" * (i % 3), "M" * 10) for i in range(30)], "oid long, subject_id string, title string, residues string")
    found = {r["oid"]: r["volume"] for r in ranges.volumes(rows, 100, measure="bytes").collect()}
    before = 0
    for i in range(30):
        assert found[i] == before // 100
        before += 10 + 2 * (i % 3) + 10
    with pytest.raises(ValueError):
        ranges.volumes(rows, 100, measure="rows")


def test_written_parts_hold_all_records_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"s{i}", "t" if i % 2 else None, "MKVL" * (1 + i % 7)) for i in range(40)], "ord long, subject_id string, title string, residues string")
    fasta.write_parts(rows, f"{tmp_path}/parts", 4)
    folders = sorted((tmp_path / "parts").glob("part=*"))
    assert [p.name for p in folders] == [f"part={k}" for k in range(1, 5)]
    ids, sizes = [], []
    for p in folders:
        text = "".join(f.read_text() for f in sorted(p.glob("*.txt")))
        ids += [line[1:].split()[0] for line in text.splitlines() if line.startswith(">")]
        sizes.append(len(text))
    assert ids == [f"s{i}" for i in range(40)] and max(sizes) - min(sizes) < 100


def test_merged_reports(spark, tmp_path):
    for k, text in enumerate(["# head\na\tb\nc\td\n", "# head\ne\tf\n# end\n"]):
        (tmp_path / f"p{k}.txt").write_text(text)
    report.merged_files(spark, [f"{tmp_path}/p1.txt", f"{tmp_path}/p0.txt"], f"{tmp_path}/out")
    assert [line for f in sorted((tmp_path / "out").glob("*.txt")) for line in f.read_text().splitlines()] == ["e\tf", "a\tb", "c\td"]


def test_inputs_are_checked(spark, tmp_path):
    (tmp_path / "p.fa").write_text(">a\nMKVLEFW\n>b\nMKQILP\n>c\nACGTACGT\n")
    (tmp_path / "none.fa").write_text("\n")
    assert [r["subject_id"] for r in fasta.checked_input(spark, f"{tmp_path}/p.fa", "protein").collect()] == ["a", "b"]
    for path, molecule, error in (("p.fa", "nucleotide", ValueError), ("none.fa", "protein", ValueError), ("lost.fa", "protein", FileNotFoundError), ("p.fa", "rna", ValueError)):
        with pytest.raises(error):
            fasta.checked_input(spark, f"{tmp_path}/{path}", molecule)


def test_gathered_letters_are_those_of_subjects(spark):
    texts = ["ab C1d", "", None, "é", "Straße Ünï x", "12 3", "[@`{|}^_] zZaA", "😀 a😀B"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "no id"), (0, "ab")], "doc_id long, text string").repartition(3)
    got = sorted((str(r["oid"]), r["residues"]) for r in catalog.gathered(docs).collect())
    assert got == sorted((str(r["oid"]), r["residues"]) for r in catalog.subjects_of(docs).collect())
    assert ("4", "STRAENX") in got and catalog.gathered(docs.where("false")).count() == 0

"""Shards by virtual slots: the law, the numbers within a shard, and edits of the map."""

import zlib

import pytest
from pyspark.sql import functions as F

from strandloom.llm import queries, sharding
from tests.llm.helpers import documents, nothing, odd_documents


def load(df):
    out = [[] for _ in range(sharding.SHARDS)]
    for r in df.collect():
        out[r["shard"]].append((r["slot"], r["size"]))
    return out


def holds(df, largest_free):
    """Every shard numbers its rows without gaps; sizes are near equal."""
    shards = load(df)
    for rows in shards:
        assert sorted(s for s, _ in rows) == list(range(len(rows)))
    sums = [sum(n for _, n in rows) for rows in shards]
    assert max(sums) - min(sums) <= largest_free, sums


def test_query(spark, sf):
    docs = documents(spark, sf)
    found = queries.op11_sharding(spark, sf)
    rows = {r["doc_id"]: r for r in found.collect()}
    plain = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert rows.keys() == plain.keys() and found.count() == docs.count()
    for i, text in plain.items():
        raw = (text or "").encode()
        assert (rows[i]["size"], rows[i]["text_crc32"], rows[i]["law"], rows[i]["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    holds(found, 0.01 * sum(r["size"] for r in rows.values()) / 8)
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in queries.op11_sharding(spark, sf).collect()) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows.values())


def test_a_hot_record_is_spread(spark):
    """Two thirds of all rows are equal, and so are of one slot."""
    x = F.col("id") < 6000
    docs = spark.range(9000).select(F.when(~x, F.col("id")).otherwise(7).alias("doc_id"), F.when(x, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    found = sharding.place(docs)
    assert found.groupBy("virtual_slot").count().agg(F.max("count")).first()[0] >= 6000
    holds(found, 20)


def test_null_ids_and_texts(spark):
    docs = spark.createDataFrame([(None, None)] * 50 + [(None, "x" * i) for i in range(50)] + [(i, None) for i in range(50)], "doc_id long, text string")
    found = sharding.place(docs)
    assert found.count() == 150
    assert {(r["size"], r["text_crc32"]) for r in found.where("doc_id is not null").collect()} == {(1, 0)}
    holds(found, 8)


def test_odd_and_empty_tables(spark):
    docs = odd_documents(spark)
    assert sharding.place(docs, keep=tuple(docs.columns), prefix="__").drop("__size", "__text_crc32", "__law", "__shard", "__slot", "__grown_shard", "__virtual_slot", "__map_version").exceptAll(docs).count() == 0
    # The longest text is more than a shard's share; the others are numbered all the same.
    assert all(sorted(s for s, _ in rows) == list(range(len(rows))) for rows in load(sharding.place(docs)))
    assert sharding.place(nothing(spark)).count() == 0


def test_edits_move_little():
    keys = [(v, 0) for v in range(512)]
    size = {k: 100 + (k[0] * 7919) % 50 for k in keys}
    start = sharding.first_map(keys, 8)
    v2 = sharding.edited(start, size, 8)
    # The corpus grows a little, unevenly: a few slots move.
    more = {k: n + (30 if k[0] % 17 == 0 else 1) for k, n in size.items()}
    v3 = sharding.edited(v2, more, 8)
    assert sum(v2[k] != v3[k] for k in keys) <= 20
    # A ninth shard takes slots only into itself, as far as that alone brings balance.
    v4 = sharding.edited(v3, more, 9, apart=0.05)
    moved = [k for k in keys if v3[k] != v4[k]]
    assert moved and {v4[k] for k in moved} == {8}
    loads = [sum(n for k, n in more.items() if v4[k] == s) for s in range(9)]
    assert max(loads) - min(loads) <= 0.05 * sum(loads) / 9 + 1


def test_edits_leave_what_is_too_large():
    now = {(0, 0): 0, (1, 0): 0, (2, 0): 1}
    assert sharding.edited(now, {(0, 0): 1000, (1, 0): 10, (2, 0): 5}, 2) == {(0, 0): 0, (1, 0): 1, (2, 0): 1}
    assert sharding.edited(now, {}, 2) == now


def test_versions_are_kept(spark, sf, tmp_path):
    folder = f"file://{tmp_path}/maps"
    sharding.place(documents(spark, sf), maps=folder).count()
    one, two = (sharding.read_map(spark, folder, v) for v in (1, 2))
    assert one.count() == two.count() >= sharding.SLOTS and one.where("shard <> virtual_slot % 8").where("pieces = 1").isEmpty()
    assert two.groupBy("virtual_slot").agg(F.max("pieces").alias("p"), F.count("*").alias("n")).where("p <> n").isEmpty()
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.write_map(spark, folder, 2, {(0, 0): 1})


def test_written_shards_have_all_rows(spark, sf, tmp_path):
    docs = documents(spark, sf)
    sharding.write_shards(docs, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.select(docs.columns).exceptAll(docs).isEmpty() and back.count() == docs.count()
    assert sorted(p.name for p in (tmp_path / "shards").glob("__shard=*")) == [f"__shard={i}" for i in range(8)]

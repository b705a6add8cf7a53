"""What the islands of a query and subject make in tasks, against the shuffle of islands."""

import pytest
from pyspark.sql import functions as F

from strandloom.operators import hits as H
from strandloom.operators import ranges, scan, words
from strandloom.operators.pairs import local_scores
from strandloom.plans import registry

from .test_scan import rows, tables

K = 3


def counted(i):
    return i.groupBy("query_id", "oid").agg(F.sum("n_seeds").alias("seeds"), F.count("*").alias("islands"), F.count(F.when(F.col("length") >= 16, 1)).alias("long_islands"), F.max("length").cast("int").alias("longest"))


# In tasks, and by Spark from islands: F13 query_coverage, F15 hit_counters, F16 bit_scores, F23 mask_level_filter, F24 hsp_common_endpoint_purge, F25 smith_waterman, F27 range_merge, F21 range_fetch.
MADE = {
    "counters": (scan.counters, lambda i, q, s: counted(i)),
    "lengths": (scan.lengths, lambda i, q, s: i.groupBy("query_id", "oid", F.col("length").cast("int").alias("length")).agg(F.count("*").alias("n"))),
    "covered": (scan.covered, lambda i, q, s: ranges.coverage(registry._as_hsps(i), q).select("query_id", "oid", "covered")),
    "purged": (scan.purged, lambda i, q, s: H.purged(registry._as_hsps(i))),
    "local scores": (lambda f, s: scan.local_scores(f, s, 5), lambda i, q, s: local_scores(i.where("length >= 5").select("query_id", "oid").distinct(), q, s)),
    "merged ranges": (lambda f, s: scan.merged_ranges(f, s, 1, 2), lambda i, q, s: ranges.merged(registry._places(i), gap=1, pad=2).withColumns({"from": F.col("from").cast("int"), "to": F.col("to").cast("int")})),
    "fetched ranges": (lambda f, s: scan.merged_ranges(f, s, 1, 2, True).where("oid is not null"), lambda i, q, s: ranges.fetched(s, registry._places(i), gap=1, pad=2)),
    "mask level": (lambda f, s: H.masked_level(scan.best_of_ranges(f, s, 1), 50), lambda i, q, s: H.masked_level(registry._as_hsps(i), 50)),
    "culled": (lambda f, s: H.culled(scan.best_of_ranges(f, s, 2), 2), lambda i, q, s: H.culled(registry._as_hsps(i), 2)),
    "long islands": (lambda f, s: scan.islands(f, s, 5), lambda i, q, s: i.where("length >= 5")),
}


@pytest.mark.parametrize("made", MADE)
@pytest.mark.parametrize(("query_ids", "oids"), [(range(5), range(8)), (range(5), [*range(7), None]), (range(5), [1, 1, 2, None, None, 3])])
def test_islands_of_a_pair_are_summed_up_where_they_are_found(spark, made, query_ids, oids):
    q, s = tables(spark, 11, query_ids, oids)
    alone, plain = MADE[made]
    found = words.of_islands(q, s, K, alone, lambda i: plain(i, q, s))
    want = plain(words.islands(words.seeds(q, s, K), K), q, s)
    if made in ("mask level", "culled") and len(set(oids)) < len(list(oids)):
        pytest.skip("filters over all subjects go over both parts, as in the queries")
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found.select(want.columns)) == rows(want) != []


@pytest.mark.parametrize("made", MADE)
def test_parts_of_queries_and_folds_change_nothing(spark, made, monkeypatch):
    q, s = tables(spark, 5, range(9), range(6))
    kernels = lambda: MADE[made][0](scan.few(q, K), s)
    want = rows(kernels())
    source = scan.Index.steps

    def small(self, texts, lo=0):
        kept, scan._SEEDS = scan._SEEDS, 4
        try:
            yield from source(self, texts, lo)
        finally:
            scan._SEEDS = kept

    monkeypatch.setattr(scan, "_HELD", 3)
    monkeypatch.setattr(scan.Index, "steps", small)
    assert rows(kernels()) == want != []


@pytest.mark.parametrize("name", ["counters", "lengths", "covered", "purged", "local scores", "merged ranges", "fetched ranges", "long islands"])
def test_neither_islands_nor_residues_are_shuffled(spark, name):
    q, s = tables(spark, 3, range(5), range(8))
    plan = words.of_islands(q, s, K, MADE[name][0], lambda i: i)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("name", ["query_coverage", "hit_counters", "bit_scores", "evalues", "hsp_common_endpoint_purge", "smith_waterman", "range_merge", "range_fetch"])
def test_queries_shuffle_texts_once_and_nothing_else(spark, sf, name):
    found = registry.queries()[name](spark, sf)
    found.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    shuffles = [x for x in final.splitlines() if "Exchange" in x and "Broadcast" not in x and "SinglePartition" not in x]
    assert len([x for x in shuffles if "hashpartitioning(oid" in x]) == 1 and all("hashpartitioning(oid" in x or "query_id" in x for x in shuffles), final

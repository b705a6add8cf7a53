"""Seeds found as subjects stream by, against the joins and shuffles of seeds."""

import numpy as np
import pytest

from strandloom.operators import scan, words

STEPS = {
    "islands": (lambda q, s, k: words.islands_of(q, s, k), lambda q, s, k: words.islands(words.seeds(q, s, k), k)),
    "two hits": (lambda q, s, k: words.two_hits_of(q, s, k, 12), lambda q, s, k: words.two_hits(words.seeds(q, s, k), k, 12)),
    "right arms": (lambda q, s, k: words.right_arms_of(q, s, k, 9), lambda q, s, k: words.right_arms(q, s, k, 9)),
    "seeds": (lambda q, s, k: words.seeds(q, s, k), lambda q, s, k: words.seeds(q, s, k)),
}


def tables(spark, seed, query_ids, oids):
    rng = np.random.default_rng(seed)
    text = lambda n: "".join(rng.choice(list("ACDW"), rng.integers(0, n)))
    q = spark.createDataFrame([(i, text(40)) for i in query_ids], "query_id long, residues string")
    s = spark.createDataFrame([(i, text(90)) for i in oids] + [(901, ""), (902, "A"), (903, "ACDWACDWACDWACDWACDW")], "oid long, residues string")
    return q, s


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize(("query_ids", "oids"), [(range(5), range(8)), ([1, 2, 2, None, None], range(8)), (range(5), [1, 1, 2, None, None, 3, 2**53 + 1])])
def test_scan_gives_the_rows_of_the_join(spark, monkeypatch, step, query_ids, oids):
    q, s = tables(spark, 7, query_ids, oids)
    found, plain = STEPS[step]
    mine = rows(found(q, s, 3))
    monkeypatch.setattr(scan, "WORDS", 0)
    assert mine == rows(plain(q, s, 3)) and mine


def test_steps_are_bounded_and_lose_no_seed(monkeypatch):
    rng = np.random.default_rng(1)
    text = lambda n: "".join(rng.choice(list("AC"), n))
    index = scan.Index([(0, text(30)), (1, text(20)), (0, text(9)), (2, "A")], 2)
    texts = ["", text(40), text(3), text(25), "A"]
    whole = lambda: sorted((lo + at, *x) for lo, _, _, (a, *r) in index.steps(texts) for at, *x in zip(a.tolist(), *(c.tolist() for c in r), strict=True))
    once = whole()
    plain = sorted((j, c, x, y) for j, t in enumerate(texts) for c, r in index.rows for y in range(len(t) - 1) for x in range(len(r) - 1) if t[y : y + 2] == r[x : x + 2])
    monkeypatch.setattr(scan, "_SEEDS", 20)
    assert len(list(index.steps(texts))) > 4 and whole() == once == plain


def test_neither_words_nor_seeds_are_shuffled(spark):
    q, s = tables(spark, 3, range(5), range(8))
    for found, _ in STEPS.values():
        plan = found(q, s, 3)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("oids", [range(8), [1, 1, 2, None, 3], [1, 1, 2, None, None]])
@pytest.mark.parametrize("more", ["", "äöüßé", "".join(map(chr, range(200, 2000)))])
def test_words_are_counted_where_texts_are(spark, oids, more):
    from pyspark.sql import functions as F

    _, s = tables(spark, 5, range(2), oids)
    s = s.union(spark.createDataFrame([(77, more + "ACACACA" + more)], "oid long, residues string"))
    plain = words.words(s, 6, key="oid").groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("oid").alias("subjects"))
    found = words.word_counts(s, 6)
    assert rows(found) == rows(plain)
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString() or len(set(oids)) < len(list(oids))

"""Options of the search act or are refused; the default search against plain look-ups of every word."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import residues as R
from strandloom.functions.matrix import RESIDUES
from strandloom.operators import hits as H
from strandloom.plans import search as S
from strandloom.plans.options import SearchOptions

AMINO = "ACDEFGHIKLMNPQRSTVWY"


def tables(spark, queries, subjects):
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, residues string")
    return q, spark.createDataFrame(list(enumerate(subjects)), "oid long, residues string")


@pytest.fixture(scope="module")
def related(spark):
    """Queries, and subjects that hold a mutated copy of some query."""
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice(AMINO) for _ in range(n))
    queries = [text(60) for _ in range(6)] + ["", "AC", "ACD"]
    subjects = []
    for i in range(30):
        copy = "".join(c if rng.random() < 0.75 else rng.choice(AMINO) for c in queries[i % 6])
        subjects.append(text(rng.randint(0, 80)) + copy + text(rng.randint(0, 80)))
    return (queries, subjects + ["", "A"], *tables(spark, queries, subjects + ["", "A"]))


def test_blocks_of_queries_give_the_pairs_of_one_block(spark, related, monkeypatch):
    _, _, q, s = related
    rows = lambda: sorted(tuple(r) for r in S.search(spark, q, s, SearchOptions(evalue=1e-3)).select("query_id", "oid", "q_start", "q_end", "s_start", "s_end", "score").collect())
    want = rows()
    monkeypatch.setattr(S, "BLOCK_RESIDUES", 100)
    assert rows() == want and len(want) >= 30


def test_default_search_finds_the_copies(spark, related):
    _, _, q, s = related
    best = {r["oid"]: r["query_id"] for r in S.search(spark, q, s, SearchOptions(evalue=1e-6)).orderBy("evalue", ascending=False).collect()}
    assert best == {i: i % 6 for i in range(30)}


def test_masks_hold_in_both_modes(spark, related):
    queries, subjects, q, s = related
    for o in (SearchOptions(evalue=1e-3), SearchOptions(threshold=None, word_size=3, evalue=1e-3)):
        n = S.search(spark, q, s, o).where("oid = 0").count()
        whole = spark.createDataFrame([(0, 0, len(subjects[0]))], "oid long, from int, to int")
        edge = spark.createDataFrame([(0, 0, 1), (0, len(subjects[0]) - 1, len(subjects[0])), (7, 3, 3)], "oid long, from int, to int")
        assert n and S.search(spark, q, s, o, masks=whole).where("oid = 0").count() == 0
        assert S.search(spark, q, s, o, masks=edge).where("oid = 0").count() == n
        assert S.search(spark, q, s, o, masks=whole).where("oid = 6").count() > 0


def test_lower_case_queries_seed_nothing(spark, related):
    queries, _, _, s = related
    q, _ = tables(spark, [queries[0].lower(), queries[1][:30] + queries[1][30:].lower()], [])
    for o in (SearchOptions(evalue=1e-3), SearchOptions(threshold=None, evalue=1e-3)):
        assert {r["query_id"] for r in S.search(spark, q, s, o).collect()} == {0, 1}
        assert 0 not in {r["query_id"] for r in S.search(spark, q, s, o.with_(lower_case_masking=True)).collect()}


def test_matrix_text_scores(spark, related):
    _, _, q, s = related
    letters = RESIDUES[1:]
    twos = "  " + " ".join(letters) + "\n" + "\n".join(a + " " + " ".join("9" if a == b else "-3" for b in letters) for a in letters)
    o = SearchOptions(threshold=None, ungapped=True, evalue=1e-3)
    changed = S.search(spark, q, s, o.with_(matrix=twos))
    assert changed.where(F.col("score") != 9 * F.col("identities") - 3 * (F.col("align_length") - F.col("identities"))).count() == 0 < changed.count()
    for bad in ({"matrix": "PAM30"}, {"max_intron": 100}, {"genetic_code": 99}):
        with pytest.raises(ValueError):
            SearchOptions(**bad)


def test_genetic_code_of_a_translated_search(spark):
    q, s = tables(spark, ["TGAGCTTGGAAATGAGCTTGGAAATGGCAT" * 3], ["WAWKWAWKWH" * 3])
    o = SearchOptions(task="translated", threshold=None, evalue=10.0, strand="plus", seg=False, composition=0)
    one, two = (S.search(spark, q, s, o.with_(genetic_code=c)).where("frame = 1").agg(F.max("identities")).first()[0] for c in (1, 2))
    assert two == 30 and (one or 0) < 30
    assert spark.range(1).select(R.translated(F.lit("TGAAGAATA"), 1, R.CODES[2])).first()[0] == "W*M"


def test_search_space_goes_by_the_longest_frame(spark):
    """The frame that is last in the alphabet is not the longest one."""
    bases = "TAC" * 40 + "TACG"
    q, s = tables(spark, [bases], ["Y" * 40 + "ACDEFGHIKLMNPQRSTVWY" * 20])
    o = SearchOptions(task="translated", threshold=None, seg=False, composition=0)
    frames = S.contexts(q, o)
    longest = max(len(r["residues"]) for r in frames.collect())
    space = H.search_space(longest, 440, 1)
    r = S.search(spark, q, s, o).orderBy("evalue").first()
    want = space * 0.041 * np.exp(-0.267 * r["score"])
    assert abs(r["evalue"] / want - 1) < 1e-9


def test_long_subjects_in_pieces_give_the_hits_of_whole_ones(spark, monkeypatch):
    """Passages are planted across every seam; pairs are those of a search without pieces, masks included."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice(AMINO) for _ in range(n))
    queries = [text(50) for _ in range(3)]
    size = 5000  # four times the margin is less
    body = list(text(4 * size + 700))
    for at in (size - 25, 2 * size - 3, 3 * size - 49, 4 * size + 640, 0, 1200, size + 900):
        copy = "".join(c if rng.random() < 0.85 else rng.choice(AMINO) for c in queries[at % 3])
        body[at : at + 50] = copy
    body = "".join(body)
    q, s = tables(spark, queries, [body, text(300) + queries[0]])
    masks = spark.createDataFrame([(0, 1200, 1250), (0, 2 * size - 3, 2 * size + 60)], "oid long, from int, to int")
    key = ["query_id", "oid", "q_start", "q_end", "s_start", "s_end", "score", "script"]
    for o in (SearchOptions(evalue=1e-3, composition=0), SearchOptions(evalue=1e-3, ungapped=True, link=False, threshold=None)):
        rows = lambda chunk, m=None: sorted(map(str, S.search(spark, q, s, o.with_(chunk=chunk), masks=m).select(key).collect()))  # noqa: B023, E731
        whole = rows(10**9)
        assert rows(size) == whole and len(whole) >= 6
        assert rows(size, masks) == rows(10**9, masks) != whole
    assert S.pieces(s, size, 1100).count() == 6


def test_limits_and_filters_of_a_whole_search(spark, related):
    _, _, q, s = related
    o = SearchOptions(evalue=1e-3)
    every = S.search(spark, q, s, o)
    few = S.search(spark, q, s, o.with_(max_hsps_total=2)).collect()
    best = {}
    for r in every.collect():
        best.setdefault(r["query_id"], []).append(r["score"])
    assert {k: sorted(v)[-2:] for k, v in best.items()} == {k: sorted(r["score"] for r in few if r["query_id"] == k) for k in best}
    level = S.search(spark, q, s, o.with_(mask_level=50)).collect()
    assert {r["query_id"] for r in level} == set(best) and len(level) < every.count()
    raw = S.search(spark, q, s, SearchOptions(least_score=90, evalue=1e-30))
    assert raw.count() > 0 and raw.where("score < 90").isEmpty()
    with pytest.raises(ValueError):
        SearchOptions(mask_level=101)


def test_hits_with_titles_and_taxids(spark, related):
    from strandloom.sources import report

    _, _, q, s = related
    subjects = s.withColumns({"subject_id": F.concat(F.lit("s"), "oid"), "title": F.concat(F.lit("title "), "oid"), "taxid": F.col("oid").cast("int") + 7})
    hits = report.enriched(S.search(spark, q, s, SearchOptions(evalue=1e-3)), subjects.where("oid <> 3"))
    rows = report.tabular(hits, "qseqid sacc stitle staxid").collect()
    assert len(rows) == hits.count() and {(r["stitle"], r["staxid"]) for r in rows if r["sacc"] == "s4"} == {("title 4", "11")}
    assert {r["stitle"] for r in rows if r["sacc"] is None} == {None}

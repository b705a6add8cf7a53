"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import queries, spelling
from tests.llm.helpers import documents, nothing, odd_documents


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, letters=6, least=5, ratio=5):
    """The whole contract over (doc_id, text) rows."""
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = "".join(c for k, c in enumerate(run) if k != h % len(run))
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= letters and c >= least}
    others = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in others.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def taken(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé", max_size=7), max_size=60))
def test_trie_gives_all_pairs(found):
    words = sorted(found)
    assert sorted(spelling.joined(words)) == [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)]


@pytest.mark.parametrize("most", [5000, 20, 2])
def test_pairs_of_a_partitioned_trie(spark, most):
    """Tries cut down to any size give every pair once."""
    rng = random.Random(most)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 8))) for _ in range(150)} | {"prefixes" + x + y for x in "abcdefg" for y in "abcdefgh"})
    vocabulary = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    found = sorted((r["word"], r["near"]) for r in spelling.near_pairs(vocabulary, most=most).collect())
    assert found == [(a, b) for a in words for b in words if near(a, b)]


def test_whole_contract(spark):
    rng = random.Random(3)
    base = ["receive", "separate", "ÉTUDIANT", "straße", "aaaaaa", "language" * 4]
    rows = []
    for i in range(120):
        some = []
        for _ in range(60):
            w = rng.choice(base)
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "x", "é"]) + w[k + rng.randrange(2) :]
            some.append(w)
        rows.append((None if i == 7 else i % 100, rng.choice([" ", "-", "\n", "1", "×÷"]).join(some) if i != 9 else None))
    rows += [(200, "chainedword " * 400 + "chainedwor " * 40), (201, "chainedwo " * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    assert any(r[1] and r[1] != r[2] for r in expected)  # a chain of forms
    assert taken(spelling.variants(docs)) == expected
    assert taken(spelling.variants(docs, most=3)) == expected


def test_ties_take_the_first_word(spark):
    rows = [(1, "spelling " * 50 + "spalling " * 50 + "spolling " * 5)]
    found = {r["word"]: r for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found["spolling"]["form"] == "spalling" and found["spalling"]["form"] is None and found["spelling"]["n_near"] == 2


def test_odd_rows(spark):
    docs = odd_documents(spark)
    assert taken(spelling.variants(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert spelling.variants(nothing(spark)).count() == 0


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    rows = [(1, "letters and lettres " * 3000 + "m" * 50_000 + " " + ("m" * 50_000 + " ") * 5)]
    assert taken(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_query_against_sql(spark, sf):
    found = taken(queries.op12_spelling_variants(spark, sf))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cols = ["word", "form", "root", "n", "n_near", "form_n"]
    assert found == sorted(con.execute(f"select {', '.join(cols)} from ({spelling.ORACLE_SQL})").fetchall(), key=str)
    assert found == brute([(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()])

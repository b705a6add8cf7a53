"""URL filters, near duplicates, chat formatting, WARC, token store, pipeline."""

import base64
import hashlib
import io
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import chat_format, decontaminate, language_id, near_dedup, pii, queries, token_store, url_filters, warc
from strandloom.llm.chunks import default_path
from strandloom.llm.components import components
from tests.llm.helpers import documents, nothing, odd_documents

# ------------------------------------------------------------------ urls


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.index(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def plain_rule(host, path):
    best = (None, None)
    for rule, says in url_filters.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best[0] is None or len(rule) > len(best[0])):
            best = rule, says
    return best


URLS = [None, "", "nothing", "http://", "http:///p", "HTTP://EXAMPLE.com/en/7?x#y", "ftp://a.ÉXample.com/en/9", "x://com/en/", "x://telecom/en/", "x://a.b.net/de/8", "x://example.net/de/8/9", "x://example.net?/de/8", "x://y.org/es/#/", "a://b://c/d", "http://h/" + "s/" * 3000, "http://h/a b\n/c"]


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, "http://again.com/en/")], "page_id long, url string")
    found = url_filters.judge(pages, None).collect()
    assert len(found) == len(URLS) + 1
    for r in found:
        if r["page_id"]:
            host, path = plain_parts(URLS[r["page_id"]])
            rule, says = plain_rule(host, path)
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, says or "allow")


def test_url_templates_reject_by_purity(spark):
    rows, labels = [], []
    for i in range(400):
        rows.append((i, f"http://site.com/{'spam' if i % 4 == 0 else 'good'}/{i}/page-{i % 3}"))
        if i % 2 == 0:
            labels.append((i, 0 if i % 4 == 0 else 1))
    for i in range(400, 460):
        rows.append((i, f"http://site.com/u{i}x/about"))
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    found = {r["page_id"]: r for r in url_filters.judge(pages, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert found[0]["template"].startswith("/spam/*/") and found[1]["template"].startswith("/good/*/")
    assert {r["verdict"] for i, r in found.items() if i < 400 and i % 4 == 0} == {"block"}
    assert {r["verdict"] for i, r in found.items() if i % 4 or i >= 400} == {"allow"}


def test_url_paths_share_runs_of_segments(spark, monkeypatch):
    """Deep paths take a round for each level at which they part; templates are those of single levels."""
    rounds = []
    before = url_filters.written
    monkeypatch.setattr(url_filters, "written", lambda df, name, *a: (rounds.append(name), before(df, name, *a))[1])
    trap = "/".join(["calendar", "2024"] * 400)
    deep = [f"/{trap}/a/x1", f"/{trap}/b/x2", f"/{trap}/b/12345", f"/{trap}", f"/{trap[:1000]}", "/u/v/w", "/u/v", "/u"]
    rows = [(i, f"http://trap.com{p}") for i, p in enumerate(deep)] + [(i + 50, f"http://chain.com{'/s' * i}") for i in range(1, 120)]
    found = {r["page_id"]: r["template"] for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string"), None).collect()}
    looks = lambda p: "".join("/" + ("*" if re.match(url_filters.VARIABLE, x) else x) for x in p.split("/") if x)
    assert found == {i: looks(u.split(".com", 1)[1]) for i, u in rows}
    assert rounds.count("children") <= 6


def test_url_statistics_reach_every_level(spark):
    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:04d}")
    rows = [(i, f"http://deep.com/a/b/c/d/e/f/{'bad' if i < 200 else 'good'}/g/{word(i)}") for i in range(600)]
    labels = [(i, 0 if i < 200 else 1) for i in range(0, 600, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = {r["page_id"]: r for r in url_filters.judge(pages, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert {r["template"] for r in found.values()} == {"/a/b/c/d/e/f/bad/g/*", "/a/b/c/d/e/f/good/g/*"}
    assert all(r["verdict"] == ("block" if i < 200 else "allow") for i, r in found.items())


def plain_templates(rows, labels, most_children=64, rare=0.02, z=1.96, support=5):
    """The tree by plain dictionaries: {page: template}."""
    votes = {}
    for i, y in labels:
        votes.setdefault(i, []).append(y)
    paths = {}
    for i, url in rows:
        at = paths.setdefault(plain_parts(url), [0, 0, 0])
        at[0] += 1
        at[1] += sum(votes.get(i, []))
        at[2] += sum(1 - y for y in votes.get(i, []))
    state = {k: "" for k in paths}
    segs = {k: [s for s in k[1].split("/") if s] for k in paths}
    done, level = {}, 0
    while state:
        nodes = {}
        for k, t in state.items():
            if len(segs[k]) > level:
                nodes.setdefault((k[0], t), []).append(k)
        for k in [k for k, t in state.items() if len(nodes.get((k[0], t), ())) < 2 or len(segs[k]) <= level]:
            done[k] = state.pop(k) + "".join("/" + ("*" if re.search(url_filters.VARIABLE, s) else s) for s in segs[k][level:])
        nodes = {}
        for k, t in state.items():
            nodes.setdefault((k[0], t), {}).setdefault(segs[k][level], []).append(k)
        for (_, t), kinds in nodes.items():
            sums = {s: np.sum([paths[k] for k in ks], 0) for s, ks in kinds.items()}
            n, good, bad = np.sum(list(sums.values()), 0)
            for s, (c, g, b) in sums.items():
                known, others = g + b, good + bad - g - b
                alike = False
                if known >= support and others >= support:
                    p = good / (good + bad)
                    alike = abs(g / known - (good - g) / others) / np.sqrt(max(p * (1 - p), 1e-9) * (1 / known + 1 / others)) < z
                wild = re.search(url_filters.VARIABLE, s) or (len(sums) > most_children and c < rare * n) or alike
                for k in kinds[s]:
                    state[k] = f"{t}/{'*' if wild else s}"
        level += 1
    return {i: done[plain_parts(url)] for i, url in rows}, paths


def test_url_verdicts_by_plain_dictionaries(spark, sf):
    """The query's verdicts, templates and purities against the tree by plain dictionaries."""
    rng = random.Random(21)
    words = ["news", "blog", "shop", "tag", "a", "b", "2024", "item-7", "deadbeef01"]
    rows = [(i, f"http://h{rng.choice('aab')}.com/" + "/".join(rng.choice(words) + (str(rng.randint(0, 400)) if rng.random() < 0.2 else "") for _ in range(rng.randint(0, 6)))) for i in range(1500)]
    labels = [(i, int("shop" not in u or rng.random() < 0.3)) for i, u in rows if rng.random() < 0.5]
    real = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    known = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    for data, votes in ((rows, labels), (real, known)):
        found = {r["page_id"]: r for r in url_filters.judge(spark.createDataFrame(data, "page_id long, url string"), spark.createDataFrame(votes, "doc_id long, quality int")).collect()}
        want, paths = plain_templates(data, votes)
        assert {i: r["template"] for i, r in found.items()} == want
        total = np.sum(list(paths.values()), 0)
        prior = (total[1] + 1) / (total[1] + total[2] + 2)
        hosts, shapes = {}, {}
        for i, url in data:
            host = plain_parts(url)[0]
            ys = [y for k, y in votes if k == i]
            for table, key in ((hosts, host), (shapes, (host, want[i]))):
                at = table.setdefault(key, [0, 0])
                at[0] += sum(ys)
                at[1] += len(ys)
        blocked = 0
        for i, url in data:
            host, path = plain_parts(url)
            g, n = shapes[host, want[i]]
            purity = (g + 8 * (hosts[host][0] + 8 * prior) / (hosts[host][1] + 8)) / (n + 8)
            assert abs(found[i]["purity"] - purity) < 1e-9
            rule, says = plain_rule(host, path)
            assert found[i]["verdict"] == (says or ("block" if purity < 0.5 else "allow"))
            blocked += found[i]["verdict"] == "block"
        assert blocked or data is real


def test_url_empty_table(spark):
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string"), None).count() == 0


# ------------------------------------------------------------------ near duplicates


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    rng = random.Random(1)
    for _ in range(3000):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 12))]
        b = [x for x in a if rng.random() > 0.1] if rng.random() < 0.8 else [rng.randint(0, 3) for _ in range(8)]
        b.insert(rng.randint(0, len(b)), rng.randint(0, 3))
        most, d = rng.randint(0, 8), distance(a, b)
        assert near_dedup.aligned(a, b, most) == (d if d <= most else None)
        size = max(len(a), len(b))
        want = 1 - d / size if d <= int(0.2 * size + 1e-9) else 0
        assert abs(near_dedup.similarity(a, b) - want) < 1e-9


def test_sketches():
    h = np.arange(100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (near_dedup.sketches(h) == near_dedup.sketches(h.copy())).all()
    assert len(near_dedup.sketches(h[:0])) == 0 and len(near_dedup.sketches(h[:2])) == near_dedup.SKETCHES
    big = np.random.default_rng(1).integers(1, 2**63, 200_000, dtype=np.uint64)
    assert (near_dedup.sketches(big) == near_dedup.sketches(big)).all()
    assert (near_dedup.sketches(h) != near_dedup.sketches(h[::-1])).all()


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(1, 50)]
    top = {x: x for p in links for x in p}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        top[max(find(a), find(b))] = min(find(a), find(b))
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: find(x) for p in links if p[0] != p[1] for x in p}


def test_near_duplicates_by_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    texts = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in texts.items()}
    owners = {}
    for i, s in shingles.items():
        for x in s:
            owners.setdefault(x, []).append(i)
    pairs = {(a, b) for v in owners.values() if len(v) < 80 for a in v for b in v if a < b}
    close = 0
    for a, b in pairs:
        j = len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
        if j >= 0.8 and near_dedup.similarity(texts[a], texts[b]):
            close += 1
            assert got[a] == got[b], (a, b, j)
    assert close > 50 and len(got) == len(texts)
    # No class without a link: each member is similar to another one of its class.
    classes = {}
    for i, c in got.items():
        classes.setdefault(c, []).append(i)
    for c, members in classes.items():
        assert c == min(members)
        for i in members if len(members) > 1 else ():
            assert any(near_dedup.similarity(texts[i], texts[k]) for k in members if k != i), (c, i)


def test_near_duplicates_in_hot_groups(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, passage, line = [word() for _ in range(120)], [word() for _ in range(60)], [word() for _ in range(9)]
    rows = [(i, " ".join(base)) for i in range(60)]
    for i in range(100, 160):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    own = {i: [word() for _ in range(90)] for i in range(200, 300)}
    rows += [(i, " ".join(own[i][:40] + passage + own[i][40:])) for i in range(200, 260)]
    rows += [(i, " ".join(own[i]) + ("\n" + " ".join(line)) * 60) for i in range(260, 300)]
    rows += [(400 + i, " ".join(own[i][:40] + passage + own[i][40:89])) for i in range(200, 210)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in [*range(60), *range(100, 160)]} == {0}
    assert all(got[i] == i for i in range(200, 260))
    assert all(got[400 + i] == i for i in range(200, 210))
    # 90 own words and one line of 9 words 60 times: an edit similarity of 540 / 630.
    assert {got[i] for i in range(260, 300)} == {260}


def test_near_duplicates_compare_whole_texts(spark):
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    passage, other, line = words(60), words(60), words(9)
    texts = [passage * 2, passage * 3, other * 8, other * 15, words(90) + line * 60, words(90) + line * 60]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4}


def test_near_duplicates_by_edit_similarity(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, pairs = [], {}
    for size, edits in [(5, 1), (7, 1), (11, 2), (30, 6), (100, 20), (100, 15), (300, 60), (1000, 200)]:
        for _ in range(40):
            a = [word() for _ in range(size)]
            b = list(a)
            for i in rng.sample(range(size), edits):
                b[i] = word()
            pairs.setdefault(size, []).append(len(rows))
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for size, firsts in pairs.items():
        assert sum(got[i] == got[i + 1] for i in firsts) >= 0.97 * len(firsts), size
    seven = [(0, "one two three four five six seven"), (1, "one two three four five six eight"), (2, "one two three four five"), (3, "one two other four five")]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(seven, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2}


def test_swept_band_equals_plain_alignment():
    rng = random.Random(11)
    for _ in range(4000):
        a = [rng.randint(0, 5) for _ in range(rng.randint(1, 18))]
        b = [x for x in a if rng.random() > 0.15] if rng.random() < 0.7 else [rng.randint(0, 5) for _ in range(rng.randint(1, 18))]
        most = rng.randint(0, 18)
        if b and abs(len(a) - len(b)) <= most:
            d = distance(a, b)
            assert near_dedup._swept(a, b, most) == (d if d <= most else None)


def test_sketch_recall_by_similarity_band():
    """Share of pairs that share a sketch, by edit similarity, for words all rare and for a corpus half of which is frequent words."""
    rng = np.random.default_rng(12)
    common, rare = rng.integers(1, 2**63, 50, dtype=np.uint64), rng.integers(1, 2**63, 5000, dtype=np.uint64)
    counts = np.zeros(near_dedup.RANKS, np.int64)
    counts[(common >> np.uint64(48)).astype(int)] += 200_000
    handicap = near_dedup.handicaps(counts + 40)
    for size in (40, 150, 600):
        for similar in (0.8, 0.85, 0.9, 0.95):
            met = 0
            for _ in range(60):
                h = np.where(rng.random(size) < 0.5, rng.choice(common, size), rng.choice(rare, size))
                other = h.copy()
                at = rng.choice(size, round((1 - similar) * size), replace=False)
                other[at] = rng.integers(1, 2**63, len(at), dtype=np.uint64)
                met += bool((near_dedup.keys_of(h, handicap) == near_dedup.keys_of(other, handicap)).any())
            assert met >= 0.9 * 60, (size, similar, met)


def test_rarest_words_of_similar_texts_meet():
    rng = random.Random(13)
    counts = np.zeros(near_dedup.RANKS, np.int64)
    vocabulary = np.random.default_rng(14).integers(1, 2**63, 30, dtype=np.uint64)
    counts[(vocabulary >> np.uint64(48)).astype(int)] = range(30)
    for _ in range(2000):
        a = [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        b = [x if rng.random() > 0.15 else rng.choice(vocabulary) for x in a if rng.random() > 0.1]
        if b and near_dedup.similarity([int(x) for x in a], [int(x) for x in b]):
            assert set(near_dedup.rarest(np.array(a), counts).tolist()) & set(near_dedup.rarest(np.array(b), counts).tolist())


def test_kept_takes_one_row_of_each_class(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "something else"), (2, "a b c"), (3, None), (3, None), (4, ""), (5, ""), (None, "a b c")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, md5 int")
    found = near_dedup.near_classes(docs)
    left = sorted(((r["doc_id"], r["text"]) for r in near_dedup.kept(docs, found).collect()), key=str)
    assert left == sorted([(1, "a b c"), (1, "something else"), (3, None), (3, None), (4, ""), (None, "a b c")], key=str)
    sizes = {(r["doc_id"], r["class_id"], r["class_size"], r["links"]) for r in found.collect()}
    assert sizes == {(1, 1, 4, 0), (1, 1, 1, 0), (2, 1, 4, 0), (3, 3, 1, 0), (4, 4, 2, 0), (5, 4, 2, 0), (None, 1, 4, 0)}


def test_near_duplicates_equal_all_pairs(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    texts = sorted(((r["text"].split(), r["doc_id"]) for r in docs.collect()), key=lambda x: len(x[0]))
    close = 0
    for k, (a, i) in enumerate(texts):
        for b, j in texts[k + 1 :]:
            if len(a) < 0.8 * len(b) - 1e-6:
                break
            if near_dedup.similarity(a, b):
                close += 1
                assert got[i] == got[j], (i, j)
    assert close > 50


def test_near_duplicates_of_one_sketch_are_never_lost(spark, monkeypatch):
    rng = random.Random(6)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    # Every text has one sketch in common with all others and none else, under a pivot that is like none.
    own = {}
    monkeypatch.setattr(near_dedup, "_MOST", 16)
    sketched = near_dedup._sketched
    monkeypatch.setattr(near_dedup, "FULL", 16)
    monkeypatch.setattr(near_dedup, "_sketched", lambda *a: sketched(*a).withColumn("keys", F.array(F.lit(1), *[F.xxhash64("h", F.lit(j)) for j in range(19)])))
    texts = {0: words(50)}
    for i in range(1, 60):
        a = words(50)
        texts[i], texts[100 + i] = a, [*a[:20], *words(5), *a[25:]]
        own[i] = own[100 + i] = i
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == own | {0: 0}


def test_bags_bound_the_edit_distance():
    rng = np.random.default_rng(8)
    vocabulary = rng.integers(0, 2**64, 40, dtype=np.uint64)
    texts = [rng.choice(vocabulary, rng.integers(1, 30)) for _ in range(40)] + [np.repeat(vocabulary[:1], n) for n in (254, 300, 600)]
    bags = np.stack([np.frombuffer(near_dedup.bag(t), np.uint8) for t in texts])
    for t, one in zip(texts[::3], bags[::3], strict=True):
        for other, bound in zip(texts, near_dedup._bounds(one, bags, bags.sum(1, dtype=np.int64)), strict=True):
            assert 0 <= bound <= distance(t.tolist(), other.tolist())


def test_fine_bags_bound_the_edit_distance_and_say_more():
    rng = np.random.default_rng(9)
    vocabulary = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    first = rng.choice(vocabulary, 800)
    texts = [np.where(rng.random(800) < share, rng.choice(vocabulary, 800), first) for share in (0.0, 0.1, 0.3, 0.5, 1.0)] + [rng.choice(vocabulary, 129), np.repeat(vocabulary[:1], 70_000)]
    bags, sums, row = near_dedup._fine_bags(pa.array([near_dedup.fine(t) for t in [*texts, first[:128]]], pa.binary()))
    assert row.tolist() == [0, 1, 2, 3, 4, 5, 6, -1]
    coarse = np.stack([np.frombuffer(near_dedup.bag(t), np.uint8) for t in texts])
    plain = near_dedup._bounds(coarse[0], coarse, coarse.sum(1, dtype=np.int64))
    bounds = near_dedup._bounds(bags[0], bags, sums)
    for t, bound in zip(texts[:6], bounds[:6], strict=True):
        assert 0 <= bound <= distance(first.tolist(), t.tolist())
    # Unlike texts of frequent words pass the plain bound, but not this one.
    assert (plain <= bounds).all() and plain[2] <= 160 < bounds[2]
    assert bounds[6] <= 70_000


def test_a_large_class_is_dealt_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "_MOST", 16)
    rows = [(1, u, 0) for u in range(400)] + [(1, 1000 + u, u) for u in range(1, 11)] + [(2, u, u % 3) for u in range(100)] + [(3, u, 5) for u in range(50)]
    placed = near_dedup._placed(near_dedup._dealt(spark.createDataFrame(rows, "key long, u long, label long"))).collect()
    # Every text of the large class meets the ten others once; a square of 410 rows in 26 parts had been 10,660.
    assert sum(r["key"] == 1 for r in placed) == 400 + 10 * 26
    assert not any(r["key"] == 3 for r in placed)
    met = Counter()
    blocks = {}
    for r in placed:
        blocks.setdefault((r["key"], min(r["part"], r["other"]), max(r["part"], r["other"])), []).append(r)
    for (key, x, y), members in blocks.items():
        for k, a in enumerate(members):
            met.update((key, *sorted((a["u"], b["u"]))) for b in members[k + 1 :] if a["label"] != b["label"] and (x == y or a["part"] != b["part"]))
    pairs = {(k, *sorted((u, v))) for k, u, a in rows for j, v, b in rows if k == j and a < b}
    assert set(met) == pairs and set(met.values()) == {1}


def test_buckets_of_few_mixed_pairs_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "FULL", 4)
    # Key 1: 20 texts of one class and two others: 41 mixed pairs, 66 words. Key 2: 20 classes: 190 pairs, 60 words. Key 3: one class. Key 4: few texts.
    rows = [(1, u, 22, max(0, u - 19), 3) for u in range(22)] + [(2, u, 20, u, 3) for u in range(20)] + [(3, u, 9, 1, 3) for u in range(9)] + [(4, u, 3, u, 0) for u in range(3)]
    found = near_dedup._mixed(spark.createDataFrame(rows, "key long, u long, size long, label long, n long")).collect()
    assert Counter((r["key"], r["pairwise"]) for r in found) == {(1, True): 22, (2, False): 20, (4, True): 3}


def test_near_duplicates_odd_rows(spark):
    docs = odd_documents(spark)
    found = near_dedup.near_classes(docs).collect()
    assert len(found) == docs.count()
    by = {r["doc_id"]: r["class_id"] for r in found if r["doc_id"] != 5}
    assert by[0] == 0 and by[9] == by[10] == 9
    assert near_dedup.near_classes(nothing(spark)).count() == 0
    assert near_dedup.kept(docs, near_dedup.near_classes(docs)).columns == docs.columns


# ------------------------------------------------------------------ chats


def chats(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes <|end|> é"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "alone"), (4, 0, "user", "same"), (5, 0, "user", "same"), (6, None, None, None), (7, 0, "assistant", ""), (None, 0, "user", "x"), (8, 1, "user", "tie b"), (8, 1, "user", "tie a"), (9, 1, "user", "tie a"), (9, 1, "user", "tie b"), (9, 2, "assistant", "z")]
    rows += [(10, i, "assistant", f"t{i}") for i in range(200)] + [(11, i, "assistant", f"t{i if i < 150 else -i}") for i in range(200)]
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")


def test_chat_format(spark):
    out = {(r["pair_id"], r["part"], r["block"]): r for r in chat_format.preferences(chat_format.paired(chats(spark))).collect()}
    assert out[0, "prompt", 0]["text"] == "<|user|>\nhi<|end|>\n" and out[0, "prompt", 0]["mask"] == ""
    chosen = out[0, "chosen", 0]
    assert chosen["text"] == "<|assistant|>\nyes < |end|> é<|end|>\n"
    a, b = map(int, chosen["mask"].split(":"))
    assert chosen["text"][a:b] == "yes < |end|> é<|end|>\n"
    assert (1, "prompt", 0) not in out and out[1, "chosen", 0]["n_turns"] == 1 and (1, "rejected", 0) not in out
    assert (2, "chosen", 0) not in out and (4, "rejected", 0) in out and out[4, "prompt", 0]["n_turns"] == 1
    long = [out[5, "prompt", k] for k in range(3)]
    assert [r["start"] for r in long] == [0, len(long[0]["text"]), len(long[0]["text"]) + len(long[1]["text"])]
    assert sum(r["n_turns"] for k, r in out.items() if k[:2] == (5, "prompt")) == 150 and out[5, "rejected", 2]["start"] == 0


def test_chat_pairs_share_their_prompt(spark, sf):
    """By plain lists: every conversation with an answer, and a neighbour with one, has prompt, chosen and rejected."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    talks = {}
    for r in rows:
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    answers = {c: max(t for t, role, _ in x if role == "assistant") for c, x in talks.items() if any(role == "assistant" for _, role, _ in x)}
    show = lambda said: "".join(f"<|{role}|>\n{text}<|end|>\n" for _, role, text in said)
    got = {}
    for r in chat_format.preferences(chat_format.swapped(spark.read.parquet(f"{sf}/conversations.parquet"))).orderBy("block").collect():
        got[r["pair_id"], r["part"]] = got.get((r["pair_id"], r["part"]), "") + r["text"]
    prompts = 0
    for c, talk in talks.items():
        talk = sorted(talk)
        if c not in answers:
            assert got[c, "prompt"] == show(talk) and (c, "chosen") not in got
            continue
        chosen = [x for x in talk if x[0] <= answers[c]]
        other = [(answers[c], *x[1:]) for x in sorted(talks.get(c ^ 1, [])) if x[0] == answers.get(c ^ 1)]
        rejected = [x for x in chosen if x[0] < answers[c]] + other
        k = 0
        while k < min(len(chosen), len(rejected)) and chosen[k] == rejected[k]:
            k += 1
        assert (got.get((c, "prompt"), ""), got.get((c, "chosen"), ""), got.get((c, "rejected"), "")) == (show(chosen[:k]), show(chosen[k:]), show(rejected[k:]))
        prompts += k > 0 and (c, "rejected") in got
    assert prompts > 5


def test_chat_format_equals_sql(spark, sf):
    for data in (chats(spark), spark.read.parquet(f"{sf}/conversations.parquet"), chats(spark).where("false")):
        mine = chat_format.digest(chat_format.preferences(chat_format.swapped(data))).toPandas()
        c = duckdb.connect()
        c.register("conversations", pa.Table.from_pandas(data.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}), schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]), preserve_index=False))
        other = c.sql(queries.oracle_sql()["op8_chat_format"]).df()
        cols = sorted(mine.columns)
        assert cols == sorted(other.columns)
        key = lambda d: sorted((tuple(None if pd.isna(x) else x for x in r) for r in d[cols].itertuples(index=False, name=None)), key=str)
        assert key(mine) == key(other)


# ------------------------------------------------------------------ archives


def pages(spark):
    rows = [(5, "http://a/1", "<p>é</p>"), (3, "http://a/2", "<p>é</p>"), (9, None, None), (8, "u x\r\ny: z", ""), (7, "v", "WARC/1.1\r\nfake\r\n\r\n\x1f\x8b\x08"), (7, "v", "WARC/1.1\r\nfake\r\n\r\n\x1f\x8b\x08"), (11, "w", "<p>é</p>"), (12, "x", "y" * 200_000)]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, i int")


@pytest.mark.parametrize("gzipped", [True, False])
def test_archives_round_trip(spark, gzipped):
    archives = warc.write_archives(pages(spark), gzipped=gzipped, roll=1000)
    records = warc.read_archives(archives)
    assert records.where("kind = 'gap'").count() == 0
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.pages_of(records).collect())
    first, want = {}, []
    rows = sorted((r["page_id"], (r["html"] or "").encode()) for r in pages(spark).collect())
    for i, body in rows:
        first.setdefault(body, i)
        k = None if first[body] == i else first[body]
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if k is None else "revisit", k))
    assert got == sorted(want, key=lambda x: (x[0], x[1]))
    kept = {bytes(r["payload"]) for r in records.where("headers['WARC-Type'] = 'response'").collect()}
    assert kept == set(first)


def test_small_payloads_can_stay_responses(spark):
    out = warc.pages_of(warc.read_archives(warc.write_archives(pages(spark), min_bytes=1)))
    assert {r["record_type"] for r in out.where("payload_bytes = 0").collect()} == {"response"}
    assert warc.read_archives(warc.write_archives(pages(spark).where("false"))).count() == 0


def repeated_pages(spark):
    """Ids that repeat with other payloads, each of which others have as well, and rows without an id."""
    rows = [(3, "u", "A"), (5, "u", "A"), (5, "u", "B"), (2, "u", "C"), (5, "u", "C"), (5, "u", "C"), (3, "v", "A"), (None, "u", "A"), (None, "u", "D"), (None, None, None), (9, None, "B"), (9, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("kind", ["long", "string"])
def test_archives_of_repeated_and_missing_ids(spark, kind):
    """A record for each row; a row revisits by its payload, one without an id never does."""
    data = repeated_pages(spark).withColumn("page_id", F.col("page_id").cast(kind))
    records = warc.read_archives(warc.write_archives(data))
    found = sorted((tuple(r)[:2] + tuple(r)[3:] for r in warc.pages_of(records, kind).collect()), key=str)
    to = {"long": int, "string": str}[kind]
    want = [(3, 1, "response", None), (3, 1, "response", None), (5, 1, "revisit", 3), (5, 1, "response", None), (2, 1, "response", None), (5, 1, "revisit", 2), (5, 1, "revisit", 2), (None, 1, "response", None), (None, 1, "response", None), (None, 0, "response", None), (9, 1, "revisit", 5), (9, 0, "response", None)]
    assert found == sorted(((None if i is None else to(i), n, t, None if r is None else to(r)) for i, n, t, r in want), key=str)
    assert {bytes(r["payload"]) for r in records.where("headers['WARC-Type'] = 'response'").collect()} == {b"A", b"B", b"C", b"D", b""}


def test_bounds_of_a_reader_are_parameters():
    large = warc.record(1, "u", b"x" * 5000, None)
    assert [k for k, *_ in warc.salvage(pa.BufferReader(member(large)), most_inflated=4000)] == ["gap"]
    assert [k for k, *_ in warc.salvage(pa.BufferReader(member(large)), most_inflated=6000)] == ["record"]
    wide = warc.record(1, "u" * (5 << 20), b"x", None)
    assert "record" not in [k for k, *_ in salvaged(wide)] and [k for k, *_ in warc.salvage(pa.BufferReader(wide), most_header=16 << 20)] == ["record"]


def test_archives_equal_sql(spark, sf):
    for data in (spark.read.parquet(f"{sf}/pages.parquet"), pages(spark).where("page_id <> 7"), repeated_pages(spark)):
        mine = warc.pages_of(warc.read_archives(warc.write_archives(data), payloads=False)).toPandas()
        c = duckdb.connect()
        c.register("pages", data.toPandas())
        other = c.sql(queries.oracle_sql()["op9_warc"]).df()
        cols = sorted(mine.columns)
        assert cols == sorted(other.columns)
        key = lambda d: sorted((tuple(None if pd.isna(x) else x for x in r) for r in d[cols].itertuples(index=False, name=None)), key=str)
        assert key(mine) == key(other)


def test_archive_results_come_from_the_blocks(spark, tmp_path):
    """Headers that lie about a payload are damage; a revisit without its response has no bytes."""
    good = warc.record(1, "u", b"payload", None)
    lies = good.replace(b"X-Payload-Length: 7", b"X-Payload-Length: 9")
    wrong = warc.record(2, "u", b"payload", None).replace(warc.sha1(b"payload").encode(), warc.sha1(b"other").encode(), 1)
    lost = warc.record(3, "u", b"gone", 99)
    (tmp_path / "a.warc").write_bytes(lies + wrong + lost + warc.record(4, "u", b"payload", 1))
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc",)], "file string")
    records = warc.read_archives(files)
    assert records.where("kind = 'gap'").count() == 1
    found = {r["page_id"]: tuple(r)[1:] for r in warc.pages_of(records).collect()}
    digest = warc.sha1(b"payload")
    assert found == {1: (7, digest, "response", None), 3: (None, None, "revisit", 99), 4: (7, digest, "revisit", 1)}


def test_archives_of_string_ids(spark):
    data = spark.createDataFrame([("a b\r\nX: y", "u", "p"), ("z>+%", "u", "p"), ("é", None, None)], "page_id string, url string, html string")
    found = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.pages_of(warc.read_archives(warc.write_archives(data)), "string").collect()}
    assert found == {"a b\r\nX: y": ("response", None), "z>+%": ("revisit", "a b\r\nX: y"), "é": ("response", None)}


def salvaged(data):
    return list(warc.salvage(pa.BufferReader(data)))


def member(data):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def test_salvage_recovers_and_logs_gaps():
    plain = [warc.record(i, f"http://h/{i}", bytes([65 + i]) * (50 + i), None) for i in range(6)]
    for parts in (plain, [member(p) for p in plain]):
        whole = b"".join(parts)
        good = salvaged(whole)
        assert [x[0] for x in good] == ["record"] * 6 and sum(x[2] for x in good) == len(whole)
        rng = random.Random(7)
        for _ in range(60):
            hurt = rng.randrange(1, 5)
            start = sum(map(len, parts[:hurt]))
            data = bytearray(whole)
            if rng.random() < 0.5:
                for _ in range(5):
                    data[start + rng.randrange(len(parts[hurt]))] ^= 0x5A
            else:
                cut = rng.randrange(1, len(parts[hurt]))
                del data[start + cut : start + len(parts[hurt])]
            out = salvaged(bytes(data))
            ids = {x[3]["WARC-Record-ID"] for x in out if x[0] == "record"}
            assert {f"<urn:page:{i}>" for i in range(6) if i != hurt} <= ids
            assert sum(x[2] for x in out) == len(data)  # every byte is in a record or in a logged gap
            # A flipped byte in a plain record's header value may pass all checks; nothing else may go unlogged.
            if sum(x[0] == "record" for x in out) < 6:
                assert any(x[0] == "gap" and x[5] for x in out)
    assert salvaged(b"") == [] and salvaged(b"junk" * 10)[0][0] == "gap"
    mixed = salvaged(plain[0] + member(plain[1]) + b"??" + plain[2])
    assert [x[0] for x in mixed] == ["record", "record", "gap", "record"]
    assert salvaged(whole[:-3])[-1][0] == "gap"
    assert io.BytesIO(whole).read() == whole


# ------------------------------------------------------------------ token store


def test_token_store_round_trip(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    docs = documents(spark, sf).unionByName(odd_documents(spark).withColumn("doc_id", F.col("doc_id") - 50), allowMissingColumns=True)
    index = token_store.write_sequences(docs, length=128)
    found = sorted(map(tuple, token_store.read_checksums(index).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted(r["doc_id"] for r in docs.collect())
    at = 0
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    for i, start, n, crc in found:
        assert start == at
        at += n
        wants = [np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4") for x in texts[i]]
        assert (n, crc) in {(len(w), zlib.crc32(w.tobytes())) for w in wants}
    file = token_store.SequenceFile(index.first()["file"])
    ids, mask = file.sequence(0)
    assert ids.dtype == np.uint16 and len(ids) == len(mask) == 128 and not ids.flags["OWNDATA"]


def test_token_store_files_are_equal_length_and_masked(tmp_path):
    w = token_store.SequenceWriter(f"file://{tmp_path}/x/a.arrow", "<u2", 8, 2)
    docs = [np.arange(n, dtype="<u2") for n in (3, 0, 20, 5, 1)]
    places = [w.add(d.tobytes()) for d in docs]
    w.close()
    f = token_store.SequenceFile(f"file://{tmp_path}/x/a.arrow")
    for d, at in zip(docs, places, strict=True):
        assert np.concatenate([*f.tokens(at, len(d)), np.zeros(0, "<u2")]).tolist() == d.tolist()
    assert [sum(f.sequence(i)[1].to_pylist()) for i in range(4)] == [8, 8, 8, 5]


def test_token_store_files_say_what_they_hold(tmp_path):
    """Documents, their places, lengths and checksums come from the file alone, whatever batches they lie in."""
    uri = f"file://{tmp_path}/b.arrow"
    w = token_store.SequenceWriter(uri, "<u2", 8, 2, part=3)
    docs = [(None, 3), (-5, 13), (-5, 16), (7, 1), (8, 50), (9, 16), (2**40, 2)]
    ids = [np.arange(n, dtype="<u2") + k for k, (_, n) in enumerate(docs)]
    places = [w.add(x.tobytes(), d) for (d, _), x in zip(docs, ids, strict=True)]
    w.close()
    f = token_store.SequenceFile(uri)
    assert f.part == 3
    assert list(f.documents()) == [(d, at, n, zlib.crc32(x.astype("<u4").tobytes())) for (d, n), at, x in zip(docs, places, ids, strict=True)]


def test_token_store_results_come_from_the_files(spark, sf):
    """An index that lies about places and lengths changes nothing."""
    index = token_store.write_sequences(documents(spark, sf), length=64)
    rows = lambda d: sorted(map(tuple, d.collect()))
    lies = index.withColumns({"at": F.lit(0).cast("long"), "n_tokens": F.lit(1).cast("long"), "start": F.lit(5).cast("long")})
    assert rows(token_store.read_checksums(lies)) == rows(token_store.read_checksums(index))


def test_token_store_empty(spark):
    assert token_store.read_checksums(token_store.write_sequences(nothing(spark))).count() == 0


# ------------------------------------------------------------------ pipeline


def test_pipeline_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0.7 * docs.count() < out.count() <= docs.count()
        docs = out
    final = corpus_pipeline.run(spark, sf)
    assert final.count() == docs.count() and final.where("n_tokens = 0").count() == 0


def test_pipeline_by_brute_force(spark, sf):
    """Each stage against a plain version of it, on what the stage before it kept; then the whole run."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    now = {r["doc_id"]: r for r in docs.collect()}
    model = language_id.fit(docs.where(language_id.learnable()))
    found = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    now = {i: r for i, r in now.items() if found[i]["lang_pred"] != "und" and not found[i]["ambiguous"]}
    # Near duplicates: all pairs, components, the least id of each.
    words = {i: (r["text"] or "").split() for i, r in now.items()}
    top = {i: i for i in now}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(now)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if now[i]["text"] == now[j]["text"] or words[i] and words[j] and near_dedup.similarity(words[i], words[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    now = {i: r for i, r in now.items() if root(i) == i}
    now = {i: r for i, r in now.items() if not decontaminate.brute(r["text"], bench)[1]}
    # Personal data: spans by the operator (tested on its own), replaced by slicing.
    spans = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    texts = {}
    for i, r in now.items():
        out, at = "", 0
        for x in spans[i]:
            if x["start"] >= at:
                out += r["text"][at : x["start"]] + f"[{x['kind'].upper()}]"
            at = max(at, x["end"])
        texts[i] = out + r["text"][at:]
    library = Tokenizer.from_file(default_path())
    want = [(i, now[i]["lang"], now[i]["source"], len(e), e) for i, t in sorted(texts.items()) for e in [library.encode(t, add_special_tokens=False).ids]]
    got = sorted((r["doc_id"], r["lang"], r["source"], r["n_tokens"], r["ids"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and 0 < len(got) < docs.count()


def test_pipeline_stages_on_odd_and_empty_tables(spark, sf):
    """What each stage keeps of nulls, empty and long texts, repeated rows and clashing columns."""
    for docs, want in ((odd_documents(spark), {5, 6, 7, 8, 9, 11, 12}), (nothing(spark), set())):
        clash = docs.withColumn("n_hit", F.lit(1)).withColumn("md5", F.lit("x"))
        ids = lambda d: [r["doc_id"] for r in d.collect()]
        found = corpus_pipeline.language_stage(spark, clash, sf)
        assert found.columns == clash.columns and set(ids(found)) <= want | {10}
        left = ids(corpus_pipeline.dedup_stage(spark, clash, sf))
        # The repeated long text goes, as the repeated row of id 5 does; its other text stays, as do nulls.
        assert sorted(left) == ([0, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 11, 12] if want else [])
        clean = corpus_pipeline.decontamination_stage(spark, clash, sf)
        assert sorted(ids(clean)) == sorted(ids(docs)) and clean.columns == clash.columns
        same = corpus_pipeline.pii_stage(spark, clash, sf)
        assert sorted(map(str, same.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
        coded = corpus_pipeline.bpe_stage(spark, clash, sf).collect()
        assert sorted(r["doc_id"] for r in coded) == sorted(ids(docs)) and all(r["n_tokens"] == len(r["ids"]) for r in coded)


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [*(f"op{i}" for i in range(1, 13)), "pipeline"]


def test_texts_that_no_join_needs_are_not_moved(spark):
    rows = [(i, f"text {i}") for i in range(5000)] + [(None, "text 1"), (None, "other"), (7, "text 7")]
    table = spark.createDataFrame(rows, "i long, t string").withColumn("h", F.unhex(F.md5("t")))
    wanted = [*rows[:5000:50], (None, "other"), (7, "text 7")]
    keys = spark.createDataFrame(wanted, table.select("i", "t").schema).select("i", F.unhex(F.md5("t")).alias("h"))
    for n in (len(wanted), 1, 1 << 40):
        left = near_dedup.among(table, keys, n, "i", "h")
        assert left.columns == table.columns
        # None of the keys goes, and repeated rows all stay.
        assert {(r["i"], r["t"]) for r in left.collect()} >= set(wanted)
        assert left.where("i = 7").count() == 2
    assert near_dedup.among(table, keys, len(wanted), "i", "h").count() < 700
    assert near_dedup.among(table, keys.where("false"), 0, "i", "h").count() == 0


def test_equal_texts_of_odd_ids_are_one_text(spark):
    rows = [(None, "one two three four five"), (None, "one two three four five"), (None, "one two three four six"), (4, "one two three four six"), (4, "one two three four six"), (9, "one two three four six")]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and {r["class_size"] for r in got} == {6} and {r["links"] for r in got} == {1} and {r["class_id"] for r in got} == {4}

"""Spelling variants by a trie self-join with active-node sets.

Words are counted over all texts; the vocabulary (words of enough letters and occurrences) is
joined with itself at one inserted, deleted or replaced letter.  A trie of words is walked from
its root down, and every node carries its active nodes: those whose path is one edit away from
its own.  A child's active nodes come from its parent's alone, so the walk of a node is never
searched again; where a word ends, the active nodes that end a word are its near words.

The trie is partitioned by prefixes that near words are bound to share.  Of two words that differ
by one edit, with ``g`` letters in the shorter one, the edit lies either behind the first ``g // 2`` letters,
and both share those, or within them, and both share the last ``g - g // 2``.  So each word goes to
the trie of its first half and to that of its second half (written backwards), for ``g`` its own
length and one less.  A trie of more than ``most`` words is cut again in the same way: the window of
letters where the edit may lie is halved, and the words share all others.  Windows of one letter are as narrow
as it gets; a trie there has at most the alphabet's words.  A pair is taken only in the window that has its
first differing letter, so that none is told twice.

Null and empty texts have no words; very long texts are read in pieces and very long words are
words like others.  A null id counts as an empty one before the colon; repeated rows count each.
Of near words with equally many occurrences the first in code-point order is the form.  An empty table
has no words; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
#: One run in so many loses a letter.
DAMAGED = 199
LETTERS, OCCURRENCES, RATIO = 6, 5, 5
#: Words of a trie that is not cut again; counts and characters that a worker holds before it passes them on; runs looked at in one go.
MOST, HELD, HELD_CHARS, STEP = 5_000, 100_000, 8 << 20, 200_000


def word_of(doc_id: object, run: str) -> str:
    """The word that a lower-cased run of a document counts as."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", letters: int = LETTERS) -> DataFrame:
    """(word, n) of all words of at least ``letters`` letters.  Each task adds up what it has read, within bounds, before the shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        chars = 0

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for i, t in zip(b.column("i").to_pylist(), b.column("t"), strict=True):
                # A text at a time, in pieces: its runs are a multiple of its size.
                found = map(re.Match.group, _RUN.finditer((t.as_py() or "").translate(_LOWER)))
                while some := Counter(islice(found, STEP)):
                    for r, n in some.items():
                        # The damage may take one letter.
                        if len(r) >= letters and len(w := word_of(i, r)) >= letters:
                            if w not in held:
                                chars += len(w)
                            held[w] = held.get(w, 0) + n
                    if len(held) >= HELD or chars >= HELD_CHARS:
                        yield passed()
                        held, chars = {}, 0
        if held:
            yield passed()

    rows = docs.select(F.col(doc_id).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- tries


def joined(words: list[str]) -> Iterator[tuple[int, int]]:
    """(i, j) of distinct words at distance one, both ways round, by active-node sets down a trie."""
    kids: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]
    for i, w in enumerate(words):
        at = 0
        for c in w:
            if (to := kids[at].get(c)) is None:
                to = kids[at][c] = len(kids)
                kids.append({})
                ends.append(-1)
            at = to
        ends[at] = i
    # At the root only its children are one edit (an insertion) away.
    stack = [(0, set(kids[0].values()))]
    while stack:
        node, active = stack.pop()
        if ends[node] >= 0:
            for m in active:
                if ends[m] >= 0:
                    yield ends[node], ends[m]
        for c, child in kids[node].items():
            # Its letter deleted; replaced; another one inserted after it; matched below an active node.
            now = {k for m in active if (k := kids[m].get(c)) is not None}
            now.add(node)
            now.update(kids[node].values())
            now.update(kids[child].values())
            now.discard(child)
            stack.append((child, now))


def pairs_of(words: list[str], low: int, high: int, shorter: int) -> Iterator[tuple[int, int]]:
    """Pairs of a trie whose shorter word has ``shorter`` letters and whose first differing letter is at low to high - 1.

    The words share their first ``low`` letters and their last ``shorter - high``; the longer of
    the two shared parts is what the trie hangs from.
    """
    tail = max(shorter - high, 0)
    if low >= tail:
        parts = [w[low:] for w in words]
    else:
        parts = [w[: len(w) - tail][::-1] for w in words]
    for i, j in joined(parts):
        a, b = words[i], words[j]
        if min(len(a), len(b)) == shorter and a[:high] != b[:high]:
            yield i, j


def _window(shorter: Column) -> Column:
    """Both windows of a group: the first half of the letters, and the rest with one place behind the last."""
    half = F.floor(shorter / 2).cast("int")
    return F.array(F.struct(F.lit(0).alias("low"), half.alias("high")), F.struct(half.alias("low"), (shorter + 1).alias("high")))


def _keyed(spans: DataFrame) -> DataFrame:
    """Rows (word, n, g, low, high) with the letters that near words of a window share."""
    tail = F.greatest(F.col("g") - F.col("high"), F.lit(0))
    head = F.expr("left(word, low)")
    return spans.select("word", "n", "g", "low", "high", F.xxhash64("g", "low", "high", head, F.when(tail > 0, F.expr("right(word, greatest(g - high, 0))")).otherwise("")).alias("key"))


def near_pairs(vocabulary: DataFrame, *, most: int = MOST) -> DataFrame:
    """(word, near, near_n): all words of a vocabulary (word, n; distinct) with each near word and its n.

    Rows of one trie come to one task, sorted by the hash of what its words share; a trie is built, walked and dropped.
    """
    spark = vocabulary.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    length = F.length("word")
    groups = vocabulary.select("word", "n", F.explode(F.array(length, length - 1)).alias("g")).where("g > 0")
    spans = groups.select("word", "n", "g", F.explode(_window(F.col("g"))).alias("x")).select("word", "n", "g", "x.low", "x.high").where("high > low")
    now, ready = _keyed(spans), []
    while True:
        # A window of one letter is as narrow as it gets.
        large = written(now.groupBy("key", "low", "high").agg(F.count("*").alias("c")).where((F.col("c") > most) & (F.col("high") - F.col("low") > 1)).select("key"), "large-tries")
        if large.isEmpty():
            ready.append(now)
            break
        ready.append(now.join(large, "key", "left_anti"))
        mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        cut = now.join(large, "key", "left_semi").withColumn("x", F.explode(F.array(F.struct("low", mid.alias("high")), F.struct(mid.alias("low"), "high"))))
        now = _keyed(cut.select("word", "n", "g", "x.low", "x.high"))
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str, int]] = []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "near", "near_n"])

        chars = 0
        for g, low, high, words, counts in _groups(batches):
            for i, j in pairs_of(words, low, high, g):
                out.append((words[i], words[j], counts[j]))
                chars += len(words[i]) + len(words[j])
                if len(out) >= 4096 or chars > 4 << 20:
                    yield told()
                    out, chars = [], 0
        if out:
            yield told()

    dealt = every.select("key", "g", "low", "high", "word", "n").repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "word string, near string, near_n long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, list[str], list[int]]]:
    """(g, low, high, words, their n) of each trie in batches sorted by key; a trie of one word has no pairs and is left out."""

    def tries(rows: list[tuple]) -> Iterator[tuple[int, int, int, list[str], list[int]]]:
        shared: dict[tuple, list[tuple[str, int]]] = {}  # more than one only if keys collide
        for g, low, high, word, n in rows:
            shared.setdefault((g, low, high, word[:low], word[len(word) - max(g - high, 0) :]), []).append((word, n))
        for (g, low, high, *_), own in shared.items():
            if len(own) > 1:
                yield g, low, high, *map(list, zip(*own, strict=True))

    held, rows = None, []
    for b in batches:
        for key, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != held:
                yield from tries(rows)
                held, rows = key, []
            rows.append(row)
    yield from tries(rows)


# ---------------------------------------------------------------- forms and roots


def forms(vocabulary: DataFrame, pairs: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """(word, form, n, n_near, form_n): a word's form is its near word of largest n, if that is ``ratio`` times its own."""
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("x"))
    rows = vocabulary.join(best, "word", "left")
    is_form = -F.col("x.m") >= F.col("n") * ratio
    return rows.select("word", F.when(is_form, F.col("x.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("x.m")).alias("form_n"))


def rooted(found: DataFrame) -> DataFrame:
    """``found`` with the root of each word: the end of its chain of forms.

    Along a chain n grows by the ratio, so chains are short; each round doubles how far a word looks.
    """
    found = written(found, "forms")
    now = written(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            break
        now = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return found.join(now, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", letters: int = LETTERS, occurrences: int = OCCURRENCES, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of ``docs``."""
    counts = word_counts(docs, text=text, doc_id=doc_id, letters=letters)
    vocabulary = written(counts.where(F.col("n") >= occurrences), "vocabulary")
    return rooted(forms(vocabulary, near_pairs(vocabulary, most=most), ratio=ratio))


#: DuckDB's CRC-32 table, made from its polynomial.
CRC_SQL = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS t)"


def crc_sql(octets: str) -> str:
    """DuckDB's CRC-32 of a list of octets; the table ``crc`` has to be in scope."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, o: xor(c >> 8, crc.t[(xor(c, o) & 255) + 1])), 4294967295)"


_POINTS = "list_transform(string_split(k, ''), lambda c: CAST(unicode(c) AS BIGINT))"
_OCTETS = "flatten(list_transform(p, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END))"
#: DuckDB's SQL for ``variants(documents)``.  Near words share the word without one letter, or are one another without it.
ORACLE_SQL = f"""
WITH RECURSIVE {CRC_SQL},
run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
told AS (SELECT r, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r AS k, count(*) AS n FROM run WHERE length(r) >= 6 GROUP BY doc_id, r),
hashed AS (SELECT r, n, {crc_sql(_OCTETS)} AS h FROM (SELECT r, n, {_POINTS} AS p FROM told), crc),
word AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, sum(n) AS n FROM hashed GROUP BY 1),
v AS (SELECT word, CAST(n AS BIGINT) AS n FROM word WHERE length(word) >= 6 AND n >= 5),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM v, LATERAL (SELECT unnest(range(0, length(word))) AS i)),
near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.d = b.word),
best AS (SELECT word, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
form AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best ON best.word = v.word AND k = 1),
chain AS (SELECT word, word AS at FROM form UNION ALL SELECT c.word, f.form FROM chain c JOIN form f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM form f JOIN chain c USING (word) JOIN form e ON e.word = c.at AND e.form IS NULL
"""

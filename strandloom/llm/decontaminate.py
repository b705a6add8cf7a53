"""Benchmark decontamination by Wu-Manber search for many word windows at once.

Texts are lower-cased (A-Z) and cut into words; the strings searched for are the windows of
ten consecutive words of each benchmark item (an item with fewer words is one window).  For
windows of one length the search keeps a shift table over hashed blocks of two words, so
that most positions are skipped; where the shift is zero, the bucket of the suffix block's hash
has the windows to test, of which those with another first block go; then the words themselves
are compared.

Null and empty texts have no words and are clean.  An item without a word matches nothing.  An item without an
id is searched for like any other, and words within its windows are hit; it has no name to be listed or counted by.
Repeated rows are judged row by row, repeated items count once by id, extra columns are ignored.
An empty benchmark leaves every document clean.

Very long texts are searched whole.  A benchmark of up to ``block_bytes`` of text is broadcast as
tables of about ten times its size.  A larger one is cut into such blocks, each with a pass of its
own over the documents, after which its tables go; the passes' hits are merged by row.  So
neither the driver nor a worker ever holds more than one block's tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordClass, mapped, mix, small_batches, written

_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
_DELIMITERS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Words of digits, letters and everything beyond ASCII; A-Z counts as a-z.
BENCH_WORDS = WordClass(_DELIMITERS, _LOWER)
WINDOW = 10
#: Positions that one lane of the search runs through; lanes advance together.
_LANE = 256


class Matcher:
    """Wu-Manber tables for the windows of one length in words.

    words: hashes of all words of the items, one item after the other; starts: where windows begin in
    them; owner: the item of each window; said(i): the bytes of the words of a window.
    """

    def __init__(self, length: int, words: np.ndarray, starts: np.ndarray, owner: np.ndarray, names: list[str], raw: list[bytes], first: np.ndarray, last: np.ndarray):
        self.length, self.block = length, min(2, length)
        self.words, self.names, self.raw, self.first, self.last = words, names, raw, first, last
        self.bits = max(12, int(np.ceil(np.log2(1 + len(starts) * length))) + 3)
        self.down = np.uint64(64 - self.bits)
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.int32)
        for end in range(self.block - 1, length):
            np.minimum.at(self.shift, self._code(self._block(words, starts + end)), length - 1 - end)
        # Buckets by the hash of the last block; within one, by the hash of the first.
        key = self._bucket(self._block(words, starts + length - 1), self._block(words, starts + self.block - 1))
        order = np.argsort(key, kind="stable")
        self.bucket, self.starts, self.owner = key[order], starts[order], owner[order]

    def _block(self, h: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of the block whose last word is at ``end``."""
        return mix(h[end] if self.block == 1 else h[end - 1] * np.uint64(0x9DDFEA08EB382D69) + h[end])

    def _code(self, block: np.ndarray) -> np.ndarray:
        return (block >> self.down).astype(np.int64)

    def _bucket(self, suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Buckets follow one another; below each, what its windows begin with."""
        low = np.uint64(64 - self.bits)
        return (suffix >> self.down << low) | (prefix >> np.uint64(self.bits))

    def said(self, i: int) -> bytes:
        """The words of a window, separated by blanks."""
        text, at = self.raw[self.owner[i]], self.starts[i]
        return b" ".join(text[self.first[k] : self.last[k]] for k in range(at, at + self.length)).translate(_LOWER)

    def find(self, h: np.ndarray, doc: np.ndarray, word: callable) -> tuple[np.ndarray, np.ndarray]:
        """(position of the last word, window) of all occurrences within one text.  word(i, n): n words up to position i."""
        n, m = len(h), self.length
        if n < m or not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(m - 1, n, _LANE)
        stop = np.minimum(at + _LANE, n)
        ends: list[np.ndarray] = []
        while len(at):
            step = self.shift[self._code(self._block(h, at))]
            ends.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        end = np.concatenate(ends)
        end = end[doc[end] == doc[end - m + 1]]
        key = self._bucket(self._block(h, end), self._block(h, end - m + self.block))
        lo, hi = np.searchsorted(self.bucket, key, "left"), np.searchsorted(self.bucket, key, "right")
        where = np.repeat(end, hi - lo)
        which = np.arange(len(where)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        # Direct comparison: hashes of all words first, then the words.
        for k in range(m):
            same = h[where - k] == self.words[self.starts[which] + m - 1 - k]
            where, which = where[same], which[same]
        same = np.fromiter((word(int(e), m) == self.said(int(w)) for e, w in zip(where, which, strict=True)), bool, len(where))
        return where[same], which[same]


def windows(items: list[tuple[str | None, str | None]], width: int = WINDOW) -> list[Matcher]:
    """A matcher for each length of window in (id, text) items."""
    raw = [(text or "").encode("utf-8", "replace") for _, text in items]
    h, own, first, last = BENCH_WORDS.words(raw)
    count = np.bincount(own, minlength=len(items))
    begin = np.cumsum(count) - count
    size = np.minimum(count, width)
    found = []
    for length in np.unique(size[size > 0]).tolist():
        mine = np.flatnonzero(size == length)
        many = count[mine] - length + 1
        owner = np.repeat(mine, many)
        starts = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[mine], many)
        found.append(Matcher(length, h, starts, owner, [name for name, _ in items], raw, first, last))
    return found


def places(texts: list[bytes], blocks: list[list[Matcher]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
    """Of all texts' words, which are hit and which text has them; of each text: words, ids of items with occurring windows."""
    h, doc, s, e = BENCH_WORDS.words(texts)
    mark = np.zeros(len(h) + 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]

    def word(end: int, n: int) -> bytes:
        raw = texts[doc[end]]
        return b" ".join(raw[s[i] : e[i]] for i in range(end - n + 1, end + 1)).translate(_LOWER)

    for block in blocks:
        for m in block:
            end, which = m.find(h, doc, word)
            np.add.at(mark, end - m.length + 1, 1)
            np.add.at(mark, end + 1, -1)
            for i, j in zip(end.tolist(), m.owner[which].tolist(), strict=True):
                if m.names[j] is not None:
                    items[doc[i]].add(m.names[j])
    return np.cumsum(mark[:-1]) > 0, doc, np.bincount(doc, minlength=len(texts)), items


def hits(texts: list[bytes], blocks: list[list[Matcher]]) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Of each text: words, hit words, ids of items with occurring windows."""
    hit, doc, n, items = places(texts, blocks)
    return n, np.bincount(doc[hit], minlength=len(texts)), items


def search(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, block_bytes: int = 8 << 20, prefix: str = "") -> DataFrame:
    """The columns ``keep`` of docs with n_words, n_hit, items (sorted ids as strings), contaminated, each name after ``prefix``."""
    spark = docs.sparkSession
    small_batches(spark)
    bench = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = -(-size // block_bytes) or 1
    names = [prefix + n for n in ("n_words", "n_hit", "items", "contaminated")]

    def block(k: int) -> Broadcast:
        rows = bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).collect()  # of about ``block_bytes`` of text
        return spark.sparkContext.broadcast(windows([tuple(r) for r in rows], width))

    if parts == 1:
        only = block(0)

        def run(texts: list[str | None]) -> list[pa.Array]:
            n, hit, items = hits([(t or "").encode("utf-8", "replace") for t in texts], [only.value])
            return [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(hit > 0)]

        return mapped(docs, text, list(keep), "long, long, array<string>, boolean", names, run)

    # Beyond one block: a pass over the documents for each, which leaves the places of its hits.
    inner = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("t"), F.monotonically_increasing_id().alias("row"))
    rows = written(inner, "numbered")
    found = []
    for k in range(parts):
        now = block(k)

        def run(texts: list[str | None], now: Broadcast = now) -> list[pa.Array]:
            hit, doc, n, items = places([(t or "").encode("utf-8", "replace") for t in texts], [now.value])
            begin = np.cumsum(n) - n
            at = np.split(np.flatnonzero(hit), np.searchsorted(np.flatnonzero(hit), begin[1:]))
            return [pa.array(n, pa.int64()), pa.array([x - b for x, b in zip(at, begin.tolist())], pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]

        made = mapped(rows.select("row", "t"), "t", ["row"], "long, array<long>, array<string>", ["n", "at", "items"], run)
        found.append(written(made if k == 0 else made.where(F.size("at") > 0), "pass"))
        now.unpersist()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    merged = every.groupBy("row").agg(F.max("n").alias("n"), F.size(union("at")).cast("long").alias("n_hit"), union("items").alias("items"))
    out = rows.join(merged, "row").select(*[f"k{i}" for i in range(len(keep))], "n", "n_hit", "items", F.col("n_hit") > 0)
    return out.toDF(*keep, *names)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``search``."""
    return found.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256)}).drop("items")


def brute(text: str | None, items: list[tuple[str | None, str | None]], width: int = WINDOW) -> tuple[int, int, list[str]]:
    """The same by plain comparison of every window, for tests; items without an id hit and are not named."""
    cut = lambda t: [bytes(w) for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().translate(bytes.maketrans(_DELIMITERS, b" " * len(_DELIMITERS))).split(b" ") if w]
    words, hit, names = cut(text), set(), set()
    for name, t in items:
        w = cut(t)
        size = min(width, len(w))
        wins = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in wins:
                hit.update(range(i, i + size))
                names.add(name)
    names.discard(None)
    return len(words), len(hit), sorted(names)


_WORDS_SQL = r"list_filter(string_split_regex(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
#: DuckDB's SQL for ``digest(search(documents, benchmark))``.
ORACLE_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
       FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
d AS (SELECT doc_id, {_WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
dw AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i)),
hits AS (SELECT DISTINCT doc_id, size, i, item FROM dw JOIN bw USING (size, win)),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, LATERAL (SELECT unnest(range(i, i + size)) AS p) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits WHERE item IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""

"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A sketch samples the ``order`` k-mers (two words, each labelled with its occurrence) of least
hash and keeps them in text order, so that it is sensitive to edits and not only to the bag
of k-mers.  Texts that share a sketch are candidates; a candidate pair is a link if a banded
alignment of the words of both whole texts finds an edit similarity of at least ``least``.

k-mers compete by hash, those of frequent words at a handicap: a k-mer whose rarest word is
frequent in the corpus is sampled up to ``2 ** HANDICAP`` times less often.  So "of the" or a line
that a third of the corpus has in common rarely makes a bucket.  Counts of words come from all
texts, in a table of fixed size.  Texts that are alike in nothing but frequent lines meet by further
sketches, of k-mers of five words without a handicap.

Equal texts collapse first.  In a bucket (the texts with a sketch in common) every text meets
one pivot, the least.  Buckets whose texts then still lie in several classes are searched on:

* those of up to ``FULL`` texts, or of no more pairs of texts of different classes than words, pair by pair;
* others by their rarest words.  Two texts of an edit similarity of ``least`` have at least
  that share of the longer one's words in common, so, in whatever order words are ranked, each
  has one of the other's among its own first (1 - least) * length + 1.  Words are ranked from
  rare to frequent, so texts that share a passage meet at words of their own, in small groups.

So no pair that shares a sketch is lost, whatever else is in its bucket.  What meets is compared
by an exact bound on the edit distance, from counts of words (finer ones for longer texts), before any alignment.  Classes are
the connected components of the links; the least doc_id names a class.

Null texts are classes of their own, as are rows without a word unless equal.  Texts of up to
``SHORT`` words have further sketches of single words.  Equal texts and repeated rows share a
class; rows of one id and different texts are judged each by its text.  A class of rows without
an id has a null class_id.  An empty table gives no rows.  Very long texts are compared whole.
Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, mix, runs, small_batches, spans_of, steps, utf8, written
from .components import components

WORDS, LEAST = 2, 0.8
#: Sketches of a text and k-mers in each: texts with a share J of common k-mers meet with
#: probability 1 - (1 - J**2)**18.  Scattered edits of one word in five leave a J of about 0.47.
SKETCHES, ORDER = 18, 2
#: Sketches of k-mers of five words and without a handicap: of one edit in five these would find one pair in five.
LONG, LONGS = 5, 6
#: Texts of up to SHORT words have SINGLES more sketches, of one word each: few of their pairs of words outlive an edit.
SHORT, SINGLES = 20, 8
#: Buckets of several classes are compared pair by pair up to this many texts.
FULL = 512
#: Counts of words in a bag; in the fine bag of a text of more words than ``_PLAIN``, whose counts in so few bins say little; counts of the corpus's words (a table of this fixed size reaches the driver and every worker).
BINS, FINE, _PLAIN, RANKS = 256, 2048, 128, 1 << 16
#: Words of up to 64 occurrences, or one in 2**15 of all, have no handicap; each doubling beyond adds one bit, up to HANDICAP.
HANDICAP, RARE_COUNT, RARE_SHARE = 6, 64, 2.0**-15
#: Texts of a block that are compared at once, partners that meet one text in a task, and pairs of two classes that are aligned before all others.
_MOST, _RUN, _FEW = 4096, 64, 4
#: Partners of a text in a block that are told before all others.
_PARTNERS = 3
#: Least keys of a text's groups by which repeated pairs are told from new ones.
_FIRSTS = 32
#: Bits (a power of 2) of a table that tells rows that are needed from most others, at most (4 MiB) and of each of its bitmaps.
BITS, _MAP = 25, 15
_BLOCK = 1 << 16
#: Rows of a file of pairs that were aligned, which are dearer than others.
_PAIRS = 5_000


def _occurrence(g: np.ndarray) -> np.ndarray:
    """How many equal items come before each item."""
    rank = np.argsort(g, kind="stable")
    begin = np.flatnonzero(np.diff(g[rank], prepend=g[rank[0]] + np.uint64(1)) != 0)
    out = np.empty(len(g), np.int64)
    out[rank] = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
    return out


def labelled(g: np.ndarray) -> np.ndarray:
    """Items as themselves the first time, and as another value for each further occurrence."""
    nth = _occurrence(g).astype(np.uint64)
    return np.where(nth > 0, mix(g + nth * np.uint64(0x9E3779B97F4A7C15)), g)


def _bin(h: np.ndarray) -> np.ndarray:
    """Where words are counted."""
    return (h >> np.uint64(48)).astype(np.int64)


def handicaps(counts: np.ndarray) -> np.ndarray:
    """How many bits the words of each bin lose."""
    free = max(RARE_COUNT, RARE_SHARE * int(counts.sum()))
    return np.round(np.clip(np.log2(np.maximum(counts, 1) / free), 0, HANDICAP)).astype(np.uint8)


def sketches(h: np.ndarray, handicap: np.ndarray | None = None, count: int = SKETCHES, order: int = ORDER, k: int = WORDS, seed: int = 5) -> np.ndarray:
    """The sketches (one hash each) of a text's word hashes; none without words.  handicap: bits lost by bin of words."""
    if not len(h):
        return np.zeros(0, np.uint64)
    k = min(k, len(h))
    g = labelled(runs(h, k))
    bits = np.zeros(len(h), np.uint8) if handicap is None else handicap[_bin(h)]
    shift = (np.uint8(HANDICAP) - np.minimum.reduce([bits[i : i + len(g)] for i in range(k)])).astype(np.uint64)
    rng = np.random.default_rng(seed)
    mul, add = (rng.integers(1, 2**63, (2, count), dtype=np.uint64) | np.uint64(1))[:, :, None]
    least = np.tile(np.arange(min(order, len(g))), (count, 1))
    if len(g) > order:
        found = []
        for lo in range(0, len(g), _BLOCK):
            x = mix_rows(g[lo : lo + _BLOCK], mul, add) >> shift[lo : lo + _BLOCK]
            n = min(order, x.shape[1])
            found.append((np.argpartition(x, n - 1, 1)[:, :n] if n < x.shape[1] else np.tile(np.arange(n), (count, 1))) + lo)
        at = np.concatenate(found, 1)
        if len(found) > 1:
            v = ((g[at] ^ add) * mul) >> shift[at]
            at = np.take_along_axis(at, np.argpartition(v, order - 1, 1)[:, :order], 1)
        least = np.sort(at, 1)
    picked = g[least]
    out = np.arange(count, dtype=np.uint64) + np.uint64(1)
    for i in range(picked.shape[1]):
        out = mix(out * np.uint64(0x9DDFEA08EB382D69) + picked[:, i])
    return out


def keys_of(h: np.ndarray, handicap: np.ndarray | None = None) -> np.ndarray:
    """All sketches of a text's word hashes."""
    found = [sketches(h, handicap), ~sketches(h, None, LONGS, ORDER, LONG, 7)]
    if len(h) <= SHORT:
        found.append(mix(sketches(h, handicap, SINGLES, 1, 1, 6)))
    return np.concatenate(found)


def mix_rows(g: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """One pseudo-random order of the k-mers for each sketch."""
    return (g[None, :] ^ add) * mul


def aligned(a: list, b: list, most: int) -> int | None:
    """Edit distance of two lists if it is at most ``most``, within that band of diagonals.

    Few edits are found by furthest-reaching points, more by a sweep of the band in bits.
    """
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[lo:n], b[lo:m]
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    if not n or not m:
        return max(n, m)
    found = _reached(a, b, min(most, _NEAR))
    if found is not None or most <= _NEAR:
        return found
    return _swept(a, b, most)


#: Edits up to which alignment goes by furthest-reaching points: their cost grows with the square of the edits.
_NEAR = 10


def _reached(a: list, b: list, most: int) -> int | None:
    """Edit distance up to ``most``, by furthest-reaching points of its band of diagonals."""
    n, m = len(a), len(b)
    goal = m - n
    i = 0
    while i < n and i < m and a[i] == b[i]:
        i += 1
    reach = {0: i}
    if goal == 0 and i >= n:
        return 0
    for e in range(1, most + 1):
        new = {}
        for d in range(max(-e, -n, goal - (most - e)), min(e, m, goal + (most - e)) + 1):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
            if i < 0:
                continue
            i = min(i, n, m - d)
            j = i + d
            while i < n and j < m and a[i] == b[j]:
                i += 1
                j += 1
            new[d] = i
        if new.get(goal, -1) >= n:
            return e
        reach = new
    return None


def _swept(a: list, b: list, most: int) -> int | None:
    """Edit distance up to ``most``, column by column: differences down the band are bits of two numbers."""
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    band = min(most, n)
    top = 2 * band + 1
    every = (2 << top) - 1
    place = dict.fromkeys(b, 0)
    for i, x in enumerate(a):
        if x in place:
            place[x] |= 1 << (i + top - band)
    down, up = ((2 << band) - 1) << (top - band), 0
    now, corner, edge = band, 1 << top, 1 << top
    for j, x in enumerate(b):
        equal = place[x] >> j & every
        flat = (((equal & down) + down) ^ down | equal | up) & every
        right, left = up | every & ~(flat | down), flat & down
        if j < n - band:
            now += not flat & corner
        else:
            edge >>= 1
            now += bool(right & edge) - bool(left & edge)
        flat >>= 1
        down, up = left | every & ~(flat | right), flat & right
        # What is left of the columns can take off one each.
        if now - (m - 1 - j) > most + max(0, n - band - 1 - j):
            return None
    return now if now <= most else None


def similarity(a: list, b: list, least: float = LEAST) -> float:
    """Edit similarity of two word lists (1 - distance / length of the longer), or 0 if it is under ``least``."""
    size = max(len(a), len(b))
    if a == b:
        return 1.0
    most = int((1 - least) * size + 1e-9)
    if abs(len(a) - len(b)) > most:
        return 0.0
    # An edit takes away at most one word and two word pairs of the longer text.
    if sum((Counter(a) & Counter(b)).values()) < size - most:
        return 0.0
    if sum((Counter(zip(a, a[1:])) & Counter(zip(b, b[1:]))).values()) < size - 1 - 2 * most:
        return 0.0
    d = aligned(a, b, most)
    return 0.0 if d is None else 1 - d / size


def bag(h: np.ndarray) -> bytes:
    """How many words fall into each bin, 255 at most."""
    return np.minimum(np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def fine(h: np.ndarray) -> bytes:
    """The same in ``FINE`` bins; empty for a text of few words."""
    return np.minimum(np.bincount((h >> np.uint64(53)).astype(np.int64), minlength=FINE), 255).astype(np.uint8).tobytes() if len(h) > _PLAIN else b""


def rarest(h: np.ndarray, counts: np.ndarray, least: float = LEAST) -> np.ndarray:
    """The labelled words of a text that one of any similar text's must be among, the rarest by ``counts``."""
    g = labelled(h)
    rank = np.lexsort((g, counts[_bin(h)]))
    return g[rank[: int((1 - least) * len(g) + 1e-9) + 1]]


def _bounds(one: np.ndarray, many: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distances of one bag and many; an edit changes no count by more than one each way."""
    common = np.minimum(many, one).sum(1, dtype=np.uint16 if many.shape[1] <= BINS else np.uint32).astype(np.int64)
    return np.maximum(sums, int(one.sum(dtype=np.int64))) - common


def _allowed(size: np.ndarray, least: float) -> np.ndarray:
    """The most edits of texts of these lengths that are similar."""
    return ((1 - least) * size + 1e-9).astype(np.int64)


def _fine_bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fine bags as rows of counts, their sums, and the row of each text's; -1 where it has none."""
    raw = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    has = pc.greater(pc.binary_length(raw), 0)
    own = raw.filter(has)
    at = int(np.frombuffer(own.buffers()[1], np.int32)[own.offset]) if len(own) else 0
    bags = np.frombuffer(own.buffers()[2], np.uint8)[at : at + len(own) * FINE].reshape(-1, FINE) if len(own) else np.zeros((0, FINE), np.uint8)
    has = has.to_numpy(zero_copy_only=False)
    return bags, bags.sum(1, dtype=np.int64), np.where(has, np.cumsum(has) - 1, -1)


def _bags(column: pa.Array) -> np.ndarray:
    """Bags as rows of counts, a view of the Arrow buffer."""
    raw = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(raw):
        return np.zeros((0, BINS), np.uint8)
    at = int(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset])
    return np.frombuffer(raw.buffers()[2], np.uint8)[at : at + len(raw) * BINS].reshape(-1, BINS)


def _words(texts: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text, from bounded slices."""
    for lo, hi in steps(pc.binary_length(texts).to_pylist()):
        h, own, _, _ = SPACED.words(utf8(texts.slice(lo, hi - lo)))
        at = spans_of(own, hi - lo)
        for i in range(hi - lo):
            yield h[at[i] : at[i + 1]]


def word_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many words of all texts (t) fall into each bin; how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(RANKS, np.int64), 0
        for b in batches:
            column = b.column("t")
            n += len(column)
            for lo, hi in steps(pc.binary_length(column).to_pylist()):
                total += np.bincount(_bin(SPACED.words(utf8(column.slice(lo, hi - lo)))[0]), minlength=RANKS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, RANKS).astype(np.int32)), pa.array(np.append(total[at], n))], ["bin", "c"])

    # RANKS + 1 rows at most, whatever the data: the last bin counts texts.
    found = texts.select("t").mapInArrow(run, "bin int, c long").groupBy("bin").agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros(RANKS + 1, np.int64)
    counts[found["bin"]] = found["c"]
    return counts[:RANKS], int(counts[RANKS])


def _sketched(docs: DataFrame, kind: str, counts: np.ndarray) -> DataFrame:
    """(i, h, n, keys) of rows (i, h, t)."""
    shared = docs.sparkSession.sparkContext.broadcast(handicaps(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = list(_words(b.column("t")))
            keys = [keys_of(x, shared.value).view(np.int64) for x in each]
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("h"), pa.array([len(x) for x in each], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["i", "h", "n", "keys"])

    return docs.mapInArrow(run, f"i {kind}, h binary, n long, keys array<long>")


def _bagged(texts: DataFrame) -> DataFrame:
    """(u, n, bag, fine) of rows (u, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = list(_words(b.column("t")))
            yield pa.RecordBatch.from_arrays([b.column("u"), pa.array([len(x) for x in each], pa.int64()), pa.array([bag(x) for x in each], pa.binary()), pa.array([fine(x) for x in each], pa.binary())], ["u", "n", "bag", "fine"])

    return texts.mapInArrow(run, "u long, n long, bag binary, fine binary")


def among(rows: DataFrame, keys: DataFrame, n: int, *of: str) -> DataFrame:
    """``rows`` without most of those whose columns ``of`` are not in ``keys`` (``n`` rows at most), so that the join that follows moves few texts in vain.

    Keys set bits in a table of 16 bits for each, ``BITS`` at most; a row stays if its bit is set, so none of the keys goes, and a few others stay.
    """
    bits = 1 << min(BITS, max(_MAP, (16 * max(1, n) - 1).bit_length()))
    at = F.pmod(F.xxhash64(*of), F.lit(bits))
    number, place = F.shiftright(at, _MAP), at % (1 << _MAP)
    maps = keys.select(number.alias("__map"), place.alias("at")).groupBy("__map").agg(F.bitmap_construct_agg("at").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("__map", number).join(F.broadcast(maps), "__map").where(F.getbit(byte, (place % 8).cast("int")) == 1).select(rows.columns)


def _possible(pairs: DataFrame, meta: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that neither lengths nor the bound on the edit distance rule out.  meta: u, n, bag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _bags(b.column("ba")), _bags(b.column("bb"))
            size = np.maximum(b.column("na").to_numpy(), b.column("nb").to_numpy())
            bound = np.maximum(x.sum(1, dtype=np.int64), y.sum(1, dtype=np.int64)) - np.minimum(x, y).sum(1, dtype=np.int64)
            yield b.select(["a", "b"]).filter(pa.array(bound <= _allowed(size, least)))

    meta = meta.select("u", "n", "bag")
    full = pairs.join(meta.toDF("b", "nb", "bb"), "b").join(meta.toDF("a", "na", "ba"), "a")
    near = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(least) - 1e-6
    return full.where(near).select("a", "b", "na", "nb", "ba", "bb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, n: int, texts: DataFrame, least: float) -> DataFrame:
    """(a, b, sim) of ``n`` different pairs (a, b), a < b; sim is 0 under ``least``.  texts: u, t.

    Rows of one a are dealt in runs of about ``_RUN`` partners behind a copy of its text, so a text of many partners is spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, first = None, []
        for batch in batches:
            a, part, b = (batch.column(c).to_pylist() for c in ("a", "part", "b"))
            sims: list[float | None] = []
            for x, p, y, h in zip(a, part, b, _words(batch.column("t")), strict=True):
                if x == y:
                    head, first = (x, p), h.tolist()
                    sims.append(None)
                else:
                    if head != (x, p):
                        raise ValueError("a run without its first text")
                    sims.append(similarity(first, h.tolist(), least))
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], ["a", "b", "sim"])
            yield out.filter(pc.is_valid(out.column("sim")))

    sized = pairs.groupBy("a").agg(F.ceil(F.count("*") / _RUN).cast("int").alias("parts"))
    dealt = pairs.join(sized, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b")
    heads = sized.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("b"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("u"))
    full = dealt.unionByName(heads).join(among(texts, ends, 2 * n, "u").toDF("b", "t"), "b")
    ordered = full.repartition("a", "part").sortWithinPartitions("a", "part", F.col("a") < F.col("b"), "b")
    return ordered.select("a", "part", "b", "t").mapInArrow(run, "a long, b long, sim double")


def _by_rarest(members: DataFrame, counts: np.ndarray, least: float) -> DataFrame:
    """(key, u, label): members (u, label, t) of buckets too large for all pairs, at each of their rarest words."""
    shared = members.sparkSession.sparkContext.broadcast(counts)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [rarest(h, shared.value, least) for h in _words(b.column("t"))]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            words = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), b.column("u").take(at), b.column("label").take(at)], ["key", "u", "label"])

    return members.select("u", "label", "t").mapInArrow(spread, "key long, u long, label long")


def _dealt(groups: DataFrame) -> DataFrame:
    """(key, u, label, part, first, parts): rows of groups (key, u, label) of several classes, dealt to parts of about ``_MOST``; a row meets those of the parts from ``first`` on.

    A class that is larger than a part has parts of its own, which need not meet each other: its rows meet the others', however large it is.
    """
    of_class = groups.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = of_class.groupBy("key").agg(F.sum("n").alias("size"), F.count("*").alias("classes"), F.max(F.struct("n", "label")).alias("top")).where("classes > 1")
    own = F.floor(F.col("top.n") / _MOST).cast("int")
    others = F.ceil((F.col("size") - F.when(F.col("own") > 0, F.col("top.n")).otherwise(0)) / _MOST).cast("int")
    sized = mixed.withColumn("own", own).withColumn("others", others).select("key", F.col("top.label").alias("top"), "own", "others")
    apart = (F.col("own") > 0) & (F.col("label") == F.col("top"))
    part = F.when(apart, F.pmod(F.xxhash64("u"), "own")).otherwise(F.col("own") + F.pmod(F.xxhash64("u"), "others")).cast("int")
    return groups.join(sized, "key").select("key", "u", "label", part.alias("part"), F.when(apart, F.col("own")).otherwise(0).alias("first"), (F.col("own") + F.col("others")).alias("parts"))


def _placed(dealt: DataFrame) -> DataFrame:
    """Each row of ``_dealt`` once for each part that it meets (other)."""
    return dealt.withColumn("other", F.explode(F.sequence(F.col("first"), F.col("parts") - 1)))


def _across(groups: DataFrame, meta: DataFrame, least: float, most: int, few: int | None = None) -> DataFrame:
    """(a, b, la, lb, more), a < b: pairs of a group and of two classes la, lb that the bound does not rule out.  groups: key, u, label; meta: u, n, bag, fine.

    Groups of one class go; larger ones than a block are dealt over blocks so that every two texts of different classes meet in one.
    few: of each text's partners further on in a block only those with the least bounds are told; a row with nothing but ``more``
    names a group that has others.  most: rows of ``groups``.
    """
    dealt = written(_dealt(groups), "dealt", most)
    # A pair that shares several groups is told in the first of them, as far as these few keys of each text show.
    firsts = dealt.groupBy("u").agg(F.slice(F.sort_array(F.collect_set("key")), 1, _FIRSTS).alias("firsts"))
    placed = _placed(dealt).join(firsts.join(meta, "u"), "u")
    block = placed.select("key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "u", "label", "n", "bag", "fine", "firsts")

    def met(rows: pa.Table) -> tuple[list[np.ndarray], bool]:
        """a, b and their labels, as rows of one array each; whether there are others."""
        u, n, label, part = (rows.column(c).to_numpy() for c in ("u", "n", "label", "part"))
        same = rows.column("x")[0].as_py() == rows.column("y")[0].as_py()
        if (label == label[0]).all():
            return [], False
        bags = _bags(rows.column("bag"))
        sums = bags.sum(1, dtype=np.int64)
        fines, fine_sums, fine_row = _fine_bags(rows.column("fine"))
        here = rows.column("key")[0].as_py()
        before: dict[int, set[int]] = {}

        def earlier(i: int) -> set[int]:
            if i not in before:
                before[i] = {x for x in rows.column("firsts")[i].as_py() if x < here}
            return before[i]

        found, more = [], False
        for k in range(len(n) - 1):
            size = np.maximum(n[k + 1 :], n[k])
            at = np.flatnonzero((label[k + 1 :] != label[k]) & (np.minimum(n[k + 1 :], n[k]) >= size * least - 1e-6) & (same | (part[k + 1 :] != part[k])))
            if len(at):
                bounds = _bounds(bags[k], bags[k + 1 :][at], sums[k + 1 :][at])
                near = bounds <= _allowed(size[at], least)
                at, bounds = at[near], bounds[near]
            if len(at) and fine_row[k] >= 0:
                row = fine_row[k + 1 :][at]
                has = row >= 0
                bounds[has] = _bounds(fines[fine_row[k]], fines[row[has]], fine_sums[row[has]])
                near = bounds <= _allowed(size[at], least)
                at, bounds = at[near], bounds[near]
            if len(at):
                mine = [earlier(k).isdisjoint(earlier(i + k + 1)) for i in at.tolist()]
                at, bounds = at[mine], bounds[mine]
            if few is not None and len(at) > few:
                at, more = at[np.argsort(bounds, kind="stable")[:few]], True
            if len(at):
                other = u[k + 1 :][at]
                less = other < u[k]
                mine, theirs = np.full(len(at), label[k]), label[k + 1 :][at]
                found.append(np.stack([np.minimum(other, u[k]), np.maximum(other, u[k]), np.where(less, theirs, mine), np.where(less, mine, theirs)]))
        return found, more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        made: list[np.ndarray] = []
        open_: set[int] = set()
        last = None

        def told() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(made, 1), axis=1) if made else np.zeros((4, 0), np.int64)
            keys = sorted(open_)
            made.clear()
            open_.clear()
            none = [None] * len(keys)
            return pa.RecordBatch.from_arrays([*(pa.array([*x.tolist(), *none], pa.int64()) for x in pairs), pa.array([None] * pairs.shape[1] + keys, pa.int64())], ["a", "b", "la", "lb", "more"])

        def add() -> None:
            found, more = met(pa.Table.from_batches(held))
            made.extend(found)
            if more:
                open_.add(last[0])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(c).to_numpy() for c in ("key", "x", "y")])
            cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                own = tuple(group[:, lo].tolist())
                if own != last and held:
                    add()
                last = own
                held.append(batch.slice(lo, hi - lo))
            if sum(x.shape[1] for x in made) > 100_000:
                yield told()
        if held:
            add()
        yield told()

    return block.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "a long, b long, la long, lb long, more long").distinct()


def _labels(of: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """(u, label) of the texts ``of`` (u) in the components of the links (a, b), ``most`` at most."""
    over = components(links, most).toDF("u", "label")
    return of.join(over, "u", "left").select("u", F.coalesce("label", "u").alias("label"))


def _mixed(member: DataFrame) -> DataFrame:
    """(key, u, label, pairwise): rows of buckets (key, u, size, label, n) of several classes; whether the bucket is small, or has no more pairs of two classes than words."""
    of_class = member.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("n").alias("words"), F.max("size").alias("size"))
    mixed = of_class.groupBy("key").agg(F.count("*").alias("classes"), F.max("size").alias("size"), F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("same"), F.sum("words").alias("words")).where("classes > 1")
    across = (F.col("all") * F.col("all") - F.col("same")) / 2
    return member.select("key", "u", "label").join(mixed.select("key", ((F.col("size") <= FULL) | (across <= F.col("words"))).alias("pairwise")), "key")


def _links(buckets: DataFrame, meta: DataFrame, texts: DataFrame, counts: np.ndarray, least: float) -> DataFrame:
    """(a, b): the links among the texts of buckets (key, u, pivot, size)."""
    size = buckets.count()
    stars = buckets.where("u > pivot").select(F.col("pivot").alias("a"), F.col("u").alias("b")).distinct()
    possible = written(_possible(stars, meta, least), "possible", size)
    met = possible.count()
    checked = written(_verified(possible, met, texts, least), "checked", met, _PAIRS)
    involved = buckets.select("u").distinct()
    labels = written(_labels(involved, checked.where("sim > 0"), met), "classes", size)

    # The rest: buckets of several classes.
    member = written(buckets.select("key", "u", "size").join(labels, "u").join(meta.select("u", "n"), "u"), "members", size)
    rest = written(_mixed(member), "mixed", size)
    large = written(rest.where(~F.col("pairwise")).select("u", "label").distinct(), "of-large", size)
    large = large.join(among(texts, large, large.count(), "u"), "u")
    groups = rest.where("pairwise").select("key", "u", "label").unionByName(_by_rarest(written(large, "large", size), counts, least))
    groups = written(groups, "groups")

    def settled(new: DataFrame, checked: DataFrame) -> DataFrame:
        """``checked`` and what is found of the pairs ``new`` (a, b, la, lb) that it lacks, but for those whose classes others of them make one."""
        new = written(new.join(checked.select("a", "b"), ["a", "b"], "left_anti"), "across")
        open_ = new.count()
        # A few pairs of each two classes first: they mostly make them one.
        best = new.groupBy(F.least("la", "lb").alias("lo"), F.greatest("la", "lb").alias("hi"), F.pmod(F.xxhash64("a", "b"), F.lit(_FEW)).alias("k")).agg(F.min(F.struct("a", "b")).alias("p"))
        some = written(best.select("p.a", "p.b"), "some", open_)
        few = some.count()
        some = written(_verified(some, few, texts, least), "checked", few, _PAIRS)
        links = some.where("sim > 0").select("a", "b").join(new, ["a", "b"])
        merged = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")), open_)
        for c in ("la", "lb"):
            new = new.join(merged.toDF(c, "top"), c, "left").withColumn(c, F.coalesce("top", c)).drop("top")
        others = written(new.where("la <> lb").select("a", "b").join(some.select("a", "b"), ["a", "b"], "left_anti"), "others", open_)
        many = others.count()
        return checked.unionByName(some).unionByName(written(_verified(others, many, texts, least), "checked", many, _PAIRS))

    # The most alike partners of each text first; only groups that have others are looked at again, with the classes that these made.
    first = written(_across(groups, meta, least, groups.count(), _PARTNERS), "partners")
    checked = settled(first.where("more is null").drop("more"), checked)
    again = written(groups.join(first.select(F.col("more").alias("key")).distinct(), "key", "left_semi"), "again")
    n = again.count()
    if n:
        labels = _labels(involved, checked.where("sim > 0").select("a", "b"), checked.count())
        again = written(again.select("key", "u").join(labels, "u"), "again", n)
        checked = settled(_across(again, meta, least, n).drop("more"), checked)
    return checked.where("sim > 0").select("a", "b")


def near_classes(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", least: float = LEAST) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, class_size (rows), links (similar other texts found), text_md5 and is_first.

    ``is_first`` marks, in each class, the rows of least id, and of them those of one text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    base = rows.where("t is not null").withColumn("h", F.unhex(F.md5("t")))
    counts, n = word_counts(base)
    # One node u for each different text; rep: its least id.
    once = _sketched(base.select("i", "h", "t"), kind, counts).groupBy("h").agg(F.min("i").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = written(once.select(F.monotonically_increasing_id().alias("u"), "h", "rep", "copies", "n", "keys"), "nodes", n)

    each = nodes.where("n > 0").select("u", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("size"), F.min("u").alias("pivot")).where("size > 1")
    buckets = written(each.join(shared, "key"), "buckets")
    involved = written(nodes.join(buckets.select("u").distinct(), "u", "left_semi").select("u", F.col("h").alias("uh"), "rep"), "involved", n)
    # Dealt by the text's hash alone, so that repeated rows meet without another shuffle; of equal texts only the rows of the least id are moved.
    same = F.coalesce(F.col("i") == F.col("rep"), F.col("i").isNull() & F.col("rep").isNull())
    texts = among(base, involved.select(F.col("rep").alias("i"), F.col("uh").alias("h")), involved.count(), "i", "h")
    texts = texts.join(involved, (F.col("h") == F.col("uh")) & same).dropDuplicates(["h"]).select("u", "t")
    texts = written(texts, "texts", n)
    links = _links(buckets, written(_bagged(texts), "bags", n), texts, counts, least)
    found = links.count()
    links = written(links, "all-links", found)

    ends = links.select(F.col("a").alias("u")).unionByName(links.select(F.col("b").alias("u"))).groupBy("u").agg(F.count("*").alias("links"))
    linked = written(ends.join(components(links, found).toDF("u", "label"), "u"), "linked", n)
    member = nodes.select("u", "h", "rep", "copies").join(linked, "u", "left").select("h", "rep", "copies", F.coalesce("label", "u").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    head = member.groupBy("label").agg(F.sum("copies").alias("class_size"), F.min(F.when(F.col("rep").isNotNull(), F.struct("rep", "h"))).alias("head"))
    classes = member.join(head, "label").select("h", F.col("head.rep").alias("class_id"), F.col("head.h").alias("hh"), "class_size", "links")
    out = base.select("i", "h").join(classes, "h").select("i", "class_id", "class_size", "links", F.hex("h").alias("text_md5"), F.coalesce((F.col("i") == F.col("class_id")) & (F.col("h") == F.col("hh")), F.lit(False)).alias("is_first"))
    none = rows.where("t is null").select("i", F.col("i").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("links"), F.lit(None).cast("string").alias("text_md5"), F.lit(True).alias("is_first"))
    return out.unionByName(none).withColumnRenamed("i", doc_id)


def kept(docs: DataFrame, classes: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each class of ``near_classes``: the first.  Rows without an id or without a text all stay."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    inner = docs.toDF(*names)
    i, t = (F.col(names[docs.columns.index(c)]) for c in (doc_id, text))
    first = classes.where("is_first").select(F.col(doc_id).alias("first_id"), F.col("text_md5").alias("first_md5")).distinct()
    whole = inner.where(i.isNotNull() & t.isNotNull()).withColumn("md5", F.upper(F.md5(t)))
    stay = whole.join(first, (i == F.col("first_id")) & (F.col("md5") == F.col("first_md5")), "left_semi").dropDuplicates([names[docs.columns.index(doc_id)], "md5"])
    return stay.select(names).unionByName(inner.where(i.isNull() | t.isNull())).toDF(*docs.columns)

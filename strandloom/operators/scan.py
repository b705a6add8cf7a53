"""Exact seeds of queries with few words, found in the subjects as these stream by.

Tasks hold the words of all queries.  What a subject has (seeds, islands, second hits, arms) is worked out where its
residues are, so neither words nor seeds are joined or shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.matrix import blosum62, codes
from strandloom.operators import batches as B
from strandloom.operators.kernels import smith_waterman
from strandloom.plans.shipping import ready
from strandloom.sources.shared import dealt

#: Query words that a task holds at most; beyond it, Spark joins words.
WORDS = 200_000
#: Residues and seeds that are worked on at once; a subject with more seeds is searched by halves of the queries.
_STEP, _SEEDS = 1 << 20, 1 << 21
#: Bits of a table that tells most words that no query has.
_BITS = 22
_CHARS = 0x110000

Kernel = Callable[["Index", list, tuple], tuple]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Index:
    """Where queries (code of the id, residues) have which word of k characters.  Rows of one id are one query."""

    def __init__(self, rows: list[tuple[int, str]], k: int):
        self.rows, self.k = rows, k
        kinds = np.unique(_points("".join(r for _, r in rows)))
        kinds = kinds[kinds > 0]
        self.base = len(kinds) + 1
        self.table = np.zeros(_CHARS, np.int64)
        self.table[kinds] = np.arange(1, self.base)
        number, at, length = self.numbers([r for _, r in rows])
        owner = np.repeat(np.arange(len(rows)), length)[: len(number)]
        place = np.flatnonzero(number >= 0)
        place = place[np.argsort(number[place], kind="stable")]
        self.words, begin = np.unique(number[place], return_index=True)
        self.begin = np.append(begin, len(place))
        self.code = np.array([c for c, _ in rows], np.int64)[owner[place]]
        self.pos = place - at[owner[place]]
        self.some = np.zeros(1 << _BITS, bool)
        self.some[self._short(self.words)] = True

    def halves(self) -> list[Index]:
        """The same queries in two parts, rows of one id in one."""
        own = sorted({c for c, _ in self.rows})
        mid = own[len(own) // 2]
        return [Index([r for r in self.rows if r[0] < mid], self.k), Index([r for r in self.rows if r[0] >= mid], self.k)]

    @staticmethod
    def _short(number: np.ndarray) -> np.ndarray:
        return (number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the word at each place, -1 where no query has its letters or it is none; where each text begins; its places)."""
        c = self.table[_points("\0".join(texts) + "\0")]
        length = np.array([len(t) + 1 for t in texts], np.int64)
        n = max(0, len(c) - self.k + 1)
        out, good = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(self.k):
            part = c[i : i + n]
            out *= self.base
            out += part
            good &= part > 0
        out[~good] = -1
        return out, np.cumsum(length) - length, length

    def hits(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(place of a word, first entry, entries) of the words that queries have, and where texts begin."""
        number, at, _ = self.numbers(texts)
        place = np.flatnonzero(self.some[self._short(number)] & (number >= 0))
        number = number[place]
        entry = np.minimum(np.searchsorted(self.words, number), max(len(self.words) - 1, 0))
        own = self.words[entry] == number if len(self.words) else np.zeros(0, bool)
        place, entry = place[own], entry[own]
        return place, self.begin[entry], self.begin[entry + 1] - self.begin[entry], at

    def seeds(self, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """(place of the subject, code of the query, q_pos, s_pos) of all seeds of ``hits``."""
        place, first, many, at = found
        entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        place = np.repeat(place, many)
        owner = np.searchsorted(at, place, "right") - 1
        return owner, self.code[entry], self.pos[entry], place - at[owner]

    def steps(self, texts: list[str], lo: int = 0) -> Iterator[tuple[int, Index, list[str], tuple]]:
        """(place of the first text, index, texts, seeds), of bounded size: by subjects, then by queries."""
        found = self.hits(texts)
        if found[2].sum() > _SEEDS and len(texts) > 1:
            half = len(texts) // 2
            yield from self.steps(texts[:half], lo)
            yield from self.steps(texts[half:], lo + half)
        elif found[2].sum() > _SEEDS and len({c for c, _ in self.rows}) > 1:
            for part in self.halves():
                yield from part.steps(texts, lo)
        else:
            yield lo, self, texts, self.seeds(found)


class Few:
    """Queries with few words: their ids, and (code of the id, residues) for the tasks."""

    def __init__(self, ids: list, rows: Broadcast, k: int, kind: str, repeated: bool):
        self.ids, self.rows, self.k, self.kind, self.repeated = ids, rows, k, kind, repeated


def few(queries: DataFrame, k: int) -> Few | None:
    """The queries (query_id, residues), if they have few words and few enough letters for numbers of words; else None."""
    spark = queries.sparkSession
    n = queries.agg(F.sum(F.greatest(F.length("residues") - (k - 1), F.lit(0))).alias("words"), F.count("*").alias("rows")).first()
    if (n["words"] or 0) > WORDS or n["rows"] > WORDS:
        return None
    rows = [r for r in queries.select("query_id", "residues").collect() if r["residues"] is not None]  # at most WORDS words
    if (len({c for r in rows for c in r["residues"]}) + 1) ** k >= 1 << 62:
        return None
    ready(spark)
    ids: dict = {}
    coded = [(ids.setdefault(r["query_id"], len(ids)), r["residues"]) for r in rows]
    return Few(list(ids), spark.sparkContext.broadcast(coded), k, queries.schema["query_id"].dataType.simpleString(), len(ids) < len(rows))


def _blocks(given: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], int]]:
    """Subjects (oid, residues) in blocks of about ``_STEP`` residues: ids of a batch, texts of the block, its place in the batch."""
    for batch in given:
        oid, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
        begin = 0
        while begin < len(texts):
            end, size = begin + 1, len(texts[begin])
            while end < len(texts) and size + len(texts[end]) <= _STEP:
                size += len(texts[end])
                end += 1
            yield oid, texts[begin:end], begin
            begin = end


#: Rows that a task gathers before they are folded.
_HELD = 1 << 18


def _mapped(q: Few, subjects: DataFrame, kernel: Kernel, columns: str, fold: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """(query_id, oid, columns) that a kernel makes of the seeds of some subjects: it returns the places of subjects, codes of queries, and columns.

    fold: what a task keeps of the rows it has made so far.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = subjects.sparkSession
    schema = spark.createDataFrame([], f"query_id {q.kind}, oid {subjects.schema['oid'].dataType.simpleString()}, {columns}").schema
    names, kinds, ids, rows, k = schema.names, [to_arrow_type(f.dataType) for f in schema.fields], q.ids, q.rows, q.k

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, own = Index(rows.value, k), pa.array(ids, kinds[0])
        held: list[pa.RecordBatch] = []
        size, most = 0, _HELD
        for oid, texts, begin in _blocks(given):
            for lo, part, mine, seeds in index.steps(texts, begin):
                at, code, *made = kernel(part, mine, seeds)
                if not len(at):
                    continue
                out = pa.RecordBatch.from_arrays([own.take(pa.array(code)), oid.take(pa.array(at + lo)), *(pa.array(c).cast(t) for c, t in zip(made, kinds[2:], strict=True))], names)
                if fold is None:
                    yield out
                    continue
                held.append(out)
                size += out.num_rows
                if size > most:
                    held = fold(pa.Table.from_batches(held)).combine_chunks().to_batches()
                    size = sum(b.num_rows for b in held)
                    most = size + max(_HELD, size)
        if held:
            yield from fold(pa.Table.from_batches(held)).to_batches(max_chunksize=1 << 16)

    return subjects.select("oid", "residues").mapInArrow(run, schema)


def seeds(q: Few, subjects: DataFrame) -> DataFrame:
    """(query_id, oid, q_pos, s_pos, diag) of all seeds."""
    return _mapped(q, subjects, lambda index, texts, found: (*found, found[2] - found[3]), "q_pos int, s_pos int, diag int")


def _diagonals(found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Seeds by subject, query, diagonal and place, and which of them are the first of a diagonal."""
    at, code, q_pos, s_pos = found
    order = np.lexsort((s_pos, q_pos - s_pos, code, at))
    at, code, q_pos, s_pos = (x[order] for x in (at, code, q_pos, s_pos))
    first = np.ones(len(at), bool)
    diag = q_pos - s_pos
    first[1:] = (at[1:] != at[:-1]) | (code[1:] != code[:-1]) | (diag[1:] != diag[:-1])
    return at, code, q_pos, s_pos, first


def _islands(index: Index, texts: list[str], found: tuple) -> tuple:
    at, code, q_pos, s_pos, fresh = _diagonals(found)
    fresh[1:] |= s_pos[1:] - s_pos[:-1] > index.k
    begin = np.flatnonzero(fresh)
    n = np.diff(np.append(begin, len(at)))
    q0, s0 = q_pos[begin], s_pos[begin]
    return at[begin], code[begin], q0 - s0, q0, s0, s_pos[begin + n - 1] - s0 + index.k, n


def islands(q: Few, subjects: DataFrame, least: int = 0) -> DataFrame:
    """``words.islands`` of subjects whose ids are theirs alone, those of at least some length."""

    def kernel(index: Index, texts: list[str], found: tuple) -> tuple:
        made = _islands(index, texts, found)
        long = made[5] >= least
        return tuple(x[long] for x in made)

    return _mapped(q, subjects, kernel if least else _islands, "diag int, q_start int, s_start int, length int, n_seeds long")


# ------------------------------------------------------------------ what the islands of a query and subject, or of a subject, make


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    fresh = np.ones(len(columns[0]), bool)
    fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(fresh)


def _sums(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x.astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)


def _merged(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, from, to) of ranges merged within their group where at most ``gap`` lies between them."""
    order = np.lexsort((hi, lo, group))
    group, lo, hi = group[order], lo[order], hi[order]
    span = int(hi.max(initial=0)) + 1
    far = np.maximum.accumulate(group * span + hi) - group * span
    fresh = np.ones(len(lo), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (lo[1:] > far[:-1] + gap)
    begin = np.flatnonzero(fresh)
    return group[begin], lo[begin], far[np.append(begin[1:], len(lo))[: len(begin)] - 1]


def counters(q: Few, subjects: DataFrame) -> DataFrame:
    """(query_id, oid, seeds, islands, long_islands, longest) of each query and subject with islands."""

    def kernel(index: Index, texts: list[str], found: tuple) -> tuple:
        at, code, _, _, _, length, n = _islands(index, texts, found)
        begin = _heads(at, code)
        longest = np.maximum.reduceat(length, begin) if len(begin) else length
        return at[begin], code[begin], _sums(n, begin), np.diff(np.append(begin, len(at))), _sums(length >= 16, begin), longest

    return _mapped(q, subjects, kernel, "seeds long, islands long, long_islands long, longest int")


def lengths(q: Few, subjects: DataFrame) -> DataFrame:
    """(query_id, oid, length, n): how many islands of a query and subject have each length."""

    def kernel(index: Index, texts: list[str], found: tuple) -> tuple:
        at, code, _, _, _, length, _ = _islands(index, texts, found)
        order = np.lexsort((length, code, at))
        at, code, length = at[order], code[order], length[order]
        begin = _heads(at, code, length)
        return at[begin], code[begin], length[begin], np.diff(np.append(begin, len(at)))

    return _mapped(q, subjects, kernel, "length int, n long")


def covered(q: Few, subjects: DataFrame) -> DataFrame:
    """(query_id, oid, covered): residues of a query that the islands of a subject cover, counted once."""

    def kernel(index: Index, texts: list[str], found: tuple) -> tuple:
        at, code, _, q0, _, length, _ = _islands(index, texts, found)
        begin = _heads(at, code)
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(at))))
        group, lo, hi = _merged(group, q0, q0 + length, 0)
        return at[begin], code[begin], _sums(hi - lo, _heads(group))

    return _mapped(q, subjects, kernel, "covered long")


def purged(q: Few, subjects: DataFrame) -> DataFrame:
    """``hits.purged`` of islands as segment pairs that score 5 for each residue."""

    def kernel(index: Index, texts: list[str], found: tuple) -> tuple:
        at, code, _, q0, s0, n, _ = _islands(index, texts, found)
        cols = (at, code, q0, q0 + n, s0, s0 + n, 5 * n)
        for x, y in ((2, 4), (3, 5)):
            order = np.lexsort((cols[5], cols[3], cols[4], cols[2], -cols[6], cols[y], cols[x], cols[1], cols[0]))
            cols = tuple(c[order] for c in cols)
            head = _heads(cols[0], cols[1], cols[x], cols[y])
            cols = tuple(c[head] for c in cols)
        return cols

    return _mapped(q, subjects, kernel, "q_start int, q_end int, s_start int, s_end int, score int")


def best_of_ranges(q: Few, subjects: DataFrame, most: int) -> DataFrame:
    """Islands as segment pairs that score 5 for each residue, of those of one range of a query in the subjects of a task only the ``most`` first by oid and place (all score the same)."""

    def kernel(index: Index, texts: list[str], found: tuple) -> tuple:
        at, code, _, q0, s0, n, _ = _islands(index, texts, found)
        return at, code, q0, q0 + n, s0, s0 + n, 5 * n

    def fold(rows: pa.Table) -> pa.Table:
        own = rows.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode").indices
        order = pc.sort_indices(pa.table([own, *(rows.column(c) for c in ("q_start", "q_end", "oid", "s_start"))], ["code", "q_start", "q_end", "oid", "s_start"]), [(c, "ascending") for c in ("code", "q_start", "q_end", "oid", "s_start")], null_placement="at_start")
        rows = rows.take(order)
        begin = _heads(np.asarray(own.take(order)), np.asarray(rows.column("q_start")), np.asarray(rows.column("q_end")))
        place = np.arange(rows.num_rows) - np.repeat(begin, np.diff(np.append(begin, rows.num_rows)))
        return rows.filter(pa.array(place < most))

    return _mapped(q, subjects, kernel, "q_start int, q_end int, s_start int, s_end int, score int", fold)


def local_scores(q: Few, subjects: DataFrame, least: int, gap_open: int = 11, gap_extend: int = 1) -> DataFrame:
    """(query_id, oid, score, q_end, s_end): the best local alignment of each query and subject with an island of at least some length."""
    m = blosum62()

    def kernel(index: Index, texts: list[str], found: tuple) -> tuple:
        at, code, *_, length, _ = _islands(index, texts, found)
        at, code = at[length >= least], code[length >= least]
        head = _heads(at, code)
        own: dict[int, list[np.ndarray]] = {}
        for c, r in index.rows:
            own.setdefault(c, []).append(codes(r))
        made = [(i, c, *smith_waterman(a, codes(texts[i]), m, gap_open, gap_extend)) for i, c in zip(at[head].tolist(), code[head].tolist(), strict=True) for a in own[c]]
        return tuple(np.array(made, np.int64).reshape(-1, 5).T)

    return _mapped(q, subjects, kernel, "score int, q_end int, s_end int").where("query_id is not null and oid is not null")


def merged_ranges(q: Few, subjects: DataFrame, gap: int, pad: int, fetch: bool = False) -> DataFrame:
    """(oid, from, to): ``ranges.merged`` of the places of islands; fetch: ``ranges.fetched``, cut at the end and with the residues."""
    kind = subjects.schema["oid"].dataType
    schema = subjects.sparkSession.createDataFrame([], f"oid {kind.simpleString()}, from int, to int" + ", residues string" * fetch).schema
    rows, k = q.rows, q.k

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rows.value, k)
        for oid, texts, begin in _blocks(given):
            # All islands of a subject, also where it is searched by parts of the queries: those of a part are merged before the next.
            parts = []
            for lo, part, mine, found in index.steps(texts):
                at, _, _, _, s0, n, _ = _islands(part, mine, found)
                parts.append(_merged(at + lo, np.maximum(s0 - pad, 0), s0 + n + pad, gap))
            at, lo, hi = _merged(*(np.concatenate(x) for x in zip(*parts, strict=True)), gap)
            if not len(at):
                continue
            if fetch:
                hi = np.minimum(hi, np.array([len(t) for t in texts])[at])
            cut = [pa.array([texts[i][a:b] for i, a, b in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True)], pa.string())] if fetch else []
            yield pa.RecordBatch.from_arrays([oid.take(pa.array(at + begin)), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), *cut], schema.names)

    return subjects.select("oid", "residues").mapInArrow(run, schema)


def two_hits(q: Few, subjects: DataFrame, window: int) -> DataFrame:
    """``words.two_hits`` of subjects whose ids are theirs alone: all diagonals go from mark to mark at once."""

    def kernel(index: Index, texts: list[str], found: tuple) -> tuple:
        at, code, q_pos, s_pos, fresh = _diagonals(found)
        first = np.flatnonzero(fresh)
        end = np.append(first[1:], len(at))
        span = int(s_pos.max(initial=0)) + index.k + 1
        place = (np.cumsum(fresh) - 1) * span + s_pos
        live, now, made = np.arange(len(first)), first, []
        while len(live):
            next_ = np.searchsorted(place, place[now] + index.k)
            ok = next_ < end[live]
            live, now, next_ = live[ok], now[ok], next_[ok]
            near = s_pos[next_] - s_pos[now] < window
            made.append(np.stack([next_[near], s_pos[now[near]]]))
            now = next_
        hit, before = np.concatenate(made, 1) if made else np.zeros((2, 0), np.int64)
        return at[hit], code[hit], q_pos[hit] - s_pos[hit], s_pos[hit], before

    return _mapped(q, subjects, kernel, "diag int, s_pos int, before int")


def right_arms(q: Few, subjects: DataFrame, drop: int) -> DataFrame:
    """(query_id, oid, diag, gain, steps): the right arm of the longest island (the first of equals) of each diagonal, where both sequences go on.

    Ids of queries and of subjects are theirs alone.
    """
    m = blosum62()

    def kernel(index: Index, texts: list[str], found: tuple) -> tuple:
        at, code, diag, q0, s0, n, _ = _islands(index, texts, found)
        order = np.lexsort((q0, -n, diag, code, at))
        at, code, diag, q0, s0 = (x[order] for x in (at, code, diag, q0 + n, s0 + n))
        best = np.ones(len(at), bool)
        best[1:] = (at[1:] != at[:-1]) | (code[1:] != code[:-1]) | (diag[1:] != diag[:-1])
        at, code, diag, q0, s0 = (x[best] for x in (at, code, diag, q0, s0))
        own = np.unique([c for c, _ in index.rows])  # codes in order: a part of the queries has some of them
        by_code = dict(index.rows)
        Q, S = B.flat([codes(by_code[c]) for c in own.tolist()]), B.flat([codes(t) for t in texts])
        place = np.searchsorted(own, code)
        on = (q0 < Q.length[place]) & (s0 < S.length[at])
        at, code, diag, q0, s0, place = (x[on] for x in (at, code, diag, q0, s0, place))
        gain, steps = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for lo in range(0, len(at), 1 << 14):
            x = slice(lo, lo + (1 << 14))
            gain[x], steps[x], _ = B.walk(Q.codes, S.codes, Q.begin[place[x]] + q0[x], S.begin[at[x]] + s0[x], 1, np.zeros(len(at[x]), np.int64), False, drop, m)
        return at, code, diag, gain, steps

    return _mapped(q, subjects, kernel, "diag int, gain long, steps long")


#: Residues whose words are counted together.
_COUNTED = 1 << 22


def _counted(texts: list[str], known: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(word, how often, in how many of the texts whose id is known) of all words of texts."""
    points = _points("\0".join(texts) + "\0")
    kinds = np.unique(points)
    if (len(kinds) + 1) ** k >= 1 << 62 or kinds[-1:] > 127 or "\0" in "".join(texts):
        found: dict[str, list[int]] = {}
        for text, own in zip(texts, known.tolist(), strict=True):
            for word, n in Counter(text[i : i + k] for i in range(len(text) - k + 1)).items():
                total = found.setdefault(word, [0, 0])
                total[0] += n
                total[1] += own
        n, many = np.array(list(found.values()), np.int64).reshape(-1, 2).T
        return pa.array(list(found), pa.string()), n, many
    table = np.zeros(128, np.int64)
    table[kinds] = np.arange(len(kinds))  # 0 is the end of a text
    c = table[points]
    places = max(0, len(c) - k + 1)
    number, good = np.zeros(places, np.int64), np.ones(places, bool)
    for i in range(k):
        number *= len(kinds)
        number += c[i : i + places]
        good &= c[i : i + places] > 0
    place = np.flatnonzero(good)
    length = np.array([len(t) + 1 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), length)[place]
    order = np.argsort(number[place], kind="stable")  # places of a word stay in order, so those of a text are together
    number, owner = number[place][order], owner[order]
    fresh = np.ones(len(number), bool)
    fresh[1:] = number[1:] != number[:-1]
    begin = np.flatnonzero(fresh)
    text = fresh.copy()
    text[1:] |= owner[1:] != owner[:-1]
    n = np.diff(np.append(begin, len(number)))
    many = np.add.reduceat((text & known[owner]).astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
    number = number[begin]
    letters = np.empty((len(number), k), np.uint8)
    for i in range(k - 1, -1, -1):
        letters[:, i] = kinds[number % len(kinds)]
        number //= len(kinds)
    offsets = np.arange(len(begin) + 1, dtype=np.int32) * k
    return pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters)]), n, many


def word_counts(subjects: DataFrame, k: int) -> DataFrame:
    """(word, n, subjects): how often some subjects have each word, and how many of them with an id; a word has several rows.  Ids are theirs alone."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            known, texts = np.asarray(batch.column(0).is_valid()), [t or "" for t in batch.column(1).to_pylist()]
            begin = 0
            while begin < len(texts):
                end, size = begin + 1, len(texts[begin])
                while end < len(texts) and size + len(texts[end]) <= _COUNTED:
                    size += len(texts[end])
                    end += 1
                word, n, many = _counted(texts[begin:end], known[begin:end], k)
                for lo in range(0, len(word), 1 << 16):
                    yield pa.RecordBatch.from_arrays([word.slice(lo, 1 << 16), pa.array(n[lo : lo + (1 << 16)]), pa.array(many[lo : lo + (1 << 16)])], ["word", "n", "subjects"])
                begin = end

    ready(subjects.sparkSession)
    return dealt(subjects.select("oid", "residues")).mapInArrow(run, "word string, n long, subjects long")

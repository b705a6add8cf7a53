"""Words of sequences, their neighbours, and the joins that seed a search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.matrix import RESIDUES, blosum62, codes
from strandloom.operators import scan
from strandloom.operators.ungapped import right_arm
from strandloom.sources.shared import dealt

#: Query words are broadcast up to this many rows; beyond it, Spark shuffles both sides.
BROADCAST_ROWS = 200_000


def words(seqs: DataFrame, k: int, *, key: str, residues: str = "residues", pos: str = "pos", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, pos, word): every word of k residues with its zero-based position.

    One pass of a look-ahead pattern, so the cost is linear in the length of a sequence.
    """
    found = F.regexp_extract_all(F.col(residues), F.lit(f"(?=(.{{{k}}}))"), F.lit(1))
    return seqs.select(key, *keep, F.posexplode(found).alias(pos, "word"))


def hinted(words_: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A build side that is broadcast if it has at most ``limit`` rows."""
    return F.broadcast(words_) if words_.limit(limit + 1).count() <= limit else words_


def seeds(queries: DataFrame, subjects: DataFrame, k: int, *, neighbours: DataFrame | None = None) -> DataFrame:
    """(query_id, oid, q_pos, s_pos, diag) of all word hits.

    queries: query_id, residues.  subjects: oid, residues.  With ``neighbours`` (query_id, q_pos, word)
    those words are looked up instead of the queries' own.  Few words of queries are found by a scan, many by a join.
    """
    if neighbours is None and (q := scan.few(queries, k)):
        return scan.seeds(q, subjects)
    q = words(queries, k, key="query_id", pos="q_pos") if neighbours is None else neighbours
    s = words(subjects, k, key="oid", pos="s_pos")
    return s.join(hinted(q), "word").select("query_id", "oid", "q_pos", "s_pos", (F.col("q_pos") - F.col("s_pos")).alias("diag"))


def presence(queries: DataFrame, subjects: DataFrame, k: int) -> DataFrame:
    """(oid, pos, word) of subject words that any query has."""
    q = words(queries, k, key="query_id").select("word").distinct()
    return words(subjects, k, key="oid").join(hinted(q), "word", "left_semi").select("oid", "pos", "word")


def neighbour_words(spark: SparkSession, queries: DataFrame, k: int, threshold: int, *, scores: np.ndarray | None = None) -> DataFrame:
    """(query_id, q_pos, word) of all words that score at least ``threshold`` against a word of a query.

    Words are grown letter by letter; what can no longer reach the threshold with the best
    score of each letter that is left is dropped at once.
    """
    m = blosum62() if scores is None else scores
    alphabet = [(RESIDUES[i], RESIDUES[j], int(m[i, j])) for i in range(1, 28) for j in range(1, 28)]
    table = F.broadcast(spark.createDataFrame(alphabet, "a string, b string, sc int"))  # 27 x 27 rows
    best = F.create_map(*[F.lit(x) for i in range(1, 28) for x in (RESIDUES[i], int(m[i, 1:28].max()))])
    start = words(queries, k, key="query_id", pos="q_pos").withColumnRenamed("word", "w")
    hope = [F.element_at(best, F.substring("w", i + 1, 1)) for i in range(k)]
    now = start.select("query_id", "q_pos", "w", F.lit("").alias("word"), F.lit(0).alias("score"), sum(hope[1:], hope[0]).alias("left"))
    for i in range(k):
        letter = F.substring("w", i + 1, 1)
        now = now.withColumn("a", letter).join(table, "a")
        now = now.select("query_id", "q_pos", "w", F.concat("word", "b").alias("word"), (F.col("score") + F.col("sc")).alias("score"), (F.col("left") - F.element_at(best, F.col("a"))).alias("left")).where(F.col("score") + F.col("left") >= threshold)
    return now.select("query_id", "q_pos", "word", "score")


def neighbour_index(residues: str, k: int, threshold: int | None, scores: np.ndarray | None = None) -> dict[int, list[int]]:
    """Word number -> positions in one query, for the kernels; ``threshold`` None: exact words."""
    m = blosum62() if scores is None else scores
    c = codes(residues).astype(np.int64)
    out: dict[int, list[int]] = {}
    for at in range(len(c) - k + 1):
        w = c[at : at + k]
        if threshold is None:
            found = [int((w * 28 ** np.arange(k - 1, -1, -1)).sum())] if (w > 0).all() else []
        else:
            top = [int(m[x, 1:28].max()) for x in w]
            states = [(0, 0)]
            for i, x in enumerate(w):
                rest = sum(top[i + 1 :])
                states = [(number * 28 + y, score + int(m[x, y])) for number, score in states for y in range(1, 28) if score + int(m[x, y]) + rest >= threshold]
            found = [number for number, _ in states]
        for number in found:
            out.setdefault(number, []).append(at)
    return out


def diagonals(seeds_: DataFrame) -> DataFrame:
    """(query_id, oid, diag, n, first, last) for each diagonal with seeds."""
    return seeds_.groupBy("query_id", "oid", "diag").agg(F.count("*").alias("n"), F.min("s_pos").alias("first"), F.max("s_pos").alias("last"))


def islands(seeds_: DataFrame, k: int) -> DataFrame:
    """Runs of overlapping or touching exact seeds on a diagonal: query_id, oid, diag, q_start, s_start, length, n_seeds."""
    from pyspark.sql import Window as W

    w = W.partitionBy("query_id", "oid", "diag").orderBy("s_pos")
    fresh = F.when(F.col("s_pos") - F.lag("s_pos").over(w) <= k, 0).otherwise(1)
    runs = seeds_.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w))
    return runs.groupBy("query_id", "oid", "diag", "run").agg(F.min("q_pos").alias("q_start"), F.min("s_pos").alias("s_start"), (F.max("s_pos") - F.min("s_pos") + k).alias("length"), F.count("*").alias("n_seeds")).drop("run")


def by_id(subjects: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose oid is theirs alone, and those that share one (None if there are none)."""
    again = subjects.groupBy("oid").agg(F.count("*").alias("n")).where("n > 1").select(F.col("oid").alias("__o"))
    if again.isEmpty():
        return subjects, None
    same = F.col("oid").eqNullSafe(F.col("__o"))
    return subjects.join(again, same, "left_anti"), subjects.join(again, same, "left_semi")


def word_counts(subjects: DataFrame, k: int) -> DataFrame:
    """(word, n, subjects): how often subjects (oid, residues) have each word of k residues, and how many different ids have it.

    Words are counted where the texts are; only counts are shuffled, one for each word of some million residues.
    """
    own, shared_ = by_id(subjects)
    counted = scan.word_counts(own, k)
    if shared_ is not None:
        counted = counted.unionByName(words(shared_, k, key="oid").groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("oid").alias("subjects")))
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("subjects").alias("subjects"))


def of_subjects(queries: DataFrame, subjects: DataFrame, k: int, alone: Callable[[scan.Few, DataFrame], DataFrame], together: Callable[[DataFrame, DataFrame], DataFrame], read: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What seeds make of each query and subject: ``alone`` where the seeds of an id are all in one row, ``together`` of queries and subjects elsewhere.

    Many words of queries, and the rows of ids that occur more than once, go by the join and the shuffle of seeds.  read: makes (oid, residues)
    of rows with an oid; they are dealt to tasks anew before it, as a few large row groups would keep a few cores busy.
    """
    q = scan.few(queries, k)
    if q is None:
        return together(queries, read(subjects) if read else subjects)
    own, shared_ = by_id(subjects)
    found = alone(q, read(dealt(own, "oid")) if read else own)
    return found if shared_ is None else found.unionByName(together(queries, read(shared_) if read else shared_))


def islands_of(queries: DataFrame, subjects: DataFrame, k: int, least: int = 0, read: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The islands of all exact seeds of queries (query_id, residues) in subjects (oid, residues), those of at least some length."""
    return of_islands(queries, subjects, k, lambda q, s: scan.islands(q, s, least), lambda i: i.where(F.col("length") >= least) if least else i, read)


def of_islands(queries: DataFrame, subjects: DataFrame, k: int, alone: Callable[[scan.Few, DataFrame], DataFrame], plain: Callable[[DataFrame], DataFrame], read: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What islands make of each query and subject (or of a subject): ``alone`` in tasks where all seeds of an id are in one row, ``plain`` of the islands elsewhere."""
    return of_subjects(queries, subjects, k, alone, lambda q, s: plain(islands(seeds(q, s, k), k)), read)


def two_hits_of(queries: DataFrame, subjects: DataFrame, k: int, window: int, read: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The second hits of all exact seeds of queries in subjects."""
    return of_subjects(queries, subjects, k, lambda q, s: scan.two_hits(q, s, window), lambda q, s: two_hits(seeds(q, s, k), k, window), read)


def right_arms(queries: DataFrame, subjects: DataFrame, k: int, drop: int) -> DataFrame:
    """(query_id, oid, diag, gain, steps): the right arm of the longest island (the first of equals) of each diagonal, where both sequences go on."""
    best = islands(seeds(queries, subjects, k), k).groupBy("query_id", "oid", "diag").agg(F.max(F.struct("length", (-F.col("q_start")).alias("m"), "s_start")).alias("x"))
    e = best.select("query_id", "oid", "diag", (-F.col("x.m") + F.col("x.length")).cast("int").alias("q0"), (F.col("x.s_start") + F.col("x.length")).cast("int").alias("s0"))
    arms = e.join(queries, "query_id").withColumn("a", F.substring("residues", F.col("q0") + 1, F.length("residues"))).drop("residues").join(subjects.select("oid", "residues"), "oid").withColumn("b", F.substring("residues", F.col("s0") + 1, F.length("a")))
    n = F.least(F.length("a"), F.length("b"))
    return arms.where(n > 0).select("query_id", "oid", "diag", right_arm(F.col("a"), F.col("b"), n, drop).alias("x")).select("query_id", "oid", "diag", F.col("x.best").cast("long").alias("gain"), F.col("x.steps").cast("long").alias("steps"))


def right_arms_of(queries: DataFrame, subjects: DataFrame, k: int, drop: int, read: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``right_arms`` by a scan, but where an id of a query or subject occurs more than once."""
    own = lambda q, s: right_arms(queries, s, k, drop) if q.repeated else scan.right_arms(q, s, drop)
    return of_subjects(queries, subjects, k, own, lambda q, s: right_arms(q, s, k, drop), read)


def crowded(seeds_: DataFrame, window: int) -> DataFrame:
    """Seeds with another one less than ``window`` away on their diagonal; the others can neither be nor make a second hit."""
    from pyspark.sql import Window as W

    w = W.partitionBy("query_id", "oid", "diag").orderBy("s_pos")
    near = (F.col("s_pos") - F.lag("s_pos").over(w) < window) | (F.lead("s_pos").over(w) - F.col("s_pos") < window)
    return seeds_.withColumn("__near", near).where("__near").drop("__near")


def two_hits(seeds_: DataFrame, k: int, window: int) -> DataFrame:
    """(query_id, oid, diag, s_pos, before): hits that have another one on their diagonal, k to window - 1 before.

    ``before`` is where that one was.  Overlapping hits do not move the mark.  Extensions are
    left out, so this is the state machine as if none succeeded.
    """
    step = lambda acc, s: F.when(acc["last"].isNull() | (s - acc["last"] >= window), F.struct(s.alias("last"), acc["out"].alias("out"))).when(s - acc["last"] >= k, F.struct(s.alias("last"), F.concat(acc["out"], F.array(F.struct(s.alias("s_pos"), acc["last"].alias("before")))).alias("out"))).otherwise(acc)
    zero = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<struct<s_pos:int,before:int>>").alias("out"))
    folded = crowded(seeds_, window).groupBy("query_id", "oid", "diag").agg(F.aggregate(F.array_sort(F.collect_list("s_pos")), zero, step, lambda a: a["out"]).alias("hits"))
    return folded.select("query_id", "oid", "diag", F.explode("hits").alias("h")).select("query_id", "oid", "diag", "h.s_pos", "h.before")


def unmasked(seeds_: DataFrame, masks: DataFrame, k: int, width: int = 256) -> DataFrame:
    """Seeds whose word touches no mask of its subject (oid, from, to).

    An equi-join on bins of ``width`` residues instead of a range join.
    """
    last = F.greatest(F.col("to") - 1, F.col("from"))
    bins = masks.where(F.col("to") > F.col("from")).select("oid", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor(last / width))).alias("bin"))
    s = seeds_.withColumn("lo", F.floor(F.col("s_pos") / width)).withColumn("hi", F.floor((F.col("s_pos") + k - 1) / width))
    wide = s.withColumn("bin", F.explode(F.array_distinct(F.array("lo", "hi"))))
    hit = wide.join(bins, ["oid", "bin"]).where((F.col("from") < F.col("s_pos") + k) & (F.col("to") > F.col("s_pos"))).select("query_id", "oid", "q_pos", "s_pos").distinct()
    return seeds_.join(hit, ["query_id", "oid", "q_pos", "s_pos"], "left_anti")


def near_diagonals(seeds_: DataFrame, reach: int) -> Column:
    """Diagonals within ``reach`` of a seed's own, for off-diagonal two-hit tests."""
    return F.explode(F.sequence(F.col("diag") - reach, F.col("diag") + reach))

"""From segment pairs to a report: statistics, purging, culling, ranking, limits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions.matrix import GAPPED, UNGAPPED

# ------------------------------------------------------------------ statistics

Parameters = tuple[float, float, float]  # lambda, K, H


def of(gapped: bool, params: Parameters | None = None) -> Parameters:
    """``params``, or else those of BLOSUM62 with gap costs 11 and 1, or without gaps."""
    return params or (GAPPED if gapped else UNGAPPED)


def bits(score: Column, gapped: bool = True, params: Parameters | None = None) -> Column:
    lam, k, _ = of(gapped, params)
    return (score * lam - math.log(k)) / math.log(2)


def raw_from_bits(b: float, gapped: bool = True, params: Parameters | None = None) -> int:
    """Raw score of a bit score, rounded up."""
    lam, k, _ = of(gapped, params)
    return math.ceil((b * math.log(2) + math.log(k)) / lam)


def raw_drop(b: float, gapped: bool = False, params: Parameters | None = None) -> int:
    """Raw X-drop of a drop in bits."""
    lam = of(gapped, params)[0]
    return math.ceil(b * math.log(2) / lam)


def length_adjustment(m: int, n: int, count: int, gapped: bool = True, params: Parameters | None = None) -> int:
    """Expected length of an alignment by chance (Altschul and Gish 1996), by fixed-point steps."""
    _, k, h = of(gapped, params)
    found = 0.0
    for _ in range(20):
        space = max(m - found, 1 / k) * max(n - count * found, 1 / k)
        new = max(0.0, min(math.log(max(k * space, 1.0)) / h, m - 1 / k, n / max(count, 1)))
        if abs(new - found) < 0.5:
            found = new
            break
        found = (found + new) / 2
    return int(found)


def search_space(m: int, n: int, count: int, gapped: bool = True, params: Parameters | None = None) -> int:
    a = length_adjustment(m, n, count, gapped, params)
    return max(1, m - a) * max(1, n - count * a)


def evalue(score: Column, space: Column, gapped: bool = True, params: Parameters | None = None) -> Column:
    lam, k, _ = of(gapped, params)
    return space * k * F.exp(score * -lam)


def spaces(queries: DataFrame, subjects: DataFrame, *, gapped: bool = True, db_size: int = 0, fixed: int = 0, length: Column | None = None, params: Parameters | None = None) -> DataFrame:
    """(query_id, space): effective search spaces, from totals of all subjects before any filter.

    ``length``: of a query, that of its residues unless given.
    """
    size = F.length("residues") if length is None else length
    if fixed:
        return queries.select("query_id", F.lit(fixed).cast("double").alias("space"))
    total = subjects.agg(F.sum(F.length("residues")).alias("n"), F.count("*").alias("c")).first()
    n, c = db_size or total["n"] or 1, total["c"] or 1
    # One row for each length that occurs: at most as many as the longest query has residues.
    lengths = [r["n"] for r in queries.select(size.cast("int").alias("n")).distinct().collect()]
    table = queries.sparkSession.createDataFrame([(m, float(search_space(m, n, c, gapped, params))) for m in lengths], "n int, space double")
    return queries.select("query_id", size.cast("int").alias("n")).join(F.broadcast(table), "n").select("query_id", "space")


def least_score(space: Column, evalue_limit: float, gapped: bool = True, params: Parameters | None = None) -> Column:
    """The least raw score of an E-value within the limit."""
    lam, k, _ = of(gapped, params)
    return F.greatest(F.ceil(F.log(space * k / evalue_limit) / lam), F.lit(1)).cast("int")


def cutoffs(queries: DataFrame, subjects: DataFrame, *, evalue_limit: float = 10.0, trigger: float = 22.0, drop: float = 7.0, drop_gapped: float = 15.0) -> DataFrame:
    """Raw cutoffs that hold for all queries, the least stringent of each: ungapped and gapped score, X-drops."""
    each = spaces(queries, subjects).select(least_score(F.col("space"), evalue_limit).alias("score"))
    return each.agg(F.min("score").alias("gapped_score")).select(F.lit(raw_from_bits(trigger, False)).alias("ungapped_score"), "gapped_score", F.lit(raw_drop(drop)).alias("x_drop"), F.lit(raw_drop(drop_gapped, True)).alias("x_drop_gapped"))


# ------------------------------------------------------------------ dedupe and culling

#: Full order of segment pairs within a query and subject; ties end with coordinates.
BEST = (F.desc, "score"), (F.asc, "q_start"), (F.asc, "s_start"), (F.asc, "q_end"), (F.asc, "s_end")


def _best() -> list[Column]:
    return [f(c) for f, c in BEST]


def purged(hsps: DataFrame, keys: tuple[str, ...] = ("query_id", "oid")) -> DataFrame:
    """Of pairs with a common start the best stays, then of those with a common end."""
    out = hsps
    for ends in (("q_start", "s_start"), ("q_end", "s_end")):
        w = W.partitionBy(*keys, *ends).orderBy(*_best())
        out = out.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return out


def uncontained(hsps: DataFrame, separation: int = 0, keys: tuple[str, ...] = ("query_id", "oid")) -> DataFrame:
    """Drops pairs inside the box of a better pair that was kept, on about the same diagonal.

    Greedy in the full order; ``separation`` 0 takes boxes alone.
    """
    fields = [f for f in hsps.columns if f not in keys]
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o1"), F.col("q_start").alias("o2"), F.col("s_start").alias("o3"), F.col("q_end").alias("o4"), F.col("s_end").alias("o5"), F.struct(*fields).alias("row"))))
    kind = hsps.select(F.array(F.struct(*fields))).schema[0].dataType
    inside = lambda a, b: (a["q_start"] >= b["q_start"]) & (a["q_end"] <= b["q_end"]) & (a["s_start"] >= b["s_start"]) & (a["s_end"] <= b["s_end"]) & (F.lit(separation == 0) | (F.abs((a["q_start"] - a["s_start"]) - (b["q_start"] - b["s_start"])) < separation) | (F.abs((a["q_end"] - a["s_end"]) - (b["q_end"] - b["s_end"])) < separation))
    step = lambda acc, x: F.when(F.exists(acc, lambda b: inside(x["row"], b)), acc).otherwise(F.concat(acc, F.array(x["row"])))
    kept = hsps.groupBy(*keys).agg(F.aggregate(ordered, F.array().cast(kind), step).alias("kept"))
    return kept.select(*keys, F.explode("kept").alias("x")).select(*keys, "x.*").select(hsps.columns)


#: Query residues in a bin of the joins that look for pairs covering others.
_BIN = 32


def _binned(pairs: DataFrame, first: Column, last: Column) -> DataFrame:
    """Pairs at every bin of the query residues first to last."""
    return pairs.withColumn("bin", F.explode(F.sequence(F.floor(first / _BIN), F.greatest(F.floor(last / _BIN), F.floor(first / _BIN)))))


def culled(hsps: DataFrame, limit: int) -> DataFrame:
    """Drops a pair whose query range lies within those of at least ``limit`` better pairs of its query.

    Pairs of one range are first cut to the ``limit`` best: those beyond lie within these, and whatever they cover these cover
    as well.  So what goes on is bounded by the ranges that a query has, not by how many subjects share them.  What covers a pair covers its
    first residue, so the two meet in that one's bin.
    """
    if limit < 1:
        return hsps
    rank = F.rank().over(W.partitionBy("query_id", "q_start", "q_end").orderBy(F.desc("score"), "oid", "s_start"))
    hsps = hsps.withColumn("__k", rank).where(F.col("__k") <= limit).drop("__k")
    b = hsps.select("query_id", F.col("score").alias("bs"), F.col("q_start").alias("b0"), F.col("q_end").alias("b1"), F.col("oid").alias("bo"), F.col("s_start").alias("bp"))
    better = (F.col("bs") > F.col("score")) | ((F.col("bs") == F.col("score")) & ((F.col("bo") < F.col("oid")) | ((F.col("bo") == F.col("oid")) & (F.col("bp") < F.col("s_start")))))
    key = ["query_id", "oid", "q_start", "q_end", "s_start", "s_end"]
    at = hsps.select(*key, "score", F.floor(F.col("q_start") / _BIN).alias("bin"))
    over = at.join(_binned(b, F.col("b0"), F.col("b1") - 1), ["query_id", "bin"]).where((F.col("b0") <= F.col("q_start")) & (F.col("b1") >= F.col("q_end")) & better).groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= limit)
    return hsps.join(over, key, "left_anti").select(hsps.columns)


def best_hits(hsps: DataFrame, overhang: float = 0.1, edge: float = 0.1) -> DataFrame:
    """Drops a pair that another of its query covers but for the overhang, with no larger E-value and clearly more score per residue.

    Overhang and edge are less than a half.  What covers a pair but for the overhang covers its middle, so the two meet in that one's bin.
    Only what differs in range, score or E-value is compared: copies of a passage are one.
    """
    if not (0 <= overhang < 0.5 and 0 <= edge < 0.5):
        raise ValueError("overhang and edge are from 0 to less than 0.5")
    b = hsps.select("query_id", F.col("evalue").alias("be"), F.col("q_start").alias("b0"), F.col("q_end").alias("b1"), (F.col("score") / (F.col("q_end") - F.col("q_start"))).alias("bd"))
    slack = (F.col("q_end") - F.col("q_start")) * overhang
    key = ["query_id", "q_start", "q_end", "evalue", "score"]
    b = b.distinct()
    at = hsps.select(key).distinct().select(*key, F.floor((F.col("q_start") + F.col("q_end")) / 2 / _BIN).alias("bin"))
    # One residue more on either side: the middle may lie on the edge of what covers the pair.
    beaten = at.join(_binned(b, F.greatest(F.col("b0") - 1, F.lit(0)), F.col("b1")), ["query_id", "bin"]).where((F.col("b0") <= F.col("q_start") + slack) & (F.col("b1") >= F.col("q_end") - slack) & (F.col("be") <= F.col("evalue")) & (F.col("bd") * (1 - edge) > F.col("score") / (F.col("q_end") - F.col("q_start")))).select(*key).distinct()
    return hsps.join(beaten, key, "left_anti").select(hsps.columns)


def masked_level(hsps: DataFrame, level: int = 80) -> DataFrame:
    """Keeps, of pairs of a query that overlap by at least ``level`` percent of the shorter one, the best (greedy).

    Of pairs of one range only the best can stay: what drops it drops the others, and else it does so itself.  The fold
    over a query's pairs has one for each range.
    """
    own = W.partitionBy("query_id", "q_start", "q_end").orderBy(F.desc("score"), "oid", "s_start")
    hsps = hsps.withColumn("__r", F.row_number().over(own)).where("__r = 1").drop("__r")
    fields = [f for f in hsps.columns if f != "query_id"]
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o1"), F.col("oid").alias("o2"), F.col("q_start").alias("o3"), F.col("s_start").alias("o4"), F.struct(*fields).alias("row"))))
    kind = hsps.select(F.array(F.struct(*fields))).schema[0].dataType
    over = lambda a, b: 100 * (F.least(a["q_end"], b["q_end"]) - F.greatest(a["q_start"], b["q_start"])) >= level * F.least(a["q_end"] - a["q_start"], b["q_end"] - b["q_start"])
    step = lambda acc, x: F.when(F.exists(acc, lambda b: over(x["row"], b)), acc).otherwise(F.concat(acc, F.array(x["row"])))
    kept = hsps.groupBy("query_id").agg(F.aggregate(ordered, F.array().cast(kind), step).alias("kept"))
    return kept.select("query_id", F.explode("kept").alias("x")).select("query_id", "x.*").select(hsps.columns)


# ------------------------------------------------------------------ ranking and limits


def per_subject(hsps: DataFrame, n: int) -> DataFrame:
    """The n best pairs of each query and subject; 0: all."""
    if not n:
        return hsps
    w = W.partitionBy("query_id", "oid").orderBy(*_best())
    return hsps.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def per_query(hsps: DataFrame, n: int) -> DataFrame:
    """The n best pairs of each query over all subjects; 0: all."""
    if not n:
        return hsps
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "oid", "q_start", "s_start", "q_end", "s_end")
    return hsps.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def top_subjects(hsps: DataFrame, n: int) -> DataFrame:
    """Pairs of the n best subjects (0: all) of each query: least E-value, then highest score, then oid; with the rank of the subject."""
    best = hsps.groupBy("query_id", "oid").agg(F.min("evalue").alias("e"), F.max("score").alias("s"))
    w = W.partitionBy("query_id").orderBy("e", F.desc("s"), "oid")
    ranks = best.withColumn("rank", F.row_number().over(w)).where(F.lit(not n) | (F.col("rank") <= n)).select("query_id", "oid", "rank")
    return hsps.join(ranks, ["query_id", "oid"])


def linked(hsps: DataFrame, longest_gap: int = 50) -> DataFrame:
    """(query_id, oid, chain_score, n): the best chain of pairs in order on both sides, gaps at most ``longest_gap``.

    A chain of n pairs scores the sum of their scores less ln K of each after the first (sum
    statistics, Karlin and Altschul 1993, in units of a pair's raw score).
    """
    lam, k, _ = GAPPED
    cost = -math.log(k) / lam / 4
    ordered = F.array_sort(F.collect_list(F.struct("q_start", "s_start", "q_end", "s_end", F.col("score").cast("double").alias("score"))))
    kind = "array<struct<q1:int,s1:int,total:double,n:int>>"

    def step(acc: Column, x: Column) -> Column:
        fits = F.filter(acc, lambda c: (c["q1"] <= x["q_start"]) & (c["s1"] <= x["s_start"]) & (x["q_start"] - c["q1"] <= longest_gap) & (x["s_start"] - c["s1"] <= longest_gap))
        top = F.array_max(F.transform(fits, lambda c: F.struct(c["total"].alias("total"), c["n"].alias("n"))))
        gain = F.when(top.isNotNull() & (top["total"] > cost), F.struct((top["total"] - cost).alias("t"), top["n"].alias("n"))).otherwise(F.struct(F.lit(0.0).alias("t"), F.lit(0).alias("n")))
        return F.concat(acc, F.array(F.struct(x["q_end"].cast("int").alias("q1"), x["s_end"].cast("int").alias("s1"), (x["score"] + gain["t"]).alias("total"), (gain["n"] + 1).alias("n"))).cast(kind))

    chains = hsps.groupBy("query_id", "oid").agg(F.aggregate(ordered, F.array().cast(kind), step).alias("c"))
    best = F.array_max(F.transform("c", lambda c: F.struct(c["total"].alias("total"), (-c["n"]).alias("m"))))
    return chains.select("query_id", "oid", F.round(best["total"], 6).alias("chain_score"), (-best["m"]).alias("n"))


def script_stats(hsps: DataFrame, script: str = "script") -> DataFrame:
    """Alignment length, gaps and gap openings from the steps of an alignment."""
    s = F.col(script)
    total = lambda f: F.aggregate(F.filter(s, f), F.lit(0), lambda a, x: a + x["n"])
    gap = lambda x: x["op"] != "sub"
    return hsps.withColumns({"align_length": total(lambda x: F.lit(True)), "gaps": total(gap), "gap_opens": F.size(F.filter(s, gap))})

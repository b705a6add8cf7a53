"""Ungapped extension as a column expression, for letters A to Z."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.matrix import RESIDUES, blosum62


@lru_cache(1)
def _scores() -> list[int]:
    m, at = blosum62(), {c: i for i, c in enumerate(RESIDUES)}
    letters = [chr(65 + i) for i in range(26)]
    return [int(m[at[a], at[b]]) for a in letters for b in letters]


def right_arm(a: Column, b: Column, n: Column, drop: int, start: int = 0) -> Column:
    """(best, steps, ...) of walking along the first n letters of a and b until the score is ``drop`` below its best.

    A fold over positions; the best is updated before the test, and only if it is beaten.
    """
    table = F.array(*[F.lit(x) for x in _scores()])
    zero = F.struct(F.lit(start).alias("total"), F.lit(start).alias("best"), F.lit(0).alias("steps"), F.lit(True).alias("on"))

    def step(acc: Column, i: Column) -> Column:
        total = acc["total"] + F.get(table, (F.ascii(F.substring(a, i, F.lit(1))) - 65) * 26 + F.ascii(F.substring(b, i, F.lit(1))) - 65)
        best = F.greatest(acc["best"], total)
        steps = F.when(total > acc["best"], i).otherwise(acc["steps"])
        return F.when(acc["on"], F.struct(total.alias("total"), best.alias("best"), steps.alias("steps"), (best - total < drop).alias("on"))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), n), zero, step)

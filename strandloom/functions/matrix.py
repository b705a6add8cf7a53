"""Substitution scores and the statistics that go with them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Order of residue codes; code 0 separates sequences and ends every extension.
RESIDUES = "-ABCDEFGHIKLMNPQRSTVWXYZU*OJ"
SENTINEL = -128

# BLOSUM62 (Henikoff and Henikoff 1992), lower triangle of the twenty amino acids.
_AMINO = "ACDEFGHIKLMNPQRSTVWY"
_TRIANGLE = """
 4
 0  9
-2 -3  6
-1 -4  2  5
-2 -2 -3 -3  6
 0 -3 -1 -2 -3  6
-2 -3 -1  0 -1 -2  8
-1 -1 -3 -3  0 -4 -3  4
-1 -3 -1  1 -3 -2 -1 -3  5
-1 -1 -4 -3  0 -4 -3  2 -2  4
-1 -1 -3 -2  0 -3 -2  1 -1  2  5
-2 -3  1  0 -3  0  1 -3  0 -3 -2  6
-1 -3 -1 -1 -4 -2 -2 -3 -1 -3 -2 -2  7
-1 -3  0  2 -3 -2  0 -3  1 -2  0  0 -1  5
-1 -3 -2  0 -3 -2  0 -3  2 -2 -1  0 -2  1  5
 1 -1  0  0 -2  0 -1 -2  0 -2 -1  1 -1  0 -1  4
 0 -1 -1 -1 -2 -2 -2 -1 -1 -1 -1  0 -1 -1 -1  1  5
 0 -1 -3 -2 -1 -3 -3  3 -2  1  1 -3 -2 -2 -3 -2  0  4
-3 -2 -4 -3  1 -2 -2 -3 -3 -2 -1 -4 -4 -2 -3 -3 -2 -3 11
-2 -2 -3 -2  3 -3  2 -1 -2 -1 -1 -2 -3 -1 -2 -2 -2 -1  2  7
"""
# The ambiguous codes against the twenty, then against B, Z and J.
_AMBIGUOUS = {
    "B": "-2 -3 4 1 -3 -1 0 -3 0 -4 -3 4 -2 0 -1 0 -1 -3 -4 -3  4 0 -3",
    "Z": "-1 -3 1 4 -3 -2 0 -3 1 -3 -1 0 -1 4 0 0 -1 -2 -2 -2  0 4 -3",
    "J": "-1 -1 -3 -3 0 -4 -3 3 -3 3 2 -3 -3 -2 -2 -2 -1 2 -2 -1  -3 -3 3",
}
#: Karlin-Altschul parameters of BLOSUM62 (Altschul and Gish 1996): lambda, K, H; with gaps for costs 11 and 1.
UNGAPPED, GAPPED = (0.3176, 0.134, 0.4012), (0.267, 0.041, 0.14)


@lru_cache(1)
def blosum62() -> np.ndarray:
    """28 x 28 scores by residue code.  X, U and O score -1, a stop -4 and 1 against itself, code 0 the sentinel."""
    at = {c: i for i, c in enumerate(RESIDUES)}
    out = np.full((28, 28), -1, np.int32)
    for c, row in zip(_AMINO, _TRIANGLE.strip().split("\n"), strict=True):
        for d, v in zip(_AMINO, row.split(), strict=False):
            out[at[c], at[d]] = out[at[d], at[c]] = int(v)
    for c, row in _AMBIGUOUS.items():
        for d, v in zip(_AMINO + "BZJ", row.split(), strict=True):
            out[at[c], at[d]] = out[at[d], at[c]] = int(v)
    out[at["*"], :] = out[:, at["*"]] = -4
    out[at["*"], at["*"]] = 1
    out[0, :] = out[:, 0] = SENTINEL
    return out


def base_scores(reward: int, penalty: int) -> np.ndarray:
    """28 x 28 scores of bases: equal ones of A, C, G and T gain, all others lose."""
    out = np.full((28, 28), penalty, np.int32)
    for c in "ACGT":
        out[RESIDUES.index(c), RESIDUES.index(c)] = reward
    out[0, :] = out[:, 0] = SENTINEL
    return out


def read_matrix(text: str) -> np.ndarray:
    """Scores from the usual text form: a line of column letters, then a line for each row."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    at = {c: i for i, c in enumerate(RESIDUES)}
    out = np.full((28, 28), -1, np.int32)
    for row in lines[1:]:
        for d, v in zip(lines[0], row[1:], strict=True):
            if row[0] in at and d in at:
                out[at[row[0]], at[d]] = int(v)
    out[0, :] = out[:, 0] = SENTINEL
    return out


_CODE = np.full(256, RESIDUES.index("X"), np.uint8)
for _i, _c in enumerate(RESIDUES):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def codes(residues: str) -> np.ndarray:
    """Residue codes of a text; letters that are none become X."""
    return _CODE[np.frombuffer(residues.encode("latin-1", "replace"), np.uint8)]


def matrix_table(spark: SparkSession, scores: np.ndarray | None = None) -> DataFrame:
    """(a, b, score) of all pairs of residues but the separator: 27 x 27 rows."""
    m = blosum62() if scores is None else scores
    rows = [(RESIDUES[i], RESIDUES[j], int(m[i, j])) for i in range(1, 28) for j in range(1, 28)]
    return spark.createDataFrame(rows, "a string, b string, score int")

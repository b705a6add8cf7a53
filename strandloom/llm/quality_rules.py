"""Quality rules: counts of a text plus a calibrated logistic regression over hashed n-grams.

The model is trained on labelled rows (1 good, 0 bad), calibrated by a logistic curve on rows
kept out of the training, and applied in Arrow batches against a fixed threshold.

Null and empty texts have no words, fail the base rule and are not kept.  Repeated rows are
judged row by row; extra columns are ignored.  Without labels of both kinds the model gives
every text the share of good labels (1 without any label).  Very long texts are read whole.  A probability at the
threshold is kept.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, mix, runs, small_batches, spans_of, steps

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))  # white space, and bytes that continue a code point
_SYMBOLS = b"#*$%&|<>"
#: Words in a window, and the least share (percent) of repeated words that fails a text.
WINDOW, MOST_REPEATED, LEAST_WORDS = 8, 30, 20
#: Kinds of features: words, word pairs, character 4-grams.
_KINDS = 3


@dataclass(frozen=True)
class QualityModel:
    """Score of a text: bias + the sum over kinds of the mean weight of its n-grams, then slope and shift of the calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int
    threshold: float


def base_counts(texts: list[bytes], words: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    h, doc, _, _ = words
    n = len(texts)
    n_words = np.bincount(doc, minlength=n)
    chars = np.array([len(t.translate(None, _NOT_COUNTED)) for t in texts], np.int64)
    symbols = np.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in texts], np.int64)
    dup = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        lines = t.split(b"\n")
        if len(lines) > len(seen := set(lines)):
            # every line after its first appearance, if it has a word
            dup[i] = sum(1 for x in lines if x.strip(_SPACE)) - sum(1 for x in seen if x.strip(_SPACE))
    repeat = np.zeros(n, np.int64)
    if len(h) >= WINDOW:
        win = runs(h, WINDOW)
        own = doc[: len(win)]
        inside = own == doc[WINDOW - 1 :]
        at = np.flatnonzero(inside)
        key = mix(win[at] ^ mix(own[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + WINDOW, -1)
        repeat = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n)
    return [n_words, chars, symbols, dup, repeat]


def features(texts: list[bytes], words: tuple[np.ndarray, ...], bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, text index, bucket) of words, word pairs and character 4-grams."""
    shift = np.uint64(64 - bits)
    h, doc, _, _ = words
    yield 0, doc, (h >> shift).astype(np.int64)
    if len(h) > 1:
        same = doc[1:] == doc[:-1]
        yield 1, doc[1:][same], (runs(h, 2)[same] >> shift).astype(np.int64)
    for lo, hi in steps([len(t) + 1 for t in texts], 1 << 20):
        c = np.frombuffer(b"\0".join([*(t.replace(b"\0", b" ") for t in texts[lo:hi]), b""]).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        own = np.cumsum(c == 0) - (c == 0) + lo
        for at in range(0, len(c), 1 << 20):
            x = c[at : at + (1 << 20) + 3].astype(np.uint64)
            m = len(x) - 3
            if m > 0:
                own_x = own[at : at + m]
                ok = (own_x == own[at + 3 : at + 3 + m]) & (own_x < hi)
                key = ((x[:m] * np.uint64(0x100000001B3) + x[1 : m + 1]) * np.uint64(0x9E3779B97F4A7C15) + x[2 : m + 2]) * np.uint64(0xD6E8FEB86659FD93) + x[3:]
                yield 2, own_x[ok], (mix(key[ok]) >> shift).astype(np.int64)


def score_texts(model: QualityModel, texts: list[bytes], words: tuple[np.ndarray, ...]) -> np.ndarray:
    """The calibrated probability that each text is good."""
    n = len(texts)
    total, seen = np.zeros((_KINDS, n)), np.zeros((_KINDS, n))
    for kind, own, bucket in features(texts, words, model.bits):
        total[kind] += np.bincount(own, model.weights[kind][bucket], n)
        seen[kind] += np.bincount(own, minlength=n)
    z = model.bias + (total / np.maximum(seen, 1)).sum(0)
    return 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -30, 30)))


def _descend(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, width: int, rounds: int, penalty: float) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over sparse rows."""
    w, b = np.zeros(width), 0.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, vals * w[cols], len(y)) + b, -30, 30)))
        r = (p - y) / len(y)
        g, gb = np.bincount(cols, vals * r[rows], width) + penalty * w, r.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**i, 1 - 0.999**i
        w -= 0.05 * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= 0.05 * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", most_rows: int = 1500, bits: int = 14, threshold: float = 0.5, rounds: int = 150, penalty: float = 1e-6) -> QualityModel:
    """Trains on about ``most_rows`` labelled rows, whole texts, chosen by a hash of the id."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.min("y").alias("y"))
    n = known.count()
    pick = F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit("quality")), F.lit(2**31)) < min(1.0, most_rows / max(n, 1)) * 2**31
    sample = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).where("t is not null").where(pick).join(known.where(pick), "i")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode("utf-8", "replace") for t in b.column("t").to_pylist()]
            got: list[list[np.ndarray]] = [[] for _ in texts]
            for lo, hi in steps([len(t) for t in texts]):
                part = texts[lo:hi]
                for kind, own, bucket in features(part, SPACED.words(part), bits):
                    order = np.argsort(own, kind="stable")
                    at = spans_of(own[order], len(part))
                    for j in range(len(part)):
                        got[lo + j].append(bucket[order[at[j] : at[j + 1]]] + (kind << bits))
            cols, vals = [], []
            for x in got:
                u, c = np.unique(np.concatenate(x) if x else np.zeros(0, np.int64), return_counts=True)
                kinds = np.bincount(u >> bits, c, _KINDS)
                cols.append(u.astype(np.int32).tobytes())
                vals.append((c / np.maximum(kinds[u >> bits], 1)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("i").cast(pa.string()), b.column("y"), pa.array(cols, pa.binary()), pa.array(vals, pa.binary())], ["i", "y", "cols", "vals"])

    rows = sample.select("i", "y", "t").mapInArrow(sparse, "i string, y int, cols binary, vals binary").toPandas().sort_values("i", ignore_index=True)
    y = rows["y"].to_numpy(float)
    width = _KINDS << bits
    if len(set(y)) < 2:
        p = float(np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6))
        return QualityModel(np.zeros((_KINDS, 1 << bits), np.float32), 0.0, 0.0, float(np.log(p / (1 - p))), bits, threshold)
    owner = np.repeat(np.arange(len(y), dtype=np.int32), [len(x) // 4 for x in rows["cols"]])
    cols = np.frombuffer(b"".join(rows["cols"]), np.int32)
    vals = np.frombuffer(b"".join(rows["vals"]), np.float32)
    del rows
    test = np.arange(len(y)) % 4 == 3
    if len(set(y[~test])) < 2 or len(set(y[test])) < 2:
        test[:] = False
    train = ~test[owner]
    usual = np.sqrt(np.bincount(cols[train], vals[train], width) / max(1, (~test).sum()) + 1e-6)
    vals = (vals / usual[cols]).astype(np.float32)
    new = (np.cumsum(~test) - 1).astype(np.int32)
    w, b = _descend(new[owner[train]], cols[train], vals[train], y[~test], width, rounds, penalty)
    z = np.bincount(owner, vals * w[cols], len(y)) + b
    held = test if test.any() else ~test
    slope, shift = _platt(z[held], y[held])
    return QualityModel((w / usual).astype(np.float32).reshape(_KINDS, -1), float(b), slope, shift, bits, threshold)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (z, y), with smoothed targets, by Newton's method."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t = np.where(y > 0, hi, lo)
    x = np.stack([z, np.ones_like(z)], 1)
    c = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        c = c - np.clip(np.linalg.solve(h, x.T @ (p - t) + 1e-3 * (c - [1.0, 0.0])), -1, 1)
    return float(c[0]), float(c[1])


def judge(docs: DataFrame, model: QualityModel, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the five counts, base_failed, probability, kept."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by ``bits``
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["i", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in b.column("t").to_pylist()]
            for lo, hi in steps([len(t) for t in texts]):
                part = texts[lo:hi]
                words = SPACED.words(part)
                counts = base_counts(part, words)
                failed = (counts[0] < LEAST_WORDS) | (100 * counts[4] > MOST_REPEATED * counts[0])
                p = score_texts(shared.value, part, words)
                yield pa.RecordBatch.from_arrays([b.column("i").slice(lo, hi - lo), *(pa.array(c, pa.int64()) for c in counts), pa.array(failed), pa.array(p), pa.array(~failed & (p >= shared.value.threshold))], names)

    schema = f"i {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).mapInArrow(run, schema).withColumnRenamed("i", doc_id)

"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier over hashed character n-grams predicts
each bit.  A text gets the language whose codeword has the least weighted loss, and is marked
ambiguous if the runner-up is close.

Null texts, and texts without a letter, get ``und`` with score 0.  Nothing but the text is
an input of a prediction.  Repeated rows and ids are predicted row by row; extra columns of
the input are ignored.  With no labelled row, every text gets ``und``.  Very long texts are read whole, in
blocks.  Languages of equal loss: the first in the order of their names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, mix, small_batches

UNDETERMINED = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


@dataclass(frozen=True)
class LanguageModel:
    """``weights``: a column of n-gram weights for each bit; ``code``: a row of +1 and -1 for each language."""

    langs: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    bits_of_bucket: int
    scale: float
    least_gap: float


def code_book(n: int, seed: int = 11) -> np.ndarray:
    """Codewords of n languages: all distinct splits for up to 6, else random splits far apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        splits = np.arange(1, 2 ** (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    width, rng = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed)
    best, best_gap = None, -1.0
    for _ in range(64):
        code = np.where(rng.random((n, width)) < 0.5, 1.0, -1.0)
        code = code[:, np.abs(code.sum(0)) < n]
        gap = min(np.abs(code[i] - code[:i]).sum(1).min() for i in range(1, n))
        if gap > best_gap:
            best, best_gap = code, gap
    return best


def _grams(texts: list[str], bits: int, step: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, bucket) of the 1- to 3-grams of letters and single blanks, in blocks."""
    shift, letter = np.uint64(64 - bits), _letters()
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= step):
            total += len(texts[end])
            end += 1
        c = np.frombuffer("\0".join(["", *(f" {t.lower()} ".replace("\0", " ") for t in texts[at:end]), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(letter[c], c, np.where(c == 0, 0, 32)).astype(np.uint32)
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
        c = c[keep]
        owner = np.cumsum(c == 0) - 1 + at
        for lo in range(0, len(c), step):
            x = c[lo : lo + step + 2].astype(np.uint64)
            n = min(step, len(c) - lo)
            own = owner[lo : lo + n]
            full = x[:n] > 0
            yield own[full & (x[:n] != 32)], mix(x[:n][full & (x[:n] != 32)] + np.uint64(1 << 60)) >> shift
            for size in (2, 3):
                m = min(n, len(x) - size + 1)
                if m <= 0:
                    continue
                ok = np.ones(m, bool)
                h = np.full(m, size << 60, np.uint64)
                for i in range(size):
                    ok &= x[i : i + m] > 0
                    h += x[i : i + m] << np.uint64(21 * i) if i < 3 else 0
                yield own[:m][ok], mix(h[ok] * np.uint64(0x9E3779B97F4A7C15)) >> shift
        at = end


def learnable(doc_id: str = "doc_id") -> F.Column:
    """Rows that may be learnt from: the checksum of the id as text (null: empty) leaves no 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 != 2


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 2000, bits: int = 15, scale: float = 6.0, least_gap: float = 0.02) -> LanguageModel:
    """Learns from the rows of ``docs``; give it only those that may be learnt from.

    per_language: about so many labelled rows of each language are read, chosen by a hash of
    the id, so that the fit costs the same at any input size.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.select(F.col(doc_id).alias("i"), F.col(lang).alias("g"), F.col(text).alias("t")).where("g is not null and t is not null")
    sizes = {r["g"]: r["n"] for r in known.groupBy("g").agg(F.count("*").alias("n")).collect()}
    langs = tuple(sorted(sizes))
    code = code_book(len(langs))
    if not langs:
        return LanguageModel((), code, np.zeros((1 << bits, 1), np.float32), np.ones(1), bits, scale, least_gap)
    share = F.create_map(*[x for g in langs for x in (F.lit(g), F.lit(min(1.0, per_language / sizes[g]) * 2**31))])
    sample = known.where(F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(2**31)) < share[F.col("g")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            g = b.column("g").to_pylist()
            t = b.column("t").to_pylist()
            for name in set(g):
                own = total.setdefault(name, np.zeros(1 << bits, np.int64))
                for _, bucket in _grams([x for x, y in zip(t, g, strict=True) if y == name], bits):
                    own += np.bincount(bucket.astype(np.int64), minlength=1 << bits)
        for name, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["g", "bucket", "n"])

    counts = sample.select("g", "t").mapInArrow(count, "g string, bucket int, n long").groupBy("g", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(langs), 1 << bits))
    table[counts["g"].map({g: i for i, g in enumerate(langs)}).to_numpy(int), counts["bucket"].to_numpy(int)] = counts["n"].to_numpy(float)
    p = (table + 0.05) / (table.sum(1, keepdims=True) + 0.05 * table.shape[1])
    weights, trust = [], []
    for bit in code.T:
        yes = p[bit > 0].mean(0) if (bit > 0).any() else p.mean(0)
        no = p[bit < 0].mean(0) if (bit < 0).any() else p.mean(0)
        w = np.log(yes / no)
        weights.append(w)
        trust.append(abs((yes * w).sum()) + abs((no * w).sum()))
    trust = np.asarray(trust)
    w = np.asarray(weights).T / np.where(trust > 0, trust / 2, 1)
    return LanguageModel(langs, code, w.astype(np.float32), trust / trust.sum() if trust.sum() else np.ones(len(trust)), bits, scale, least_gap)


def decode(model: LanguageModel, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, score, gap to the runner-up) of rows of bit margins, by weighted hinge loss."""
    loss = np.maximum(0, 1 - margin[:, None, :] * model.code[None]) @ model.trust
    z = np.exp(-model.scale * (loss - loss.min(1, keepdims=True)))
    z /= z.sum(1, keepdims=True)
    order = np.sort(z, 1)
    return loss.argmin(1), order[:, -1], order[:, -1] - (order[:, -2] if z.shape[1] > 1 else 0)


def predict_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score from 0 to 1, ambiguous) of each text."""
    n, k = len(texts), model.weights.shape[1]
    total, seen = np.zeros((n, k)), np.zeros(n)
    columns = np.ascontiguousarray(model.weights.T)
    for own, bucket in _grams([t or "" for t in texts], model.bits_of_bucket):
        if len(own):
            lo, hi = int(own[0]), int(own[-1]) + 1
            own, bucket = own - lo, bucket.astype(np.int64)
            seen[lo:hi] += np.bincount(own, minlength=hi - lo)
            for b in range(k):
                total[lo:hi, b] += np.bincount(own, columns[b][bucket], hi - lo)
    some = seen > 0
    lang, score, unsure = [UNDETERMINED] * n, np.zeros(n), np.ones(n, bool)
    if model.langs and some.any():
        best, p, gap = decode(model, total[some] / seen[some, None])
        for i, j in zip(np.flatnonzero(some), best, strict=True):
            lang[i] = model.langs[j]
        score[some], unsure[some] = p, gap < model.least_gap
    return lang, score, unsure


def predict(docs: DataFrame, model: LanguageModel, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred, score and ambiguous, each name after ``prefix``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x n-gram buckets: its size is set by parameters

    def run(texts: list[str | None]) -> list[pa.Array]:
        lang, score, unsure = predict_texts(shared.value, texts)
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())]

    return mapped(docs, text, list(keep), "string, double, boolean", [prefix + n for n in ("lang_pred", "score", "ambiguous")], run)

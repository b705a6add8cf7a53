"""Shared pieces: the shared folder, written tables, and vectorised word splitting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one vectorised step looks at (a single longer text is its own step).
STEP_BYTES = 4 << 20
#: Bytes that are hashed at once; longer texts are cut at delimiters.
_PIECE = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder of its own.
    """
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _LOCAL.get(spark.sparkContext.applicationId)
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        _LOCAL[spark.sparkContext.applicationId] = place
    return place.rstrip("/")


_LOCAL: dict[str, str] = {}


#: Rows that a file of a written table holds, where a bound on the table's rows is known, and files that any table may have.
FILE_ROWS, FEW_FILES = 20_000, 8


def written(df: DataFrame, name: str, most_rows: int | None = None, per_file: int = FILE_ROWS) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again (cuts lineage, survives executors); it goes when the session ends.

    most_rows: a bound on its rows, where one is known.  The table then has no more files (and its last
    stage no more tasks) than ``per_file`` rows each need, so small tables of many partitions are a few files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if most_rows is not None:
        df = df.coalesce(max(FEW_FILES, -(-most_rows // per_file)))
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch.  Every operator sets the same, so it does not matter which one was called last.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20
#: For Python workers: Arrow's own pool and the arenas of malloc would hold on to a stage's peak for as long as the worker lives.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, as texts can be long; lets Python workers give memory back, and find this package where the driver did."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    spark.sparkContext.environment.update(WORKER_ENV)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (paths, root)))


def utf8(texts: pa.Array) -> list[memoryview]:
    """The bytes of texts, as views of the Arrow buffer; nulls are empty."""
    if not len(texts):
        return []
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].tolist()
    data = memoryview(texts.buffers()[2] or b"").cast("B")
    return [data[lo:hi] for lo, hi in zip(at, at[1:])]


def mapped(docs: DataFrame, text: str, keep: list[str], made: str, names: list[str], run: callable, *, arrow: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` and what ``run`` makes of each text.

    ``run`` takes a list of texts (None for nulls; with ``arrow``, an Arrow array) and returns one Arrow array for each of
    ``names``, whose types are ``made``.  Columns go through by position, whatever they are called.
    """
    small_batches(docs.sparkSession)
    source = docs.select(*[docs[f"`{c}`"] for c in keep], *([] if text in keep else [docs[f"`{text}`"]]))
    inner = [f"k{i}" for i in range(len(source.columns))]
    at = keep.index(text) if text in keep else len(keep)
    kinds = [f.dataType.simpleString() for f in source.schema.fields][: len(keep)]
    results = [f"r{i}" for i in range(len(names))]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at)
            for lo, hi in steps(pc.binary_length(texts).fill_null(0).to_pylist()):
                part = texts.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[: len(keep)]), *run(part if arrow else part.to_pylist())], [*inner[: len(keep)], *results])

    schema = ", ".join(f"{n} {k}" for n, k in zip([*inner[: len(keep)], *results], [*kinds, *made.split(", ")], strict=True))
    return source.toDF(*inner).mapInArrow(apply, schema).toDF(*keep, *names)


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches joined up to about ``limit`` bytes of a column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        n = b.column(column).nbytes
        if held and size + n > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if b.num_rows:
            held.append(b)
            size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def steps(sizes: list[int], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items whose sizes add up to at most ``limit`` (or one larger item)."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


# ---------------------------------------------------------------- words of many texts at once

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POW[i] = np.cumprod(p, dtype=np.uint64)
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class WordClass:
    """Which bytes of UTF-8 text form words; ``fold`` maps bytes before hashing (for example to lower case)."""

    def __init__(self, delimiters: bytes, fold: bytes | None = None):
        self.inside = np.ones(256, bool)
        self.inside[list(delimiters)] = False
        self.fold = fold
        self.value = _BYTE if fold is None else _BYTE[np.frombuffer(fold, np.uint8)]

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text index, start byte, end byte) of all words, in text order."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in steps([len(t) + 1 for t in texts], _PIECE):
            if hi - lo == 1 and len(texts[lo]) > _PIECE:
                for at, end in self._cuts(texts[lo]):
                    h, s, e = self._piece(texts[lo][at:end])
                    out.append((h, np.full(len(h), lo, np.int64), s + at, e + at))
                continue
            h, s, e = self._piece(b"\n".join(texts[lo:hi]))
            begin = np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]])
            doc = np.searchsorted(begin, s, "right") - 1
            out.append((h, doc + lo, s - begin[doc], e - begin[doc]))
        if not out:
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _cuts(self, text: bytes) -> Iterator[tuple[int, int]]:
        gaps = np.flatnonzero(~self.inside[np.frombuffer(text, np.uint8)])
        at = 0
        while at < len(text):
            k = np.searchsorted(gaps, at + _PIECE)
            end = int(gaps[k - 1]) + 1 if k and gaps[k - 1] >= at else int(gaps[k]) + 1 if k < len(gaps) else len(text)
            if len(text) - at <= _PIECE:
                end = len(text)
            yield at, end
            at = end

    def _piece(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(data, np.uint8)
        edge = np.flatnonzero(np.diff(self.inside[raw], prepend=False, append=False))
        s, e = edge[::2], edge[1::2]
        if not len(s):
            return np.zeros(0, np.uint64), s, e
        p, inv = _powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.value[raw] * p[: len(raw)], dtype=np.uint64, out=total[1:])
        return mix((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64)), s, e


#: Words between ASCII white space.
SPACED = WordClass(b"\x20\x09\x0a\x0b\x0c\x0d")


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k neighbouring items of ``h`` (len(h) - k + 1 of them)."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9DDFEA08EB382D69) + h[i : i + n]
    return mix(out)


def spans_of(owner: np.ndarray, n: int) -> np.ndarray:
    """Where each owner's items begin in a list sorted by owner: n + 1 offsets."""
    return np.searchsorted(owner, np.arange(n + 1))

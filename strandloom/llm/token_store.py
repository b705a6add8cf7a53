"""Token ids in Arrow files of equal-length sequences.

A file is an Arrow IPC file (random access by its footer) of record batches with two
fixed-size-list columns: ``ids`` (16 bits wide if the vocabulary fits, else 32) and ``mask``
(true where an id stands, false in the padding after a file's last id).  All batches but the
last have the same number of sequences, so a sequence is found by arithmetic and read without
a copy from a mapped file.  Files hold documents in ascending order of doc_id.  Each batch carries,
as metadata, the ids of the documents that begin in it and where; so the files alone say what they hold, and
an index table only names them (with each document's place, for random access).

Files are written under names of their own; only those that the index names count, so a
task that is lost and run again leaves at most a file that nobody reads.

Null and empty texts are the end id alone.  Rows of equal doc_id are all stored, next to each
other; null ids come first.  Very long texts run on over as many batches as they take.  Extra columns are ignored.  An empty table gives an empty index.
doc_id is an integer column.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import TAIL, Memo, collect_less, default_path, distinct
from .common import gathered, shared_dir, small_batches, steps, written

LENGTH, PER_BATCH = 2048, 64
#: Text bytes in which each distinct word is looked up once.
_GATHERED = 12 << 20


@lru_cache(2)
def _memo(path: str, kind: str) -> Memo:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    collect_less()
    vocab = t.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
    width = np.dtype(kind).itemsize

    #: A token that no word without "<" contains and that is cut out before anything else.
    mark = next(((i, x.content) for i, x in t.get_added_tokens_decoder().items() if x.special and not x.normalized and "<" in x.content), None)
    simple_end = re.compile(f"[{re.escape(TAIL)}]*")

    def cut(part: list[str], joint: str, ends: callable) -> bool:
        """Encodes a list of words as one text; False if its ids do not fall into as many pieces."""
        ids = np.array(t.encode_batch_fast([joint.join(part)], add_special_tokens=False)[0].ids, kind)
        begin, stop = ends(ids)
        if len(stop) != len(part):
            return False
        raw = ids.tobytes()
        out.update(zip(part, [raw[x:y] for x, y in zip((begin * width).tolist(), (stop * width).tolist())]))
        return True

    def after_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stop = np.flatnonzero(ends[ids]) + 1
        return np.concatenate([[0], stop[:-1]]), stop

    def between_marks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(ids == mark[0])
        return np.concatenate([[0], at + 1]), np.concatenate([at, [len(ids)]])

    out: dict[str, bytes] = {}

    def encode(texts: list[str]) -> list[bytes]:
        """Ids of words; simple ones, of which each ends with its only word-end token, go to the library in one text, others between marks."""
        out.clear()
        simple = [w for w in texts if w.isalpha() or (w and simple_end.fullmatch(w))]
        for lo in range(0, len(simple), 4096):
            cut(simple[lo : lo + 4096], " ", after_words)
        if mark:
            others = [w for w in texts if w not in out and "<" not in w]
            for lo in range(0, len(others), 4096):
                cut(others[lo : lo + 4096], mark[1], between_marks)
        rest = [w for w in texts if w not in out]
        for lo in range(0, len(rest), 1024):  # the library's results are large: a few at a time
            part = rest[lo : lo + 1024]
            out.update((w, np.array(e.ids, kind).tobytes()) for w, e in zip(part, t.encode_batch_fast(part, add_special_tokens=False), strict=True))
        return [out[w] for w in texts]

    return Memo(encode, 300_000)


def encoded(memo: Memo, texts: pa.Array, kind: str, end_id: int) -> list[bytes]:
    """The ids of each text and the end id; only distinct chunks are looked up."""
    end = np.array([end_id], kind).tobytes()
    words, code, offsets = distinct(texts)
    values = memo.values_of(words)
    size = np.fromiter(map(len, values), np.int32, len(values)) // np.int32(np.dtype(kind).itemsize)
    begin = np.cumsum(size, dtype=np.int32) - size
    data = np.frombuffer(b"".join(values), kind)
    n = size[code]
    after = np.cumsum(n, dtype=np.int64)
    if len(n) and after[-1] >= 1 << 31:
        raise ValueError("a text with over 2**31 ids")
    place = np.repeat(begin[code] - (after - n).astype(np.int32), n)
    place += np.arange(len(place), dtype=np.int32)
    ids = data[place]
    ends = np.concatenate([[0], after])[offsets]
    return [ids[a:b].tobytes() + end for a, b in zip(ends[:-1], ends[1:], strict=True)]


def vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


class SequenceWriter:
    """Writes one file of equal-length sequences."""

    def __init__(self, uri: str, kind: str, length: int = LENGTH, per_batch: int = PER_BATCH, part: int = 0):
        self.kind, self.length, self.block = kind, length, length * per_batch
        fs, place = pa.fs.FileSystem.from_uri(uri)
        fs.create_dir(os.path.dirname(place), recursive=True)
        value = pa.from_numpy_dtype(np.dtype(kind))
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))], metadata={"part": str(part)})
        self.sink = fs.open_output_stream(place)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.waiting, self.size, self.total, self.written = [], 0, 0, 0
        self.begun: list[tuple[int | None, int]] = []

    def add(self, ids: bytes, doc: int | None = None) -> int:
        """Appends a document; its first position in the file."""
        at = self.total
        self.begun.append((doc, at))
        n = len(ids) // np.dtype(self.kind).itemsize
        self.waiting.append(ids)
        self.size += n
        self.total += n
        if self.size >= self.block:
            flat = np.frombuffer(b"".join(self.waiting), self.kind)
            full = len(flat) // self.block * self.block
            for lo in range(0, full, self.block):
                self._batch(flat[lo : lo + self.block], self.block)
            self.waiting, self.size = [flat[full:].tobytes()], len(flat) - full
        return at

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.zeros(len(flat), bool)
        mask[:real] = True
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.written += real
        here = [x for x in self.begun if x[1] < self.written]
        self.begun = self.begun[len(here) :]
        bounds = pa.table({"doc": pa.array([d for d, _ in here], pa.int64()), "at": pa.array([a for _, a in here], pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, bounds.schema) as out:
            out.write_table(bounds)
        self.out.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema), custom_metadata={"documents": sink.getvalue().to_pybytes()})

    def close(self) -> None:
        if self.size:
            flat = np.frombuffer(b"".join(self.waiting), self.kind)
            self._batch(np.concatenate([flat, np.zeros(-len(flat) % self.length, self.kind)]), len(flat))
        self.out.close()
        self.sink.close()


class SequenceFile:
    """Random access to a file of sequences; a local file is mapped and never copied."""

    def __init__(self, uri: str):
        fs, place = pa.fs.FileSystem.from_uri(uri)
        source = pa.memory_map(place) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(place)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.per_batch = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0
        self._at = -1

    def _batch(self, k: int) -> pa.RecordBatch:
        if k != self._at:
            self._now, self._at = self.reader.get_batch(k), k
        return self._now

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence i."""
        b = self._batch(i // self.per_batch)
        row = i % self.per_batch
        lo = row * self.length
        return b.column("ids").values.to_numpy()[lo : lo + self.length], b.column("mask").values.slice(lo, self.length)

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, first position, ids, crc32 of the ids as little-endian 32-bit numbers) of all documents, from one pass over the file."""
        now, at = None, 0
        for k in range(self.reader.num_record_batches):
            batch, meta = self.reader.get_batch_with_custom_metadata(k)
            bounds = pa.ipc.open_stream(meta[b"documents"]).read_all()
            real = int(pc.sum(batch.column("mask").values.slice(0, len(batch) * self.length)).as_py() or 0)
            ids = batch.column("ids").values.to_numpy()[:real]
            cuts = [a - at for a in bounds.column("at").to_pylist()]
            ends = [*cuts, real]
            if now is not None:
                now[2:] = now[2] + ends[0], zlib.crc32(ids[: ends[0]].astype("<u4").tobytes(), now[3])
            for doc, lo, hi in zip(bounds.column("doc").to_pylist(), cuts, ends[1:], strict=True):
                if now is not None:
                    yield tuple(now)
                now = [doc, at + lo, hi - lo, zlib.crc32(ids[lo:hi].astype("<u4").tobytes())]
            at += real
        if now is not None:
            yield tuple(now)

    @property
    def part(self) -> int:
        """Which of the files of a store this is, by ascending ids."""
        return int(self.reader.schema.metadata[b"part"])

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids at positions start to start + n, a view for each batch touched."""
        size = self.per_batch * self.length
        while n > 0:
            k, lo = divmod(start, size)
            take = min(n, size - lo)
            yield self._batch(k).column("ids").values.to_numpy()[lo : lo + take]
            start, n = start + take, n - take


def write_sequences(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", path: str | None = None, end_id: int = 2, length: int = LENGTH, files: int | None = None, folder: str | None = None) -> DataFrame:
    """Stores all documents; the index (doc_id, file, at, start, n_tokens): place in the file, and ids of all documents before it."""
    spark = docs.sparkSession
    small_batches(spark)
    vocab_file = path or default_path()
    kind = "<u2" if max(vocabulary(vocab_file), end_id + 1) <= 1 << 16 else "<u4"
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    id_kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ranges of ids from their quantiles, so that texts are read once and only their ids are moved.
    cuts = rows.agg(F.percentile_approx("i", [k / files for k in range(1, files)], 20 * files)).first()[0] if files > 1 else None
    cuts = sorted(set(cuts or []))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(vocab_file, kind)
        edges = np.array(cuts, np.int64)
        for b in gathered(batches, "t", _GATHERED):
            texts = b.column("t").fill_null("")
            for lo, hi in steps(pc.binary_length(texts).to_pylist(), _GATHERED):
                ids = pa.array(encoded(memo, texts.slice(lo, hi - lo), kind, end_id), pa.binary())
                i = b.column("i").slice(lo, hi - lo)
                part = np.searchsorted(edges, i.fill_null(np.iinfo(i.type.to_pandas_dtype()).min).to_numpy(zero_copy_only=False), "left")
                yield pa.RecordBatch.from_arrays([i, pa.array(part, pa.int32()), ids], ["i", "part", "ids"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, uri = None, None, ""
        for b in batches:
            places, names, sizes = [], [], []
            for doc, part, ids in zip(b.column("i").to_pylist(), b.column("part").to_pylist(), b.column("ids"), strict=True):
                if part != now:
                    if out:
                        out.close()
                    now, uri = part, f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
                    out = SequenceWriter(uri, kind, length, part=part)
                raw = ids.as_buffer().to_pybytes()
                places.append(out.add(raw, doc))
                names.append(uri)
                sizes.append(len(raw) // np.dtype(kind).itemsize)
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("part"), pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], ["i", "part", "file", "at", "n_tokens"])
        if out:
            out.close()

    coded = rows.mapInArrow(encode, f"i {id_kind}, part int, ids binary")
    ranged = coded.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", F.col("i").asc_nulls_first(), "ids")
    index = written(ranged.mapInArrow(store, f"i {id_kind}, part int, file string, at long, n_tokens long"), "index")
    return index.join(F.broadcast(_ahead(index)), "part").select(F.col("i").alias(doc_id), "file", "at", (F.col("base") + F.col("at")).alias("start"), "n_tokens")


def _ahead(rows: DataFrame) -> DataFrame:
    """(part, base): the ids in all files before each one.  A row for each file: as many as there are shuffle partitions, not as many as documents."""
    base, total = [], 0
    for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        base.append((r["part"], total))
        total += r["n"]
    return rows.sparkSession.createDataFrame(base, "part int, base long")


def read_checksums(index: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit numbers) of all documents, all read from the files that an index names."""
    spark = index.sparkSession
    small_batches(spark)
    id_kind = index.schema[doc_id].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["i", "part", "at", "n_tokens", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for b in batches:
            for uri in b.column("file").to_pylist():
                file, rows = SequenceFile(uri), []
                for doc, at, n, crc in file.documents():
                    rows.append((doc, file.part, at, n, crc))
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    spread = index.select("file").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    found = written(spread.mapInArrow(check, "i long, part int, at long, n_tokens long, ids_crc32 long"), "documents-read")
    ahead = F.broadcast(_ahead(found))
    return found.join(ahead, "part").select(F.col("i").cast(id_kind).alias(doc_id), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")

"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The writer puts one record per row into archives of gzip members (or plain text) in the shared
folder.  Of rows with equal payloads, that with the least id is a response and the others
revisit it.  The reader checks every record (gzip checksum, version line, headers, length,
digests of block and payload); after a failed check it searches for the next gzip member or version line
that begins a valid record, goes on there, and logs the bytes in between as a gap.

Null and empty payloads are payloads of no bytes; very long ones are one record each.  Ids are whole numbers or strings.  Every row is
written as one record, whatever ids and payloads repeat: a row revisits by its payload, not by its id, and all rows
of the least id of a payload are responses.  A row without an id is a response whose record id names no page, and comes back
without one; no row revisits it.  A null url is written as an empty one.  Extra columns
are ignored; an empty table writes no archive.

Two bounds keep a reader's memory finite, and what is beyond them is a gap: ``most_inflated`` bytes of a gzip member
and ``most_header`` bytes of a plain record's headers.  Archives with larger ones are read whole by raising them.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, written

VERSION = b"WARC/1.1"
#: Archives are closed beyond this many bytes.
ROLL = 64 << 20
_CHUNK = 1 << 15
#: A gzip member, and the headers of a plain record, of more bytes count as damaged, unless a reader is told otherwise.
MOST_INFLATED, MOST_HEADER = 1 << 31, 4 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1(data: bytes) -> str:
    """Digest as archives write it: upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: object, url: str | None, payload: bytes, refers_to: object | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """The bytes of one record: a response, or a revisit of ``refers_to`` without a block."""
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    page_id, refers_to = (quote(x, safe="") if isinstance(x, str) else x for x in (page_id, refers_to))
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    digest, block = sha1(payload), payload if refers_to is None else b""
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": name, "WARC-Date": date, "WARC-Target-URI": clean, "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{digest if refers_to is None else sha1(b'')}", "X-Payload-Length": len(payload)}
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": _PROFILE}
    head |= {"Content-Type": "text/html; charset=utf-8", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "replace")
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


class Damaged(ValueError):
    """What a check found."""


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``at``; Damaged if a check fails."""
    if not re.match(rb"WARC/1\.[01]\r?\n", data[at : at + 10]):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("headers not ended")
    head = {}
    for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header without a colon")
        # Only this one may come twice; else two records' headers have run together.
        if (name := name.strip()) in head and name.lower() != "warc-concurrent-to":
            raise Damaged("header twice")
        head[name] = value.strip()
    if missing := {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} - head.keys():
        raise Damaged(f"no {min(missing)}")
    size = head["Content-Length"]
    if not (size.isascii() and size.isdigit()):
        raise Damaged("no length")
    body, end = stop + 4, stop + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("length does not fit")
    block = data[body:end]
    digests = {head.get("WARC-Block-Digest", "")}
    if head["WARC-Type"] == "response" and not head.get("Content-Type", "").startswith("application/http"):
        digests.add(head.get("WARC-Payload-Digest", ""))  # the block is the payload
    if digests := {d[5:] for d in digests if d.startswith("sha1:")}:
        if digests != {sha1(block)}:
            raise Damaged("digest does not fit")
    return head, block, end + 4


class _Bytes:
    """Random reads of a file, in pieces."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(min(n, self.size - at), at) if at < self.size else b""

    def find(self, mark: bytes, at: int) -> int:
        """Where ``mark`` is next, from ``at`` on; the file's size if nowhere."""
        while at < self.size:
            piece = self.read(at, (1 << 20) + len(mark) - 1)
            if (k := piece.find(mark)) >= 0:
                return at + k
            at += 1 << 20
        return self.size


def _member(src: _Bytes, at: int, most: int) -> tuple[bytes, int]:
    """The data of the gzip member at ``at`` and its end."""
    z, out, pos, size = zlib.decompressobj(31), [], at, 0
    while not z.eof:
        piece = src.read(pos, _CHUNK)
        if not piece:
            raise Damaged("member cut off")
        try:
            out.append(z.decompress(piece, most - size + 1))
        except zlib.error as e:
            raise Damaged("gzip: " + str(e)) from None
        pos += len(piece)
        size += len(out[-1])
        if size > most:
            raise Damaged("member too large")
    return b"".join(out), pos - len(z.unused_data)


def _plain(src: _Bytes, at: int, most: int) -> tuple[dict[str, str], bytes, int]:
    """The plain record at ``at``: its headers say how much to read."""
    n = 1 << 14
    while True:
        data = src.read(at, n)
        stop = data.find(b"\r\n\r\n")
        if stop >= 0 or len(data) < n or n >= most:
            break
        n = min(4 * n, most)
    m = re.search(rb"(?i)\r\ncontent-length: *([0-9]{1,18})\r\n", data[: stop + 2]) if stop >= 0 else None
    if m and stop + 8 + int(m[1]) > len(data):
        data = src.read(at, stop + 8 + int(m[1]))
    head, block, end = parse(data)
    return head, block, at + end


def salvage(file, most_inflated: int = MOST_INFLATED, most_header: int = MOST_HEADER) -> Iterator[tuple[str, int, int, dict[str, str] | None, bytes, str]]:
    """('record' or 'gap', offset, bytes, headers, block, reason) over a file, gzip members and plain records alike."""
    src, at, gap, why = _Bytes(file), 0, -1, ""
    while at < src.size:
        try:
            found = []
            if src.read(at, 2) == b"\x1f\x8b":
                data, end = _member(src, at, most_inflated)
                k = 0
                while k < len(data):
                    head, block, k = parse(data, k)
                    found.append((head, block))
                if not found:
                    raise Damaged("empty member")
            else:
                head, block, end = _plain(src, at, most_header)
                found.append((head, block))
        except Damaged as e:
            if gap < 0:
                gap, why = at, str(e)
            at = min(src.find(b"\x1f\x8b\x08", at + 1), src.find(b"WARC/1.", at + 1))
            continue
        if gap >= 0:
            yield "gap", gap, at - gap, None, b"", why
            gap = -1
        for head, block in found:
            yield "record", at, end - at, head, block, ""
        at = end
    if gap >= 0:
        yield "gap", gap, src.size - gap, None, b"", why


def write_archives(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, gzipped: bool = True, roll: int = ROLL, folder: str | None = None) -> DataFrame:
    """Writes all rows; the table (file, records, bytes) of the archives that count.

    Tasks write under names of their own, so an archive of a task that was lost is never listed.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(F.col(page_id).alias("i"), F.col(url).alias("u"), F.coalesce(payload, F.lit("")).alias("p")).withColumn("h", F.unhex(F.sha2("p", 256)))
    # Only ids and hashes are grouped; payloads move once, by both.
    hashed = rows.where(F.octet_length("p") >= min_bytes).select("i", "h")
    firsts = hashed.groupBy("h").agg(F.min("i").alias("first"), F.max("i").alias("last")).where("last > first").select("h", "first")
    again = written(hashed.join(firsts, "h").where("i > first").select("i", "h", "first").distinct(), "revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, uri, n, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for b in batches:
            for i, u, p, first in zip(*(b.column(c).to_pylist() for c in ("i", "u", "p", "first")), strict=True):
                if sink is None:
                    uri, n, size = f"{folder}/{uuid.uuid4().hex}.warc{'.gz' * gzipped}", 0, 0
                    fs, place = pa.fs.FileSystem.from_uri(uri)
                    fs.create_dir(os.path.dirname(place), recursive=True)
                    sink = fs.open_output_stream(place, compression=None)
                data = record(i, u, p.encode("utf-8", "replace"), first)
                if gzipped:
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                sink.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll:
                    sink.close()
                    sink = None
                    done.append((uri, n, size))
        if sink:
            sink.close()
            done.append((uri, n, size))
        if done:
            f, r, s = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(r, pa.int64()), pa.array(s, pa.int64())], ["file", "records", "bytes"])

    full = rows.join(again, ["i", "h"], "left").select("i", "u", "p", "first") if not again.isEmpty() else rows.select("i", "u", "p", F.lit(None).cast(kind).alias("first"))
    return written(full.mapInArrow(run, "file string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, *, payloads: bool = True, most_inflated: int = MOST_INFLATED, most_header: int = MOST_HEADER) -> DataFrame:
    """Records and gaps of archives (column file): file, kind, offset, bytes, headers, block_bytes, block_sha1, payload, reason.

    Lengths and digests are those of the blocks that are read, whatever the headers say; without ``payloads`` the blocks themselves stay behind.
    """
    spark = archives.sparkSession
    small_batches(spark)
    names = ["file", "kind", "offset", "bytes", "headers", "block_bytes", "block_sha1", "payload", "reason"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("file").to_pylist():
                fs, place = pa.fs.FileSystem.from_uri(uri)
                rows, size = [], 0
                with fs.open_input_file(place) as f:
                    for kind, at, n, head, block, why in salvage(f, most_inflated, most_header):
                        rows.append((uri, kind, at, n, list(head.items()) if head is not None else None, len(block) if head is not None else None, sha1(block) if head is not None else None, block if payloads else None, why))
                        size += len(block) if payloads else 0
                        if len(rows) >= 1024 or size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    spread = archives.select("file").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    return spread.mapInArrow(run, "file string, kind string, offset long, bytes long, headers map<string,string>, block_bytes long, block_sha1 string, payload binary, reason string")


def pages_of(records: DataFrame, kind: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records read.

    Bytes and digest of a response are those of its block; a revisit has those of the response that it
    refers to, by id and digest, and nulls where that one is not there.
    """
    h = F.col("headers")

    def urn(c: F.Column) -> F.Column:
        text = F.regexp_extract(c, "^<urn:page:(.*)>$", 1)
        value = F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))) if kind == "string" else text.try_cast(kind)
        return F.when(c.startswith("<urn:page:"), value)

    rows = written(records.where("kind = 'record'").select(
        urn(h["WARC-Record-ID"]).alias("page_id"),
        F.col("block_bytes").alias("payload_bytes"),
        F.col("block_sha1").alias("payload_digest"),
        F.regexp_replace(h["WARC-Payload-Digest"], "^sha1:", "").alias("said"),
        h["WARC-Type"].alias("record_type"),
        F.when(h["WARC-Type"] == "revisit", urn(h["WARC-Refers-To"])).alias("refers_to"),
    ), "records")
    own = rows.where("record_type <> 'revisit'")
    first = own.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("said"), F.col("payload_bytes").alias("n")).distinct()
    again = rows.where("record_type = 'revisit'").join(first, ["refers_to", "said"], "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.select(names).unionByName(again.select("page_id", F.col("n").alias("payload_bytes"), F.when(F.col("n").isNotNull(), F.col("said")).alias("payload_digest"), "record_type", "refers_to"))


_BITS_SQL = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(h, {5 * i + 1}, 5) AS INT) >> {5 * (3 - k)}) % 32 + 1, 1)" for i in range(8) for k in range(4))
#: DuckDB's SQL for what is read back of ``pages``: SHA-1 in base32, five hexadecimal digits for every four letters.
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_BITS_SQL} AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM p
"""

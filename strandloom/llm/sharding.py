"""Sharding by fixed virtual slots and a versioned map from slots to shards.

Every record hashes (by id and the checksum of its text) into one of a few thousand virtual slots, whose number never
changes.  Records, bytes and shards meet in the map only: version 1 deals the slots in turn;
an edit takes the bytes of the slots, as measured, and moves as few of them as it needs from the fullest
shard to the emptiest, until all are near equal.  A new shard is an empty one, so an edit for it moves
slots into it and nowhere else.  Maps are stored as Parquet, a folder for each version, and are
never changed; placing reads the map back and takes any version.

A slot of more than a sixteenth of a shard (of many equal rows, which hash alike) is cut into pieces of
equal bytes in the order of its rows, and the map has an entry for each piece.  So a hot record does not
bind a third of all bytes to a shard.

Size: bytes of the text in UTF-8 and one more.  Null and empty texts are of size 1 and checksum 0; null
and repeated ids are placed row by row, equal rows beside each other; very long texts stay whole, and one larger than
a shard's share makes that shard the larger one.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.ranges import numbered

from .common import shared_dir, written

SLOTS, SHARDS = 4096, 8
#: Shares of a shard: what a piece of a slot holds at most, and how far apart shards may be after an edit.
PIECE, APART = 1 / 16, 0.0005
MAP = "version int, virtual_slot int, piece int, pieces int, shard int"
Key = tuple[int, int]  # slot and piece


def first_map(keys: list[Key], shards: int) -> dict[Key, int]:
    """Slots in turn, whatever they hold."""
    return {k: (k[0] + k[1]) % shards for k in keys}


def edited(now: dict[Key, int], size: dict[Key, int], shards: int, apart: float = APART) -> dict[Key, int]:
    """The map after moves from the fullest to the emptiest shard, until they are ``apart`` (of the mean) or no move brings them closer."""
    load, own = [0] * shards, [[] for _ in range(shards)]
    for k in sorted(now):
        n = size.get(k, 0)
        load[now[k]] += n
        if n:
            insort(own[now[k]], (n, k))
    out, near, stuck = dict(now), apart * sum(load) / shards, set()
    while len(stuck) < shards:
        full = max((s for s in range(shards) if s not in stuck), key=lambda s: (load[s], -s))
        free = min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[free]
        if gap <= near:
            break
        i = bisect_left(own[full], ((gap + 1) // 2, (-1, -1)))
        best = min((own[full][j] for j in (i - 1, i) if 0 <= j < len(own[full]) and own[full][j][0] < gap), key=lambda x: abs(gap - 2 * x[0]), default=None)
        if best is None:
            stuck.add(full)  # what it has is larger than the gap
            continue
        own[full].remove(best)
        insort(own[free], best)
        out[best[1]] = free
        load[full], load[free] = load[full] - best[0], load[free] + best[0]
        stuck.discard(free)
    return out


def write_map(spark: SparkSession, folder: str, version: int, now: dict[Key, int]) -> None:
    """One version of a map (a few thousand rows) in its own folder; a version that is there already is refused."""
    pieces: dict[int, int] = {}
    for slot, piece in now:
        pieces[slot] = max(pieces.get(slot, 0), piece + 1)
    rows = [(version, slot, piece, pieces[slot], shard) for (slot, piece), shard in sorted(now.items())]
    spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(f"{folder}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{folder}/version={version}")


def place(docs: DataFrame, *, shards: int = SHARDS, slots: int = SLOTS, keep: tuple[str, ...] = ("doc_id",), text: str = "text", doc_id: str = "doc_id", prefix: str = "", maps: str | None = None) -> DataFrame:
    """The columns ``keep`` with size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version, each after ``prefix``.

    ``slot`` numbers the rows of a shard from 0 without gaps.  The law is `bytes`: sizes are near equal.  maps: folder for
    the versions of the map, a new one in the shared folder unless given; the driver holds an entry for each slot and piece, at most
    ``slots`` and 16 for each shard.
    """
    spark = docs.sparkSession
    maps = maps or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    full = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = [f"k{i}" for i in range(len(keep))]
    base = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names, strict=True)], F.col(f"`{doc_id}`").cast("string").alias("i"), (F.octet_length(full) + 1).cast("long").alias("z"), F.crc32(full).alias("crc"))
    base = base.withColumn("v", F.pmod(F.xxhash64("i", "crc"), F.lit(slots)).cast("int")).drop("i")
    # The place of a row is written, as rows of equal slots have no other order that a second reading would keep.
    rows = numbered(written(base.withColumn("at", F.monotonically_increasing_id()), "slotted"), "v", "at", weight="z").drop("at")
    rows = written(rows, "placed")

    held = rows.groupBy("v").agg(F.sum("z").alias("t"), F.count("*").alias("c"), F.min("before").alias("b0")).collect()  # at most ``slots`` rows
    most = max(1.0, PIECE * sum(r["t"] for r in held) / shards)
    cuts = [(r["v"], r["b0"], r["t"], max(1, min(int(-(-r["t"] // most)), r["c"]))) for r in held]
    table = F.broadcast(spark.createDataFrame(cuts, "v int, b0 long, t long, pieces int"))  # a row for each slot
    piece = F.when(F.col("pieces") == 1, 0).otherwise(F.least(F.floor((F.col("before") - F.col("b0")) * F.col("pieces") / F.col("t")).cast("int"), F.col("pieces") - 1))
    rows = rows.join(table, "v").withColumn("piece", piece.cast("int")).drop("b0", "t", "pieces", "before")
    found = rows.groupBy("v", "piece").agg(F.sum("z").alias("t"), F.count("*").alias("c"), F.min("rn").alias("first")).collect()

    every = [(v, p) for v, n in ({v: 1 for v in range(slots)} | {v: n for v, _, _, n in cuts}).items() for p in range(n)]
    start = first_map(every, shards)
    write_map(spark, maps, 1, start)
    write_map(spark, maps, 2, edited(start, {(r["v"], r["piece"]): r["t"] for r in found}, shards))
    now = {(r["virtual_slot"], r["piece"]): (r["shard"], r["version"]) for r in read_map(spark, maps, 2).collect()}

    ahead, entries = [0] * shards, []
    for r in sorted(found, key=lambda r: (r["v"], r["piece"])):
        shard, version = now[r["v"], r["piece"]]
        entries.append((r["v"], r["piece"], shard, version, ahead[shard] - r["first"]))
        ahead[shard] += r["c"]
    told = F.broadcast(spark.createDataFrame(entries, "v int, piece int, shard int, version int, shift long"))
    out = rows.join(told, ["v", "piece"]).select(*names, "z", "crc", F.lit("bytes"), "shard", F.col("rn") + F.col("shift"), F.lit(None).cast("int"), "v", "version")
    return out.toDF(*keep, *[prefix + n for n in ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot", "map_version")])


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """All columns of ``docs`` in a folder for each shard, with the columns of ``place`` after two underscores."""
    placed = place(docs, keep=tuple(docs.columns), prefix="__", **how)
    placed.repartition("__shard", F.floor(F.col("__slot") / 100_000)).write.partitionBy("__shard").parquet(path)

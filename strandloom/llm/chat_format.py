"""Preference formatting: the common beginning of two conversations once, then two completions.

Only DataFrame functions.  A pair's prompt is the longest run of turns, from the first on, that
chosen and rejected share (role and text); what follows is the chosen and the rejected
completion.  Each part is rendered in blocks of ``block`` turn numbers, so that no row and no
group grows with the length of a conversation; ``start`` is where a block begins in its part.
``mask`` lists the code points of a block that are trained on: in completions, what the
assistant says with its end mark; in prompts, nothing.

Pairs come from the caller: ``paired`` takes neighbouring conversations, ``swapped`` sets each
conversation against itself with another one's last answer.

Null roles and texts count as empty, a null turn number as -1.  Rows of equal turn number
are one turn, ordered by role and text; repeated rows count once.  Rows without an id are one
pair.  A pair of which one side is missing has no prompt, only the other side's completion.  A
mark of the text's own is broken up by a blank.  Very long texts are rendered whole.  Extra
columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

BLOCK, END, TRAINED = 64, "<|end|>\n", "assistant"


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.replace(role, F.lit("<|"), F.lit("< |")), F.lit("|>\n"))


def _body(text: Column) -> Column:
    return F.concat(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit(END))


def paired(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns (pair_id, rejected, turn, role, text) of neighbouring conversations: even ids are chosen, the odd ones after them rejected."""
    c = F.col(conv_id)
    return conversations.select(F.floor(c / 2).cast("long").alias("pair_id"), F.coalesce(F.pmod(c, F.lit(2)) == 1, F.lit(False)).alias("rejected"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))


def swapped(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = TRAINED) -> DataFrame:
    """Turns (pair_id, rejected, turn, role, text): chosen is a conversation up to its last answer, rejected the same with its neighbour's last answer.

    Neighbours are an even id and the odd one after it.  Without an answer of its own a conversation is only a
    prompt; without one of its neighbour's, nothing is rejected.
    """
    c = conversations.select(F.col(conv_id).alias("pair_id"), F.coalesce(F.col(turn).cast("long"), F.lit(-1)).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    last = c.where(F.col("role") == trained).groupBy("pair_id").agg(F.max("turn").alias("last"))
    known = c.join(last, "pair_id", "left")
    mine = known.where(F.col("last").isNull() | (F.col("turn") <= F.col("last")))
    side = lambda rejected: F.lit(rejected).alias("rejected")
    chosen = mine.select("pair_id", side(False), "turn", "role", "text")
    common = mine.where(F.col("last").isNull() | (F.col("turn") < F.col("last"))).select("pair_id", side(True), "turn", "role", "text")
    given = known.where(F.col("turn") == F.col("last")).select((F.col("pair_id") + 1 - 2 * F.pmod("pair_id", F.lit(2))).alias("pair_id"), "role", "text")
    other = given.join(last, "pair_id").select("pair_id", side(True), F.col("last").alias("turn"), "role", "text")
    return chosen.unionByName(common).unionByName(other)


def preferences(turns: DataFrame, *, block: int = BLOCK, trained: str = TRAINED) -> DataFrame:
    """pair_id, part (prompt, chosen, rejected), block, start, n_turns, text, mask of turns as ``paired`` gives them."""
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    cells = turns.select("pair_id", "rejected", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), said.alias("m"))
    cells = cells.groupBy("pair_id", "turn").agg(*[F.array_sort(F.collect_set(F.when(F.col("rejected") == F.lit(side), F.col("m")))).alias(name) for name, side in (("chosen", False), ("rejected", True))])
    differ = cells.groupBy("pair_id").agg(F.min(F.when(F.col("chosen") != F.col("rejected"), F.col("turn"))).alias("differ"))
    # A null pair_id stays one pair.
    cells = cells.alias("c").join(differ.withColumnRenamed("pair_id", "p"), F.col("c.pair_id").eqNullSafe(F.col("p"))).drop("p")
    common = F.col("differ").isNull() | (F.col("turn") < F.col("differ"))
    part = lambda name, msgs: F.struct(F.lit(name).alias("part"), F.col(msgs).alias("msgs"))
    rows = cells.select("pair_id", "turn", F.explode(F.when(common, F.array(part("prompt", "chosen"))).otherwise(F.array(part("chosen", "chosen"), part("rejected", "rejected")))).alias("x"))
    rows = rows.where(F.size("x.msgs") > 0).groupBy("pair_id", F.col("x.part").alias("part"), F.floor(F.col("turn") / block).cast("long").alias("block"))
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("turn", F.col("x.msgs").alias("msgs")))).alias("turns"))
    msgs = F.flatten(F.transform("turns", lambda t: t["msgs"]))
    text = F.array_join(F.transform(msgs, lambda m: F.concat(_head(m["role"]), _body(m["text"]))), "")

    def span(acc: Column, m: Column) -> Column:
        begin = acc["at"] + F.length(_head(m["role"]))
        end = begin + F.length(_body(m["text"]))
        mine = F.concat(acc["out"], F.array(F.concat_ws(":", begin.cast("string"), end.cast("string"))))
        return F.struct(end.cast("int").alias("at"), F.when((m["role"] == trained) & (F.col("part") != "prompt"), mine).otherwise(acc["out"]).alias("out"))

    mask = F.aggregate(msgs, F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<string>").alias("out")), span, lambda a: F.array_join(a["out"], ","))
    rows = rows.select("pair_id", "part", "block", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), mask.alias("mask"))
    rows = written(rows, "blocks")
    # Lengths of a part's blocks meet here, not its texts.
    before = W.partitionBy("pair_id", "part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.select("pair_id", "part", "block", F.length("text").cast("long").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = starts.select(F.col("pair_id").alias("p"), F.col("part").alias("q"), F.col("block").alias("b"), "start")
    out = rows.join(starts, F.col("pair_id").eqNullSafe(F.col("p")) & (F.col("part") == F.col("q")) & (F.col("block") == F.col("b")))
    return out.select("pair_id", "part", "block", "n_turns", "text", "mask", "start")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("pair_id", "part", "block", "start", "n_turns", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "mask")


#: DuckDB's SQL for ``digest(preferences(swapped(conversations)))``.
ORACLE_SQL = """
WITH base AS (SELECT conv_id AS pair_id, coalesce(turn, -1) AS turn, role, text FROM conversations),
last AS (SELECT pair_id, max(turn) AS last FROM base WHERE role = 'assistant' AND pair_id IS NOT NULL GROUP BY pair_id),
known AS (SELECT base.*, last FROM base LEFT JOIN last USING (pair_id)),
sides AS (
  SELECT pair_id, false AS rej, turn, role, text FROM known WHERE last IS NULL OR turn <= last
  UNION ALL SELECT pair_id, true, turn, role, text FROM known WHERE last IS NULL OR turn < last
  UNION ALL SELECT l.pair_id, true, l.last, k.role, k.text FROM known k JOIN last l ON l.pair_id = k.pair_id + 1 - 2 * (((k.pair_id % 2) + 2) % 2) WHERE k.turn = k.last),
m AS (SELECT pair_id, rej, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM sides),
cells AS (
  SELECT pair_id, turn,
         coalesce(list_sort(list(DISTINCT struct_pack(role := role, text := text)) FILTER (NOT rej)), []) AS c,
         coalesce(list_sort(list(DISTINCT struct_pack(role := role, text := text)) FILTER (rej)), []) AS r
  FROM m GROUP BY ALL),
d AS (SELECT pair_id, min(turn) FILTER (c <> r) AS differ FROM cells GROUP BY pair_id),
parts AS (
  SELECT cells.pair_id, turn, 'prompt' AS part, c AS msgs FROM cells JOIN d ON cells.pair_id IS NOT DISTINCT FROM d.pair_id WHERE differ IS NULL OR turn < differ
  UNION ALL SELECT cells.pair_id, turn, 'chosen', c FROM cells JOIN d ON cells.pair_id IS NOT DISTINCT FROM d.pair_id WHERE turn >= differ
  UNION ALL SELECT cells.pair_id, turn, 'rejected', r FROM cells JOIN d ON cells.pair_id IS NOT DISTINCT FROM d.pair_id WHERE turn >= differ),
one AS (
  SELECT pair_id, part, turn, CAST(floor(turn / 64.0) AS BIGINT) AS block, unnest(msgs) AS x, generate_subscripts(msgs, 1) AS k
  FROM parts WHERE len(msgs) > 0),
text AS (
  SELECT pair_id, part, block, turn, k, x.role AS role,
         '<|' || replace(x.role, '<|', '< |') || '|>' || chr(10) AS head, replace(x.text, '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM one),
placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, part, block ORDER BY turn, k) AS e FROM text),
blocks AS (
  SELECT pair_id, part, block, count(DISTINCT turn) AS n_turns, string_agg(head || body, '' ORDER BY turn, k) AS t,
         coalesce(string_agg(CAST(e - length(body) AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY turn, k) FILTER (role = 'assistant' AND part <> 'prompt'), '') AS mask
  FROM placed GROUP BY ALL)
SELECT pair_id, part, block,
       CAST(coalesce(sum(length(t)) OVER (PARTITION BY pair_id, part ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
       CAST(n_turns AS BIGINT) AS n_turns, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS text_sha256, mask
FROM blocks
"""

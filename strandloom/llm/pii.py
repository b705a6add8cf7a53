"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Only DataFrame functions: no row leaves the JVM.  Of each kind the leftmost matches that do
not overlap are proposed.  The four base kinds (email, ip, card, phone) stay whatever their
score; the further kinds (iban, secret, natid) stay from a score of 0.5 on.  A score starts
from the kind's own, rises by a checksum (Luhn, mod 97) and by a word of the kind's context
nearby, and falls by a word that says the value is made up.  So a national id needs its context,
and an account number or a secret is dropped as an example.  Nearby are the 40 code points on
either side, as far as the next match of the same kind; context words are whole words.
Of an account number's blank-separated groups, the longest run from the first on that passes counts.

Null texts count as empty and have no spans.  Spans are in code points, end exclusive.  Rows are
judged one by one, so ties and repeated rows need no rule; extra columns stay untouched; an
empty table gives no rows.  Very long texts are searched whole, in time about linear in their
matches: spans are made in groups, whose places are added up afterwards.

The patterns repeat possessively and look back where a match cannot begin, which makes them
linear on long runs and spares Java's stack; they match what the plain patterns match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 40
KEEP_FROM = 0.5
#: What a checksum and a context word add, and what a word of made-up values takes.
SURE, CLOSE, MADE_UP = 0.4, 0.2, 0.4
UNREAL = "example|sample|dummy|placeholder|fake"
#: Matches of a text whose spans are made in one group.
_GROUP = 64


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the (up to 20) digits of ``m`` pass Luhn's test."""
    full = F.lpad(_digits(m), 20, "0")

    def add(total: Column, i: Column) -> Column:
        d = F.substring(full, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), add) % 10 == 0


def _mod97(m: Column) -> Column:
    """Whether an account number leaves 1 when its rearranged digits are divided by 97."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.lit(64)), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def account(m: Column) -> Column:
    """The longest run of blank-separated groups of ``m``, from the first on, of 15 characters and more that passes mod 97; else null."""
    groups = F.split(m, " ")
    runs = F.transform(F.sequence(F.size(groups), F.lit(1)), lambda k: F.array_join(F.slice(groups, F.lit(1), k), " "))
    return F.get(F.filter(runs, lambda r: (F.length(F.replace(r, F.lit(" "), F.lit(""))) >= 15) & _mod97(r)), F.lit(0))


def _octets(m: Column) -> Column:
    """Whether all parts are at most 255; leading zeros do not count."""
    short = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0++(?=[0-9])", ""))
    return F.forall(short, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


@dataclass(frozen=True)
class Kind:
    """A kind of personal data; ``might`` is a cheap test that a text has any, ``valid`` drops matches."""

    name: str
    pattern: str
    might: str
    valid: callable
    score: float
    context: str
    base: bool = True
    sure: callable | None = None
    #: What of a match counts; null drops it.
    part: callable | None = None


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]++\.", lambda m: F.lit(True), 0.7, "mail|email|contact|write|reach"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]", _octets, 0.5, "ip|addr|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}", lambda m: F.length(_digits(m)).between(14, 19) & luhn(m), 0.4, "card|visa|credit|pay|payment", sure=luhn),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda m: F.length(_digits(m)).between(10, 15), 0.5, "phone|telephone|call|tel|mobile"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", lambda m: F.lit(True), 0.2, "iban|account|bank", base=False, sure=lambda m: F.lit(True), part=account),
    Kind("secret", r"AKIA[0-9A-Z]{16}|(?:[Pp]assword|[Pp]asswd|[Ss]ecret|[Tt]oken|[Aa]pi_?[Kk]ey)[\x20]{0,2}[=:][\x20]{0,2}[\"']?[A-Za-z0-9+/_-]{8,}[\"']?", r"AKIA|[=:][\x20]{0,2}[\"']?[A-Za-z0-9+/_-]{8}", lambda m: m.rlike("[0-9]"), 0.5, "key|login|auth|credential", base=False),
    Kind("natid", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda m: ~m.rlike("^(000|666|9..)-|-00-|-0000$"), 0.35, "ssn|social|security|tax", base=False),
)
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def words_of(context: str) -> str:
    """The pattern of a context's whole words in lower-cased text, as any engine reads it."""
    return f"(^|[^a-z])({context})s?([^a-z]|$)"


def _in_groups(items: Column) -> Column:
    """An array as an array of its parts of ``_GROUP`` neighbours."""

    def parts(x: Column) -> Column:
        last = F.greatest(F.ceil(F.size(x) / _GROUP).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(x, g * _GROUP + 1, F.lit(_GROUP)))

    # As a lambda's variable the array is computed once, not once for each group.
    return F.get(F.transform(F.array(items), parts), F.lit(0))


def _found(text: Column, kind: Kind, rank: int) -> Column:
    """The spans of one kind: matches lie between the pieces that splitting leaves."""
    pieces = F.split(text, kind.pattern, -1)
    joined = F.arrays_zip(pieces.alias("p"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"), F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))).alias("q"))

    def step(acc: Column, x: Column) -> Column:
        m = kind.part(x["m"]) if kind.part else x["m"]
        start = acc["pos"] + F.length(x["p"])
        end = start + F.coalesce(F.length(m), F.lit(0))
        near = F.lower(F.concat(F.right(x["p"], F.lit(NEAR)), F.lit(" "), F.left(F.coalesce(x["q"], F.lit("")), F.lit(NEAR))))
        sure = F.when(kind.sure(m), SURE).otherwise(0.0) if kind.sure else F.lit(0.0)
        score = F.lit(kind.score) + sure + F.when(near.rlike(words_of(kind.context)), CLOSE).otherwise(0.0) - F.when(near.rlike(words_of(UNREAL)), MADE_UP).otherwise(0.0)
        score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)
        span = F.array(F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))).cast(_SPAN)
        good = m.isNotNull() & kind.valid(m)
        if not kind.base:
            good = good & (score >= KEEP_FROM)
        after = start + F.coalesce(F.length(x["m"]), F.lit(0))
        return F.struct(after.cast("int").alias("pos"), F.when(good, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    # Spans gather group by group, so that no array grows by one at a time beyond a group's.
    none = F.array().cast(_SPAN)
    group = lambda acc, part: F.aggregate(part, F.struct(acc["pos"].alias("pos"), none.alias("out")), step, lambda r: F.struct(r["pos"].alias("pos"), F.concat(acc["out"], r["out"]).alias("out")))
    whole = F.aggregate(_in_groups(joined), F.struct(F.lit(0).cast("int").alias("pos"), none.alias("out")), group, lambda acc: acc["out"])
    return F.when(text.rlike(kind.might), whole).otherwise(F.array().cast(_SPAN))


def find(docs: DataFrame, *, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with an array of spans (start, rank of the kind, end, kind, score), by start and kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(out, F.array_sort(F.concat(*[_found(t, k, i) for i, k in enumerate(KINDS)])))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, *, doc_id: str = "doc_id", spans: str = "spans") -> DataFrame:
    """The contract's columns of ``find``, counts of the further kinds and of all spans, and the spans' scores."""
    s = F.col(spans)
    base = F.filter(s, lambda x: x["rank"] < sum(k.base for k in KINDS))
    ranks = F.transform(s, lambda x: x["rank"])
    count = [F.size(F.filter(ranks, F.lit(i).__eq__)).cast("long").alias(f"n_{k.name}") for i, k in enumerate(KINDS)]
    scores = F.array_join(F.transform(s, lambda x: F.format_string("%.2f", x["score"])), ",")
    return found.select(doc_id, *count, F.size(s).cast("long").alias("n_spans"), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(s).alias("spans"), scores.alias("scores"))


def redacted(docs: DataFrame, *, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans become one of the first's kind."""
    rows = find(docs, text=text, out="__spans")
    span = "struct<start:int,end:int,kind:string>"

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        more = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).cast(f"array<{span}>")
        wider = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))).cast(f"array<{span}>")
        return F.when(F.size(acc) == 0, more).when(s["start"] < last["end"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), wider)).otherwise(F.concat(acc, more))

    none = F.array().cast(f"array<{span}>")
    # Group by group: only the last span so far can reach into the next group.
    tail = lambda acc: F.when(F.size(acc) == 0, none).otherwise(F.slice(acc, F.lit(-1), F.lit(1)))
    head = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    merged = F.aggregate(_in_groups(F.col("__spans")), none, lambda acc, part: F.concat(head(acc), F.aggregate(part, tail(acc), merge)))
    t = F.col(text)

    def blotted(m: Column) -> Column:
        before = F.transform(m, lambda s, i: F.concat(F.substring(t, F.when(i == 0, F.lit(1)).otherwise(F.get(m, i - 1)["end"] + 1), s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get(m, i - 1)["end"])), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(before, ""), F.substring(t, F.element_at(m, -1)["end"] + 1, F.length(t)))

    # As a lambda's variable the spans are computed once.
    rows = rows.withColumn(text, F.when(F.size("__spans") > 0, F.get(F.transform(F.array(merged), blotted), F.lit(0))).otherwise(t))
    if n_chars and n_chars in docs.columns:
        kind = docs.schema[n_chars].dataType
        rows = rows.withColumn(n_chars, F.when(F.size("__spans") > 0, F.length(text).cast(kind)).otherwise(F.col(n_chars)))
    return rows.select(docs.columns)


_LUHN_SQL = "list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN (length(g) - i) % 2 = 1 THEN CAST(substr(g, i, 1) AS INT) * 2 - CASE WHEN CAST(substr(g, i, 1) AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST(substr(g, i, 1) AS INT) END)) % 10 = 0"
_MOD_SQL = "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(r, ' ', ''), 5) || substr(replace(r, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"
_RUNS_SQL = "list_transform(range(len(string_split(hit, ' ')), 0, -1), lambda k: array_to_string(string_split(hit, ' ')[1:k], ' '))"
_ACCOUNT_SQL = f"list_filter({_RUNS_SQL}, lambda r: length(replace(r, ' ', '')) >= 15 AND {_MOD_SQL})[1]"
_CLOSE_SQL = "CASE kind " + " ".join(f"WHEN '{k.name}' THEN regexp_matches(near, '{words_of(k.context)}')" for k in KINDS) + " END"
_START_SQL = "CASE kind " + " ".join(f"WHEN '{k.name}' THEN {k.score}" for k in KINDS) + " END"
#: DuckDB's SQL for ``digest(find(documents))``, with the plain patterns.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
kinds(rank, kind, rx) AS (VALUES
  (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  (2, 'card', '[0-9]([\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'),
  (4, 'iban', '[A-Z]{{2}}[0-9]{{2}}( ?[A-Z0-9]{{4}}){{2,7}}( ?[A-Z0-9]{{1,3}})?'),
  (5, 'secret', 'AKIA[0-9A-Z]{{16}}|([Pp]assword|[Pp]asswd|[Ss]ecret|[Tt]oken|[Aa]pi_?[Kk]ey)[\x20]{{0,2}}[=:][\x20]{{0,2}}["'']?[A-Za-z0-9+/_-]{{8,}}["'']?'),
  (6, 'natid', '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}')),
parts AS (SELECT doc_id, rank, kind, string_split_regex(t, rx) AS p, regexp_extract_all(t, rx) AS m FROM d, kinds),
found AS (SELECT doc_id, rank, kind, k, p[k] AS piece, m[k] AS hit, p[k + 1] AS nxt FROM parts, LATERAL (SELECT unnest(range(1, len(m) + 1)) AS k)),
placed AS (SELECT *, CAST(sum(length(piece) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY k) AS BIGINT) AS e, regexp_replace(hit, '[^0-9]', '', 'g') AS g FROM found),
judged AS (
  SELECT doc_id, rank, kind, e - length(hit) AS s, CASE WHEN kind = 'iban' THEN {_ACCOUNT_SQL} ELSE hit END AS got, hit, g,
         lower(right(piece, 40) || ' ' || left(coalesce(nxt, ''), 40)) AS near
  FROM placed),
good AS (
  SELECT doc_id, rank, kind, s, s + length(got) AS e,
         round(greatest(0, least(1, {_START_SQL} + CASE WHEN kind = 'iban' OR kind = 'card' AND {_LUHN_SQL} THEN {SURE} ELSE 0 END
           + CASE WHEN {_CLOSE_SQL} THEN {CLOSE} ELSE 0 END - CASE WHEN regexp_matches(near, '{words_of(UNREAL)}') THEN {MADE_UP} ELSE 0 END)), 2) AS score
  FROM judged
  WHERE got IS NOT NULL AND CASE kind
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) < 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') <= '255')))
    WHEN 'card' THEN length(g) BETWEEN 14 AND 19 AND {_LUHN_SQL}
    WHEN 'phone' THEN length(g) BETWEEN 10 AND 15
    WHEN 'secret' THEN regexp_matches(hit, '[0-9]')
    WHEN 'natid' THEN NOT regexp_matches(hit, '^(000|666|9..)-|-00-|-0000$')
    ELSE true END),
kept AS (SELECT * FROM good WHERE rank < 4 OR score >= {KEEP_FROM}),
spelled AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (rank = {i}) AS n_{k.name}" for i, k in enumerate(KINDS))}, count(*) AS n_spans,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans,
         string_agg(format('{{:.2f}}', CAST(score AS DOUBLE)), ',' ORDER BY s, rank) AS scores
  FROM kept GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS)}, coalesce(n_spans, 0) AS n_spans,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN spelled USING (doc_id)
"""

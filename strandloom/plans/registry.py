"""All registered queries of the search engine and the DuckDB SQL that gives the same rows.

Queries are the benchmark items, subjects the documents, both as their letters; bases are
letters mapped to ACGT.  Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions import residues as R
from strandloom.functions import statistics
from strandloom.functions.matrix import GAPPED, blosum62
from strandloom.operators import hits as H
from strandloom.operators import ranges, scan, words
from strandloom.plans.options import SearchOptions
from strandloom.plans.search import by_composition, search
from strandloom.sources import catalog, fasta, report
from strandloom.sources.shared import written

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Word lengths of the relational seeds: rare words for hits, shorter ones where every diagonal counts.
K = 8
CHUNK, OVERLAP = 1000, 100

_BASE = f"""
subj AS (SELECT doc_id AS oid, source, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS residues, text FROM documents),
s AS (SELECT * FROM subj WHERE length(residues) > 0),
q AS (SELECT item_id AS query_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS residues FROM benchmark),
n AS (SELECT query_id, translate(residues, '{R.LETTERS}', '{R.AS_BASES}') AS bases FROM q),
"""


def _words_sql(k: int) -> str:
    return f"""
sw AS (SELECT oid, i AS s_pos, substr(residues, CAST(i AS BIGINT) + 1, {k}) AS word FROM s, LATERAL (SELECT unnest(range(0, length(residues) - {k - 1})) AS i)),
qw AS (SELECT query_id, i AS q_pos, substr(residues, CAST(i AS BIGINT) + 1, {k}) AS word FROM q, LATERAL (SELECT unnest(range(0, length(residues) - {k - 1})) AS i)),
seed AS (SELECT query_id, oid, CAST(q_pos AS INT) AS q_pos, CAST(s_pos AS INT) AS s_pos, CAST(q_pos - s_pos AS INT) AS diag FROM sw JOIN qw USING (word)),
"""


_ISLANDS = f"""
marked AS (SELECT *, CASE WHEN s_pos - lag(s_pos) OVER (PARTITION BY query_id, oid, diag ORDER BY s_pos) <= {K} THEN 0 ELSE 1 END AS fresh FROM seed),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id, oid, diag ORDER BY s_pos) AS run FROM marked),
island AS (SELECT query_id, oid, diag, CAST(min(q_pos) AS INT) AS q_start, CAST(min(s_pos) AS INT) AS s_start, CAST(max(s_pos) - min(s_pos) + {K} AS INT) AS length, count(*) AS n_seeds
           FROM runs GROUP BY query_id, oid, diag, run),
hsp AS (SELECT query_id, oid, q_start, q_start + length AS q_end, s_start, s_start + length AS s_end, length * 5 AS score FROM island),
"""


def _with(*parts: str) -> str:
    return "WITH " + "".join(parts).rstrip().rstrip(",") + "\n"


def hits_sql() -> str:
    """Common tables up to ``q``, ``s``, ``island`` and ``hsp``, for SQL that goes on from there."""
    return _with(_BASE, _words_sql(K), _ISLANDS)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _s(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.subjects_of(_table(spark, sf, "documents")).select("oid", "subject_id", "residues", "length")


def _all(spark: SparkSession, sf: str) -> DataFrame:
    """(oid, residues) of the subjects, for a search that reads them all."""
    return catalog.gathered(_table(spark, sf, "documents"))


def _q(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.queries_of(_table(spark, sf, "benchmark"))


def _n(spark: SparkSession, sf: str) -> DataFrame:
    return _q(spark, sf).select("query_id", R.as_bases(F.col("residues")).alias("bases"))


def _seeds(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    return words.seeds(_q(spark, sf), _s(spark, sf), k)


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """(oid, text) of the subjects, whose letters a scan gathers once they are dealt."""
    docs = _table(spark, sf, "documents")
    return docs.where(R.with_letters(F.col("text"))).select(F.col("doc_id").alias("oid"), "text")


def _read(texts: DataFrame) -> DataFrame:
    return texts.select("oid", R.letters(F.col("text")).alias("residues"))


def _islands(spark: SparkSession, sf: str, least: int = 0) -> DataFrame:
    return words.islands_of(_q(spark, sf), _texts(spark, sf), K, least, _read)


def _of_islands(spark: SparkSession, sf: str, alone: Callable[[scan.Few, DataFrame], DataFrame], plain: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return words.of_islands(_q(spark, sf), _texts(spark, sf), K, alone, plain, _read)


def _hsps(spark: SparkSession, sf: str, least: int = 0) -> DataFrame:
    """Exact islands (of at least some length) as segment pairs that score 5 for each residue."""
    return _as_hsps(_islands(spark, sf, least))


def _as_hsps(i: DataFrame) -> DataFrame:
    return i.select("query_id", "oid", "q_start", (F.col("q_start") + F.col("length")).cast("int").alias("q_end"), "s_start", (F.col("s_start") + F.col("length")).cast("int").alias("s_end"), (F.col("length") * 5).cast("int").alias("score"))


def _masks(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.lower_case_masks(_table(spark, sf, "documents").select(F.col("doc_id").alias("oid"), "text"))


# ------------------------------------------------------------------ words and seeds


@query(_with(_BASE, _words_sql(K)) + "SELECT word, count(*) AS n, count(DISTINCT oid) AS subjects FROM sw GROUP BY word")
def kmer_counts(spark, sf):
    return words.word_counts(_s(spark, sf), K)


@query(_with(_BASE, _words_sql(K)) + "SELECT * FROM seed")
def seed_join(spark, sf):
    return _seeds(spark, sf)


@query(_with(_BASE, _words_sql(K)) + "SELECT oid, count(*) AS n FROM sw WHERE word IN (SELECT word FROM qw) GROUP BY oid")
def seed_semi_presence(spark, sf):
    return words.presence(_q(spark, sf), _s(spark, sf), K).groupBy("oid").agg(F.count("*").alias("n"))


_PAIRS = ", ".join(f"('{a}', '{b}', {int(v)})" for a, b, v in [(x, y, blosum62()[i, j]) for i, x in enumerate("-ABCDEFGHIKLMNPQRSTVWXYZU*OJ") for j, y in enumerate("-ABCDEFGHIKLMNPQRSTVWXYZU*OJ") if i and j])
_MATRIX = f"matrix(a, b, sc) AS (VALUES {_PAIRS}),\n"


@query(
    _with(_BASE, _words_sql(3), _MATRIX)
    + """, dw AS (SELECT DISTINCT word FROM qw),
one AS (SELECT word, x.b AS b1, x.sc AS s1 FROM dw JOIN matrix x ON x.a = substr(word, 1, 1)),
two AS (SELECT word, b1, x.b AS b2, s1 + x.sc AS s2 FROM one JOIN matrix x ON x.a = substr(word, 2, 1)),
three AS (SELECT word, b1 || b2 || x.b AS near, s2 + x.sc AS score FROM two JOIN matrix x ON x.a = substr(word, 3, 1) WHERE s2 + x.sc >= 11)
SELECT query_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(score) AS BIGINT) AS total, count(DISTINCT near) AS kinds FROM qw JOIN three USING (word) GROUP BY query_id"""
)
def neighbor_words(spark, sf):
    near = words.neighbour_words(spark, _q(spark, sf), 3, 11)
    return near.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("score").cast("long").alias("total"), F.countDistinct("word").alias("kinds"))


@query(_with(_BASE, _words_sql(K)) + "SELECT query_id, oid, diag, count(*) AS n, CAST(min(s_pos) AS INT) AS first, CAST(max(s_pos) AS INT) AS last FROM seed GROUP BY ALL")
def diag_histogram(spark, sf):
    return words.diagonals(_seeds(spark, sf))


@query(
    "WITH RECURSIVE "
    + (_BASE + _words_sql(6)).rstrip().rstrip(",")
    + """,
step AS (SELECT query_id, oid, diag, s_pos, row_number() OVER (PARTITION BY query_id, oid, diag ORDER BY s_pos) AS rn FROM seed),
fold AS (
  SELECT query_id, oid, diag, rn, s_pos, s_pos AS last, CAST(NULL AS INT) AS before FROM step WHERE rn = 1
  UNION ALL
  SELECT n.query_id, n.oid, n.diag, n.rn, n.s_pos, CASE WHEN n.s_pos - f.last < 6 THEN f.last ELSE n.s_pos END,
         CASE WHEN n.s_pos - f.last >= 6 AND n.s_pos - f.last < 40 THEN f.last END
  FROM fold f JOIN step n ON n.query_id = f.query_id AND n.oid = f.oid AND n.diag = f.diag AND n.rn = f.rn + 1)
SELECT query_id, oid, diag, s_pos, before FROM fold WHERE before IS NOT NULL"""
)
def two_hit_pairs(spark, sf):
    return words.two_hits_of(_q(spark, sf), _texts(spark, sf), 6, 40, _read)


@query(_with(_BASE, _words_sql(K), _ISLANDS) + "SELECT * FROM island")
def seed_islands(spark, sf):
    return _islands(spark, sf)


@query(_with(_BASE, _words_sql(K), _ISLANDS) + "SELECT query_id, oid, CAST(sum(n_seeds) AS BIGINT) AS seeds, count(*) AS islands, count(*) FILTER (length >= 16) AS long_islands, CAST(max(length) AS INT) AS longest FROM island GROUP BY query_id, oid")
def hit_counters(spark, sf):
    plain = lambda i: i.groupBy("query_id", "oid").agg(F.sum("n_seeds").alias("seeds"), F.count("*").alias("islands"), F.count(F.when(F.col("length") >= 16, 1)).alias("long_islands"), F.max("length").cast("int").alias("longest"))
    return _of_islands(spark, sf, scan.counters, plain)


# ------------------------------------------------------------------ ungapped extension

_XDROP = H.raw_drop(7.0)
_ARM = f"""
e AS (SELECT query_id, oid, diag, max(length) AS length, arg_max(q_start, (length, -q_start)) AS q_start, arg_max(s_start, (length, -q_start)) AS s_start FROM island GROUP BY query_id, oid, diag),
pair AS (SELECT e.query_id, e.oid, e.diag, i, substr(q.residues, CAST(e.q_start + e.length + i AS BIGINT), 1) AS a, substr(s.residues, CAST(e.s_start + e.length + i AS BIGINT), 1) AS b
         FROM e JOIN q USING (query_id) JOIN s USING (oid), LATERAL (SELECT unnest(range(1, least(length(q.residues) - e.q_start - e.length, length(s.residues) - e.s_start - e.length) + 1)) AS i)),
scored AS (SELECT query_id, oid, diag, i, sc FROM pair JOIN matrix m ON m.a = pair.a AND m.b = pair.b),
total AS (SELECT *, sum(sc) OVER w AS t FROM scored WINDOW w AS (PARTITION BY query_id, oid, diag ORDER BY i)),
peak AS (SELECT *, greatest(0, max(t) OVER (PARTITION BY query_id, oid, diag ORDER BY i)) AS p FROM total),
stopped AS (SELECT *, min(CASE WHEN p - t >= {_XDROP} THEN i END) OVER (PARTITION BY query_id, oid, diag) AS stop FROM peak),
"""


@query(
    _with(_BASE, _words_sql(K), _ISLANDS, _MATRIX, _ARM)
    + """SELECT query_id, oid, diag, CAST(max(p) AS BIGINT) AS gain, CAST(coalesce(min(i) FILTER (t = best AND best > 0), 0) AS BIGINT) AS steps
FROM (SELECT *, max(p) OVER (PARTITION BY query_id, oid, diag) AS best FROM stopped WHERE stop IS NULL OR i <= stop) GROUP BY query_id, oid, diag"""
)
def ungapped_xdrop(spark, sf):
    """The right arm of the longest island of each diagonal, to the X-drop or the end of a sequence; the SQL has it in window form."""
    return words.right_arms_of(_q(spark, sf), _texts(spark, sf), K, _XDROP, _read)


def _exact_options() -> SearchOptions:
    return SearchOptions(threshold=None, word_size=6, evalue=1e-3)


@query()
def ungapped_hsps(spark, sf):
    return search(spark, _q(spark, sf), _all(spark, sf), _exact_options().with_(ungapped=True)).select("query_id", "oid", "q_start", "q_end", "s_start", "s_end", "score", "rank", "n_linked")


@query()
def gapped_hsps(spark, sf):
    return search(spark, _q(spark, sf), _all(spark, sf), _exact_options()).select("query_id", "oid", "q_start", "q_end", "s_start", "s_end", "score", "rank", "gaps", "identities")


@query()
def default_search(spark, sf):
    """All options at their defaults: neighbouring words of three residues, two hits, gapped alignment, E-value 10."""
    h = search(spark, _q(spark, sf), _all(spark, sf))
    return h.select("query_id", "oid", "q_start", "q_end", "s_start", "s_end", "score", "rank", "gaps", "identities")


@query()
def composition_modes(spark, sf):
    """Pairs of each query that stay significant with scores by composition: none, scaled, a matrix for each pair of sequences."""
    out = None
    modes = (0, 1, 2)
    for mode, h in zip(modes, by_composition(spark, _q(spark, sf), _all(spark, sf), _exact_options().with_(max_targets=0), modes), strict=True):
        n = h.groupBy("query_id").agg(F.lit(mode).alias("mode"), F.countDistinct("oid").alias("subjects"), F.count("*").alias("pairs"), F.round(F.max("bits"), 3).alias("best_bits"))
        out = n if out is None else out.unionByName(n)
    return out


@query()
def edit_script_stats(spark, sf):
    h = search(spark, _q(spark, sf), _all(spark, sf), _exact_options().with_(max_targets=0))
    return h.groupBy("query_id").agg(F.count("*").alias("pairs"), F.sum("align_length").alias("columns"), F.sum("gaps").alias("gaps"), F.sum("gap_opens").alias("gap_opens"), F.sum("identities").alias("identities"))


@query()
def translated_search(spark, sf):
    """Bases in six frames against the proteins of their own first and fifth frames."""
    n = _n(spark, sf).withColumnRenamed("bases", "residues")
    own = n.select((F.col("query_id") * 2).alias("oid"), R.translated(F.col("residues"), 1).alias("residues")).unionByName(n.select((F.col("query_id") * 2 + 1).alias("oid"), R.translated(F.col("residues"), -2).alias("residues")))
    h = search(spark, n, own, SearchOptions(task="translated", evalue=1e-3))
    return h.select("query_id", "oid", "frame", "score", "identities", F.col("on_bases.from").alias("base_from"), F.col("on_bases.to").alias("base_to"), "rank")


@query()
def nucleotide_search(spark, sf):
    """Bases of the items, every other one on its other strand, against the bases of all documents."""
    n = _n(spark, sf)
    turned = n.select("query_id", F.when(F.col("query_id") % 2 == 0, F.col("bases")).otherwise(R.reverse_complement(F.col("bases"))).alias("residues"))
    own = _all(spark, sf).select("oid", R.as_bases(F.col("residues")).alias("residues"))
    h = search(spark, turned, own, SearchOptions(task="nucleotide", evalue=1e-6))
    return h.select("query_id", "oid", "strand", "q_start", "q_end", "s_start", "s_end", "score", "identities", "gaps", "rank")


@query()
def frame_shift_search(spark, sf):
    """Bases with every 101st one left out against the proteins of their first frame: alignments across frames."""
    n = _n(spark, sf).withColumnRenamed("bases", "residues")
    own = n.select(F.col("query_id").alias("oid"), R.translated(F.col("residues"), 1).alias("residues"))
    broken = n.withColumn("residues", F.regexp_replace("residues", "(.{100}).", "$1"))
    h = search(spark, broken, own, SearchOptions(task="translated", frame_shift=15, evalue=1e-3))
    return h.select("query_id", "oid", "strand", "score", "identities", "base_from", "base_to", "s_start", "s_end", "rank", F.size(F.filter("script", lambda x: x["op"].startswith("shift"))).alias("shifts"))


@query()
def tabular_report(spark, sf):
    h = search(spark, _q(spark, sf), _all(spark, sf), _exact_options())
    return report.tabular(h)


_WINDOW = f"""
m11 AS (SELECT query_id, oid, q_start, s_start, score FROM hsp WHERE q_end - q_start > 11)
SELECT query_id, oid, q_start, s_start, CAST(arg_max(i + 5, (t, -i)) AS INT) AS start_at
FROM (SELECT query_id, oid, q_start, s_start, i, sum(sc) OVER (PARTITION BY query_id, oid, q_start, s_start ORDER BY i ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS t, count(*) OVER (PARTITION BY query_id, oid, q_start, s_start ORDER BY i ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS full_
      FROM (SELECT h.*, j AS i, m.sc FROM hsp h JOIN q USING (query_id), LATERAL (SELECT unnest(range(h.q_start, h.q_end)) AS j), matrix m
            WHERE h.q_end - h.q_start > 11 AND m.a = substr(q.residues, CAST(j AS BIGINT) + 1, 1) AND m.b = m.a))
WHERE full_ = 11 GROUP BY query_id, oid, q_start, s_start"""


@query(_with(_BASE, _words_sql(K), _ISLANDS, _MATRIX).rstrip() + "," + _WINDOW)
def gapped_start_window(spark, sf):
    """Where gapped extension of an exact island begins: the middle of its best eleven pairs."""
    h = _hsps(spark, sf, 12).join(_q(spark, sf), "query_id")
    m = blosum62()
    own = F.create_map(*[F.lit(x) for i, c in enumerate("-ABCDEFGHIKLMNPQRSTVWXYZU*OJ") if i for x in (c, int(m[i, i]))])
    part = F.substring("residues", F.col("q_start") + 1, F.col("q_end") - F.col("q_start"))
    scores = F.transform(F.filter(F.split(part, ""), lambda c: c != ""), lambda c: F.element_at(own, c))
    n = F.size("sc")
    sums = F.transform(F.sequence(F.lit(0), n - 11), lambda i: F.struct(F.aggregate(F.slice("sc", i + 1, 11), F.lit(0), lambda a, x: a + x).alias("t"), (-i).alias("m")))
    rows = h.withColumn("sc", scores)
    return rows.select("query_id", "oid", "q_start", "s_start", (F.col("q_start") - F.array_max(sums)["m"] + 5).cast("int").alias("start_at"))


# ------------------------------------------------------------------ ranking and filters

_TOP = """SELECT query_id, oid, best, n, rank FROM (
  SELECT query_id, oid, max(length) AS best, count(*) AS n, CAST(row_number() OVER (PARTITION BY query_id ORDER BY max(length) DESC, count(*) DESC, oid) AS INT) AS rank FROM island WHERE length >= 12 GROUP BY query_id, oid)
WHERE rank <= 10"""


@query(_with(_BASE, _words_sql(K), _ISLANDS) + _TOP)
def top_hits_per_query(spark, sf):
    """Which documents contain passages of which benchmark items: the ten with the longest."""
    pairs = _islands(spark, sf, 12).groupBy("query_id", "oid").agg(F.max("length").cast("int").alias("best"), F.count("*").alias("n"))
    w = W.partitionBy("query_id").orderBy(F.desc("best"), F.desc("n"), "oid")
    return pairs.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


_ORDER = "score DESC, q_start, s_start, q_end, s_end"


@query(
    _with(_BASE, _words_sql(K), _ISLANDS)
    + f""", a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, oid, q_start, s_start ORDER BY {_ORDER}) AS r FROM hsp) WHERE r = 1)
SELECT query_id, oid, q_start, q_end, s_start, s_end, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, oid, q_end, s_end ORDER BY {_ORDER}) AS r2 FROM a) WHERE r2 = 1"""
)
def hsp_common_endpoint_purge(spark, sf):
    return _of_islands(spark, sf, scan.purged, lambda i: H.purged(_as_hsps(i)))


@query(
    "WITH RECURSIVE "
    + (_BASE + _words_sql(K) + _ISLANDS).rstrip().rstrip(",")
    + f""",
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, oid ORDER BY {_ORDER}) AS rn FROM hsp),
fold AS (
  SELECT query_id, oid, rn, [struct_pack(a := q_start, b := q_end, c := s_start, d := s_end)] AS kept, true AS mine FROM o WHERE rn = 1
  UNION ALL
  SELECT n.query_id, n.oid, n.rn,
         CASE WHEN list_bool_or(list_transform(f.kept, lambda x: n.q_start >= x.a AND n.q_end <= x.b AND n.s_start >= x.c AND n.s_end <= x.d)) THEN f.kept
              ELSE list_append(f.kept, struct_pack(a := n.q_start, b := n.q_end, c := n.s_start, d := n.s_end)) END,
         NOT list_bool_or(list_transform(f.kept, lambda x: n.q_start >= x.a AND n.q_end <= x.b AND n.s_start >= x.c AND n.s_end <= x.d))
  FROM fold f JOIN o n ON n.query_id = f.query_id AND n.oid = f.oid AND n.rn = f.rn + 1)
SELECT query_id, oid, q_start, q_end, s_start, s_end, score FROM o JOIN fold USING (query_id, oid, rn) WHERE mine"""
)
def hsp_containment(spark, sf):
    return H.uncontained(_hsps(spark, sf))


@query(
    _with(_BASE, _words_sql(K), _ISLANDS)
    + """SELECT h.query_id, h.oid, h.q_start, h.q_end, h.s_start, h.s_end, h.score FROM hsp h
WHERE (SELECT count(*) FROM hsp b WHERE b.query_id = h.query_id AND b.q_start <= h.q_start AND b.q_end >= h.q_end
  AND (b.score > h.score OR (b.score = h.score AND (b.oid < h.oid OR (b.oid = h.oid AND b.s_start < h.s_start))))) < 3"""
)
def hsp_culling(spark, sf):
    return H.culled(written(_of_islands(spark, sf, lambda q, s: scan.best_of_ranges(q, s, 3), _as_hsps), "ranges"), 3)


@query(
    _with(_BASE, _words_sql(K), _ISLANDS)
    + """, d AS (SELECT query_id, oid, q_start, q_end, s_start, s_end, CAST(score + (q_start * 7 + oid) % (4 * (q_end - q_start)) AS INT) AS score FROM hsp),
l AS (SELECT *, exp(-0.1 * score) AS evalue FROM d)
SELECT h.query_id, h.oid, h.q_start, h.q_end, h.s_start, h.s_end, h.score FROM l h WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.query_id = h.query_id
  AND b.q_start <= h.q_start + (h.q_end - h.q_start) * 0.25 AND b.q_end >= h.q_end - (h.q_end - h.q_start) * 0.25
  AND b.evalue <= h.evalue AND b.score / (b.q_end - b.q_start) * 0.9 > h.score / (h.q_end - h.q_start))"""
)
def best_hit_filter(spark, sf):
    """Islands with scores that are made uneven, so that some have clearly more for each residue than others."""
    uneven = F.col("score") + (F.col("q_start") * 7 + F.col("oid")) % (4 * (F.col("q_end") - F.col("q_start")))
    h = written(_hsps(spark, sf), "pairs").withColumn("score", uneven.cast("int"))  # read three times
    return H.best_hits(h.withColumn("evalue", F.exp(F.col("score") * -0.1)), 0.25, 0.1).drop("evalue")


@query(
    _with(_BASE, _words_sql(K), _ISLANDS)
    + f""", e AS (SELECT h.*, length(q.residues) * exp(-{GAPPED[0]} * score) AS evalue FROM hsp h JOIN q USING (query_id) WHERE q_end - q_start >= 12),
best AS (SELECT query_id, oid, min(evalue) AS e, max(score) AS s FROM e GROUP BY query_id, oid),
ranked AS (SELECT query_id, oid, CAST(row_number() OVER (PARTITION BY query_id ORDER BY e, s DESC, oid) AS INT) AS rank FROM best)
SELECT query_id, oid, q_start, s_start, score, rank FROM e JOIN ranked USING (query_id, oid) WHERE rank <= 10"""
)
def top_subjects(spark, sf):
    """The pairs of the ten best subjects of each query, by least E-value, then score, then oid."""
    h = written(_hsps(spark, sf, 12), "pairs").join(_q(spark, sf).select("query_id", F.length("residues").alias("m")), "query_id")
    h = h.withColumn("evalue", F.col("m") * F.exp(F.col("score") * -GAPPED[0]))
    return H.top_subjects(h, 10).select("query_id", "oid", "q_start", "s_start", "score", "rank")


_LAM, _KK, _ = GAPPED


@query(_with(_BASE, _words_sql(K), _ISLANDS) + f"SELECT query_id, oid, score, count(*) AS n, round((score * {_LAM} - ln({_KK})) / ln(2), 6) AS bits FROM hsp GROUP BY query_id, oid, score")
def bit_scores(spark, sf):
    n = _of_islands(spark, sf, scan.lengths, lambda i: i.groupBy("query_id", "oid", F.col("length").cast("int").alias("length")).agg(F.count("*").alias("n")))
    return n.select("query_id", "oid", (F.col("length") * 5).cast("int").alias("score"), "n").withColumn("bits", F.round(H.bits(F.col("score")), 6))


_BACK = ", ".join(f"('{c}', {i}, {v!r})" for i, (c, v) in enumerate(statistics.BACKGROUND.items()))
_CHANCE = f"""
back(b, ord, f) AS (VALUES {_BACK}),
letter AS (SELECT d.lang, b, CAST(sum(length(residues) - length(replace(residues, b, ''))) AS DOUBLE) AS n FROM s JOIN documents d ON d.doc_id = s.oid, back WHERE d.lang IS NOT NULL GROUP BY d.lang, b),
pr AS (SELECT lang, b AS a, n / sum(n) OVER (PARTITION BY lang) AS p, sum(n) OVER (PARTITION BY lang) AS total FROM letter),
by_score AS (SELECT lang, sc AS x, sum(p * f / (SELECT sum(f) FROM back)) AS c, any_value(total) AS total FROM pr JOIN matrix m USING (a) JOIN back ON back.b = m.b GROUP BY lang, sc),
edge AS (SELECT min(sc) AS lo, max(sc) AS hi FROM matrix m JOIN back u ON u.b = m.a JOIN back w ON w.b = m.b),
grid AS (SELECT lang, unnest(range(lo, hi + 1)) AS x FROM (SELECT DISTINCT lang FROM by_score), edge),
filled AS (SELECT g.lang, g.x, coalesce(c, 0) AS c FROM grid g LEFT JOIN by_score b ON b.lang = g.lang AND b.x = g.x),
dist AS (SELECT lang, list(c ORDER BY x) AS cs, list(x ORDER BY x) AS xs FROM filled GROUP BY lang),
halved AS (
  SELECT lang, 0 AS k, CAST(0.01 AS DOUBLE) AS a, CAST(5 AS DOUBLE) AS z FROM dist
  UNION ALL
  SELECT lang, k + 1, CASE WHEN over_ THEN a ELSE mid END, CASE WHEN over_ THEN mid ELSE z END
  FROM (SELECT h.lang, k, a, z, (a + z) / 2 AS mid, list_sum(list_transform(range(1, len(cs) + 1), lambda i: cs[i] * exp((a + z) / 2 * xs[i]))) > 1 AS over_ FROM halved h JOIN dist USING (lang) WHERE k < 60)),
lam AS (SELECT lang, (a + z) / 2 AS l FROM halved WHERE k = 60),
entropy AS (SELECT lang, l, l * list_sum(list_transform(range(1, len(cs) + 1), lambda i: xs[i] * cs[i] * exp(l * xs[i]))) AS h FROM lam JOIN dist USING (lang)),
sums AS (
  SELECT lang, 1 AS k, cs AS c, (SELECT lo FROM edge) AS low FROM dist
  UNION ALL
  SELECT s.lang, k + 1, list_transform(range(0, len(c) + len(cs) - 1), lambda i: list_sum(list_transform(range(greatest(0, i - len(c) + 1), least(i, len(cs) - 1) + 1), lambda j: cs[j + 1] * c[i - j + 1]))), low + (SELECT lo FROM edge)
  FROM sums s JOIN dist USING (lang) WHERE k < 240),
series AS (SELECT lang, sum(list_sum(list_transform(range(1, len(c) + 1), lambda i: c[i] * exp(l * least(low + i - 1, 0)))) / k) AS sigma FROM sums JOIN lam USING (lang) GROUP BY lang),
"""


@query("WITH RECURSIVE " + (_BASE + _MATRIX + _CHANCE).rstrip().rstrip(",") + """
SELECT lang, CAST((SELECT any_value(total) FROM by_score b WHERE b.lang = e.lang) AS BIGINT) AS n, round(l, 6) AS lambda, round(exp(-2 * sigma) / (h / l * (1 - exp(-l))), 5) AS k, round(h, 6) AS h
FROM entropy e JOIN series USING (lang)""")
def matrix_statistics(spark, sf):
    """lambda, K and H of the matrix for the composition of the letters of each language, against the background of proteins."""
    docs = _table(spark, sf, "documents").where("lang is not null").select(F.col("doc_id").alias("oid"), "lang")
    found = statistics.composition_parameters(statistics.compositions(_s(spark, sf).join(docs, "oid"), "lang"), "lang")
    return found.select("lang", "n", F.round("lambda", 6).alias("lambda"), F.round("k", 5).alias("k"), F.round("h", 6).alias("h"))


_EV = f"""
tot AS (SELECT sum(length(residues)) AS n FROM s),
ev AS (SELECT h.*, length(q.residues) * (SELECT n FROM tot) * {_KK} * exp(-{_LAM} * score) AS e FROM hsp h JOIN q USING (query_id)),
"""


def _with_evalues(spark: SparkSession, sf: str) -> DataFrame:
    return _evalued(spark, sf, _hsps(spark, sf), _q(spark, sf).select("query_id", F.length("residues").alias("m")))


def _evalued(spark: SparkSession, sf: str, pairs: DataFrame, q: DataFrame) -> DataFrame:
    """Pairs with their E-value ``e``; q: query_id, m (residues), and what else is wanted."""
    total = _s(spark, sf).agg(F.sum("length").alias("total"))
    return pairs.join(q.join(F.broadcast(total)), "query_id").withColumn("e", F.col("m") * F.col("total") * _KK * F.exp(F.col("score") * -_LAM)).drop("m", "total")


@query(_with(_BASE, _words_sql(K), _ISLANDS, _EV) + "SELECT query_id, oid, count(*) AS n, round(ln(min(e)), 6) AS log_evalue FROM ev GROUP BY query_id, oid")
def evalues(spark, sf):
    # The least E-value is that of the best score, with the shortest query of an id.
    q = _q(spark, sf).groupBy("query_id").agg(F.min(F.length("residues")).alias("m"), F.count("*").alias("times"))
    plain = lambda i: i.groupBy("query_id", "oid").agg(F.count("*").alias("islands"), F.max("length").cast("int").alias("longest"))
    best = _of_islands(spark, sf, lambda f, s: scan.counters(f, s).select("query_id", "oid", "islands", "longest"), plain).withColumn("score", F.col("longest") * 5)
    return _evalued(spark, sf, best, q).select("query_id", "oid", (F.col("islands") * F.col("times")).alias("n"), F.round(F.ln("e"), 6).alias("log_evalue"))


@query(_with(_BASE, _words_sql(K), _ISLANDS, _EV) + "SELECT query_id, oid, q_start, s_start, score FROM ev WHERE e <= 10")
def evalue_filter(spark, sf):
    return _with_evalues(spark, sf).where("e <= 10").select("query_id", "oid", "q_start", "s_start", "score")


@query(
    _with(_BASE, _words_sql(K), _ISLANDS)
    + """, o AS (SELECT *, max(q_end) OVER (PARTITION BY query_id, oid ORDER BY q_start, q_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM hsp),
r AS (SELECT *, sum(CASE WHEN q_start <= far THEN 0 ELSE 1 END) OVER (PARTITION BY query_id, oid ORDER BY q_start, q_end ROWS UNBOUNDED PRECEDING) AS run FROM o),
u AS (SELECT query_id, oid, run, max(q_end) - min(q_start) AS n FROM r GROUP BY query_id, oid, run)
SELECT query_id, oid, CAST(sum(n) AS BIGINT) AS covered, round(sum(n) / length(any_value(q.residues)), 6) AS share FROM u JOIN q USING (query_id) GROUP BY query_id, oid"""
)
def query_coverage(spark, sf):
    plain = lambda i: ranges.coverage(_as_hsps(i), _q(spark, sf)).select("query_id", "oid", "covered", F.round("share", 6).alias("share"))
    alone = lambda f, s: ranges.shares(scan.covered(f, s), _q(spark, sf)).withColumn("share", F.round("share", 6))
    return _of_islands(spark, sf, alone, plain)


@query()
def hsp_chains(spark, sf):
    return H.linked(_hsps(spark, sf))


@query()
def mask_level_filter(spark, sf):
    return H.masked_level(_of_islands(spark, sf, lambda q, s: scan.best_of_ranges(q, s, 1), _as_hsps))


# ------------------------------------------------------------------ subjects


@query(_with(_BASE) + f"SELECT oid, CAST(c AS INT) AS chunk, CAST(c * {CHUNK - OVERLAP} AS INT) AS start, substr(residues, CAST(c AS BIGINT) * {CHUNK - OVERLAP} + 1, {CHUNK}) AS residues FROM s, LATERAL (SELECT unnest(range(0, greatest(CAST(ceil((length(residues) - {OVERLAP}) / {CHUNK - OVERLAP}.0) AS BIGINT), 1))) AS c)")
def subject_chunks(spark, sf):
    return ranges.chunks(_s(spark, sf), CHUNK, OVERLAP).withColumns({"chunk": F.col("chunk").cast("int"), "start": F.col("start").cast("int")})


@query(
    _with(_BASE, _words_sql(K), _ISLANDS)
    + """, w AS (SELECT oid, greatest(s_start - 20, 0) AS f, s_end + 20 AS t FROM hsp),
o AS (SELECT *, max(t) OVER (PARTITION BY oid ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM w),
r AS (SELECT *, sum(CASE WHEN f <= far + 10 THEN 0 ELSE 1 END) OVER (PARTITION BY oid ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT oid, CAST(min(f) AS INT) AS "from", CAST(max(t) AS INT) AS "to" FROM r GROUP BY oid, run"""
)
def range_merge(spark, sf):
    return _of_islands(spark, sf, lambda q, s: scan.merged_ranges(q, s, 10, 20), lambda i: ranges.merged(_places(i), gap=10, pad=20).withColumns({"from": F.col("from").cast("int"), "to": F.col("to").cast("int")}))


def _places(islands: DataFrame) -> DataFrame:
    return islands.select("oid", F.col("s_start").alias("from"), (F.col("s_start") + F.col("length")).alias("to"))


@query(
    _with(_BASE, _words_sql(K), _ISLANDS)
    + """, w AS (SELECT oid, greatest(s_start - 20, 0) AS f, s_end + 20 AS t FROM hsp),
o AS (SELECT *, max(t) OVER (PARTITION BY oid ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM w),
r AS (SELECT *, sum(CASE WHEN f <= far + 10 THEN 0 ELSE 1 END) OVER (PARTITION BY oid ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS run FROM o),
u AS (SELECT oid, min(f) AS f, max(t) AS t FROM r GROUP BY oid, run)
SELECT oid, CAST(f AS INT) AS "from", CAST(least(t, length(residues)) AS INT) AS "to", substr(residues, CAST(f AS BIGINT) + 1, CAST(least(t, length(residues)) - f AS BIGINT)) AS residues FROM u JOIN s USING (oid)"""
)
def range_fetch(spark, sf):
    """The parts of subjects around their seeds."""
    plain = lambda i: ranges.fetched(_s(spark, sf), _places(i), gap=10, pad=20).withColumns({"from": F.col("from").cast("int"), "to": F.col("to").cast("int")})
    return _of_islands(spark, sf, lambda q, s: scan.merged_ranges(q, s, 10, 20, True).where("oid is not null"), plain)


@query(_with(_BASE) + "SELECT query_id, CAST(floor(before / 2000) AS INT) AS batch FROM (SELECT query_id, sum(length(residues)) OVER (ORDER BY query_id) - length(residues) AS before FROM q)")
def query_batches(spark, sf):
    return ranges.query_batches(_q(spark, sf), 2000).select("query_id", "batch")


@query(_with(_BASE) + "SELECT query_id, substr(residues, 11, 70) AS residues FROM q")
def query_location(spark, sf):
    return _q(spark, sf).select("query_id", R.restricted(F.col("residues"), "11-80")[0].alias("residues"))


@query()
def score_cutoffs(spark, sf):
    return H.cutoffs(_q(spark, sf), _s(spark, sf))


@query(_with(_BASE) + "SELECT CAST(floor(rn / 64) AS BIGINT) AS grp, count(*) AS n, CAST(max(len) AS BIGINT) AS longest, CAST(sum(len) AS BIGINT) AS residues FROM (SELECT length(residues) AS len, row_number() OVER (ORDER BY length(residues), oid) - 1 AS rn FROM s) GROUP BY 1")
def length_groups(spark, sf):
    return ranges.length_groups(_s(spark, sf), 64)


_BEFORE = "(SELECT oid, length(residues) AS len, sum(length(residues)) OVER (ORDER BY oid) - length(residues) AS before FROM s)"


@query(_with(_BASE) + f"SELECT oid, CAST(floor(before / 100000) AS INT) AS volume, CAST(row_number() OVER (PARTITION BY floor(before / 100000) ORDER BY len, oid) AS INT) AS place FROM {_BEFORE}")
def length_sorted_volumes(spark, sf):
    v = ranges.volumes(_s(spark, sf), 100_000)
    return v.select("oid", "volume", F.row_number().over(W.partitionBy("volume").orderBy("length", "oid")).alias("place"))


@query(_with(_BASE) + f"SELECT oid, CAST(least(floor(before * 4 / (SELECT sum(length(residues)) FROM s)), 3) AS INT) AS part FROM {_BEFORE}")
def balanced_partitions(spark, sf):
    return ranges.balanced(_s(spark, sf), 4)


@query(_with(_BASE) + "SELECT count(*) AS n, CAST(sum(length(residues)) AS BIGINT) AS residues, CAST(max(length(residues)) AS INT) AS longest, CAST(min(length(residues)) AS INT) AS shortest, CAST(floor(sum(length(residues)) / greatest(count(*), 1)) AS BIGINT) AS mean FROM s")
def db_stats(spark, sf):
    return catalog.stats(_s(spark, sf))


@query(_with(_BASE) + f"SELECT min(oid) AS oid FROM {_BEFORE} WHERE before + len > 50000")
def oid_at_residue(spark, sf):
    return catalog.oid_at(_s(spark, sf), 50_000)


def _labelled(spark: SparkSession, sf: str, which: str) -> DataFrame:
    return _table(spark, sf, "labels").where(f"{which} = 1").select(F.col("doc_id").cast("string").alias("subject_id"))


@query(_with(_BASE) + "SELECT oid, CAST(length(residues) AS INT) AS length FROM s WHERE oid IN (SELECT doc_id FROM labels WHERE quality = 1)")
def id_include(spark, sf):
    return catalog.restricted(_s(spark, sf), include=_labelled(spark, sf, "quality")).select("oid", "length")


@query(_with(_BASE) + "SELECT oid, CAST(length(residues) AS INT) AS length FROM s WHERE oid NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def id_exclude(spark, sf):
    return catalog.restricted(_s(spark, sf), exclude=_labelled(spark, sf, "toxic")).select("oid", "length")


@query(_with(_BASE) + "SELECT CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS taxid, count(*) AS n, CAST(sum(length(residues)) AS BIGINT) AS residues FROM s GROUP BY 1")
def taxid_totals(spark, sf):
    docs = _table(spark, sf, "documents")
    taxids = docs.select(F.col("doc_id").cast("string").alias("subject_id"), F.regexp_extract("source", "([0-9]+)$", 1).cast("int").alias("taxid"))
    return catalog.with_taxids(_s(spark, sf), taxids=taxids).groupBy("taxid").agg(F.count("*").alias("n"), F.sum("length").alias("residues"))


@query("SELECT upper(source) AS id, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return catalog.duplicate_ids(_table(spark, sf, "documents").where("source is not null").withColumnRenamed("source", "subject_id"))


@query(_with(_BASE) + "SELECT md5(residues) AS hash, count(*) AS n, min(oid) AS first FROM s GROUP BY residues HAVING count(*) > 1")
def sequence_hash_dups(spark, sf):
    return catalog.with_hash(_s(spark, sf)).groupBy("hash").agg(F.count("*").alias("n"), F.min("oid").alias("first")).where("n > 1")


_LOWER = """
letter AS (SELECT doc_id AS oid, regexp_replace(text, '[^A-Za-z]', '', 'g') AS t FROM documents),
part AS (SELECT oid, p, i FROM (SELECT oid, regexp_extract_all(t, '[a-z]+|[A-Z]+') AS ps FROM letter), LATERAL (SELECT unnest(ps) AS p, generate_subscripts(ps, 1) AS i)),
placed AS (SELECT oid, p, sum(length(p)) OVER (PARTITION BY oid ORDER BY i) AS e FROM part),
mask AS (SELECT oid, CAST(e - length(p) AS INT) AS "from", CAST(e AS INT) AS "to" FROM placed WHERE p[1] BETWEEN 'a' AND 'z'),
"""


@query(_with(_LOWER) + "SELECT * FROM mask")
def mask_ranges_lowercase(spark, sf):
    return _masks(spark, sf).withColumns({"from": F.col("from").cast("int"), "to": F.col("to").cast("int")})


@query(_with(_BASE) + "SELECT oid, md5(translate(residues, 'BZU', 'XXX')) AS masked, CAST(length(residues) - length(replace(translate(residues, 'BZU', 'XXX'), 'X', '')) AS INT) AS n_x FROM s")
def masked_letters(spark, sf):
    m = R.masked(F.col("residues"), "BZU")
    return _s(spark, sf).select("oid", F.md5(m).alias("masked"), (F.length(m) - F.length(F.replace(m, F.lit("X"), F.lit("")))).alias("n_x"))


@query(_with(_BASE, _words_sql(K), _LOWER) + f"SELECT * FROM seed WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE m.oid = seed.oid AND m.\"to\" - m.\"from\" >= 12 AND m.\"from\" < seed.s_pos + {K} AND m.\"to\" > seed.s_pos)")
def seed_soft_mask_antijoin(spark, sf):
    return words.unmasked(_seeds(spark, sf), _masks(spark, sf).where(F.col("to") - F.col("from") >= 12), K)


# ------------------------------------------------------------------ bases and files

_CODON = ", ".join(f"('{a}{b}{c}', '{R.CODE_1[16 * i + 4 * j + k]}')" for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG"))
_FRAMES = f"""
codon(c, aa) AS (VALUES {_CODON}),
strand AS (SELECT query_id, f, CASE WHEN f > 0 THEN bases ELSE translate(reverse(bases), 'ACGT', 'TGCA') END AS b FROM n, (VALUES (1), (2), (3), (-1), (-2), (-3)) v(f)),
cod AS (SELECT query_id, f, i, substr(b, CAST(abs(f) + 3 * i AS BIGINT), 3) AS c FROM strand, LATERAL (SELECT unnest(range(0, CAST(floor((length(b) - abs(f) + 1) / 3) AS BIGINT))) AS i)),
"""


@query(_with(_BASE, _FRAMES) + "SELECT query_id, CAST(f AS INT) AS frame, string_agg(aa, '' ORDER BY i) AS residues FROM cod JOIN codon USING (c) GROUP BY query_id, f")
def six_frame_translation(spark, sf):
    from strandloom.plans.search import contexts

    n = _n(spark, sf).withColumnRenamed("bases", "residues")
    return contexts(n, SearchOptions(task="translated")).select("query_id", "frame", "residues")


@query(_with(_BASE) + "SELECT query_id, translate(reverse(bases), 'ACGT', 'TGCA') AS bases FROM n")
def reverse_complement(spark, sf):
    return _n(spark, sf).select("query_id", R.reverse_complement(F.col("bases")).alias("bases"))


@query(
    _with(_BASE)
    + """SELECT query_id, CAST(f AS INT) AS frame, CAST(p AS INT) AS position, CAST(CASE WHEN f > 0 THEN p * 3 + f - 1 ELSE length(bases) - (p + 4) * 3 - abs(f) + 1 END AS INT) AS base_from,
CAST(CASE WHEN f > 0 THEN (p + 4) * 3 + f - 1 ELSE length(bases) - p * 3 - abs(f) + 1 END AS INT) AS base_to
FROM n, (VALUES (1), (2), (3), (-1), (-2), (-3)) v(f), (VALUES (0), (5), (11)) w(p)"""
)
def frame_to_dna_coords(spark, sf):
    grid = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(p).alias("p")) for f in (1, 2, 3, -1, -2, -3) for p in (0, 5, 11)]))
    rows = _n(spark, sf).select("query_id", F.length("bases").alias("n"), grid.alias("x"))
    on = R.bases_range(F.col("x.p"), F.col("x.p") + 4, F.col("x.f"), F.col("n"))
    return rows.select("query_id", F.col("x.f").alias("frame"), F.col("x.p").alias("position"), on["from"].alias("base_from"), on["to"].alias("base_to"))


_RENDER = r"""SELECT oid, md5('>' || oid || chr(10) || regexp_replace(regexp_replace(residues, '(.{60})', '\1' || chr(10), 'g'), chr(10) || '$', '')) AS record FROM s"""


@query(_with(_BASE) + _RENDER)
def fasta_render(spark, sf):
    return _s(spark, sf).select("oid", F.md5(fasta.render(F.col("subject_id"), F.col("residues"))).alias("record"))


@query(_with(_BASE) + "SELECT CAST(oid AS VARCHAR) AS subject_id, 'title ' || oid AS title, CAST(length(residues) AS INT) AS length, md5(residues) AS hash FROM s")
def fasta_parse(spark, sf):
    raw = _s(spark, sf).select(F.concat(fasta.render(F.concat_ws(" ", "subject_id", F.concat(F.lit("title "), "subject_id")), F.col("residues")), F.lit("\n")).alias("value"))
    return fasta.parse(raw).select("subject_id", "title", "length", F.md5("residues").alias("hash"))


@query(
    _with(_BASE)
    + """, z AS (SELECT oid, length(residues) + length(CAST(oid AS VARCHAR)) + 1 + 1 + CAST(ceil(length(residues) / 60.0) AS BIGINT) AS size FROM s),
b AS (SELECT oid, size, sum(size) OVER (ORDER BY oid) - size AS before, (SELECT sum(size) FROM z) AS total FROM z)
SELECT oid AS ord, CAST(size AS BIGINT) AS size, CAST(least(floor((before + size / 2) * 5 / total) + 1, 5) AS INT) AS part FROM b"""
)
def fasta_split(spark, sf):
    r = _s(spark, sf).select(F.col("oid").alias("ord"), F.col("subject_id").alias("defline"), "residues")
    return fasta.split_parts(r, 5)


@query()
def smith_waterman(spark, sf):
    """Full local alignment of every query with the documents that share a rare word with it."""
    from strandloom.operators.pairs import local_scores

    plain = lambda i: local_scores(i.where("length >= 16").select("query_id", "oid").distinct(), _q(spark, sf), _s(spark, sf))
    return _of_islands(spark, sf, lambda q, s: scan.local_scores(q, s, 16), plain)


@query()
def exhaustive_search(spark, sf):
    """Every query against every subject by full local alignment, without words: what scores an E-value of 0.001 or less."""
    from strandloom.operators.pairs import every_subject

    q, s = _q(spark, sf), _s(spark, sf)
    least = H.spaces(q, s).select("query_id", H.least_score(F.col("space"), 1e-3).alias("least"))
    h = every_subject(q, s, least)
    return h.select("query_id", "oid", "score", "q_start", "q_end", "s_start", "s_end", "identities", F.size("script").alias("runs"))


@query()
def low_complexity_masks(spark, sf):
    from strandloom.functions.masking import low_complexity
    from strandloom.plans.shipping import ready

    ready(spark)
    return low_complexity(_s(spark, sf))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

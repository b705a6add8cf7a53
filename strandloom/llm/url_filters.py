"""URL filters: rules by host and path, and a tree of path templates for every other url.

Only DataFrame functions.  Level by level, the segments below a host's template so far become
a wildcard if they look variable (digits, hex, ids), if the node has many rare children, or if
their labels do not differ from their siblings' (with at least ``support`` labels on either side:
too few labels to tell merge nothing).  A template is rejected if the smoothed share
of good labels among its urls is too small; what a template lacks in labels comes from its
host, and the host's from all.

A null url, or one without ``://``, has an empty host and path.  Rules come first, the longest
that fits.  Repeated rows and equal ids are judged row by row; extra columns are ignored.
Very long paths are followed to their end.  ``labels`` are labels of the urls' own ids, from any table that has them.  Rules of equal length cannot both fit unless their
hosts differ in length; then the greater string wins.  Labels of one id add up.  Without labels nothing is
rejected; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (host/path, verdict); a rule fits its host and all subdomains of it.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments that are variable by their looks.
VARIABLE = r"^[0-9][0-9_.,-]*(\.[a-z0-9]{2,5})?$|^[0-9a-f]{8,}(-[0-9a-f]{4,})*$|^(?=[^0-9]*[0-9])[A-Za-z0-9_=-]{16,}$"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    if len(rules) > 1000:
        raise ValueError("rules become one expression: at most 1,000")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + tail))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


#: Levels after which the paths that are done so far are written, so that no plan grows with the depth.
_LEVELS = 12


def _looks(segs: Column) -> Column:
    """Segments as the end of a template, each by its looks alone."""
    return F.array_join(F.transform(segs, lambda s: F.concat(F.lit("/"), F.when(s.rlike(VARIABLE), "*").otherwise(s))), "")


def templates(paths: DataFrame, *, most_children: int = 64, rare: float = 0.02, z: float = 1.96, support: int = 5) -> DataFrame:
    """(host, path, template) of a table (host, path, n, good, bad) with one row for each path.

    A path that is the last one below its template so far has no siblings, so the rest of it goes by its looks at once.  Where all
    paths below a template share their next segments, they go on to where the first of them parts from the others, or ends.  So there are as many
    rounds as levels at which paths part, however deep they are.
    """
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    fields = ("host", "path", "n", "good", "bad", "segs", "t")  # segs: those that are not yet in the template t
    rest = lambda taken: F.slice("segs", taken + 1, F.greatest(F.size("segs") - taken, F.lit(0)))

    def parted(state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Paths that go on, and the finished ones with their templates."""
        more = F.size("segs") > 0
        # Written, so that Spark can split the join at a host that has many of the paths.
        many = written(state.where(more).groupBy("host", "t").agg(F.count("*").alias("paths")).where("paths > 1"), "many")
        both = written(state.join(many, ["host", "t"], "left").withColumn("on", more & F.col("paths").isNotNull()), "level")
        return both.where("on").select(*fields), both.where("not on").select("host", "path", "n", "good", "bad", F.concat("t", _looks(F.col("segs"))).alias("template"))

    def run_on(state: DataFrame, nodes: DataFrame) -> DataFrame:
        """The paths below templates with one next segment, at the place where the first of them parts from the others (or all have ended)."""
        own = state.join(nodes, ["host", "t"], "left_semi")
        # Paths that part from one another part from the longest one, there or before.
        longest = written(own.groupBy("host", "t").agg(F.max(F.struct(F.size("segs").alias("z"), "segs")).alias("x")).select("host", "t", F.col("x.segs").alias("r")), "longest")
        apart = F.array_position(F.zip_with("segs", F.slice("r", F.lit(1), F.size("segs")), lambda x, y: x == y), F.lit(False))  # 0: nowhere
        taken = written(own.join(longest, ["host", "t"]).groupBy("host", "t").agg(F.coalesce(F.min(F.when(apart > 0, apart - 1)), F.max(F.size("r"))).cast("int").alias("taken")), "taken")
        k = F.least("taken", F.size("segs"))
        moved = own.join(taken, ["host", "t"]).select("host", "path", "n", "good", "bad", rest(k).alias("segs"), F.concat("t", _looks(F.slice("segs", F.lit(1), k))).alias("t"))
        return moved.select(*fields)

    state, found = parted(paths.select("host", "path", "n", "good", "bad", segs.alias("segs"), F.lit("").alias("t")))
    level = 0
    while not state.isEmpty():
        seg = F.get("segs", F.lit(0))
        child = written(state.groupBy("host", "t", seg.alias("seg")).agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")]), "children")
        node = written(child.groupBy("host", "t").agg(F.count("*").alias("kinds"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "good", "bad")]), "nodes")
        known, others = F.col("good") + F.col("bad"), F.col("all_good") + F.col("all_bad") - F.col("good") - F.col("bad")
        share = lambda good, of: F.try_divide(good.cast("double"), of.cast("double"))
        pooled = share(F.col("all_good"), F.col("all_good") + F.col("all_bad"))
        noise = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (share(F.lit(1), known) + share(F.lit(1), others)))
        apart = F.try_divide(F.abs(share(F.col("good"), known) - share(F.col("all_good") - F.col("good"), others)), noise)
        alike = (known >= support) & (others >= support) & (apart < z)
        wild = F.col("seg").rlike(VARIABLE) | ((F.col("kinds") > most_children) & (F.col("n") < rare * F.col("all_n"))) | alike
        step = child.join(node.where("kinds > 1"), ["host", "t"]).select("host", "t", "seg", F.when(F.coalesce(wild, F.lit(False)), "*").otherwise(F.col("seg")).alias("next"))
        after = state.withColumn("seg", seg).join(step, ["host", "t", "seg"]).select("host", "path", "n", "good", "bad", rest(F.lit(1)).alias("segs"), F.concat("t", F.lit("/"), "next").alias("t"))
        alone = node.where("kinds = 1").select("host", "t")
        if not alone.isEmpty():
            after = after.unionByName(run_on(state, alone))
        level += 1
        state, more = parted(written(after, "step"))
        found = found.unionByName(more)
        if level % _LEVELS == 0:
            found = written(found, "found")
    return found


def judge(pages: DataFrame, labels: DataFrame | None, *, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id", label: str = "quality", rules: tuple[tuple[str, str], ...] = RULES, least_purity: float = 0.5, weight: float = 8.0, **tree) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every page.

    labels: 1 (good) or 0 (bad) for some page ids.
    """
    host, path = parts(F.col(url))
    urls = pages.select(F.col(page_id).alias("i"), host.alias("host"), path.alias("path"))
    if labels is None:
        known = urls.withColumns({"good": F.lit(0).cast("long"), "bad": F.lit(0).cast("long")})
    else:
        votes = labels.select(F.col(label_id).alias("i"), F.col(label).alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.sum("y").cast("long").alias("good"), F.sum(1 - F.col("y")).cast("long").alias("bad"))
        known = urls.join(votes, "i", "left").fillna(0, ["good", "bad"])
    paths = written(known.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")), "paths")
    total = paths.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    prior = (total["g"] + 1) / (total["g"] + total["b"] + 2) if total["g"] is not None and total["g"] + total["b"] else 1.0
    found = templates(paths, **tree)
    hosts = paths.groupBy("host").agg(((F.sum("good") + weight * prior) / (F.sum("good") + F.sum("bad") + weight)).alias("host_purity"))
    per = found.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).join(hosts, "host")
    per = per.select("host", "template", ((F.col("good") + weight * F.col("host_purity")) / (F.col("good") + F.col("bad") + weight)).alias("purity"))
    verdicts = found.select("host", "path", "template").join(per, ["host", "template"])
    rule, says = ruled(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("purity") < least_purity, "block").otherwise("allow")
    return urls.join(verdicts, ["host", "path"]).select(F.col("i").alias(page_id), "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), "template", "purity")

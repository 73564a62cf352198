"""URL filters by path-template trees, by DataFrame functions alone.

The urls of a host form a tree of path segments. Round by round, each node first goes down what all its urls share; where they
part, segments that vary (numbers, hashes, dates, or more than BRANCHES siblings that are rare each) become a wildcard, and
siblings that can't be told apart are merged: labelled ones by their shares of blocked urls, others by the shapes of what
follows them. Rules label the urls they fit; a template (a leaf of the tree) is rejected where its smoothed share of
blocked urls reaches PURITY, counting SMOOTH allowed ones that nobody saw and, for each url without a label, UNSEEN of one.
A url's own rule goes before its template. All statistics are of distinct (host, path) pairs' counts, pre-aggregated, never
of one host's rows in one task. Rounds end when no node parts any more: as many as a host's urls part one below the other.

Defined results: null urls and those without :// have an empty host and path, no rule, and the verdict of the empty host's
template. Empty segments don't count, but for one at the end. Without labels everything is allowed. Repeated rows give
repeated rows; an empty table an empty one; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import durable, even_join

BRANCHES = 12
RARE = 0.2
SMOOTH = 2.0
UNSEEN = 0.5
ALIKE = 8  # distinct urls that a branch without labels must have to be called like another
PURITY = 0.5
DOUBT = 1.96  # standard errors within which shares can't be told apart

#: Rules of the query: verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
VARIES = r"^(?:[0-9]+|[0-9a-f]{8,}|[0-9a-f]{8}-[0-9a-f-]{27}|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?)(?:\.[a-z0-9]{1,5})?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host with A-Z in lower case, and the path; both empty for null or without ://."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(text, whole, 1), upper, upper.lower()), F.regexp_extract(text, whole, 2)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    order = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda r: ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
    pick = lambda of: reduce(lambda rest, r: F.when(fits(r), F.lit(of(r))).otherwise(rest), order, F.lit(None).cast("string"))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


#: What the segment after a branch may look like; "end" where nothing follows.
SHAPES = ("end", "varies", "digits", "plain")


def _shape(segment: Column) -> Column:
    return F.when(segment.isNull(), "end").when(segment.rlike(VARIES), "varies").when(segment.rlike("[0-9]"), "digits").otherwise("plain")


def _written(segment: Column) -> Column:
    return F.when(segment.rlike(VARIES), "*").otherwise(segment)


def _shared(tree: DataFrame) -> DataFrame:
    """tree with the segments that all urls of a node begin with moved to its template, and how many urls the node has."""
    ends = tree.groupBy("host", "template").agg(F.min("segments").alias("least"), F.max("segments").alias("most"), F.count("*").alias("urls"))
    apart = F.zip_with("least", "most", lambda a, b: F.coalesce(a != b, F.lit(True)))  # of all arrays, the least and the most share what all share
    length = F.array_position(apart, F.lit(True))
    ends = ends.select("host", "template", "urls", F.when(length > 0, length - 1).otherwise(F.size("least")).cast("int").alias("common"))
    joined = even_join(tree, ends, ["host", "template"])
    lead = F.transform(F.slice("segments", 1, F.col("common")), lambda x: F.concat(F.lit("/"), _written(x)))
    rest = F.slice("segments", F.col("common") + 1, F.size("segments"))
    return joined.withColumn("template", F.concat("template", F.array_join(lead, ""))).withColumn("segments", rest).drop("common")


def _merged(nodes: DataFrame) -> DataFrame:
    """(host, template, segment, merged) of siblings that can't be told apart from what they have in common."""
    share, error = F.col("blocked") / F.col("labelled"), lambda p, n: F.sqrt(p * (1 - p) / n + 1 / (4 * n * n))
    leaning = F.when(F.col("labelled") == 0, "open").when(share - DOUBT * error(share, F.col("labelled")) > PURITY, "block").when(share + DOUBT * error(share, F.col("labelled")) < PURITY, "allow").otherwise("mixed")
    leant = nodes.withColumn("leaning", leaning)
    pooled = leant.where("labelled > 0").groupBy("host", "template", "leaning").agg((F.sum("blocked") / F.sum("labelled")).alias("pool"), F.count("*").alias("siblings"))
    alike = even_join(leant, pooled.where("siblings > 1"), ["host", "template", "leaning"])
    alike = alike.where(F.abs(share - F.col("pool")) <= DOUBT * error(F.col("pool"), F.col("labelled"))).select("host", "template", "segment", F.concat(F.lit("~"), "leaning").alias("merged"))
    # branches without labels join those that lean to blocked where the shapes of what follows agree
    some = leant.where((F.col("urls") >= ALIKE) & F.col("leaning").isin("open", "block"))
    pool = some.where("leaning = 'block'").groupBy("host", "template").agg(F.sum("urls").alias("all"), *(F.sum(k).alias(f"all_{k}") for k in SHAPES))
    near = even_join(some.where("leaning = 'open'"), pool, ["host", "template"])
    p = lambda k: F.col(f"all_{k}") / F.col("all")
    for k in SHAPES:
        near = near.where(F.abs(F.col(k) / F.col("urls") - p(k)) <= DOUBT * (error(p(k), F.col("urls")) + error(p(k), F.col("all"))))
    return alike.unionByName(near.select("host", "template", "segment", F.lit("~block").alias("merged")))


def templates(urls: DataFrame) -> DataFrame:
    """(host, path, template) of distinct urls (host, path, n, labelled, blocked)."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    tree, done = urls.withColumn("segments", segments).withColumn("template", F.lit("")), None
    tree = durable(tree, "urls")
    while True:
        tree = durable(_shared(tree), "tree")
        ended = tree.where("urls = 1 or size(segments) = 0").drop("urls", "segments")
        done = ended if done is None else done.unionByName(ended)
        tree = tree.where("urls > 1 and size(segments) > 0").drop("urls")
        if tree.isEmpty():
            break
        tree = tree.withColumn("segment", _written(F.get("segments", F.lit(0)))).withColumn("next", _shape(F.get("segments", F.lit(1))))
        nodes = tree.groupBy("host", "template", "segment").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked")), F.count("*").alias("urls"), *(F.count_if(F.col("next") == k).alias(k) for k in SHAPES))
        nodes = durable(nodes, "nodes")
        parents = nodes.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("n").alias("all"))
        wild = parents.where((F.col("children") > BRANCHES) & (F.col("children") > RARE * F.col("all"))).select("host", "template", F.lit(True).alias("wild"))
        tree = even_join(even_join(tree, wild, ["host", "template"], "left"), _merged(nodes), ["host", "template", "segment"], "left")
        step = F.concat(F.lit("/"), F.coalesce("merged", F.when(F.col("wild"), "*"), "segment"))
        rest = F.slice("segments", 2, F.size("segments"))
        tree = tree.select(*urls.columns, rest.alias("segments"), F.concat("template", step).alias("template"))
    slash = F.col("path").endswith("/") & (F.col("path") != "/")
    return done.withColumn("template", F.when(slash, F.concat("template", F.lit("/"))).otherwise(F.col("template")))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity for every row of pages (page_id, url, ...)."""
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = longest_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)
    urls = seen.groupBy("host", "path").agg(F.count("*").alias("n"))
    urls = urls.withColumn("rule", rule).withColumn("said", said)
    urls = urls.withColumn("labelled", F.when(F.col("said").isNull(), 0).otherwise(F.col("n"))).withColumn("blocked", F.when(F.col("said") == "block", F.col("n")).otherwise(0))
    placed = templates(urls)
    pure = placed.groupBy("host", "template").agg((F.sum("blocked") / (F.sum("labelled") + UNSEEN * F.sum(F.col("n") - F.col("labelled")) + SMOOTH)).alias("purity"))
    judged = even_join(placed, pure, ["host", "template"])
    verdict = F.coalesce("said", F.when(F.col("purity") >= PURITY, "block").otherwise("allow"))
    return even_join(seen, judged.select("host", "path", "rule", verdict.alias("verdict"), "template", "purity"), ["host", "path"])

"""URL filter by a tree of path templates; DataFrame operations only.

The paths of a host form a tree of segments, to the depth that they have. From the root down, a node's children are judged one by one: a child with
``LEAST_PAGES`` pages or ``LEAST_LABELS`` labels stands for itself, all others are variable and become the wildcard ``*``. The children that stand for
themselves are ordered by their smoothed share of bad labels and neighbours whose shares differ by less than ``SIMILAR_Z`` standard errors
are merged into one branch, named by its first segment and the number of the others. A path's template is its branches from root to leaf.

A template's purity is its share of bad labels, smoothed with ``STRENGTH`` pseudo-labels towards its parent's share, the parent's
towards the grandparent's, up to the share of all labels (``NO_LABELS`` if there is none). Templates of ``REJECT`` or more are
blocked. Rules (host and path prefix, for the host and its subdomains) go first; the longest that fits decides.

Null urls and urls without ``://`` have an empty host and path; they form one template. Repeated rows are judged alike. Labels
may be null. Columns of the input may have any names; those named like a result are replaced. An empty table gives no rows. Very long urls are cut at
their slashes, a level at a time. Joins are equality joins whose hot keys adaptive execution splits; only counts are
summed, never lists of rows. Children of one node with equal counts are ordered as one, so a window holds a node's different pairs of counts, however many
children it has. The rule list is bounded by ``MAX_RULES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from nearpass.llm.common import checkpointed

LEAST_PAGES = 8
LEAST_LABELS = 3
SIMILAR_Z = 1.5
STRENGTH = 8.0
REJECT = 0.5
NO_LABELS = 0.2
MAX_RULES = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a url, both empty if there is no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.greatest(F.length(rest), F.lit(1))), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does; of equally long ones the first in the list.

    A rule is a verdict and ``host/path``: it fits the host and its subdomains where the path starts with the rule's.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules are above the bound of {MAX_RULES}")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _smoothed(bad: str, n: str, towards: Column) -> Column:
    return (F.col(bad) + F.lit(STRENGTH) * towards) / (F.col(n) + F.lit(STRENGTH))


def branches(rows: DataFrame, prior: float) -> DataFrame:
    """(node, segment, child, share): the node below ``node`` that rows with this segment go to, and its smoothed share of bad labels.

    ``rows`` has node, up (the node's share), segment, b and n (bad labels and labels of the row).
    """
    each = rows.groupBy("node", "segment").agg(F.first("up").alias("up"), F.count(F.lit(1)).alias("pages"), F.sum("b").alias("b"), F.sum("n").alias("n"))
    each = checkpointed(each.withColumn("own", (F.col("pages") >= LEAST_PAGES) | (F.col("n") >= LEAST_LABELS)))
    alike = each.filter("own").groupBy("node", "b", "n").agg(F.min("segment").alias("first"), F.count(F.lit(1)).alias("many"))
    alike = alike.withColumn("r", _smoothed("b", "n", F.lit(prior)))
    order = W.partitionBy("node").orderBy("r", "n")
    mean = (F.col("r") + F.lag("r").over(order)) / 2
    error = F.sqrt(mean * (1 - mean) * (1 / (F.col("n") + STRENGTH) + 1 / (F.lag("n").over(order) + STRENGTH)))
    apart = alike.withColumn("new", F.coalesce((F.col("r") - F.lag("r").over(order) > SIMILAR_Z * error).cast("int"), F.lit(0)))
    group = apart.withColumn("g", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    every = W.partitionBy("node", "g")
    many = F.sum("many").over(every)
    name = F.when(many > 1, F.concat(F.min("first").over(every), F.lit("|+"), (many - 1).cast("string"))).otherwise(F.min("first").over(every))
    named = group.select("node", "b", "n", F.lit(True).alias("own"), name.alias("name"))
    placed = each.join(named, ["node", "b", "n", "own"], "left").withColumn("child", F.concat_ws("/", "node", F.coalesce("name", F.lit("*"))))
    total = placed.groupBy("child").agg(F.first("up").alias("up"), F.sum("b").alias("b"), F.sum("n").alias("n"))
    share = total.select("child", _smoothed("b", "n", F.col("up")).alias("share"))
    return checkpointed(placed.select("node", "segment", "child").join(share, "child"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", bad: str = "bad") -> DataFrame:
    """The rows with ``host``, ``path``, ``rule``, ``verdict`` (allow or block), ``template`` and ``purity``.

    ``bad`` is 1 for labelled bad pages, 0 for labelled good ones, null for the rest.
    """
    results = ("host", "path", "rule", "verdict", "template", "purity")
    rest = [c for c in pages.columns if c.lower() not in results and c != bad]
    # the caller's columns travel in one struct, so none of them can be taken for one of these
    mine = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{url}`").alias("url"), F.col(f"`{bad}`").cast("int").alias("bad"))
    host, path = host_and_path(F.col("url"))
    rows = mine.select("row", host.alias("host"), path.alias("path"), F.coalesce("bad", F.lit(0)).cast("long").alias("b"), F.col("bad").isNotNull().cast("long").alias("n"))
    rows = checkpointed(rows.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")))
    whole = rows.agg(F.sum("b"), F.sum("n")).first()
    prior = whole[0] / whole[1] if whole[1] else NO_LABELS
    hosts = rows.groupBy("host").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).select("host", _smoothed("b", "n", F.lit(prior)).alias("up"))
    at = checkpointed(rows.join(hosts, "host").withColumn("node", F.col("host")))
    done, depth = [], 0
    while True:
        done.append(at.filter(F.size("segments") <= depth))
        deeper = at.filter(F.size("segments") > depth).withColumn("segment", F.get("segments", F.lit(depth)))
        if deeper.isEmpty():
            break
        below = branches(deeper.select("node", "up", "segment", "b", "n"), prior)
        at = checkpointed(deeper.join(below, ["node", "segment"]).select(*[c for c in at.columns if c not in ("node", "up")], F.col("child").alias("node"), F.col("share").alias("up")))
        depth += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = out.withColumn("fits", fitting_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("fits.verdict", F.when(F.col("up") >= REJECT, "block").otherwise("allow"))
    return out.select(*[F.col(f"row.`{c}`") for c in rest], "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"),
                      F.col("node").alias("template"), F.col("up").alias("purity"))

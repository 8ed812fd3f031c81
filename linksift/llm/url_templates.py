"""URL verdicts by rules and, where none fits, by a tree of path templates.

Every host has a tree of path segments. Digits in a segment become ``#``; a node with more than
``CHILDREN`` different children gets one wildcard child ``*`` instead. Labelled pages are counted at
the leaves (templates). From the host downwards, sibling branches whose shares of bad pages do not
differ significantly are merged as wholes; the share of a merged branch is drawn towards that of the
branch above it, and that of a host towards all hosts. A template is rejected if its smoothed share
reaches ``PURITY``. A template without labels takes the share of its nearest labelled branch, to
which the share of the pages of its own shape on all hosts is drawn.

A null url, or one without ``://``, has an empty host and path and is allowed unless a rule fits.
Repeated rows are judged alike; an empty table gives no rows. Only DataFrame functions are used.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linksift.llm.tables import settle

DEPTH = 6
CHILDREN = 30
SMOOTHING = 20.0
PURITY = 0.9
DIFFERS = 1.96
#: A side of a join is broadcast only up to so many rows (of a shape and two counts).
BROADCAST_ROWS = 100_000

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), path


def with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``ruled`` (its verdict): the longest rule that fits, block before allow.

    Rules are looked up per host, by all its suffixes; a page then tries the rules of its host.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    fitting = pages.select("host").distinct().select("host", F.explode(suffixes).alias("rule_host")).join(
        rules.select(F.col("host").alias("rule_host"), F.col("path").alias("start"), "verdict"), "rule_host"
    )
    name = F.concat("rule_host", "start")
    each = F.struct(F.length(name).alias("long"), F.col("verdict").alias("verdict"), name.alias("name"), F.col("start").alias("start"))
    by_host = fitting.groupBy("host").agg(F.collect_list(each).alias("rules"))
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"])))
    return (
        pages.join(by_host, "host", "left")
        .withColumn("_best", best)
        .withColumn("rule", F.col("_best.name"))
        .withColumn("ruled", F.col("_best.verdict"))
        .drop("_best", "rules")
    )


def _shape(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]+", "#")


def templates(counted: DataFrame, depth: int = DEPTH, children: int = CHILDREN) -> DataFrame:
    """Adds ``parent`` and ``template`` to a table of host, shape, n and bad.

    Level by level, a node's children are counted and replaced by a wildcard if there are too many.
    Segments beyond ``depth`` stay one last segment.
    """
    parts = F.split("shape", "/")
    pieces = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    cut = F.when(
        F.size(pieces) > depth,
        F.concat(F.slice(pieces, 1, depth - 1), F.array(F.array_join(F.slice(pieces, depth, F.size(pieces)), "/"))),
    ).otherwise(pieces)
    level = counted.select("host", "shape", "n", "bad", cut.alias("pieces"), F.lit("").alias("parent"), F.lit("").alias("template"))
    for at in range(depth):
        here = level.withColumn("piece", F.get("pieces", F.lit(at)))
        kinds = here.where("piece is not null").groupBy("host", "template", "piece").agg(F.lit(1).alias("one"))
        wide = kinds.groupBy("host", "template").agg((F.count("*") > children).alias("wide")).where("wide")
        here = here.join(wide, ["host", "template"], "left")
        child = F.concat_ws("/", "template", F.when(F.col("wide"), F.lit("*")).otherwise(F.col("piece")))
        level = settle(
            here.select(
                "host",
                "shape",
                "n",
                "bad",
                "pieces",
                F.when(F.col("piece").isNull(), F.col("parent")).otherwise(F.col("template")).alias("parent"),
                F.when(F.col("piece").isNull(), F.col("template")).otherwise(child).alias("template"),
            ),
            "templates",
        )
    return level.drop("pieces")


def branch_shares(level: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """Adds ``smoothed`` to the table of host, shape, n, bad and template, from the hosts downwards.

    At every level the whole branches below one node are merged where their shares do not differ,
    and a merged branch is drawn towards the one above. A branch without labels keeps the share of
    the one above, so a template ends with that of its nearest labelled branch.
    """
    hosts = level.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("bad").alias("host_bad"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_bad").alias("bad")).first()
    prior = (total["bad"] or 0) / max(total["n"] or 0, 1)
    host_share = (F.col("host_bad") + smoothing * prior) / (F.col("host_n") + smoothing)
    now = level.join(hosts.select("host", host_share.alias("smoothed")), "host")
    now = now.withColumn("deep", F.size(F.split("template", "/")) - 1)
    # Siblings in order of their share: one that differs from the one before begins a new branch.
    # A node has at most CHILDREN children, so these windows are small.
    siblings = W.partitionBy("host", "above").orderBy("share", "node")
    n0, bad0 = F.lag("n").over(siblings), F.lag("bad").over(siblings)
    pooled = (F.col("bad") + bad0) / (F.col("n") + n0)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / n0))
    gap = F.abs(F.col("share") - bad0 / n0)
    begins = F.when(n0.isNull(), 0).when((spread > 0) & (gap > DIFFERS * spread), 1).otherwise(0)
    whole = W.partitionBy("host", "above", "branch")
    drawn = (F.sum("bad").over(whole) + smoothing * F.col("smoothed")) / (F.sum("n").over(whole) + smoothing)
    for at in range(1, DEPTH + 1):
        # The last segment may hold more than one slash.
        node = F.col("template") if at == DEPTH else F.substring_index("template", "/", at + 1)
        here = now.where(F.col("deep") >= at).select(
            "host", F.substring_index("template", "/", at).alias("above"), node.alias("node"), "n", "bad", "smoothed"
        )
        nodes = here.groupBy("host", "above", "node").agg(
            F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max("smoothed").alias("smoothed")
        )
        marked = nodes.where("n > 0").withColumn("share", F.col("bad") / F.col("n")).withColumn("begins", begins)
        branch = marked.withColumn("branch", F.sum("begins").over(siblings))
        found = branch.select("host", F.col("node").alias("at_node"), drawn.alias("found"))
        now = now.withColumn("at_node", F.when(F.col("deep") >= at, node)).join(found, ["host", "at_node"], "left")
        now = now.withColumn("smoothed", F.coalesce("found", "smoothed")).drop("at_node", "found")
        now = settle(now, "shares")
    return now.drop("deep")


def rejected_shapes(level: DataFrame, smoothing: float = SMOOTHING, purity: float = PURITY) -> DataFrame:
    """(host, shape) of the paths whose template labelled pages show to be bad."""
    shares = branch_shares(level, smoothing)
    own_n = shares.groupBy("host", "template").agg(F.sum("n").alias("own_n"))
    shapes = settle(
        shares.where("n > 0").groupBy("shape").agg(F.sum("n").alias("shape_n"), F.sum("bad").alias("shape_bad")), "shapes"
    )
    shapes = F.broadcast(shapes) if shapes.count() <= BROADCAST_ROWS else shapes
    # Without labels of its own, a template takes those of the same shape on other hosts.
    known, hits = F.coalesce("shape_n", F.lit(0)), F.coalesce("shape_bad", F.lit(0))
    bare = (hits + smoothing * F.col("smoothed")) / (known + smoothing)
    found = shares.join(own_n, ["host", "template"]).join(shapes, "shape", "left")
    share = F.when(F.col("own_n") > 0, F.col("smoothed")).otherwise(bare)
    return found.where(share >= purity).select("host", "shape")


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; pages that a rule judges are the labels."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = settle(with_rules(split, rules).withColumn("shape", _shape(F.col("path"))), "ruled")
    counted = ruled.groupBy("host", "shape").agg(
        F.count("ruled").alias("n"), F.count_if(F.col("ruled") == "block").alias("bad")
    )
    bad = rejected_shapes(templates(counted)).withColumn("found", F.lit("block"))
    found = ruled.join(bad, ["host", "shape"], "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", "found", F.lit("allow")).alias("verdict"))

"""A Merkle manifest of a dataset: one digest for all rows, and a proof for each of them.

Every row is a leaf. The leaves of a group stand in the order of their ids; runs of ``FAN``
neighbours are hashed to one node, level by level, up to the group's subroot, and the subroots in the
order of their groups likewise up to the root.

No sort of the leaves gives them their places. The ids of a group form a compressed bitmap: only the
64-bit words with an id are kept, merged by ``bit_or`` before and after the shuffle. Over the words
lies a directory of popcounts: a node sums the rows of ``1 << NODE`` neighbours below it, and the
places before a word are the sums before it in each node on its way down, so no task ever orders more
than one node's children. The place of a leaf is that count and the popcount of the lower bits of its
own word. Slot arrays keyed by (group, place >> 3) then reduce the levels: a task sees eight nodes at
a time, whatever the size of the group.

Rows that share an id share a bit. Where a word counts more rows than bits, the places of its rows
follow (id, leaf); equal leaves are numbered in slices, and may swap places, which changes no result.
A null id comes before all others, a null group before all others; null fields are marked as such in
the leaf. An empty table gives no rows. Texts of any length are hashed whole, where they are read.
Carried columns travel in the struct ``row``, so that no names clash. One row per group is ordered in
one task; groups are kinds of documents, not documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linksift.llm.ranks import place_of, running_within, small
from linksift.llm.tables import settle

FAN_BITS = 3
FAN = 1 << FAN_BITS
WORD_BITS = 6
NODE = 10


def leaf_of(*fields: Column) -> Column:
    """sha256 over the fields: ``-`` for null, else the count of UTF-8 bytes, ``:`` and the value."""
    texts = [field.cast("string") for field in fields]
    marked = [F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")) for text in texts]
    return F.sha2(F.concat(*marked), 256)


def node_of(children: Column) -> Column:
    return F.sha2(F.array_join(F.transform(children, lambda c: c["hash"]), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """One hash over all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _numbered_groups(leaves: DataFrame) -> DataFrame:
    """(group, g, rows, low, depth): groups in their order, and their least word."""
    sizes = leaves.groupBy("group").agg(F.count("*").alias("rows"), F.min(F.shiftright("id", WORD_BITS)).alias("low"))
    number = F.row_number().over(W.orderBy(F.col("group").asc_nulls_first())).cast("long") - 1
    return settle(sizes.select("group", number.alias("g"), "rows", F.coalesce("low", F.lit(0)).alias("low"), _depth().alias("depth")), "groups")


def _depth() -> Column:
    """The number of levels above ``rows`` leaves."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(62 // FAN_BITS)), lambda level: F.col("rows") > F.pow(F.lit(FAN), level)))


def directory(words: DataFrame) -> DataFrame:
    """(g, w, before): the rows of the group that stand before each word."""
    levels, top = [words.select("g", "w", "rows")], words.agg(F.max("w")).first()[0] or 0
    while top >> NODE:
        up = levels[-1].groupBy("g", F.shiftright("w", NODE).alias("w")).agg(F.sum("rows").alias("rows"))
        levels.append(settle(up, "directory"))
        top >>= NODE
    above = None
    for level in reversed(levels):
        node = F.shiftright("w", NODE)
        earlier = W.partitionBy("g", node).orderBy("w").rowsBetween(W.unboundedPreceding, -1)
        here = level.select("g", "w", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), node.alias("up"))
        if above is not None:
            base = above.select("g", F.col("w").alias("up"), F.col("before").alias("base"))
            here = here.join(base, ["g", "up"]).withColumn("before", F.col("before") + F.col("base"))
        above = here.select("g", "w", "before") if level is levels[0] else settle(here.select("g", "w", "before"), "before")
    return above


def ranked(leaves: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, depth, place, leaf, row) from settled leaves (group, id, leaf, row, no)."""
    of = small(groups.select(F.col("group").alias("_group"), "g", "depth", "low"))
    word = F.when(F.col("id").isNull(), 0).otherwise(F.shiftright("id", WORD_BITS) - F.col("low") + 1)
    bit = F.coalesce(F.col("id").bitwiseAND(F.lit((1 << WORD_BITS) - 1)), F.lit(0)).cast("int")
    keyed = leaves.join(of, F.col("group").eqNullSafe(F.col("_group"))).select("g", "depth", word.alias("w"), bit.alias("bit"), "leaf", "row", "no")
    words = settle(keyed.groupBy("g", "w").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.count("*").alias("rows")), "bitmap")
    words = settle(words.join(directory(words), ["g", "w"]), "ranks")
    single = F.col("rows") == F.bit_count("bits")
    lower = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)")))
    plain = keyed.join(small(words.where(single)), ["g", "w"])
    plain = plain.select("g", "depth", (F.col("before") + lower).alias("place"), "leaf", "row")
    shared = words.where(~single)
    return plain if shared.isEmpty() else plain.union(_ranked_ties(keyed, shared))


def _ranked_ties(keyed: DataFrame, shared: DataFrame) -> DataFrame:
    """As ``ranked``, for the rows in words that hold more rows than ids."""
    key = ["g", "w", "bit"]
    tied = settle(keyed.join(small(shared.select("g", "w")), ["g", "w"]), "tied")
    counts = tied.groupBy(*key).agg(F.count("*").alias("n"))
    lower = W.partitionBy("g", "w").orderBy("bit").rowsBetween(W.unboundedPreceding, -1)
    ids = counts.withColumn("ids_before", F.coalesce(F.sum("n").over(lower), F.lit(0))).join(shared.select("g", "w", "before"), ["g", "w"])
    # A different leaf of an id first, then its copies.
    leaves = settle(tied.groupBy(*key, "leaf").agg(F.count("*").alias("times")), "leaves")
    along = F.conv(F.substring("leaf", 1, 8), 16, 10).cast("long")
    leaves = running_within(leaves, key, along, ["leaf"], "leaves_before", F.col("times"))
    starts = leaves.join(ids, key).select(*key, "leaf", (F.col("before") + F.col("ids_before") + F.col("leaves_before")).alias("start"))
    starts = small(settle(starts, "starts"))
    copies = running_within(tied, [*key, "leaf"], place_of("no"), ["no"], "copy")
    return copies.join(starts, [*key, "leaf"]).select("g", "depth", (F.col("start") + F.col("copy")).alias("place"), "leaf", "row")


def _slots(nodes: DataFrame, *carried: str) -> DataFrame:
    """(g, depth, slot, children): the nodes (g, depth, place, hash) in arrays of up to ``FAN``."""
    at = F.col("place").bitwiseAND(F.lit(FAN - 1)).cast("int")
    kept = F.collect_list(F.struct(at.alias("at"), "hash", *carried))
    grouped = nodes.groupBy("g", "depth", F.shiftright("place", FAN_BITS).alias("slot")).agg(kept.alias("children"))
    return grouped.withColumn("children", F.array_sort("children", lambda x, y: x["at"] - y["at"]))


def levels_of(nodes: DataFrame, most: int, *carried: str) -> list[DataFrame]:
    """Slot arrays of every level, from leaves (g, depth, place, hash) of groups of up to ``most``."""
    found = [settle(_slots(nodes, *carried), "slots")]
    reach = FAN
    while reach < most:
        done = len(found)
        up = found[-1].where(F.col("depth") > done).select("g", "depth", F.col("slot").alias("place"), node_of(F.col("children")).alias("hash"))
        found.append(settle(_slots(up), "slots"))
        reach *= FAN
    return found


def roots_of(levels: list[DataFrame]) -> DataFrame:
    """(g, root): a lone leaf itself, else the hash of the last array."""
    parts = [level.where(F.greatest("depth", F.lit(1)) == at + 1) for at, level in enumerate(levels)]
    root = F.when(F.col("depth") == 0, F.col("children")[0]["hash"]).otherwise(node_of(F.col("children")))
    found = [part.select("g", root.alias("root")) for part in parts]
    together = found[0]
    for part in found[1:]:
        together = together.union(part)
    return together


def paths_of(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """(g, place, child, path) of every leaf; ``top`` has the path (g, path) above each group's root."""
    down = None
    for at in reversed(range(len(levels))):
        level = levels[at]
        here = level.where(F.greatest("depth", F.lit(1)) == at + 1).join(top, "g").select("g", "depth", "slot", "children", "path")
        if down is not None:
            inner = level.where(F.col("depth") > at + 1).join(down, ["g", "slot"])
            here = here.union(inner.select("g", "depth", "slot", "children", "path"))
        each = here.select("g", "depth", "slot", "children", "path", F.posexplode("children").alias("pos", "child"))
        joined = lambda first, count: F.array_join(F.transform(F.slice("children", first, count), lambda c: c["hash"]), "")
        own = F.struct(joined(F.lit(1), F.col("pos")).alias("left"), joined(F.col("pos") + 2, F.lit(FAN)).alias("right"))
        path = F.when(F.col("depth") == 0, F.col("path")).otherwise(F.concat(F.array(own), F.col("path")))
        place = F.shiftleft("slot", FAN_BITS) + F.col("pos")
        if at:
            down = settle(each.select("g", place.alias("slot"), path.alias("path")), "paths")
        else:
            down = each.select("g", place.alias("place"), "child", path.alias("path"))
    return down


def manifest(docs: DataFrame, leaf: Column, group: str, key: str, carried: list[Column]) -> DataFrame:
    """row (the carried columns), leaf, place, subroot, root and path of every row of ``docs``.

    ``path`` holds one step per level from the leaf to the root: the hashes of the siblings to the
    left and to the right of the node, each joined to one string.
    """
    read = docs.select(F.col(group).alias("group"), F.col(key).cast("long").alias("id"), leaf.alias("leaf"), F.struct(*carried).alias("row"))
    leaves = settle(read.withColumn("no", F.monotonically_increasing_id()), "leaves")
    groups = _numbered_groups(leaves)
    told = groups.agg(F.count("*").alias("groups"), F.max("rows").alias("rows")).first()
    nodes = ranked(leaves, groups).withColumnRenamed("leaf", "hash")
    levels = levels_of(nodes, told["rows"] or 0, "row")
    subroots = settle(roots_of(levels), "subroots")
    n = F.lit(told["groups"]).cast("long")
    tops = subroots.select(F.lit(0).cast("long").alias("g"), n.alias("rows"), F.col("g").alias("place"), F.col("root").alias("hash"))
    tops = tops.select("g", _depth().alias("depth"), "place", "hash")
    upper = levels_of(tops, told["groups"])
    empty = F.array().cast("array<struct<left:string,right:string>>")
    root = roots_of(upper).select("root", "g", empty.alias("path"))
    above = paths_of(upper, root.select("g", "path")).select(F.col("place").alias("g"), "path")
    whole = root.first()
    known = subroots.select("g", F.col("root").alias("subroot"), F.lit(whole and whole["root"]).cast("string").alias("root"))
    known = settle(known.join(above, "g"), "tops")
    found = paths_of(levels, known.select("g", "path"))
    found = found.join(small(known.select("g", "subroot", "root")), "g")
    return found.select("child.row", F.col("child.hash").alias("leaf"), "place", "subroot", "root", "path")

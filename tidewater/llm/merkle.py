"""A Merkle manifest of a table, with a proof for every row, found by pointer jumping.

Rows are the leaves of one tree a group (source); the groups' roots are the leaves of one tree above. Runs of 16
consecutive nodes become their digest, level by level. Each node then holds the siblings of its run, a segment of one
step towards its parent. Self-joins put a node's segment before that of the node it points at and let it point where
that one points: the distance doubles each round, until every node points at the root. The rows of a run share the way
above it, so they take it together, with their own siblings in front.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, ascii_lower, broadcast_if
from tidewater.operators.windows import numbered

TOP = "t"  # the tree of the groups' roots; those of groups begin with s, that of null is empty
MOST = 4_096  # rows of segments, a few KB each, that may be sent to every task
STEPS = "array<struct<left:string,right:string>>"
NODE = "struct<tree:string,level:int,at:bigint>"


def leaf_digest(values: Sequence[Column]) -> Column:
    """sha256, in hex, of the values: ``-`` for null, else the bytes of its text in UTF-8, ``:``, its text."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _grown(nodes: DataFrame, fan: int, level: int, scratch: Scratch) -> DataFrame:
    """The runs of nodes (tree, at, h, n, rows) as nodes of the next level, their children's digests in ``kids``."""
    kids = F.sort_array(F.collect_list(F.struct("at", "h", "row")))
    runs = nodes.groupBy("tree", F.expr(f"at div {fan}").alias("at")).agg(kids.alias("c"), F.max("n").alias("of"))
    made = runs.select("tree", F.lit(level).alias("level"), "at", F.expr(f"(of + {fan} - 1) div {fan}").alias("n"), F.array_join("c.h", "").alias("kids"), F.col("c.row").alias("rows"))
    return scratch.cut(made.withColumn("h", F.sha2("kids", 256)))


def _forest(leaves: DataFrame, fan: int, scratch: Scratch) -> list[DataFrame]:
    """The levels of runs above leaves (tree, at, h, n, row); a tree ends with the level at which one node remains."""
    levels, at = [], leaves.where("n > 1")
    while True:
        made = _grown(at, fan, len(levels) + 1, scratch)
        if made.isEmpty():
            return levels
        levels.append(made)
        at = made.where("n > 1").select("tree", "at", "h", "n", F.lit(None).cast(leaves.schema["row"].dataType).alias("row"))


def _segment(kids: Column, i: Column) -> Column:
    """The digests of a run left and right of its child i."""
    return F.struct(F.substring(kids, F.lit(1), i * 64).alias("left"), F.substring(kids, i * 64 + 65, F.length(kids)).alias("right"))


def _below(runs: DataFrame, fan: int) -> DataFrame:
    """The children of runs as nodes that point at their run, with the segment of one step."""
    children = F.explode(F.sequence(F.lit(0), F.floor(F.length("kids") / 64).cast("int") - 1)).alias("i")
    one = runs.select("tree", "level", "at", "kids", children)
    return one.select("tree", (F.col("level") - 1).alias("level"), (F.col("at") * fan + F.col("i")).alias("at"), F.struct("tree", "level", "at").alias("up"), F.array(_segment(F.col("kids"), F.col("i"))).alias("steps"))


def jumped(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """nodes (tree, level, at, up, steps) with the whole way to the root in ``steps``, by doubling; ``up`` is null at the root.

    In round k a node joins the node 2^k levels above it, so few nodes are asked: an ever smaller part of the upper
    ones, sent to all tasks once they are few. No node is asked by more than its own descendants at that distance.
    """
    nodes, path = scratch.put(nodes)
    for k in range(64):
        if nodes.where("up is not null").isEmpty():
            return nodes
        above = nodes.where((F.col("level") > 2**k) | (F.col("tree") == TOP)).select(F.col("tree").alias("t"), F.col("level").alias("l"), F.col("at").alias("a"), F.col("up").alias("next"), F.col("steps").alias("more"))
        above = broadcast_if(above, above.count(), MOST)
        joined = nodes.join(above, (F.col("up.tree") == F.col("t")) & (F.col("up.level") == F.col("l")) & (F.col("up.at") == F.col("a")), "left")
        nodes, new = scratch.put(joined.select("tree", "level", "at", F.col("next").alias("up"), F.when(F.col("up").isNull(), F.col("steps")).otherwise(F.concat("steps", "more")).alias("steps")))
        scratch.drop(path)
        path = new
    raise RuntimeError("the pointers did not reach the root")


def manifest(df: DataFrame, id_col: str, group_col: str, values: Sequence[str], changed: dict[str, Column] | None = None, when: Column | None = None, fan: int = 16) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of df.

    A leaf is the digest of ``values``; the leaves of a group ascend by id (null first, repeated ids by their leaf), the
    groups' roots by group (null first, bytewise). ``proof_sha256`` digests the siblings on the way to the root, level
    by level, left to right. ``folded_root`` is found again from the leaf and the siblings; where ``when`` is true, from
    a leaf with the ``changed`` columns instead, so that ``verified`` says whether the change shows. A row alone in its
    group is the group's root, a group alone gives the root; nulls in any value are told from empty texts; repeated rows
    are a leaf each; rows with a null id take part; an empty table gives an empty result; other columns are not read.
    """
    scratch, brief = Scratch(df.sparkSession), Scratch(df.sparkSession)
    c = lambda n: F.col(f"`{n}`")
    other = F.when(when, leaf_digest([changed.get(v, c(v)) for v in values])) if changed else F.lit(None)
    digests = brief.cut(df.select(c(id_col).alias("id"), F.coalesce(F.concat(F.lit("s"), c(group_col).cast("string")), F.lit("")).alias("tree"), leaf_digest([c(v) for v in values]).alias("h"), other.cast("string").alias("other")))
    placed = numbered(digests, [F.asc_nulls_first("id"), "h"], "at", ["tree"], "n", brief)
    placed = scratch.cut(placed.select("tree", "h", "n", (F.col("at") - 1).alias("at"), F.struct("id", "h", "other").alias("row")))
    levels = _forest(placed, fan, scratch)

    lone = placed.where("n = 1").select("tree", F.lit(0).alias("level"), F.lit(0).cast("long").alias("at"), "h", F.array("row").alias("rows"))
    subroots = scratch.cut(reduce(DataFrame.unionByName, [x.where("n = 1").select("tree", "level", "at", "h") for x in levels], lone.drop("rows")))
    tops = numbered(subroots, ["tree"], "i", (), "n", brief)
    tops = scratch.cut(tops.select(F.lit(TOP).alias("tree"), (F.col("i") - 1).alias("at"), "h", "n", F.struct("tree", "level", "at").alias("row")))
    brief.free()
    upper = _forest(tops, fan, scratch)

    # a node a run, pointing at the run above; a group's root points into the tree of the groups
    inner = [_below(x, fan) for x in [*levels[1:], *upper[1:]]]
    entry = [x.select("tree", "level", "at", "kids", F.posexplode("rows").alias("i", "r")).select("r.tree", "r.level", "r.at", F.struct("tree", "level", "at").alias("up"), F.array(_segment(F.col("kids"), F.col("i"))).alias("steps")) for x in upper[:1]]
    there = (upper[-1] if upper else subroots.withColumn("n", F.lit(1))).where("n = 1")  # one row
    final = there.select("tree", "level", "at", F.lit(None).cast(NODE).alias("up"), F.array().cast(STEPS).alias("steps"))
    ways = jumped(reduce(DataFrame.unionByName, [*inner, *entry, final]), scratch)

    top = there.select(F.col("h").alias("root"))
    subs = subroots.select("tree", F.col("h").alias("subroot"))
    runs = [x.select("tree", "level", "at", "rows", "kids") for x in levels[:1]] + [lone.select("tree", "level", "at", "rows", F.lit("").alias("kids"))]
    whole = reduce(DataFrame.unionByName, runs).join(ways.select("tree", "level", "at", "steps"), ["tree", "level", "at"]).join(broadcast_if(subs, subs.count()), "tree").join(F.broadcast(top))
    each = whole.select("kids", "steps", "subroot", "root", F.posexplode("rows").alias("i", "r"))
    way = F.when(F.col("kids") == "", F.col("steps")).otherwise(F.concat(F.array(_segment(F.col("kids"), F.col("i"))), F.col("steps")))
    each = each.select("r", "subroot", "root", way.alias("way"))
    fold = F.aggregate("way", F.coalesce("r.other", "r.h"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    proof = F.sha2(F.array_join(F.transform("way", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = each.select(F.col("r.id").alias(id_col), F.col("r.h").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), fold.alias("folded_root"))
    scratch.free(*levels[:1], placed, subroots, *upper[-1:])
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_case_tampered(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 5) -> tuple[dict[str, Column], Column]:
    """A tampering for tests of a manifest: A-Z of the text in small letters, in rows whose crc32(id) ``every`` divides."""
    return {text_col: ascii_lower(F.col(text_col))}, F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % every == 0

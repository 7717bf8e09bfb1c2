"""Near duplicates by SimHash, joined over a hierarchical index in Gray order.

Distinct fingerprints are sorted by their rank in the Gray code, so that neighbours share bits, and cut into blocks of
consecutive ones. A node of the index holds the bits that all fingerprints below it share (a mask and a pattern); a
fixed number of neighbours makes the node above. The join descends pairs of nodes: each level counts only the
differences in bits that the level above did not share, adds them to those of the pair above, and prunes a pair, with
all that is below both nodes, once they exceed the distance. Pairs of blocks that are left meet in tasks, where the
last levels (groups of 64 fingerprints, then fingerprints) are searched in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, broadcast_if
from tidewater.llm.components import components
from tidewater.llm.hashing import FOLD, U, packed, slices, words
from tidewater.operators.windows import numbered

SEED = 42
BYTE = U(0x0101010101010101)
LEAF, BLOCK, FAN = 64, 4_096, 16  # fingerprints of a group and of a block, children of a node
TOGETHER = 64  # blocks that meet one block in one task: 2 MB
PAIRS = 64  # pairs of groups whose distances are counted at once: 2 MB
RUN = 1 << 17  # shingles hashed at once


def _sums(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text and bit how many of its hashes h[bounds[d]:bounds[d + 1]] have the bit: texts x 64."""
    n = np.diff(bounds)
    parts = -(-n // 255)  # counters of a byte hold 255
    first = np.repeat(bounds[:-1], parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    out = np.zeros((len(n), 64), np.int64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    at = (np.cumsum(parts) - parts)[some]
    for k in range(8):
        lanes = np.add.reduceat((h >> U(k)) & BYTE, first)  # a byte of each lane counts one bit
        out[np.ix_(some, np.arange(k, 64, 8))] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), at, axis=0)
    return out


def fingerprint(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A bit is 1 if it is set in over half of a text's hashes; no hash: zero."""
    ones = 2 * _sums(h, bounds) > np.diff(bounds)[:, None]
    return (ones * (U(1) << np.arange(64, dtype=U))).sum(axis=1, dtype=U)


def shingle_hashes(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of n words, joined by spaces, and the bounds of each text's; fewer words: the sequence."""
    starts, ends, bounds = words(data, off)
    lengths = ends - starts
    to = np.cumsum(lengths + 1) - lengths - 1  # where each word begins in the joined text
    joined = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    joined[np.repeat(to - starts, lengths) + at] = FOLD[data[at]]
    count = np.diff(bounds)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    first = np.repeat(bounds[:-1] - out_bounds[:-1], made) + np.arange(out_bounds[-1])
    last = first + np.repeat(np.minimum(count, n), made) - 1
    text, digest, out = joined.tobytes(), xxhash.xxh64_intdigest, np.empty(len(first), U)
    for s in range(0, len(first), RUN):
        a, b = to[first[s : s + RUN]].tolist(), (to + lengths)[last[s : s + RUN]].tolist()
        out[s : s + RUN] = np.fromiter((digest(text[x:y], SEED) for x, y in zip(a, b, strict=True)), U, len(a))
    return out, out_bounds


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each whole text, as a long of the same bits; ids keep their type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = packed(batch["text"])
            for i, j, d, o in slices(data, off):
                fp = fingerprint(*shingle_hashes(d, o, shingle))
                yield pa.RecordBatch.from_arrays([batch["id"].slice(i, j - i), pa.array(fp.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def gray_rank(fp: Column) -> Column:
    """The place of the bits in Gray order, as a long that ascends with it."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _node(df: DataFrame, at: str, size: int, *more: Column) -> DataFrame:
    """Nodes over ``size`` neighbours each: the mask of bits that all below share, and these bits."""
    both, any_ = F.bit_and("pattern"), F.bit_or(F.col("pattern").bitwiseOR(F.bitwise_not("mask")))
    made = df.groupBy(F.expr(f"{at} div {size}").alias("node")).agg(both.alias("_and"), any_.alias("_or"), *more)
    return made.select("node", F.bitwise_not(F.col("_and").bitwiseXOR(F.col("_or"))).alias("mask"), F.col("_and").alias("pattern"), *[c for c in made.columns if c not in ("node", "_and", "_or")])


def _differences(a: str, b: str, known: Column) -> Column:
    """Bits shared within both nodes, not yet counted above, in which their patterns differ."""
    fresh = F.col(f"{a}.mask").bitwiseAND(F.col(f"{b}.mask")).bitwiseAND(F.bitwise_not(known))
    return F.bit_count(F.col(f"{a}.pattern").bitwiseXOR(F.col(f"{b}.pattern")).bitwiseAND(fresh))


def near_blocks(blocks: DataFrame, distance: int, fan: int, scratch: Scratch) -> DataFrame:
    """(a, b), a <= b: the pairs of blocks (node, mask, pattern) that may hold fingerprints within the distance.

    From the top, where at most ``fan`` nodes stand, to the blocks; only pairs of nodes that are left are joined with
    their children, so a level makes at most fan * fan rows of a pair of the level above before it prunes.
    """
    levels = [blocks.select("node", "mask", "pattern")]
    while (n := levels[-1].count()) > fan:
        levels.append(scratch.cut(_node(levels[-1], "node", fan)))
    rows = lambda df, side: df.select(F.expr(f"node div {fan}").alias(f"up_{side}"), F.struct("node", "mask", "pattern").alias(side))
    pairs = None
    for level in reversed(levels):
        one, two = rows(level, "x"), rows(level, "y")
        if pairs is None:  # all pairs of the few nodes at the top
            pairs = level.sparkSession.createDataFrame([(0, 0, 0, 0)] if n else [], "up_x long, up_y long, acc int, known long")
        pairs = pairs.join(one, "up_x").join(two, "up_y").where("x.node <= y.node")
        pairs = pairs.withColumn("acc", F.col("acc") + _differences("x", "y", F.col("known"))).where(F.col("acc") <= distance)
        pairs = scratch.cut(pairs.select(F.col("x.node").alias("up_x"), F.col("y.node").alias("up_y"), "acc", F.col("x.mask").bitwiseAND(F.col("y.mask")).alias("known")))
    return pairs.select(F.col("up_x").alias("a"), F.col("up_y").alias("b"))


def _groups(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(members, masks, patterns) of groups of LEAF neighbours; the last group repeats its last member."""
    m = np.concatenate([fp, np.repeat(fp[-1:], -len(fp) % LEAF)]).reshape(-1, LEAF)
    both, any_ = np.bitwise_and.reduce(m, axis=1), np.bitwise_or.reduce(m, axis=1)
    return m, ~(both ^ any_), both


def _met(distance: int):
    """Links within the distance between the block of side 0 and each of side 1, as trees: at most a link a member."""

    def run(t: pa.Table) -> pa.Table:
        side = np.asarray(t["side"])
        own = [np.asarray(x.values).view(U) for x in t["fps"]]
        u, v, most = [np.zeros(0, U)], [np.zeros(0, U)], 1 << 16
        a, mask_a, pattern_a = _groups(own[int(np.flatnonzero(side == 0)[0])])
        for k in np.flatnonzero(side == 1):
            b, mask_b, pattern_b = _groups(own[int(k)])
            apart = np.bitwise_count((pattern_a[:, None] ^ pattern_b[None]) & mask_a[:, None] & mask_b[None])
            i, j = np.nonzero(apart <= distance)
            for s in range(0, len(i), PAIRS):
                x, y = a[i[s : s + PAIRS]], b[j[s : s + PAIRS]]
                p, q, r = np.nonzero(np.bitwise_count(x[:, :, None] ^ y[:, None, :]) <= distance)
                x, y = x[p, q], y[p, r]
                other = x != y
                u.append(np.maximum(x, y)[other])
                v.append(np.minimum(x, y)[other])
                if sum(map(len, u)) > most:  # a crowded neighbourhood: keep what joins the same fingerprints
                    u, v = ([z] for z in spanning(np.concatenate(u), np.concatenate(v)))
                    most = max(most, 2 * len(u[0]))
        u, v = spanning(np.concatenate(u), np.concatenate(v))
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return run


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links: the same fingerprints joined by fewer links than fingerprints."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        np.minimum.at(low, label, low.copy())  # a root takes what its members have found
        low = low[low]
        if (low == label).all():
            break
        label = low
    kept = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[kept], nodes[label[kept]]


def near_links(fps: DataFrame, distance: int, scratch: Scratch, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Links (u, v) that join all fingerprints of fps (fp, distinct) within the distance of each other."""
    brief = Scratch(fps.sparkSession)
    placed = numbered(fps.select("fp", gray_rank(F.col("fp")).alias("rank")), ["rank"], "at", scratch=brief)
    leaves = placed.select((F.col("at") - 1).alias("at"), F.col("fp").alias("pattern"), F.lit(-1).cast("long").alias("mask"), F.struct("rank", "fp").alias("member"))
    blocks = scratch.cut(_node(leaves, "at", block, F.transform(F.sort_array(F.collect_list("member")), lambda m: m["fp"]).alias("fps")))
    brief.free()
    pairs = near_blocks(blocks, distance, fan, scratch).withColumn("part", F.expr(f"b div {TOGETHER}"))
    side = lambda k: F.lit(k).alias("side")
    rows = pairs.select("a", "part", F.col("a").alias("node"), side(0)).distinct().unionByName(pairs.select("a", "part", F.col("b").alias("node"), side(1)))
    return rows.join(blocks.select("node", "fps"), "node").groupBy("a", "part").applyInArrow(_met(distance), "u long, v long").distinct()


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(id, fingerprint, component_id) of every row of docs.

    A fingerprint bit is set if it is set in over half of the XXH64 hashes (seed 42) of the text's shingles, repeats
    included; words are runs between spaces and 0x09-0x0D, A-Z in small letters. Fingerprints link at ``distance`` or
    fewer differing bits; component_id is the least id reachable. Texts without words (null, empty, white space) have
    the fingerprint zero and link like any other; with fewer words than a shingle the whole sequence is one. Repeated
    rows stay separate with equal results, and an id with several texts has a component for each. Ids of any type that
    can be ordered keep it; a null id keeps its fingerprint, joins nothing and gets a null component. An empty table
    gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    sketch = scratch.cut(fingerprints(docs, id_col, text_col, shingle))
    classes = scratch.cut(sketch.where("id is not null").groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    links = scratch.cut(near_links(classes.select("fp"), distance, scratch, block, fan))
    label = scratch.cut(components(links, scratch))
    member = classes.join(broadcast_if(label, label.count()), classes.fp == label.node, "left").select("fp", "least", "n", F.coalesce("label", "fp").alias("comp"))
    linked = scratch.cut(member.where("comp <> fp").select("comp").distinct())
    lowest = scratch.cut(member.join(broadcast_if(linked, linked.count()), "comp", "left_semi").groupBy("comp").agg(F.min("least").alias("lowest")))
    member = member.join(broadcast_if(lowest, lowest.count()), "comp", "left").where("n > 1 or lowest is not null")
    member = scratch.cut(member.select("fp", F.coalesce("lowest", "least").alias("component_id")))  # other rows are alone
    scratch.free(sketch, member)
    out = sketch.join(broadcast_if(member, member.count()), "fp", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))

"""Near duplicates by one-permutation hashing with optimal densification.

One hash of each shingle fills 128 bins; an empty bin borrows from a bin that a fixed sequence of its own
names first. Four bins make a band, and texts that share a band are candidates. Texts with the same
shingles are one class from the start, so copies never make pairs. In each bucket the classes are paired
with one leader only; links are confirmed on full shingle sets, and components of the links are found.
Where the star of a leader still holds several components, those outside the largest meet its other
members of like size in blocks, on full sets: no pair of a bucket that could join two components stays
undecided. Only texts of stars are turned into sets, once; a leader meets its members block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, broadcast_if, need_whole_numbers
from tidewater.llm.components import components
from tidewater.llm.hashing import U, mix, packed, shingles, slices, span_hashes, words

BINS, ROWS = 128, 4
TRIES = 2048
CHUNK, VOLUME = 256, 1 << 20  # sets, and shingles, of a side of a block
MOST_IDS = 2_000_000  # ids of 8 bytes that may be sent to every task
_try: dict[str, np.ndarray] = {}


def _sequence() -> np.ndarray:
    """For each bin the bins that it asks when empty: TRIES x BINS, drawn by a hash."""
    if not _try:
        x = np.arange(TRIES * BINS, dtype=U).reshape(TRIES, BINS)
        _try["t"] = (mix(x + U(0x5851F42D4C957F2D)) % U(BINS)).astype(np.int64)
    return _try["t"]


def signature(s: np.ndarray) -> np.ndarray:
    """128 values of a sorted, non-empty set of shingle hashes."""
    bins = (s >> U(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    filled = np.zeros(BINS, bool)
    value = np.zeros(BINS, U)
    filled[bins[first]] = True
    value[bins[first]] = s[first]
    source = np.arange(BINS)
    empty = np.flatnonzero(~filled)
    t = _sequence()
    at = 0
    while len(empty) and at < TRIES:
        step = t[at : at + 64, empty]
        hit = filled[step]
        got = hit.any(axis=0)
        source[empty[got]] = step[hit.argmax(axis=0)[got], np.flatnonzero(got)]
        empty, at = empty[~got], at + 64
    if len(empty):  # with one filled bin in 128 about 1 of 9 million bins comes here
        source[empty] = bins[0]
    return value[source]


def band_keys(s: np.ndarray) -> np.ndarray:
    sig = mix(signature(s)).reshape(-1, ROWS)
    key = np.arange(1, len(sig) + 1, dtype=U) * U(0xA24BAED4963EE407)
    for k in range(ROWS):
        key = mix(key * U(0x9FB21C651E98DF25) + sig[:, k])
    return key


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, bands): h1 and h2 identify the set, bands its 32 buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = packed(batch["text"])
            for i, j, d, o in slices(data, off):
                starts, ends, bounds = words(d, o)
                sizes, one, two, bands = [], [], [], []
                for s in shingles(span_hashes(d, starts, ends), bounds, n):
                    sizes.append(len(s))
                    one.append(np.add.reduce(s))
                    two.append(np.add.reduce(mix(s)))
                    bands.append(_signed(band_keys(s)) if len(s) else np.zeros(0, np.int64))
                bands_at = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, j - i), pa.array(np.array(sizes, np.int64)), pa.array(_signed(np.array(one, U))), pa.array(_signed(np.array(two, U))), pa.ListArray.from_arrays(bands_at, np.concatenate(bands))],
                    ["doc_id", "n_shingles", "h1", "h2", "bands"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def shingle_sets(texts: DataFrame, n: int) -> DataFrame:
    """(node, own): the distinct shingle hashes of each text of texts (doc_id, text), sorted, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = packed(batch["text"])
            for i, j, d, o in slices(data, off):
                starts, ends, bounds = words(d, o)
                own = [s.tobytes() for s in shingles(span_hashes(d, starts, ends), bounds, n)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(own, pa.binary())], ["node", "own"])

    return texts.mapInArrow(run, "node long, own binary")


def _linked(percent: int):
    """Links of one block of rows (side, node, comp, own): each set of side 0 against all of side 1."""

    def block(t: pa.Table) -> pa.Table:
        side, node, comp = (np.asarray(t[c]) for c in ("side", "node", "comp"))
        own = [np.frombuffer(x.as_py(), U) for x in t["own"]]
        outer, inner = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(outer) and len(inner):
            sizes = np.array([len(own[i]) for i in inner])
            flat, of = np.concatenate([own[i] for i in inner]), np.repeat(np.arange(len(inner)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, of = flat[order], of[order]
            for i in outer:
                lo, hi = np.searchsorted(flat, own[i], "left"), np.searchsorted(flat, own[i], "right")
                runs = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
                shared = np.bincount(of[at], minlength=len(inner))
                hit = node[inner[(100 * shared >= percent * (len(own[i]) + sizes - shared)) & (comp[inner] != comp[i])]]
                u.append(np.maximum(node[i], hit))
                v.append(np.minimum(node[i], hit))
        return pa.table({"u": pa.array(np.concatenate(u)), "v": pa.array(np.concatenate(v))})

    return block


def _blocks(n: Column, volume: Column) -> Column:
    """Blocks for n sets with ``volume`` shingles together."""
    return F.greatest(F.ceil(n / CHUNK), F.ceil(volume / VOLUME)).cast("int")


def _place(node: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(node), n).cast("int")


def star_links(star: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (u, v) between leaders and members: star (leader, node, n), sets (node, own).

    A leader meets its members in blocks of bounded size and is sent once a block, so neither its set is
    repeated for every member nor do all members of a hot leader meet in one task.
    """
    wide = scratch.cut(star.groupBy("leader").agg(_blocks(F.count("*"), F.sum("n")).alias("k")).where("k > 1"))
    dealt = star.join(broadcast_if(wide, wide.count()), "leader", "left").select("leader", "node", _place("node", F.coalesce("k", F.lit(1))).alias("i"))
    side = lambda s: F.lit(s).alias("side")
    own = dealt.select("leader", "i", F.col("leader").alias("node"), side(0)).distinct().unionByName(dealt.select("leader", "i", "node", side(1)))
    return own.withColumn("comp", F.col("node")).join(sets, "node").groupBy("leader", "i").applyInArrow(_linked(percent), "u long, v long").distinct()


def cross_links(rest: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (u, v) between different components of one star: rest (leader, node, n, comp, main).

    Members outside the star's main component meet its other members, on full shingle sets, in blocks of
    bounded size. Only sets of like size can be linked: members are dealt to classes of n so wide that a
    link joins a class and itself or the next, and only those meet. A block's pairs are counted in its task
    and only links leave it.
    """
    like = rest.withColumn("c", F.floor(F.log(F.col("n")) / (math.log(100 / percent) + 0.01)).cast("int")).withColumn("outer", F.col("comp") != F.col("main"))
    out = F.col("outer")
    sizes = like.groupBy("leader", "c").agg(_blocks(F.count_if(out), F.sum(F.when(out, F.col("n")).otherwise(0))).alias("rows"), _blocks(F.count("*"), F.sum("n")).alias("cols"))
    near = sizes.where("rows > 0").select("leader", F.col("c").alias("co"), "rows", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("ci"))
    grid = scratch.cut(near.join(sizes.select("leader", F.col("c").alias("ci"), "cols"), ["leader", "ci"]))
    grid = broadcast_if(grid, grid.count())
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    key = ["leader", "co", "ci", "i", "j"]
    one = like.where("outer").withColumnRenamed("c", "co").join(grid, ["leader", "co"]).select("node", "comp", F.lit(0).alias("side"), "leader", "co", "ci", _place("node", F.col("rows")).alias("i"), upto("cols").alias("j"))
    two = like.withColumnRenamed("c", "ci").join(grid, ["leader", "ci"]).select("node", "comp", F.lit(1).alias("side"), "leader", "co", "ci", upto("rows").alias("i"), _place("node", F.col("cols")).alias("j"))
    return one.unionByName(two).join(sets, "node").groupBy(*key).applyInArrow(_linked(percent), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    Texts are linked when 100 * |A and B| >= percent * |A or B| on distinct word shingles; component_id is
    the least doc_id reachable over links, kept marks that row. A text without words (null, empty, white
    space) has no shingles and is linked with nothing; with fewer words than a shingle the whole sequence
    is one. Repeated rows stay separate rows with equal results; where a doc_id has several texts, a link of
    any of them links the id. Ids must be whole numbers. Rows with a null doc_id keep their size, with a null component, kept false. An empty table gives
    an empty result. Other columns are not read.
    """
    need_whole_numbers(docs, id_col)
    scratch = Scratch(docs.sparkSession)
    sketch = scratch.cut(sketches(docs, id_col, text_col, shingle))
    key = ["h1", "h2", "n_shingles"]
    classes = sketch.where("n_shingles > 0 and doc_id is not null").groupBy(key).agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"))
    classes = scratch.cut(classes)

    # buckets of two classes give their pair at once; only the members of larger ones are met again
    member = classes.select(F.explode("bands").alias("band"), F.struct("node", F.col("n_shingles").alias("n")).alias("m"))
    crowd = scratch.cut(member.groupBy("band").agg(F.count("*").alias("n_in"), F.min("m").alias("lead"), F.max("m").alias("last")).where("n_in > 1"))
    more = crowd.where("n_in > 2").select("band", "lead")
    pair = lambda df, m: df.select(F.col("lead.node").alias("leader"), F.col(f"{m}.node").alias("node"), F.col("lead.n").alias("na"), F.col(f"{m}.n").alias("n"))
    star = pair(crowd.where("n_in = 2"), "last").union(pair(member.join(broadcast_if(more, more.count()), "band"), "m")).where("leader < node")
    star = scratch.cut(star.groupBy("leader", "node").agg(F.max("na").alias("na"), F.max("n").alias("n")))
    fits = star.where(F.least("n", "na") * 100 >= F.greatest("n", "na") * percent)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Sets of the nodes only: their ids are sent to the texts, so that no other text is shuffled."""
        ids = scratch.cut(nodes.distinct())
        return scratch.cut(shingle_sets(texts.join(broadcast_if(ids, ids.count(), MOST_IDS), texts.doc_id == ids.node, "left_semi"), shingle).distinct())

    sets = sets_of(fits.select("leader").union(fits.select("node")).toDF("node"))
    links = scratch.cut(star_links(fits, sets, percent, scratch))
    label = scratch.cut(components(links, scratch))

    # a pair of a bucket stands beside one leader: what a leader's star left in several components is compared in blocks
    family = star.select("leader", "node", "n").union(star.groupBy("leader").agg(F.max("na").alias("n")).select("leader", F.col("leader").alias("node"), "n"))
    family = family.join(label, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
    per = family.groupBy("leader", "comp").agg(F.count("*").alias("m")).groupBy("leader").agg(F.sum("m").alias("n_all"), F.max(F.struct("m", "comp")).alias("most"))
    mixed = scratch.cut(per.where("n_all > 2 and most.m < n_all").select("leader", F.col("most.comp").alias("main")))
    rest = scratch.cut(family.join(broadcast_if(mixed, mixed.count()), "leader").where("node <> leader"))
    if not rest.isEmpty():
        beside = scratch.cut(cross_links(rest, sets_of(rest.select("node")), percent, scratch))
        if not beside.isEmpty():
            label = scratch.cut(components(links.union(beside), scratch))
    scratch.free(sketch, classes, label)
    out = sketch.select("doc_id", *key).join(classes.select("node", *key), key, "left").join(label, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("label", "node")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with one row of each group of near duplicates; rows with a null id stay.

    A repeated id keeps one of its rows; options are those of near_duplicates. Ids that go are sent to the
    rows while they are few enough to broadcast, so that the texts that stay are not shuffled.
    """
    scratch = Scratch(docs.sparkSession)
    marks = scratch.cut(near_duplicates(docs, id_col, **options).where("doc_id is not null").groupBy(F.col("doc_id").alias(id_col)).agg(F.max("kept").alias("kept"), F.count("*").alias("times")).where("not kept or times > 1"))
    gone = marks.where("not kept").select(id_col)
    twice = marks.where("kept").select(id_col)  # ids that stay with several rows
    out = docs.join(broadcast_if(gone, gone.count(), MOST_IDS), id_col, "left_anti").select(docs.columns)
    n = twice.count()
    if n:
        rest = [c for c in docs.columns if c != id_col]
        again = out.join(broadcast_if(twice, n), id_col, "left_semi")
        least = again.groupBy(id_col).agg(F.min(F.struct(rest)).alias("_row")).select(id_col, "_row.*").select(docs.columns)
        out = out.join(broadcast_if(twice, n), id_col, "left_anti").select(docs.columns).unionByName(least)
    return out

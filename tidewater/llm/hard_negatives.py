"""Hard negatives by Fagin's threshold algorithm.

Each task takes candidates in shards of bounded size and sorts every dimension of a shard into a list. For an anchor
all lists are read in step, from the top where the anchor is positive and from the bottom where it is negative; rows
met for the first time are scored whole, as integers. What has not been met scores at most the sum of the anchor's
products with the values last read. A search ends once this threshold is strictly below the kth score of each of its
windows, or below the window where fewer than k rows lie in it; equal scores may still go to a smaller id. The best
rows of a task close the windows of its later shards, and the best of all tasks are ranked by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import Scratch, need_whole_numbers

CELLS = 1 << 19  # numbers of a shard: 4 MB, and as much for its lists
BLOCK = 2_048  # anchors searched for at once
MOST = (1 << 63) - 1  # scores end here
FOUND = "q int, w int, vec_id long, score long"


def prepared(df: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v): floor(scale * x); rows with a null id or label or with null, empty or non-finite vectors go."""
    need_whole_numbers(df, id_col)
    x = F.col(f"`{vec_col}`")
    ok = (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = df.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & x.isNotNull() & F.coalesce(ok, F.lit(False)))
    return kept.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


class Found:
    """The best k rows with scores in each of an anchor's windows, so far: higher scores, then smaller ids."""

    def __init__(self, lo: list[int], hi: list[int], k: int):
        self.lo, self.hi, self.k = lo, hi, k
        self.rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in lo]  # scores, ids
        self.floor = list(lo)  # what a row must reach to matter

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for w, (lo, hi) in enumerate(zip(self.floor, self.hi, strict=True)):
            at = np.flatnonzero((scores >= lo) & (scores <= hi))
            if len(at):
                s, i = np.concatenate([self.rows[w][0], scores[at]]), np.concatenate([self.rows[w][1], ids[at]])
                best = np.lexsort((i, -s))[: self.k]
                self.rows[w] = s[best], i[best]
                if len(best) == self.k:
                    self.floor[w] = int(s[best[-1]])

    def settled(self, threshold: int | float) -> bool:
        """Whether no row that scores ``threshold`` or less can enter a window."""
        return all(threshold < f or lo > hi for f, lo, hi in zip(self.floor, self.lo, self.hi, strict=True))


class Lists:
    """Rows with a sorted list of each dimension: positions in ``order``, values in ``values``, ascending."""

    def __init__(self, m: np.ndarray, ids: np.ndarray, wide: bool):
        self.ids, self.wide = ids, wide
        self.rows = m.astype(object) if wide else m.astype(np.float64)
        self.order = np.argsort(m, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.rows, self.order.astype(np.int64), axis=0)

    def search(self, anchor: np.ndarray, found: Found, takes: Callable[[np.ndarray], np.ndarray]) -> int:
        """Adds to ``found`` what the lists hold for it; ``takes``: which positions may enter. Returns the depth read."""
        n = len(self.ids)
        a = anchor.astype(object) if self.wide else anchor.astype(np.float64)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met, depth, step = np.zeros(n, bool), 0, max(16, n // 128)
        if not len(up) + len(down):  # every score is zero and no list tells rows apart
            self._score(np.arange(n), a, found, takes)
            return n
        while depth < n:
            to = min(n, depth + step)
            before = met.copy()
            met[self.order[n - to : n - depth, up]] = True
            met[self.order[depth:to, down]] = True
            self._score(np.flatnonzero(met & ~before), a, found, takes)
            threshold = (a[up] * self.values[n - to, up]).sum() + (a[down] * self.values[to - 1, down]).sum()
            if found.settled(threshold) or met.all():
                return to
            depth, step = to, 2 * step
        return n

    def _score(self, at: np.ndarray, a: np.ndarray, found: Found, takes: Callable[[np.ndarray], np.ndarray]) -> None:
        at = at[takes(at)]
        if not len(at):
            return
        s = self.rows[at] @ a
        found.add((np.clip(s, -MOST, MOST) if self.wide else s).astype(np.int64), self.ids[at])


def _shards(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, matrix) of rows with vectors of one length, at most ``cells`` numbers (or one row)."""
    held: dict[int, list] = {}

    def out(d: int) -> tuple:
        ids, labels, m = zip(*held.pop(d), strict=True)
        return np.concatenate(ids), np.concatenate(labels), np.concatenate(m)

    for batch in batches:
        ids, labels = np.asarray(batch["id"]), np.asarray(batch["label"].to_numpy(zero_copy_only=False), object)
        sizes, flat = np.diff(np.asarray(batch["v"].offsets)), np.asarray(batch["v"].flatten())
        starts = np.cumsum(sizes) - sizes
        for d in np.unique(sizes):
            at, rows = np.flatnonzero(sizes == d), max(1, cells // int(d))
            for s in range(0, len(at), rows):
                part = at[s : s + rows]
                if d in held and sum(len(x[0]) for x in held[d]) + len(part) > rows:
                    yield out(d)
                held.setdefault(d, []).append((ids[part], labels[part], flat[starts[part][:, None] + np.arange(d)]))
    for d in list(held):
        yield out(d)


def _table(found: dict[int, Found]) -> pa.RecordBatch:
    rows = [(q, w, s, i) for q, f in found.items() for w, (s, i) in enumerate(f.rows) if len(s)]
    q, w = (np.array([x for r in rows for x in [r[k]] * len(r[2])], np.int32) for k in (0, 1))
    ids, scores = (np.concatenate([np.zeros(0, np.int64), *(r[k] for r in rows)]) for k in (3, 2))
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(w), pa.array(ids), pa.array(scores)], ["q", "w", "vec_id", "score"])


Anchor = tuple[int, str, np.ndarray]  # id, label, vector


def _positives(anchors: list[Anchor], k: int, wide: bool, cells: int):
    """The task's best k rows of each anchor's label: lists of each label's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {q: Found([-MOST], [MOST], k) for q in range(len(anchors))}
        of: dict[tuple, list[int]] = {}
        for q, (_, label, v) in enumerate(anchors):
            of.setdefault((label, len(v)), []).append(q)
        for ids, labels, m in _shards(batches, cells):
            order = np.argsort(labels, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], labels[order][1:] != labels[order][:-1]]))
            for at in np.split(order, cuts[1:]):
                asked = of.get((labels[at[0]], m.shape[1]), [])
                if asked:
                    lists = Lists(m[at], ids[at], wide)
                    for q in asked:
                        own = anchors[q][0]
                        lists.search(anchors[q][2], found[q], lambda i: lists.ids[i] != own)  # noqa: B023
        yield _table(found)

    return run


def _negatives(anchors: list[Anchor], windows: dict[int, tuple[list[int], list[int]]], k: int, wide: bool, cells: int):
    """The task's best k rows of other labels in each window of each anchor: lists of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {q: Found(lo, hi, k) for q, (lo, hi) in windows.items()}
        for ids, labels, m in _shards(batches, cells):
            lists = Lists(m, ids, wide)
            names, codes = np.unique(labels, return_inverse=True)
            code = {x: i for i, x in enumerate(names)}
            for q, f in found.items():
                own, label, v = anchors[q]
                if len(v) == m.shape[1]:
                    same = code.get(label, -1)
                    lists.search(v, f, lambda i: (codes[i] != same) & (ids[i] != own))  # noqa: B023
        yield _table(found)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    Scores are integer inner products of floor(scale * x); higher ones come first, ties by smaller id. An anchor's
    positives are its first other rows of its label; a positive's negatives are the first rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Fewer rows give fewer, a positive without
    any negative none. Rows with a null id or label, or with a null, empty or non-finite vector, take no part; vectors
    meet those of their own length; a row never meets its own id. An anchor id that occurs more than once is asked once,
    by its least label and vector; repeated rows count each. Labels of any type are compared by their text, ids must be
    whole numbers. Scores end at +-(2**63 - 1). An empty table gives an empty result; other columns are not read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    c = scratch.cut(prepared(rows, id_col, vec_col, label_col, scale).repartition(n))  # scoring uses all cores, whatever the files
    asked = scratch.cut(prepared(anchors, id_col, vec_col, label_col, scale).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v"))
    reach = F.max(F.greatest(F.abs(F.array_max("v").cast("decimal(20,0)")), F.abs(F.array_min("v").cast("decimal(20,0)"))))
    sides = [x.agg(reach.alias("most"), F.max(F.size("v")).alias("n")).first() for x in (c, asked)]
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if any(x["n"] is None for x in sides):
        return out
    wide = int(max(x["most"] for x in sides)) ** 2 * max(x["n"] for x in sides) >= 1 << 52  # else doubles are exact
    last, parts = None, []
    while True:  # one block of anchors after another, in the order of their ids
        some = (asked if last is None else asked.where(F.col("id") > last)).orderBy("id").limit(block).collect()
        if not some:
            break
        last = some[-1]["id"]
        parts.append(scratch.put(_block(c, [(r["id"], r["label"], np.array(r["v"], np.int64)) for r in some], positives, negatives, low, high, wide, cells))[1])
    scratch.free()
    return spark.read.schema(out.schema).parquet(*parts) if parts else out


def _block(c: DataFrame, anchors: list[Anchor], positives: int, negatives: int, low: int, high: int, wide: bool, cells: int) -> DataFrame:
    spark = c.sparkSession
    near = _best(c.mapInArrow(_positives(anchors, positives, wide, cells), FOUND), positives).select("q", "rank", "vec_id", "score").collect()  # k rows an anchor of the block
    by: dict[int, list] = {}
    for r in sorted(near, key=lambda r: (r["q"], r["rank"])):
        by.setdefault(r["q"], []).append(r)
    windows = {q: ([-(-low * r["score"] // 100) for r in rs], [high * r["score"] // 100 for r in rs]) for q, rs in by.items()}
    found = _best(c.mapInArrow(_negatives(anchors, windows, negatives, wide, cells), FOUND), negatives)
    names = [(q, w, anchors[q][0], r["vec_id"], r["score"]) for q, rs in by.items() for w, r in enumerate(rs)]
    names = spark.createDataFrame(names, "q int, w int, anchor_id long, positive_id long, positive_score long")
    return found.join(F.broadcast(names), ["q", "w"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

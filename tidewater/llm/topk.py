"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of a fixed size, each sent to all tasks. For a block, every candidate is
scored and counted into one histogram per query; the summed histograms tell which bin holds the kth
score, the next pass refines that bin, until a bin is one integer wide. A last pass returns scores above
the kth value and, of those equal to it, the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import Scratch, need_whole_numbers

BLOCK = 2048  # queries in a block: 2,048 x 64 integers are 1 MB
BINS = 512
MOST = (1 << 63) - 1  # scores end here


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, v array<long>): floor(scale * x); rows null, empty or holding null or non-finite parts go."""
    x = F.col(vec_col)
    ok = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def _matrix(ids: np.ndarray, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of equal length: (length, ids, matrix)."""
    sizes, flat = np.diff(np.asarray(vectors.offsets)), np.asarray(vectors.flatten())
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield int(n), ids[at], flat[starts[at][:, None] + np.arange(n)]


def _scores(batch: pa.RecordBatch, queries: dict, bound: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions of queries, candidate ids, scores: queries x candidates; the query's own row lowest).

    Up to 2**52 products are exact in floating point, up to 2**63 in 64-bit integers; beyond that they are counted
    in whole numbers of any size and end at +-MOST.
    """
    low = np.iinfo(np.int64).min
    for n, ids, m in _matrix(np.asarray(batch["id"]), batch["v"]):
        if n not in queries:
            continue
        at, qids, q = queries[n]
        for i in range(0, len(ids), 1024):
            part = m[i : i + 1024]
            if bound < 2.0**52:
                s = (q.astype(np.float64) @ part.T.astype(np.float64)).astype(np.int64)
            elif bound < 2.0**62:
                s = q @ part.T
            else:
                s = np.clip(q.astype(object) @ part.T.astype(object), -MOST, MOST).astype(np.int64)
            s[qids[:, None] == ids[None, i : i + 1024]] = low
            yield at, ids[i : i + 1024], s


def _histogram(queries: dict, lo: np.ndarray, hi: np.ndarray, width: np.ndarray, k: int, bound: float):
    """Counts of scores in BINS bins from lo to hi, a task's highest bins that hold k scores together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(lo), BINS), np.int64)
        for batch in batches:
            for at, _, s in _scores(batch, queries, bound):
                rows, cols = np.nonzero((s >= lo[at, None]) & (s <= hi[at, None]))
                bins = (s[rows, cols].view(np.uint64) - lo[at][rows].view(np.uint64)) // width[at][rows]  # differences may need all 64 bits
                counts += np.bincount(at[rows] * BINS + bins.astype(np.int64), minlength=counts.size).reshape(counts.shape)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(np.minimum(counts[q, b], k))], ["q", "b", "n"])

    return run


def _select(queries: dict, kth: np.ndarray, need: np.ndarray, bound: float):
    """All scores above the kth and, of those equal to it, the task's smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, ids, s in _scores(batch, queries, bound):
                rows, cols = np.nonzero(s > kth[at, None])
                yield pa.RecordBatch.from_arrays([pa.array(at[rows].astype(np.int32)), pa.array(ids[cols]), pa.array(s[rows, cols])], ["q", "vec_id", "score"])
                equal = s == kth[at, None]
                for r in np.flatnonzero(equal.any(axis=1)):
                    q = int(at[r])
                    found = np.concatenate([ties.get(q, ids[:0]), ids[equal[r]]])
                    ties[q] = np.sort(found)[: need[q]]
        q = np.array([q for q, x in ties.items() for _ in x], np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([np.zeros(0, np.int64), *ties.values()])), pa.array(kth[q])], ["q", "vec_id", "score"])

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all candidates.

    Ties go to the smaller id; fewer than k candidates give fewer rows; a query never meets rows of its own
    id; vectors of another length than the query's do not take part in its search. A query id that occurs
    more than once is asked once, by its least vector; repeated candidate rows count each. Vectors that are
    null, empty or hold null or non-finite parts take no part on either side, nor do null ids; ids must be whole numbers. A score beyond the range of long is
    its last value, +-(2**63 - 1), and such scores tie. Other columns are not read.
    """
    for df in (candidates, queries):
        need_whole_numbers(df, id_col)
    spark = candidates.sparkSession
    scratch = Scratch(spark)
    c = scratch.cut(quantised(candidates, id_col, vec_col, scale))
    q = quantised(queries, id_col, vec_col, scale).groupBy("id").agg(F.min("v").alias("v"))
    q = scratch.cut(q)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    bound = c.agg(F.max(norm).alias("n")).first()["n"]
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if bound is None:
        return out
    bound = max(bound, q.agg(F.max(norm)).first()[0] or 0.0)
    last, parts = None, []
    while True:  # one block of queries after another, in the order of their ids
        rows = (q if last is None else q.where(F.col("id") > last)).orderBy("id").limit(block).collect()
        if not rows:
            break
        last = rows[-1]["id"]
        parts.append(scratch.put(_block(c, [(r["id"], r["v"]) for r in rows], k, bound))[1])
    scratch.free()
    return spark.read.schema(out.schema).parquet(*parts) if parts else out


def _block(c: DataFrame, rows: list, k: int, bound: float) -> DataFrame:
    sizes = np.array([len(v) for _, v in rows])
    ids = np.array([i for i, _ in rows], np.int64)
    queries = {int(n): (at := np.flatnonzero(sizes == n), ids[at], np.array([rows[i][1] for i in at], np.int64)) for n in np.unique(sizes)}
    most = min(MOST, int(bound) + 1)
    lo, hi = [-most] * len(rows), [most] * len(rows)  # whole numbers of any size
    above = np.zeros(len(rows), np.int64)
    kth = np.full(len(rows), np.iinfo(np.int64).min + 1)  # fewer than k candidates: all of them
    open_ = np.ones(len(rows), bool)
    while open_.any():
        width = [max(1, -((lo[i] - hi[i] - 1) // BINS)) for i in range(len(rows))]
        end = [hi[i] if open_[i] else lo[i] - 1 if lo[i] > -MOST else lo[i] for i in range(len(rows))]  # settled queries count next to nothing
        found = c.mapInArrow(_histogram(queries, np.array(lo, np.int64), np.array(end, np.int64), np.array(width, np.uint64), k, bound), "q int, b int, n long").groupBy("q", "b").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("q").orderBy(F.desc("b"))
        found = found.withColumn("upto", F.sum("n").over(w)).join(F.broadcast(c.sparkSession.createDataFrame([(int(i), int(k - above[i])) for i in np.flatnonzero(open_)], "q int, need long")), "q")
        at = {r["q"]: r for r in found.groupBy("q").agg(F.max(F.when(F.col("upto") >= F.col("need"), F.struct("b", "upto", "n"))).alias("bin")).collect()}  # a row a query of the block
        for i in np.flatnonzero(open_):
            r = at.get(i)
            if r is None or r["bin"] is None:
                open_[i] = False
                continue
            above[i] += r["bin"]["upto"] - r["bin"]["n"]
            lo[i] += r["bin"]["b"] * width[i]
            hi[i] = min(hi[i], lo[i] + width[i] - 1)
            if width[i] == 1:
                kth[i], open_[i] = lo[i], False
    need = np.maximum(k - above, 0)
    chosen = c.mapInArrow(_select(queries, kth, need, bound), "q int, vec_id long, score long")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    names = c.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "q int, query_id long")
    ranked = chosen.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

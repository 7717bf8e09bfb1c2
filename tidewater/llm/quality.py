"""Quality by hierarchical empirical Bayes.

A logistic classifier on cheap text statistics gives each document a probability. Grouped means of those
by host, and by path within host, are shrunk: a host towards the global mean, a path towards its host,
with strengths estimated from the spread between groups (sparse sites move most). The posterior of the
path, without the document itself, shifts the document's own log odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, broadcast_if
from tidewater.llm.hashing import packed, slices, span_hashes, words
from tidewater.llm.toxicity import BLOCK, logistic

FEATURES = ["log_words", "word_length", "letters", "digits", "symbols", "marks", "upper", "distinct", "lines", "repeated"]
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT, _UPPER, _MARK, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58], _UPPER[65:91] = True, True
_MARK[[ord(c) for c in ".,;:!?'\"-()"]] = True
_SYMBOL[[c for c in range(33, 127) if not (_LETTER[c] or _DIGIT[c] or _MARK[c])]] = True


def text_features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """texts x FEATURES; a text without words has zeros."""
    starts, ends, bounds = words(data, off)
    size = np.maximum(1, np.diff(off)).astype(float)
    n = np.diff(bounds)
    each = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[off])
    span = np.diff(np.concatenate([[0], np.cumsum(ends - starts)])[bounds])
    h = span_hashes(data, starts, ends)
    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], float)
    twice = np.zeros(len(data), bool)
    twice[1:] = _SYMBOL[data[1:]] & (data[1:] == data[:-1])
    m = np.maximum(1, n)
    return np.stack([np.log1p(n), span / m / 10, each(_LETTER[data]) / size, each(_DIGIT[data]) / size, each(_SYMBOL[data]) / size, each(_MARK[data]) / size, each(_UPPER[data]) / size, distinct / m, each(data == 10) / m, each(twice) / size], 1) * (n > 0)[:, None]


def _evidence(docs: DataFrame, host: str, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = packed(batch["text"])
            for i, j, d, o in slices(data, off, BLOCK):
                x = text_features(d, o)
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own["doc_id"], own["host"], own["path"], *[pa.array(x[:, k]) for k in range(len(FEATURES))]], ["doc_id", "host", "path", *FEATURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    site = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select("doc_id", site(host).alias("host"), site(path).alias("path"), "text").mapInArrow(run, f"doc_id {kind}, host string, path string, " + ", ".join(f"{f} double" for f in FEATURES))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, mean: Column, within: float) -> float:
    """Prior strength (pseudo-documents) of groups (n, s, prior mean): within variance over the variance between."""
    row = groups.agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2).alias("ss"), F.count("*").alias("k"), F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("sq")).first()
    if not row["t"] or row["k"] < 2:
        return 1e6
    spread = row["t"] - row["sq"] / row["t"]
    between = max(0.0, (row["ss"] - (row["k"] - 1) * within) / spread) if spread > 0 else 0.0
    return min(1e6, max(0.1, within / between)) if between > 0 else 1e6


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", weight: float = 0.5, threshold: float = 0.5, sample: int = 20_000) -> DataFrame:
    """(doc_id, host, path, doc_score, host_posterior, path_posterior, score, keep) of every row of docs.

    The classifier is fitted to at most ``sample`` labelled rows (least hashes of doc_id); means, strengths and posteriors
    cover all rows. Null hosts and paths are empty ones; null and empty texts have zero features; without
    labels every document has even odds; repeated rows count each, but a repeated id teaches once, by the least of its
    features; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.cut(_evidence(docs, host, path))
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("y")).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample)
    got = rows.join(F.broadcast(scratch.cut(known)), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), *[F.min(f).alias(f) for f in FEATURES]).orderBy("doc_id").collect()  # a row of numbers for each id of the sample
    x, y = np.array([[r[f] for f in FEATURES] for r in got]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in got], float)
    mid, wide = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    w = logistic((x - mid) / wide, y)
    odds = F.lit(float(w[-1]))
    for k, f in enumerate(FEATURES):
        odds = odds + (F.col(f) - float(mid[k])) / float(wide[k]) * float(w[k])
    odds = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), odds))
    scored = rows.select("doc_id", "host", "path", (1 / (1 + F.exp(-odds))).alias("p"))
    paths = scratch.cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("s2")))
    t = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s2") - F.col("s") * F.col("s") / F.col("n")).alias("w"), F.count("*").alias("k")).first()
    if not t["n"]:
        return scored.select("doc_id", "host", "path", F.col("p").alias("doc_score"), F.col("p").alias("host_posterior"), F.col("p").alias("path_posterior"), F.col("p").alias("score"), (F.col("p") >= threshold).alias("keep"))
    mu, within = t["s"] / t["n"], max(1e-9, t["w"] / max(1, t["n"] - t["k"]))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    k_host = strength(hosts, F.lit(mu), within)
    hosts = hosts.select("host", ((F.col("s") + k_host * mu) / (F.col("n") + k_host)).alias("host_posterior"))
    sites = scratch.cut(paths.join(hosts, "host"))
    k_path = strength(sites, F.col("host_posterior"), within)
    out = scored.join(broadcast_if(sites.select("host", "path", "n", "s", "host_posterior"), t["k"]), ["host", "path"])
    out = out.withColumn("path_posterior", (F.col("s") - F.col("p") + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path))
    score = 1 / (1 + F.exp(-(_logit(F.col("p")) + weight * (_logit(F.col("path_posterior")) - _logit(F.lit(mu))))))
    return out.select("doc_id", "host", "path", F.col("p").alias("doc_score"), "host_posterior", "path_posterior", score.alias("score")).withColumn("keep", F.col("score") >= threshold)

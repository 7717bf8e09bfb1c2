"""Toxic spans by a linear-chain conditional random field.

Labelled documents tell which words and word beginnings occur almost only in toxic ones; in toxic
documents such tokens are labelled toxic. A two-state chain over the words of each line, with hashed
features of the word and its first 3 to 6 bytes, is trained on windows of a bounded sample. Forward and
backward passes then give each token its marginal; marginals aggregate to a document score (a calibrated
noisy-or), and runs of likely tokens are the offending offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import Scratch, broadcast_if
from tidewater.llm.hashing import BYTES, FOLD, U, _power, mix, packed, slices, words

BITS = 18
PREFIX = (3, 4, 5, 6)
N_FEATURES = len(PREFIX) + 1
BLOCK = 1 << 21  # bytes of text scored at once: a worker holds about 25 times as many


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """words x features: hashes of the first 3 to 6 bytes (of words that are longer) and of the word without its closing punctuation."""
    if not len(starts):
        return np.zeros((0, N_FEATURES), U)
    folded = FOLD[data]
    plain = ends.copy()
    soft = np.zeros(256, bool)
    soft[[ord(c) for c in ".,;:!?\"')]}"]] = True
    for _ in range(3):
        plain -= (plain - starts > 1) & soft[folded[plain - 1]]
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum(BYTES[folded] * up[: len(data)], out=total[1:])
    out = np.empty((len(starts), N_FEATURES), U)
    for k, n in enumerate((*PREFIX, 1 << 40)):
        stop = np.minimum(plain, starts + n)
        out[:, k] = mix((total[stop] - total[starts]) * down[starts] + U((k + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1))
        if n < 1 << 40:
            out[plain - starts < n, k] = 0  # no such beginning
    return out


def lines(data: np.ndarray, off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bounds of the chains: words between two line ends or text ends."""
    breaks = np.union1d(off, np.flatnonzero(data == 10))
    return np.unique(np.append(np.searchsorted(starts, breaks), [0, len(starts)]))


class Chain:
    """Weights of the field: emissions of the toxic state, and log potentials of starts and transitions."""

    def __init__(self, w: np.ndarray, start: float, trans: np.ndarray, end: np.ndarray):
        self.w, self.start, self.trans, self.end = w, start, trans, end

    def emissions(self, f: np.ndarray) -> np.ndarray:
        e = np.full(len(f), self.w[-1], np.float64)
        for k in range(f.shape[1]):
            e += np.where(f[:, k] != 0, self.w[(f[:, k] >> U(64 - BITS)).astype(np.int64)], 0.0)
        return np.clip(e, -30, 30)

    def marginals(self, e: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """P(toxic) of each token."""
        fwd, bwd = self.passes(e, bounds)
        return 1 / (1 + np.exp(-np.clip(fwd + bwd, -60, 60)))

    def pairs(self, e: np.ndarray, fwd: np.ndarray, bwd: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Expected number of each pair of states over the tokens j and those before them."""
        left = np.stack([np.zeros(len(j)), fwd[j - 1]], 1)
        right = np.stack([np.zeros(len(j)), e[j] + bwd[j]], 1)
        x = left[:, :, None] + self.trans + right[:, None, :]
        x = np.exp(x - x.max(axis=(1, 2), keepdims=True))
        return (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)

    def passes(self, e: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds from the left (with the token) and from the right; chains run from bounds[i] to
        bounds[i + 1] and advance together, position by position."""
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        first, size = bounds[:-1][order], size[order]
        live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
        (t00, t01), (t10, t11) = np.exp(self.trans)
        fwd, bwd = np.empty_like(e), np.empty_like(e)
        r = None
        for t, n in enumerate(live):
            at = first[:n] + t
            if t:
                x = np.exp(r[:n])
                r = np.clip(e[at] + np.log((t01 + t11 * x) / (t00 + t10 * x)), -40, 40)
            else:
                r = np.clip(e[at] + self.start, -40, 40)
            fwd[at] = r
        final = self.end[1] - self.end[0]
        last = first + size - 1
        r = np.full(len(size), final)
        for t in range(len(live)):
            n = live[t]
            at = last[:n] - t
            if t:
                x = np.exp(np.clip(r[:n] + e[at + 1], -40, 40))
                r = np.log((t10 + t11 * x) / (t00 + t01 * x))
            bwd[at] = r[:n]
        return fwd, bwd


def train_chain(f: np.ndarray, y: np.ndarray, bounds: np.ndarray, epochs: int = 12, rate: float = 0.3, decay: float = 1e-6) -> Chain:
    """Gradient ascent on the log likelihood of labelled chains: observed less expected counts."""
    w = np.zeros((1 << BITS) + 1)
    w[-1] = -3.0
    c = Chain(w, 0.0, np.zeros((2, 2)), np.zeros(2))
    if not len(f):
        return c
    rng = np.random.default_rng(7)
    idx = np.where(f != 0, (f >> U(64 - BITS)).astype(np.int64), -1)
    chains = np.flatnonzero(np.diff(bounds) > 0)
    g2, gt = np.full(len(w), 1e-8), np.full((2, 2), 1e-8)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(chains), max(1, len(chains) // 512)):
            size = bounds[part + 1] - bounds[part]
            at = np.repeat(bounds[part] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            b = np.concatenate([[0], np.cumsum(size)])
            e = c.emissions(f[at])
            fwd, bwd = c.passes(e, b)
            p = 1 / (1 + np.exp(-np.clip(fwd + bwd, -60, 60)))
            d = (y[at] - p) / len(part)
            ii = idx[at]
            g = np.bincount(ii[ii >= 0], np.repeat(d[:, None], ii.shape[1], 1)[ii >= 0], minlength=len(w))
            g[-1] = d.sum()
            g -= decay * c.w
            g2 += g * g
            c.w += rate * g / np.sqrt(g2)
            inner = np.ones(len(at), bool)
            inner[b[:-1]] = False
            j = np.flatnonzero(inner)
            z = y[at].astype(int)
            obs = np.bincount(z[j - 1] * 2 + z[j], minlength=4).reshape(2, 2)
            exp = c.pairs(e, fwd, bwd, j)
            q = (obs - exp) / len(part)
            gt += q * q
            c.trans += 0.1 * q / np.sqrt(gt)
            c.start += 0.05 * float(np.mean(y[at][b[:-1]] - p[b[:-1]]))
    return c


def part_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text (a null id is the empty text), modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def document_features(marginal: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text the log odds of its noisy-or and the expected number of toxic tokens."""
    log_clean = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(marginal, 1 - 1e-9)))])
    total = np.concatenate([[0.0], np.cumsum(marginal)])
    none = np.minimum(log_clean[bounds[1:]] - log_clean[bounds[:-1]], -1e-9)
    odds = np.log(-np.expm1(none)) - none
    return np.stack([np.clip(odds, -12, 12), np.log1p(total[bounds[1:]] - total[bounds[:-1]])], 1)


class Model:
    def __init__(self, chain: Chain, weights: np.ndarray):
        self.chain, self.weights = chain, weights

    def run(self, data: np.ndarray, off: np.ndarray):
        """(document features, marginals, starts, ends, word bounds) of a slice of texts."""
        starts, ends, bounds = words(data, off)
        p = self.chain.marginals(self.chain.emissions(features(data, starts, ends)), lines(data, off, starts)) if len(starts) else np.zeros(0)
        return document_features(p, bounds), p, starts, ends, bounds

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:2] + self.weights[2], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights and, last, the bias, by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0
        return w
    r = np.full(len(w), ridge)
    r[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(r), a.T @ (y - p) - r * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = 2000, rate: float = 0.02, precision: float = 0.9, id_col: str = "doc_id", text_col: str = "text", spans: int = 4, words_each: int = 48) -> Model:
    """A model from the labelled rows given. ``sample``: documents of either label whose windows train the chain, up to
    ``spans`` windows of ``words_each`` words of each, half of them around labelled tokens.

    Evidence is counted over all labelled documents of distinct text: a feature counts when at least ``rate`` of the
    toxic ones hold it (so at most words a document / rate features do) and ``precision`` of those that hold it are
    toxic. Rows are put in order of their ids before anything is fitted, so the model does not depend on how they are
    dealt to tasks. Rows without a label are not read; null texts have no words; with one label only, or none, the
    chain keeps its first weights and every score is the label's share.
    """
    y = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    y = scratch.cut(y)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(broadcast_if(y, y.count(), 1_000_000), "doc_id")
    distinct = scratch.cut(own.groupBy(F.xxhash64("text").alias("same"), "toxic").agg(F.min("doc_id").alias("doc_id")))
    counts = {r["toxic"]: r["n"] for r in distinct.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)

    def keys(only: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, off = packed(batch["text"])
                for _, _, d, o in slices(data, off, BLOCK):
                    starts, ends, bounds = words(d, o)
                    f = features(d, starts, ends)
                    found = []
                    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                        k = np.unique(f[a:b])
                        k = k[k != 0]
                        found.append(k if only is None else k[np.isin(k, only)])
                    key, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

        return run

    once = own.join(broadcast_if(distinct.select("doc_id", "toxic"), n_toxic + n_clean, 1_000_000), ["doc_id", "toxic"], "left_semi").select("toxic", "text")
    toxic = once.where("toxic = 1").select("text").mapInArrow(keys(None), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(5.0, rate * n_toxic)).collect()  # at most features a document / rate
    held = np.sort(np.array([r["key"] for r in toxic], np.int64)).view(U)
    clean = {r["key"]: r["n"] for r in once.where("toxic = 0").select("text").mapInArrow(keys(held), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()} if len(held) else {}
    evidence = np.sort(np.array([r["key"] for r in toxic if r["n"] >= precision * (r["n"] + clean.get(r["key"], 0))], np.int64).view(U))

    chosen = None
    for v in (0, 1):
        part = distinct.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(sample).select("doc_id")
        chosen = part if chosen is None else chosen.union(part)
    chosen = scratch.cut(chosen)
    texts = scratch.cut(own.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "toxic", "text"))  # 2 * sample ids at most

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document: its windows, around labelled tokens and spread over the text."""
        half = max(1, spans // 2)
        for batch in batches:
            data, off = packed(batch["text"])
            kind = np.asarray(batch["toxic"])
            for i, j, d, o in slices(data, off, BLOCK):
                starts, ends, bounds = words(d, o)
                f = features(d, starts, ends)
                chain = np.zeros(len(starts) + 1, np.int64)
                chain[lines(d, o, starts)] = 1
                rows = []
                for r in range(i, j):
                    a, b = bounds[r - i], bounds[r - i + 1]
                    y = np.isin(f[a:b], evidence).any(axis=1) & (kind[r] == 1)
                    mids = np.flatnonzero(y)[:: max(1, int(y.sum()) // half)][:half].tolist()
                    spread = np.linspace(0, b - a, half + 2, dtype=int)[1:-1].tolist()
                    seq, label, flat = [], [np.zeros(0, np.int8)], [np.zeros((0, N_FEATURES), U)]
                    for m in mids + spread:
                        lo, hi = max(a, a + m - words_each // 2), min(b, a + m + words_each // 2)
                        if lo < hi:
                            cut = np.concatenate([[lo], lo + 1 + np.flatnonzero(chain[lo + 1 : hi]), [hi]])
                            for p, q in zip(cut[:-1], cut[1:], strict=True):
                                seq.append(int(q - p))
                                label.append(y[p - a : q - a].astype(np.int8))
                                flat.append(f[p:q])
                    rows.append((seq, np.concatenate(label).tobytes(), np.concatenate(flat).tobytes()))
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own["doc_id"], own["toxic"], pa.array([x for x, _, _ in rows], pa.list_(pa.int32())), pa.array([x for _, x, _ in rows], pa.binary()), pa.array([x for _, _, x in rows], pa.binary())], ["doc_id", "toxic", "size", "label", "flat"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = texts.mapInArrow(windows, f"doc_id {kind}, toxic int, size array<int>, label binary, flat binary").collect()  # at most 2 * sample rows
    got = sorted((r for r in got if r["size"]), key=lambda r: (r["doc_id"], r["toxic"], bytes(r["flat"])))
    size = np.concatenate([np.array(r["size"]) for r in got]) if got else np.zeros(0, int)
    label = np.concatenate([np.frombuffer(r["label"], np.int8) for r in got]) if got else np.zeros(0)
    flat = np.concatenate([np.frombuffer(r["flat"], U) for r in got]).reshape(-1, N_FEATURES) if got else np.zeros((0, N_FEATURES), U)
    chain = train_chain(flat, label.astype(float), np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
    raw = Model(chain, np.zeros(3))

    def aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = packed(batch["text"])
            for i, j, d, o in slices(data, off, BLOCK):
                x = raw.run(d, o)[0]
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch["toxic"].slice(i, j - i)], ["a", "b", "toxic"])

    rows = sorted((r["a"], r["b"], r["toxic"]) for r in texts.mapInArrow(aggregate, "a double, b double, toxic int").collect())  # at most 2 * sample rows of three numbers
    x, z = np.array([r[:2] for r in rows]).reshape(-1, 2), np.array([r[2] for r in rows], float)
    w = logistic(x, z)
    share = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    inside = (z.sum() + 0.5) / (len(z) + 1) if len(z) else 0.5
    w[-1] += np.log(share / (1 - share)) - np.log(inside / (1 - inside))  # the sample holds more toxic rows than the corpus
    return Model(chain, w)


def with_scores(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with _score, _starts and _ends as the last columns: every row over its whole text, all columns kept.

    A name that docs has already gets underscores at its end. Spans are runs of tokens with a marginal of at least 0.5, in characters. Null and empty texts have no
    spans and the score of a text without tokens; repeated rows get equal values.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB of weights
    taken, added = {c.lower() for c in docs.columns}, {}
    for name, kind in {"_score": T.DoubleType(), "_starts": T.ArrayType(T.IntegerType()), "_ends": T.ArrayType(T.IntegerType())}.items():
        while name in taken:
            name += "_"
        added[name] = kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, off = packed(batch[text_col])
            for i, j, d, o in slices(data, off, BLOCK):
                x, p, starts, ends, bounds = m.run(d, o)
                hot = np.flatnonzero(p >= 0.5)
                doc = np.searchsorted(bounds, hot, "right") - 1
                new = np.ones(len(hot), bool)
                new[1:] = (np.diff(hot) > 1) | (np.diff(doc) > 0)
                first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(hot)) - 1
                chars = np.concatenate([[0], np.cumsum((d & 0xC0) != 0x80)]) if len(hot) else np.zeros(len(d) + 1, np.int64)
                base = chars[o[doc[first]]] if len(hot) else np.zeros(0, np.int64)
                a, b = (chars[starts[hot[first]]] - base, chars[ends[hot[last]]] - base) if len(hot) else (base, base)
                at = pa.array(np.searchsorted(doc[first] if len(hot) else hot, np.arange(j - i + 1)).astype(np.int32))
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(m.score(x)), pa.ListArray.from_arrays(at, pa.array(a.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(b.astype(np.int32)))], [*batch.schema.names, *added]
                )

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in added.items())]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, out: int = 2, sample: int = 2000) -> DataFrame:
    """(doc_id, held_out, score, predicted, span_starts, span_ends) of every row of docs.

    Rows whose crc32(doc_id as text) mod ``folds`` is ``out`` are held out: their labels are not learnt from.
    Without labels, or with one label only, every score is the label's share. A null doc_id counts as the
    empty text and is never labelled.
    """
    scratch = Scratch(docs.sparkSession)
    model = fit(docs, labels.where(part_of(F.col("doc_id"), folds) != out), scratch, sample)
    own = docs.select("doc_id", "text", (part_of(F.col("doc_id"), folds) == out).alias("held_out"))
    return with_scores(own, model).select("doc_id", "held_out", F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"), F.col("_starts").alias("span_starts"), F.col("_ends").alias("span_ends"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the rows that a model fitted to all their labels scores at ``threshold`` or more.

    Null and empty texts have the score of a text without tokens; repeated rows share one fate; an empty table
    gives an empty one; all columns are kept.
    """
    model = fit(docs, labels, Scratch(docs.sparkSession))
    scored = with_scores(docs, model)
    return scored.where(F.col(scored.columns[-3]) < threshold).select([F.col(f"`{c}`") for c in docs.columns])

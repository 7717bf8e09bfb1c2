"""Language-model scores: a causal self-attention model over subword ids, trained and run in numpy.

Words are cut into subwords by a public tokenizer; a text ends with one end token. Windows of 16 subwords
overlap by 4, and each scores its last 12 (a text's first window all), so every token is scored once. A
block of windows passes one masked attention layer together; the next token's probability is that of its
class times that within the class (a two-level softmax over the 1,024 most frequent ids of all training
texts; all others share one class by their counts). A word's probability is the product over its subwords.

Beside it stands the base: smoothed unigram probabilities of words, counted over all training texts. The
score of a word mixes both, share * attention + (1 - share) * base, so that no text loses more than
log10(1 - share) a word against the base. Words that training never saw are one class of the base, and the
attention's probability of the one that stands there is a lower bound for that class.

The weights start from a bounded sample on the driver and are then trained over all training texts: of the
segments of all texts one in ``part`` (a share of the corpus, from all over each text, that grows with it) is
dealt by a hash to shards of like size; each shard takes steps of its own from the start, and the shards' weights
are averaged by their tokens. Shards and the order in them depend on the texts only, not on how rows are dealt to tasks.

Every distinct word of the training texts is cut into subwords once, after it has been counted. The most
frequent words (at most KNOWN) are known to every task with their counts and subwords; the counts of the
rest are joined by shuffle.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch
from tidewater.llm.hashing import FOLD, U, mix, packed, slices, span_hashes, words
from tidewater.llm.toxicity import part_of

WINDOW, OVERLAP, DIM, CLASSES, SIZE = 16, 4, 16, 32, 32
STEP = WINDOW - OVERLAP
HEAD = CLASSES * SIZE  # ids with an embedding of their own; one more stands for all others, one for the start
KNOWN = 300_000  # words that every task knows
INDEX_BITS = 21  # leading bits of a hash that find a known word
END = mix(np.array([0xE0F], U))[0]
BLOCK = 1 << 21
MEMO = 300_000
SEGMENT, PART = 64, 16  # words of a segment; one of PART segments of all texts is trained on
SHARD, SHARD_BATCH, SHARD_RATE = 500_000, 256, 0.003  # words that a shard of segments has, and its steps


def tokenizer_bytes(path: str | None = None) -> bytes:
    """The model file of a sentencepiece tokenizer; by default the public one that is installed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


class Subwords:
    """Subword ids of words; made from the tokenizer's bytes and, at will, known words: their sorted hashes, counts, numbers of ids and ids."""

    def __init__(self, raw: bytes, known: np.ndarray | None = None, often: np.ndarray | None = None, n: np.ndarray | None = None, flat: np.ndarray | None = None):
        import sentencepiece

        none = np.zeros(0, np.int64)
        self.raw, self.known, self.often = raw, none.view(U) if known is None else known, none if often is None else often
        self.known_n, self.known_flat = none if n is None else n, np.zeros(0, np.int32) if flat is None else flat
        self.known_at = np.cumsum(self.known_n, dtype=np.int64) - self.known_n
        self.first = np.concatenate([[0], np.cumsum(np.bincount((self.known >> U(64 - INDEX_BITS)).astype(np.int64), minlength=1 << INDEX_BITS))]).astype(np.int32)
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(raw)
        self.end = self.model.get_piece_size()
        self.forget()

    def __reduce__(self):
        return Subwords, (self.raw, self.known, self.often, self.known_n, self.known_flat)

    def forget(self) -> None:
        self.seen, self.at, self.n, self.flat = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), self.known_flat

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes among the known words, else -1."""
        slot = (h >> U(64 - INDEX_BITS)).astype(np.int64)
        at, stop, out = self.first[slot], self.first[slot + 1], np.full(len(h), -1, np.int32)
        left = np.flatnonzero(at < stop)
        at = at[left]
        while len(left):
            same = self.known[at] == h[left]
            out[left[same]] = at[same]
            more = ~same & (at + 1 < stop[left])
            left, at = left[more], at[more] + 1
        return out

    def cut(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, ids) of words of lower-cased bytes."""
        raw = data.tobytes()
        found = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        try:
            raw.decode()
        except UnicodeDecodeError:
            found = [x.decode("utf-8", "replace") for x in found]
        got = self.model.encode(found, num_threads=1) if found else []
        n = np.fromiter(map(len, got), np.int64, len(got))
        return n, np.fromiter(chain.from_iterable(got), np.int32, int(n.sum()))

    def _learn(self, known: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of distinct words (their hashes, bytes and bounds) among those seen; new ones are cut. At most MEMO stay seen."""
        if len(self.seen) + len(known) > MEMO:
            self.forget()
        place = np.minimum(np.searchsorted(self.seen, known), max(0, len(self.seen) - 1))
        new = np.flatnonzero(self.seen[place] != known) if len(self.seen) else np.arange(len(known))
        if len(new):
            n, ids = self.cut(FOLD[data], starts[new], ends[new])
            at = len(self.flat) + np.cumsum(n) - n
            self.flat = np.concatenate([self.flat, ids])
            seen = np.concatenate([self.seen, known[new]])
            order = np.argsort(seen, kind="stable")
            self.seen, self.at, self.n = seen[order], np.concatenate([self.at, at])[order], np.concatenate([self.n, n])[order]
            place = np.searchsorted(self.seen, known)
        return place

    def texts(self, data: np.ndarray, off: np.ndarray, starts: bool = False):
        """(word hashes, word bounds, ids, bounds of ids): each text's subwords and its end token; with ``starts`` also where each word's ids begin and end, and its place among the known words."""
        a, b, bounds = words(data, off)
        h = span_hashes(data, a, b)
        place = self.find(h)
        other = np.flatnonzero(place < 0)
        seen, first, which = np.unique(h[other], return_index=True, return_inverse=True)
        learnt = self._learn(seen, data, a[other[first]], b[other[first]])[which]
        at, size = self.known_at[place] if len(self.known) else np.zeros(len(h), np.int64), self.known_n[place].astype(np.int64) if len(self.known) else np.zeros(len(h), np.int64)
        at[other], size[other] = (self.at[learnt], self.n[learnt]) if len(other) else (0, 0)
        total = np.concatenate([[0], np.cumsum(size)])
        text = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
        ids = np.full(int(total[-1]) + len(off) - 1, self.end, np.int32)
        src = np.repeat(at - total[:-1], size) + np.arange(total[-1])
        ids[np.arange(total[-1]) + np.repeat(text, size)] = self.flat[src]
        found = h, bounds, ids, total[bounds] + np.arange(len(off))
        return (*found, total[:-1] + text, total[1:] + text, place) if starts else found


def subwords(raw: bytes | Subwords) -> Subwords:
    return raw if isinstance(raw, Subwords) else Subwords(raw)


def windows(ids: np.ndarray, bounds: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs and next ids: windows x (WINDOW + 1), first position scored, text of each window).

    Window k of a text predicts its tokens from 12 k on (the first: all 16), with the start id before the text.
    """
    size = np.diff(bounds)
    n = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STEP)), 0)
    text = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    pos = (k * STEP)[:, None] + np.arange(-1, WINDOW)[None, :]
    inside = (pos >= 0) & (pos < size[text][:, None])
    got = np.where(inside, ids[np.where(inside, pos + bounds[:-1][text][:, None], 0)] if len(ids) else 0, np.where(pos < 0, start, -1))
    return got, np.where(k > 0, OVERLAP, 0), text


def segments(data: np.ndarray, off: np.ndarray, salt: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, text, number in it, whether it ends it) of one in ``part`` of the runs of SEGMENT words; ``salt`` of a text shifts the choice."""
    starts, ends, bounds = words(data, off)
    n = -(-np.diff(bounds) // SEGMENT)
    text = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    pick = (k + salt[text]) % part == 0
    text, k = text[pick], k[pick]
    a = bounds[text] + k * SEGMENT
    b = np.minimum(a + SEGMENT, bounds[text + 1])
    lo, size = starts[a], ends[b - 1] - starts[a]
    edge = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(lo - edge[:-1], size) + np.arange(edge[-1])], edge, text, k, b == bounds[text + 1]


def spans(ids: np.ndarray, bounds: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Windows that follow each other, of runs with an end token each: -2 stands before the ``first`` of a text, and only the ``last`` keeps its end."""
    lo, hi = bounds[:-1] - first, bounds[1:] - ~last
    n = -(-np.maximum(hi - lo - 1, 0) // WINDOW)
    run = np.repeat(np.arange(len(n)), n)
    pos = (lo[run] + (np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW)[:, None] + np.arange(WINDOW + 1)
    return np.where(pos < bounds[run][:, None], -2, np.where(pos < hi[run][:, None], ids[np.clip(pos, 0, max(0, len(ids) - 1))] if len(ids) else -1, -1))


def wide(z: np.ndarray) -> bool:
    """Whether exp may leave its range, so that rows need their maximum taken off."""
    return bool(z.size) and bool(z.max() >= 60 or z.min() <= -60)


class Attention:
    """Weights; ids are compact: 0..HEAD-1 by frequency, HEAD for all others, HEAD + 1 for the start, -1 after the end."""

    def __init__(self, head: np.ndarray, vocabulary: int, seed: int = 3, counts: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) * 0.25).astype(np.float32)
        self.compact = np.full(vocabulary, HEAD, np.int32)
        self.compact[head] = np.arange(len(head))
        self.rare = max(1, vocabulary - len(head))
        self.live = len(head)
        self.tail = np.zeros(vocabulary)  # log of an id's share of the class of others against an even one
        if counts is not None and vocabulary > len(head):
            c = np.where(self.compact == HEAD, counts + 0.1, 0.0)
            self.tail[c > 0] = np.log(c[c > 0] / c.sum() * self.rare)
        self.p = {"e": r(HEAD + 2, DIM), "pos": r(WINDOW, DIM), "q": r(DIM, DIM), "k": r(DIM, DIM), "v": r(DIM, DIM), "r": r(DIM, DIM), "b": np.zeros(DIM, np.float32), "c": r(DIM, CLASSES + 1), "cb": np.zeros(CLASSES + 1, np.float32), "u": r(CLASSES, SIZE, DIM) * 0.5, "ub": np.zeros((CLASSES, SIZE), np.float32)}
        dead = np.arange(HEAD).reshape(SIZE, CLASSES).T >= len(head)  # id i is member i // CLASSES of class i % CLASSES
        self.p["ub"][dead] = -1e9
        self.p["cb"][:CLASSES][dead.all(axis=1)] = -1e9
        self.before = np.tri(WINDOW, dtype=np.float32)  # what a position sees

    def joined(self) -> np.ndarray:
        """Query, key, value and residual weights side by side."""
        p = self.p
        return np.concatenate([p["q"] * np.float32(DIM**-0.5), p["k"], p["v"], p["r"]], axis=1)

    def attend(self, q: np.ndarray, k: np.ndarray, since: int = 0) -> np.ndarray:
        """Shares with which the positions from ``since`` on see those up to them: windows x (WINDOW - since) x WINDOW."""
        a = q @ k.transpose(0, 2, 1)
        if wide(a):
            a += (self.before[since:] - 1) * np.float32(1e9)
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a *= self.before[since:]
        a *= (1 / (a.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32))).reshape(*a.shape[:2], 1)
        return a

    def forward(self, x: np.ndarray) -> dict:
        """Inputs, joined projections, shares, attended values and hidden states of windows, from the weights as they are."""
        h = self.p["e"].take(x, 0)
        h += self.p["pos"]
        t = (h.reshape(-1, DIM) @ self.joined()).reshape(*x.shape, 4 * DIM)
        a = self.attend(t[:, :, :DIM], t[:, :, DIM : 2 * DIM])
        v = a @ t[:, :, 2 * DIM : 3 * DIM]
        o = v + t[:, :, 3 * DIM :]
        o += self.p["b"]
        return {"h": h, "t": t, "a": a, "v": v, "o": np.maximum(o, 0, out=o)}

    def tables(self) -> None:
        """Query, key, value and residual of every id, so that scoring looks up what does not depend on position."""
        p, join = self.p, self.joined()
        self.by_id, self.by_pos = p["e"] @ join, (p["pos"] @ join)
        self.by_pos[:, 3 * DIM :] += p["b"]
        self.to_class = np.vstack([p["c"], p["cb"]])  # biases stand beside a hidden value of 1
        self.to_member = np.ascontiguousarray(np.concatenate([p["u"], p["ub"][:, :, None]], axis=2).transpose(0, 2, 1))

    def hidden(self, x: np.ndarray, since: int) -> np.ndarray:
        """As forward()["o"], for positions from ``since`` on: windows x (WINDOW - since) x (DIM and a 1)."""
        t = self.by_id.take(x, 0)
        t += self.by_pos
        a = self.attend(t[:, since:, :DIM], t[:, :, DIM : 2 * DIM], since)
        o = np.empty((len(x), WINDOW - since, DIM + 1), np.float32)
        np.add(a @ t[:, :, 2 * DIM : 3 * DIM], t[:, since:, 3 * DIM :], out=o[:, :, :DIM])
        o[:, :, DIM] = 1
        return np.maximum(o, 0, out=o)

    @staticmethod
    def _log_softmax(z: np.ndarray, at: np.ndarray) -> np.ndarray:
        if wide(z):
            z -= z.max(axis=1, keepdims=True)
        got = z[np.arange(len(at)), at]
        np.exp(z, out=z)
        return got - np.log(z @ np.ones(z.shape[1], np.float32))

    @staticmethod
    def _by_class(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], int]:
        """(order of the targets by class, without those below 0; classes in it; (class, begin, end) of those with members; targets in these)."""
        cls = np.where(y < HEAD, y % CLASSES, CLASSES).astype(np.uint8)
        cls[y < 0] = CLASSES + 1
        order = np.argsort(cls, kind="stable")
        edge = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES + 2))]).tolist()
        order = order[: edge[CLASSES + 1]]
        return order, cls[order], [(j, edge[j], edge[j + 1]) for j in range(CLASSES) if edge[j + 1] > edge[j]], edge[CLASSES]

    def log_probability(self, o: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of P(y | o), for rows of hidden states and compact ids; 0 where an id is below 0."""
        order, cls, live, m = self._by_class(y)
        whole, o, y = y, o.take(order, 0), y[order]
        got = self._log_softmax(o @ self.to_class, cls)
        z = np.empty((m, SIZE), np.float32)
        for j, i, k in live:
            np.matmul(o[i:k], self.to_member[j], out=z[i:k])
        got[:m] += self._log_softmax(z, y[:m] // CLASSES)
        got[m:] -= np.float32(np.log(self.rare))
        out = np.zeros(len(whole), np.float32)
        out[order] = got
        return out

    def token_scores(self, ids: np.ndarray, bounds: np.ndarray, block: int = 512) -> np.ndarray:
        """Natural log of the probability of each id after those before it in its text."""
        self.tables()
        out = self.tail[ids]
        w, first, text = windows(self.compact[ids], bounds, HEAD + 1)
        begin = bounds[text] + (np.arange(len(text)) - np.searchsorted(text, text)) * STEP
        for start, since in ((0, 0), (1, OVERLAP)):
            chosen = np.flatnonzero((first > 0) == bool(start))
            for i in range(0, len(chosen), block):
                part = w[chosen[i : i + block]]
                y = part[:, 1 + since :]
                use = y >= 0
                got = self.log_probability(self.hidden(np.where(part[:, :-1] < 0, HEAD, part[:, :-1]), since).reshape(-1, DIM + 1), y.ravel())
                at = begin[chosen[i : i + block]][:, None] + np.arange(since, WINDOW)
                out[at[use]] += got[use.ravel()]
        return out

    @staticmethod
    def _errors(z: np.ndarray, at: np.ndarray) -> float:
        """Sum of -log softmax(z) at ``at``; z becomes the softmax less 1 there."""
        if wide(z):
            z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z *= (1 / (z @ np.ones(z.shape[1], np.float32)))[:, None]
        row = np.arange(len(at))
        got = z[row, at]
        z[row, at] = got - 1
        return -float(np.log(got + np.float32(1e-30)).sum())

    def gradients(self, part: np.ndarray) -> tuple[float, dict]:
        """(mean loss of windows of compact ids, gradients of the weights)."""
        p, g = self.p, {}
        x, y = np.where(part[:, :-1] < 0, HEAD, part[:, :-1]).astype(np.intp), part[:, 1:].ravel()
        f = self.forward(x)
        t, a = f["t"], f["a"]
        order, cls, live, m = self._by_class(y)
        n, y = max(1, len(order)), y[order]
        o = np.empty((len(order), DIM + 1), np.float32)  # biases stand beside a hidden value of 1
        o[:, :DIM], o[:, DIM] = f["o"].reshape(-1, DIM).take(order, 0), 1
        z = o @ np.vstack([p["c"], p["cb"]])
        loss = self._errors(z, cls)
        up, by_class = z @ p["c"].T, o.T @ z
        member, by_member = np.concatenate([p["u"], p["ub"][:, :, None]], axis=2), np.zeros((CLASSES, SIZE, DIM + 1), np.float32)
        z = np.empty((m, SIZE), np.float32)
        for j, i, k in live:
            np.matmul(o[i:k], member[j].T, out=z[i:k])
        loss += self._errors(z, y[:m] // CLASSES)
        for j, i, k in live:
            np.matmul(z[i:k].T, o[i:k], out=by_member[j])
            up[i:k] += z[i:k] @ p["u"][j]
        d = np.zeros((len(x) * WINDOW, DIM), np.float32)
        d[order] = up
        d = d.reshape(f["o"].shape)
        d *= f["o"] > 0
        back = np.empty_like(t)  # of queries, keys, values and residuals
        q, k, v = t[:, :, :DIM], t[:, :, DIM : 2 * DIM], t[:, :, 2 * DIM : 3 * DIM]
        s = d @ v.transpose(0, 2, 1)
        s -= ((d * f["v"]).reshape(-1, DIM) @ np.ones(DIM, np.float32)).reshape(len(x), WINDOW, 1)
        s *= a
        np.matmul(s, k, out=back[:, :, :DIM])
        np.matmul(s.transpose(0, 2, 1), q, out=back[:, :, DIM : 2 * DIM])
        np.matmul(a.transpose(0, 2, 1), d, out=back[:, :, 2 * DIM : 3 * DIM])
        back[:, :, 3 * DIM :] = d
        back = back.reshape(-1, 4 * DIM)
        by_join, dh = f["h"].reshape(-1, DIM).T @ back, back @ self.joined().T
        g["c"], g["cb"], g["u"], g["ub"] = by_class[:DIM], by_class[DIM], by_member[:, :, :DIM], by_member[:, :, DIM]
        g["q"], g["k"], g["v"], g["r"] = by_join[:, :DIM] * np.float32(DIM**-0.5), by_join[:, DIM : 2 * DIM], by_join[:, 2 * DIM : 3 * DIM], by_join[:, 3 * DIM :]
        g["b"], g["pos"] = np.ones(len(back), np.float32) @ back[:, 3 * DIM :], dh.reshape(len(x), -1).sum(axis=0).reshape(WINDOW, DIM)
        at = (x.reshape(-1, 1) * DIM + np.arange(DIM)).ravel()
        g["e"] = np.bincount(at, dh.ravel(), minlength=(HEAD + 2) * DIM).astype(np.float32).reshape(HEAD + 2, DIM)
        return loss / n, {name: z * np.float32(1 / n) for name, z in g.items()}

    def inputs(self, w: np.ndarray) -> np.ndarray:
        """Compact ids of windows of raw ids with -2 before the text and -1 after its end."""
        return np.where(w >= 0, self.compact[np.maximum(w, 0)], np.where(w == -2, HEAD + 1, -1))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def copy(self, flat: np.ndarray | None = None) -> Attention:
        """Weights of its own, by default the same; all else is shared."""
        out, at = copy.copy(self), 0
        out.p = {}
        for k in sorted(self.p):
            size = self.p[k].size
            out.p[k] = self.p[k].copy() if flat is None else flat[at : at + size].astype(np.float32).reshape(self.p[k].shape)
            at += size
        return out

    def train(self, w: np.ndarray, steps: int = 1200, batch: int = 128, rate: float = 0.01) -> Adam:
        """Steps over shuffled windows; the learner keeps its moments for more."""
        rng, learner = np.random.default_rng(5), Adam(self)
        for t in range(1, (steps if len(w) else 0) + 1):
            learner.step(w[rng.integers(0, len(w), batch)], rate * min(1, t / 50) * (1 - 0.9 * t / steps))
        return learner


class Adam:
    """Takes over the model's weights: they become views of one array."""

    def __init__(self, model: Attention):
        self.model, self.w, self.t = model, model.flat(), 0
        self.m, self.s, at = np.zeros_like(self.w), np.zeros_like(self.w), 0
        for k in sorted(model.p):
            model.p[k] = self.w[at : at + model.p[k].size].reshape(model.p[k].shape)
            at += model.p[k].size

    def step(self, w: np.ndarray, rate: float) -> float:
        """A step on windows of compact ids; their loss before it."""
        loss, g = self.model.gradients(w)
        self.apply(g, rate)
        return loss

    def apply(self, g: dict, rate: float) -> None:
        self.t += 1
        x = np.concatenate([g[k].ravel() for k in sorted(g)])
        self.m *= np.float32(0.9)
        self.m += np.float32(0.1) * x
        self.s *= np.float32(0.99)
        x *= x
        x *= np.float32(0.01)
        self.s += x
        np.multiply(self.s, np.float32(1 / (1 - 0.99**self.t)), out=x)
        np.sqrt(x, out=x)
        x += np.float32(1e-8)
        np.divide(self.m, x, out=x)
        x *= np.float32(rate / (1 - 0.9**self.t))
        self.w -= x


def _training_windows(own: DataFrame, raw: bytes | Subwords, sample: int, most: int) -> np.ndarray:
    """Windows of raw ids from a sample of texts, spread over whole texts: at most ``sample`` texts and ``most`` windows."""
    chosen = own.select("key").orderBy(F.xxhash64("key", F.lit(11)), "key").limit(sample)
    texts = own.join(F.broadcast(chosen), "key", "left_semi").select("text")
    each, raw = max(1, most // max(1, sample)), subwords(raw).raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = Subwords(raw)
        for batch in batches:
            data, off = packed(batch["text"])
            for _, _, d, o in slices(data, off, BLOCK):
                _, _, ids, bounds = sub.texts(d, o)
                w, _, text = windows(ids, bounds, -2)
                edge = np.searchsorted(text, np.arange(len(o)))
                pick = np.concatenate([np.unique(np.linspace(a, b - 1, min(each, b - a), dtype=int)) for a, b in zip(edge[:-1], edge[1:], strict=True) if b > a] or [np.zeros(0, int)])
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in w[pick].astype(np.int32)], pa.binary())], ["w"])

    got = sorted(bytes(r["w"]) for r in texts.mapInArrow(run, "w binary").collect())
    return np.frombuffer(b"".join(got), np.int32).reshape(-1, WINDOW + 1)


def fit(own: DataFrame, raw: bytes | Subwords, counts: np.ndarray, n_words: int, sample: int = 2048, most: int = 65_536, part: int = PART, shard: int = SHARD) -> Attention:
    """The attention model of all training texts (key, text) with n_words tokens; counts of all subword ids. ``sample`` and ``most`` bound only the start."""
    w = _training_windows(own, raw, sample, most)
    head = np.argsort(-counts, kind="stable")[: min(HEAD, int((counts > 0).sum()))]
    model = Attention(head, len(counts), counts=counts)
    model.train(model.inputs(w))
    return averaged(own, raw, model, max(1, round(n_words / part / shard)), part)


def averaged(own: DataFrame, raw: bytes | Subwords, model: Attention, shards: int, part: int = PART) -> Attention:
    """model after each shard of segments has trained a copy of it: a tree adds tokens x weights of the shards."""
    shared = own.sparkSession.sparkContext.broadcast((subwords(raw), model))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = packed(batch["text"])
            key = np.asarray(batch["key"])
            for i, j, d, o in slices(data, off, BLOCK):
                d, o, text, k, last = segments(d, o, (key[i:j].view(U) % U(part)).astype(np.int64), part)
                own = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer(o.astype(np.int32)), pa.py_buffer(d)])
                yield pa.RecordBatch.from_arrays([pa.array(key[i:j][text]), pa.array(k), pa.array(last), own], ["key", "k", "last", "own"])

    def train(t: pa.Table) -> pa.Table:
        sub, model = shared.value
        t = t.sort_by([("key", "ascending"), ("k", "ascending"), ("own", "ascending")])
        model = model.copy()
        _, _, ids, bounds = sub.texts(*packed(t["own"]))
        w = model.inputs(spans(ids, bounds, np.asarray(t["k"]) == 0, np.asarray(t["last"])))
        w = w[np.random.default_rng(11).permutation(len(w))]
        learner, steps = Adam(model), max(1, -(-len(w) // SHARD_BATCH))
        for i in range(steps):
            learner.step(w[i * SHARD_BATCH : (i + 1) * SHARD_BATCH], SHARD_RATE * min(1, (i + 1) / 20) * (1 - i / steps))
        n = float((w[:, 1:] >= 0).sum())
        return pa.table({"w": pa.array([np.append(model.flat().astype(np.float64) * n, n).tobytes()], pa.binary())})

    own = own.mapInArrow(cut, "key long, k long, last boolean, own binary").withColumn("shard", F.pmod(F.xxhash64("key", "k"), F.lit(shards)))
    parts = own.groupBy("shard").applyInArrow(train, "w binary").rdd.map(lambda r: np.frombuffer(r["w"]))
    total = parts.treeAggregate(np.zeros(len(model.flat()) + 1), lambda a, b: a + b, lambda a, b: a + b)
    return model.copy(total[:-1] / total[-1]) if total[-1] else model


def word_counts(texts: DataFrame, raw: bytes, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(piece, h, c, cut): how often each word, and the end token (without ids), occurs in all the texts, and its subword ids; with piece, each subword id (as h). ``keep`` stores what must not be computed twice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = packed(batch["text"])
            keys, counts, spelt = [np.array([END], U)], [np.array([len(off) - 1])], [pa.array([b""], pa.binary())]
            for _, _, d, o in slices(data, off, BLOCK):
                starts, ends, _ = words(d, o)
                k, first, n = np.unique(span_hashes(d, starts, ends), return_index=True, return_counts=True)
                lo, size = starts[first], ends[first] - starts[first]
                edge = np.concatenate([[0], np.cumsum(size)])
                own = FOLD[d[np.repeat(lo - edge[:-1], size) + np.arange(edge[-1])]]
                keys.append(k)
                counts.append(n)
                spelt.append(pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(own)]))
            k, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            n = np.bincount(which, np.concatenate(counts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.concat_arrays(spelt).take(pa.array(first)), pa.array(n)], ["h", "word", "c"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = Subwords(raw)
        for batch in batches:
            data, off = packed(batch["word"])
            n, ids = sub.cut(data, off[:-1], off[1:])
            edge = np.concatenate([[0], np.cumsum(n)]) * 4
            yield pa.RecordBatch.from_arrays([batch["h"], batch["c"], pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(ids)])], ["h", "c", "cut"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = Subwords(raw).end
        total = np.zeros(end + 1, np.int64)
        for batch in batches:
            data, off = packed(batch["cut"])
            h, c = np.asarray(batch["h"]).view(U), np.asarray(batch["c"])
            total += np.bincount(data.view(np.int32), np.repeat(c, np.diff(off) // 4), minlength=end + 1).astype(np.int64)
            total[end] += c[h == END].sum()
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["h", "c"])

    found = texts.select("text").mapInArrow(count, "h long, word binary, c long").groupBy("h", "word").agg(F.sum("c").alias("c"))
    found = keep(found.mapInArrow(cut, "h long, c long, cut binary"))
    ids = found.mapInArrow(pieces, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    return found.select(F.lit(False).alias("piece"), "h", "c", "cut").unionByName(ids.select(F.lit(True).alias("piece"), "h", "c", F.lit(None).cast("binary").alias("cut")))


def known_words(counts: DataFrame, raw: bytes) -> Subwords:
    """The tokenizer with the most frequent words of (h, c, cut): those above the least count that leaves at most KNOWN of them."""
    step = F.floor(F.log2("c") * 16)
    least, n = None, 0
    for s, more in sorted(((r["s"], r["count"]) for r in counts.groupBy(step.alias("s")).count().collect()), reverse=True):  # a row for each step of counts
        n += more
        if n > KNOWN:
            break
        least = s
    if least is None:
        return Subwords(raw)
    top = counts.where(step >= least).select("h", "c", "cut").toArrow()
    top = top.take(pa.array(np.argsort(top["h"].to_numpy().view(U))))
    data, off = packed(top["cut"])
    return Subwords(raw, top["h"].to_numpy().view(U), top["c"].to_numpy(), (np.diff(off) // 4).astype(np.int32), data.view(np.int32))


def lm_scores(docs: DataFrame, tokenizer: str | None = None, folds: int = 10, out: int = 0, id_col: str = "doc_id", text_col: str = "text", sample: int = 2048, share: float = 0.5, most: int = 65_536, part: int = PART, shard: int = SHARD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    Rows whose crc32(doc_id as text) mod ``folds`` is ``out`` are held out; all others are learnt from. Null
    texts are empty: one end token. A null doc_id counts as the empty text. Repeated rows are scored, and
    learnt from, each. Without training rows N and V are 0 and the model keeps its first weights. Other
    columns are not read. ``share`` is that of the attention model in a word's probability. Its first weights come from at
    most ``most`` windows of ``sample`` texts; then one of ``part`` runs of 64 words of all texts trains it (1: all words of
    all texts), in shards of about ``shard`` words whose weights are averaged.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    raw = tokenizer_bytes(tokenizer)
    held = part_of(F.col("doc_id"), folds) == out
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("held_out", held)
    learn = own.where("not held_out")
    both = word_counts(learn, raw, scratch.cut)
    counts = both.where("not piece").select("h", "c", "cut")
    pieces = np.zeros(Subwords(raw).end + 1, np.int64)
    for r in both.where("piece").select("h", "c").collect():  # at most the vocabulary
        pieces[r["h"]] = r["c"]
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = row["n"], row["v"]
    sub = known_words(counts, raw)
    model = fit(learn.select(F.xxhash64("doc_id", "text").alias("key"), "text"), sub, pieces, n, sample, most, part, shard)
    shared = spark.sparkContext.broadcast((sub, model))
    floor = float(n + 0.1 * (v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, model = shared.value
        p = (sub.often + 0.1) / floor
        logs = np.log10(p)
        for batch in batches:
            data, off = packed(batch["text"])
            for i, j, d, o in slices(data, off, BLOCK):
                h, bounds, ids, at, begin, stop, pos = sub.texts(d, o, starts=True)
                size = np.diff(bounds)
                text = np.append(np.repeat(np.arange(j - i), size), np.arange(j - i))
                h = np.append(h, np.full(j - i, END, U))
                each = model.token_scores(ids, at)
                upto = np.concatenate([[0.0], np.cumsum(each)])
                whole = np.append(np.where(stop > begin, np.exp(np.minimum(upto[stop] - upto[begin], 0)), 0), np.exp(each[at[1:] - 1]))  # a word without subwords goes by the base
                pos = np.append(pos, np.repeat(sub.find(np.array([END], U)), j - i))
                known = pos >= 0
                base = np.bincount(text[known], logs[pos[known]], minlength=j - i)
                score = np.bincount(text[known], np.log10(share * whole[known] + (1 - share) * p[pos[known]]), minlength=j - i)
                tail_text, tail, rest = text[~known], h[~known], whole[~known].astype(np.float32)
                sort = np.argsort(tail_text, kind="stable")
                tail_at = np.searchsorted(tail_text[sort], np.arange(j - i + 1)).astype(np.int32)
                words_of = pa.StructArray.from_arrays([pa.array(tail[sort].view(np.int64)), pa.array(rest[sort])], ["h", "p"])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, j - i), batch["held_out"].slice(i, j - i), pa.array(size + 1), pa.array(np.bincount(text[known], minlength=j - i)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(tail_at, words_of)],
                    ["doc_id", "held_out", "n_tokens", "known", "base", "score", "tail"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    scored = own.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, tail array<struct<h:long,p:float>>")
    scored = scratch.cut(scored.withColumn("key", F.monotonically_increasing_id()))  # written, so that a row keeps its key
    base = (F.coalesce("c", F.lit(0)) + 0.1) / floor
    rare = scored.select("key", F.inline("tail")).join(counts.select("h", "c"), "h", "left").groupBy("key")
    rare = rare.agg(F.sum(F.log10(base)).alias("more"), F.sum(F.log10(F.col("p") * share + base * (1 - share))).alias("mixed"), F.count("c").alias("also"))
    whole = scored.drop("tail").join(rare, "key", "left")
    plus = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0.0)))
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base", "more").alias("base_score"), plus("score", "mixed").alias("score"))

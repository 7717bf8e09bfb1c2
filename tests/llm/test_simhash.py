"""SimHash links against brute force: hashes, the Gray-order index at several sizes, components and odd rows."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import queries, simhash
from tidewater.llm.common import Scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text, n=3):
    ws = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    grams = [" ".join(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))] if ws else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def lowest(ids, fps, distance=3):
    """The least id reachable from each row, over links between all pairs."""
    fp = np.array(fps, np.uint64)
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fp[:i] ^ fp[i]) <= distance):
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(least.get(root(i), x), x)
    return [least[root(i)] for i in range(len(ids))]


def test_documents_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = [fingerprint(r["text"]) for r in rows]
    want = {(r["doc_id"], f"{f:016x}", c) for r, f, c in zip(rows, fps, lowest([r["doc_id"] for r in rows], fps), strict=True)}
    assert {tuple(r) for r in queries.QUERIES["op13_simhash"](spark, SF).collect()} == want


def test_hash_is_the_engines(spark):
    df = spark.createDataFrame([("ein satz über drei wörter hinaus",)], "text string")
    gram = df.select(F.xxhash64(F.lit("ein satz über")), F.xxhash64(F.lit("drei wörter hinaus"))).first()
    import pyarrow as pa

    from tidewater.llm.hashing import packed

    h, bounds = simhash.shingle_hashes(*packed(pa.array(df.first()["text"].split("|"))), 3)
    assert h.view(np.int64)[[0, 3]].tolist() == list(gram) and bounds.tolist() == [0, 4]


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [("e", None), ("d", ""), ("c", " \n\t"), (None, "some words here"), ("b", "one"), ("b", "one"), ("a", "ONE"), ("f", long), ("g", long + " end"), ("h", "two words"), ("i", "two\twords")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "key string, body string, fp int, id int")
    got = simhash.simhash_duplicates(df, "key", "body").collect()
    fps = [fingerprint(t) for _, t in rows]
    named = [(k, f) for (k, _), f in zip(rows, fps, strict=True) if k is not None]
    want = dict(zip([k for k, _ in named], lowest([k for k, _ in named], [f for _, f in named]), strict=True)) | {None: None}
    assert len(got) == len(rows) and all(r["component_id"] == want[r["key"]] for r in got)
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{f:016x}" for f in fps)
    assert want["e"] == want["d"] == want["c"] == "c" and want["b"] == "a" and want["i"] == "h"
    assert simhash.simhash_duplicates(df.limit(0), "key", "body").count() == 0


@pytest.mark.parametrize(("block", "fan"), [(4096, 16), (64, 2), (16, 4), (1, 2)])
def test_index_finds_all(spark, block, fan):
    """Random fingerprints, chains of near ones, and a crowded ball, over one block and over many levels."""
    rng = np.random.default_rng(block)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 150, dtype=np.uint64)
    fps = set(base.tolist()) | {0, (1 << 64) - 1, 1 << 63}
    for x in base[:40].tolist():
        for _ in range(5):  # a walk of 1 to 4 bits a step
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    for _ in range(150):
        x = int(base[0])
        for b in rng.integers(0, 64, 3):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    links = [(int(np.int64(r["u"]).view(np.uint64)), int(np.int64(r["v"]).view(np.uint64))) for r in simhash.near_links(df, 3, Scratch(spark), block, fan).collect()]
    label = {x: x for x in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for u, v in links:
        a, b = root(u), root(v)
        label[max(a, b)] = min(a, b)
    assert [root(x) for x in fps] == lowest(fps, fps)


def test_counts_beyond_a_byte():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    bounds = np.array([0, 0, 255, 256, 256, 1400, 2000, 2000])
    want = [sum(1 << b for b in range(64) if 2 * int(((x >> np.uint64(b)) & np.uint64(1)).sum()) > len(x)) for x in (h[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))]
    assert simhash.fingerprint(h, bounds).tolist() == want


def test_spanning():
    rng = np.random.default_rng(6)
    u, v = rng.integers(0, 400, 300, dtype=np.uint64), rng.integers(0, 400, 300, dtype=np.uint64)
    a, b = simhash.spanning(u, v)
    nodes = sorted(set(u.tolist()) | set(v.tolist()))
    par = dict.fromkeys(nodes)
    for x in nodes:
        par[x] = x

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        p, q = root(x), root(y)
        par[max(p, q)] = min(p, q)
    got = {x: x for x in nodes} | dict(zip(a.tolist(), b.tolist(), strict=True))
    assert got == {x: root(x) for x in nodes}

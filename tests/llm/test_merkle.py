"""The Merkle manifest against a plain tree, with nulls, repeats, lone rows, one group and none."""

import hashlib
import zlib

import pytest

from tidewater.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, steps int"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def level(nodes):
    return [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]


def climb(nodes, i):
    """The steps (left, right) from node i to what remains, and that."""
    steps = []
    while len(nodes) > 1:
        run = nodes[i - i % 16 : i - i % 16 + 16]
        steps.append((run[: i % 16], run[i % 16 + 1 :]))
        nodes, i = level(nodes), i // 16
    return steps, nodes[0]


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def expected(rows):
    leaf = lambda r, text: sha("".join(map(field, [*r[:4], text])))
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in by:
        by[s].sort(key=lambda x: x[:3])
    subs = [climb([x[2] for x in by[s]], 0)[1] for s in order]
    out = []
    for k, s in enumerate(order):
        for i, (_, _, h, r) in enumerate(by[s]):
            low, sub = climb([x[2] for x in by[s]], i)
            high, root = climb(subs, k)
            fold = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                fold = leaf(r, None if r[4] is None else "".join(c.lower() if c.isascii() else c for c in r[4]))
            for left, right in low + high:
                fold = sha("".join(left) + fold + "".join(right))
            proof = sha("".join("".join(a + b) for a, b in low + high))
            out.append((r[0], h, sub, root, proof, fold, fold == root))
    return sorted(out, key=str)


def got(spark, rows, shuffled=True):
    df = spark.createDataFrame([(*r, 7) for r in rows], DOCS)
    cols = ["doc_id", "source", "lang", "n_chars", "text"]
    out = merkle.manifest(df.repartition(3) if shuffled else df, "doc_id", "source", cols, *merkle.lower_case_tampered(df))
    return sorted((tuple(r) for r in out.collect()), key=str)


def doc(i, s, text="Some Text"):
    return (i, s, "en", len(text or ""), text)


@pytest.mark.parametrize(
    "rows",
    [
        [doc(i, "big", f"Text {i}") for i in range(300)] + [doc(i, None) for i in range(17)] + [doc(1000 + i, f"s{i}") for i in range(20)] + [doc(5, "é"), doc(6, "é"), doc(7, "")],
        [doc(i, "one") for i in range(33)],
        [doc(i, f"only {i}", None if i % 2 else "ÄX") for i in range(40)],
        [doc(3, "a")],
        [doc(3, None, None), doc(3, None, ""), doc(3, None, ""), doc(None, None, "x" * 100_000), (None, None, None, None, None), doc(20, "a"), doc(20, "a")],
    ],
    ids=["mixed", "one source", "lone rows", "one row", "nulls and repeats"],
)
def test_manifest(spark, rows):
    assert got(spark, rows) == expected(rows)


def test_no_rows_and_ids_of_text(spark):
    assert got(spark, [], False) == []
    df = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x")], "id string, grp string")
    out = merkle.manifest(df, "id", "grp", ["id", "grp"]).collect()
    leaves = [sha(field(i) + field("x")) for i in (None, "a", "b")]
    assert {r["root"] for r in out} == {sha("".join(leaves))} and all(r["verified"] and r["folded_root"] == r["root"] for r in out)


def test_changes_show(spark):
    rows = [doc(i, f"s{i % 3}", "UPPER" if i % 2 else "lower") for i in range(200)]
    for r in got(spark, rows):
        assert r[6] == (not (zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[0] % 2))

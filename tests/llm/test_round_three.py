"""Decontamination beyond word lists, scores beside columns of the same name, and the language model with all words."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, lm, near_dup, queries, topk, toxicity

FILL = "the clerk told everyone that the long train to the coast would stop again"


@pytest.mark.parametrize(
    ("item", "doc", "found"),
    [
        (f"{FILL} after 12 kilometres beside the old mill and wait", f"{FILL} after 5 leagues beside the old mill and wait", True),
        (f"{FILL} after zwei stunden beside the old mill and vier more", f"{FILL} after fünf tage beside the old mill and neun more", True),
        (f"{FILL} after trois jours beside the old mill and wait", f"{FILL} after 7 heures beside the old mill and wait", True),
        (f"{FILL} after cuatro horas beside the old mill and wait", f"{FILL} after ocho dias beside the old mill and wait", True),
        (f"{FILL} after 3 km and then 3 km more of the same old way", f"{FILL} after 8 km and then 9 km more of the same old way", False),
        (f"{FILL} after 3 km and then 4 km more of the same old way", f"{FILL} after 8 km and then 9 km more of the same old way", True),
    ],
)
def test_slots(spark, item, doc, found):
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, doc), (2, "quite another text that has 12 kilometres in it and nothing else of all this"), (3, item.upper())], "doc_id long, text string")
    got = {r["doc_id"]: r["n_slots"] for r in decontaminate.leaks(docs, items, coverage=0.9).collect()}
    assert (1 in got) == found and 2 not in got and 3 in got
    assert not found or got[1] > 0


def test_scores_beside_columns_of_the_same_name(spark):
    rows = [(i, f"{'vile' if i % 2 else 'kind'} words number {i} stand here", f"own{i}", [i], {"a": i}) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _score string, _starts array<int>, m map<string,int>")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    from tidewater.llm.common import Scratch

    model = toxicity.fit(docs, labels, Scratch(spark))
    out = toxicity.with_scores(docs, model)
    assert out.columns == ["doc_id", "text", "_score", "_starts", "m", "_score_", "_starts_", "_ends"]
    got = out.collect()
    assert all(r["_score"] == f"own{r['doc_id']}" and r["_starts"] == [r["doc_id"]] and r["m"] == {"a": r["doc_id"]} and 0 <= r["_score_"] <= 1 for r in got)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] % 2 for r in kept.collect()} == {0}


def test_all_words_can_train(spark):
    """part=1 trains on every run of words of every text, a very long one too; the base does not change by it."""
    long = " ".join(f"w{i % 97} grain" for i in range(3000))
    rows = [(i, " ".join(f"word{(i * 7 + k) % 50} grain" for k in range(80)), "s") for i in range(20)] + [(99, long, "s")]
    docs = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string")
    few = {r["doc_id"]: r for r in lm.lm_scores(docs, sample=4, most=64).collect()}
    whole = {r["doc_id"]: r for r in lm.lm_scores(docs, sample=4, most=64, part=1, shard=2000).collect()}
    assert all(few[i]["base_score"] == pytest.approx(whole[i]["base_score"]) and few[i]["n_tokens"] == whole[i]["n_tokens"] for i in few)
    assert sum(r["score"] for r in whole.values()) > sum(r["score"] for r in few.values())


def test_ids_that_are_no_numbers_are_refused_at_once(spark):
    docs = spark.createDataFrame([("a", "x", [1.0])], "doc_id string, text string, embedding array<double>")
    items = spark.createDataFrame([(1, "x")], "item_id long, text string")
    for call in (lambda: near_dup.near_duplicates(docs), lambda: decontaminate.leaks(docs, items), lambda: topk.top_k(docs, docs, id_col="doc_id")):
        with pytest.raises(ValueError, match="whole numbers"):
            call()


def test_long_runs_of_capitalised_words(spark):
    item = "please tell us how the old mill of Anna Berg was sold to the town"
    docs = spark.createDataFrame([(1, "so said " + "Word " * 50_000 + "and then " + item), (2, "so said " + "Word " * 50_000)], "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 7)]


def test_op10_trains_on_every_word(spark, monkeypatch):
    parts = []
    monkeypatch.setattr(lm, "averaged", lambda own, raw, model, shards, part=lm.PART: parts.append(part) or model)
    queries.op10_lm(spark, "/root/testdata/sf0.001")
    assert parts == [1]


def test_words_are_cut_once(spark, monkeypatch):
    """Words that every task knows are not cut again; however few these are, ids, counts and scores are the same."""
    rows = [(i, " ".join(f"word{(i * 7 + k) % 11} grain İx" for k in range(6 + i % 3)) + f" once{i}", "s") for i in range(30)] + [(90, "unseen words", "s"), (91, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    raw = lm.tokenizer_bytes()
    counts = lm.word_counts(docs.where("text is not null"), raw).where("not piece").select("h", "c", "cut").localCheckpoint()
    data, off = lm.packed(pa.array([t for _, t, _ in rows]))
    want = lm.Subwords(raw).texts(data, off)
    whole = lm.known_words(counts, raw)
    assert all((a == b).all() for a, b in zip(want, whole.texts(data, off))) and not len(whole.seen) and whole.often.sum() == counts.agg(F.sum("c")).first()[0]
    scores = lambda: {r["doc_id"]: r for r in lm.lm_scores(docs, sample=4, most=64, part=1).collect()}
    all_known = scores()
    monkeypatch.setattr(lm, "KNOWN", 6)
    few = lm.known_words(counts, raw)
    assert 0 < len(few.known) <= 6 and all((a == b).all() for a, b in zip(want, few.texts(data, off))) and len(few.seen)
    for i, r in scores().items():
        assert (r["n_tokens"], r["n_known"]) == (all_known[i]["n_tokens"], all_known[i]["n_known"])
        assert r["base_score"] == pytest.approx(all_known[i]["base_score"]) and r["score"] == pytest.approx(all_known[i]["score"], rel=1e-4)


def test_lm_gradients():
    """As differences of the loss, for every kind of weight."""
    m = lm.Attention(np.arange(700), 900)
    w = np.random.default_rng(1).integers(0, 700, (6, lm.WINDOW + 1))
    w[0, 0], w[1, 9:], w[2, 5] = lm.HEAD + 1, -1, lm.HEAD
    _, g = m.gradients(w)
    for k in m.p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        loss, was = [], m.p[k][at]
        for by in (0.003, -0.003):  # a hidden value may cross 0 between them
            m.p[k][at] = was + by
            loss.append(m.gradients(w)[0])
        m.p[k][at] = was
        assert (loss[0] - loss[1]) / 0.006 == pytest.approx(g[k][at], rel=0.05, abs=1e-3), k


def test_lm_with_large_weights():
    """Logits beyond the range of exp: shares, scores and gradients stay numbers, as of exact softmaxes."""
    m = lm.Attention(np.arange(lm.HEAD), lm.HEAD + 9)
    w = np.random.default_rng(2).integers(0, lm.HEAD, (5, lm.WINDOW + 1))
    m.p["q"] *= 300
    m.p["c"] *= 100
    m.p["cb"] -= 200
    h = m.p["e"][w[:, :-1]] + m.p["pos"]
    z = (h @ m.p["q"]) @ (h @ m.p["k"]).transpose(0, 2, 1) * lm.DIM**-0.5 + np.triu(np.full((lm.WINDOW, lm.WINDOW), -1e9), 1)
    a = np.exp(z - z.max(axis=2, keepdims=True))
    assert np.abs(z[z > -1e8]).max() > 100
    assert np.allclose(m.forward(w[:, :-1])["a"], a / a.sum(axis=2, keepdims=True), atol=1e-2)
    loss, g = m.gradients(w)
    m.tables()
    o = m.hidden(w[:, :-1], 0)
    assert np.allclose(o[:, :, : lm.DIM], m.forward(w[:, :-1])["o"], atol=2e-2)
    assert np.isfinite(loss) and all(np.isfinite(x).all() for x in g.values()) and np.isfinite(m.log_probability(o.reshape(-1, lm.DIM + 1), w[:, 1:].ravel())).all()

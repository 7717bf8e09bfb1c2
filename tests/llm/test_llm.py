"""Training-data operators: oracles, brute force, round trips and edge cases (nulls, empties, ties, repeats)."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from tidewater.llm import chat, components, decontaminate, hashing, line_dedup, lm, mixing, near_dup, quality, queries, topk, toxicity, url_filter
from tidewater.llm.common import Scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null ids and sources, repeated rows, a very long text."""
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    return docs_of(spark, [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (None, "some words here", "b"), (5, "one", "b"), (5, "one", "b"), (7, long, "b"), (8, long + " end", "b")])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (5, 1, 1), (7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_oracle(spark, name):
    assert compare(spark, SF, name, queries.QUERIES[name], queries.ORACLE[name]) == ""


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["The caté  SAT", None, "", "the caté sat", "x"]
    data, off = hashing.packed(pa.array(texts))
    starts, ends, bounds = hashing.words(data, off)
    h = hashing.span_hashes(data, starts, ends)
    assert bounds.tolist() == [0, 3, 3, 3, 6, 7] and h[:3].tolist() == h[3:6].tolist() and len(set(h.tolist())) == 4


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (100, 101)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 160)}
    assert components.components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).count() == 0


def test_near_duplicates(spark, odd):
    rng = np.random.default_rng(1)
    base = [f"v{x}" for x in rng.integers(0, 5000, 120)]
    rows = []
    for i in range(150):  # a group around the threshold, with exact copies
        w = list(base)
        for at in rng.integers(0, 120, i % 9):
            w[at] = f"z{rng.integers(0, 9999)}"
        rows.append((i, " ".join(w), "s"))
    rows += [(500 + i, rows[i][1].upper(), "s") for i in range(40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs_of(spark, rows), shingle=3, percent=85).collect()}
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t, _ in rows for w in [WORD.findall(t.lower())]}
    par = {i: i for i in sets}

    def root(i):
        while par[i] != i:
            i = par[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                par[max(x, y)] = min(x, y)
    assert got == {i: (len(sets[i]), root(i)) for i in ids}
    edge = near_dup.near_duplicates(odd).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in edge if r["n_shingles"] < 9) == [(0, 1, 0, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 1, 5, True), (5, 1, 5, True)]
    assert {r["component_id"] for r in edge if (r["doc_id"] or 0) >= 7} == {7}
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0
    assert Counter(r["doc_id"] for r in near_dup.drop_near_duplicates(odd).collect()) == Counter([1, 2, 3, None, 5, 7])
    twice = docs_of(spark, [(1, "one text of some words here", "s"), (2, "one text of some words here", "s"), (2, "another text of other words there", "s"), (3, "a third of its own and no other", "s")])
    assert Counter(r["doc_id"] for r in near_dup.drop_near_duplicates(twice).collect()) == Counter([1, 2, 3])


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
PAGES = "page_id long, url string, html string"


def test_url_filter(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [(1, "https://a.example.NET/en/x?q", ""), (2, "https://a.example.net/de", ""), (3, "http://q.com/1", link.format("https://z.net/a")), (4, "http://q.com/2", '<meta http-equiv="refresh" content="0; url=/1">'), (5, "http://r.com/", link.format("https://x.org/fr/1")), (6, "https://z.net/a", link.format("http://r.com/")), (7, None, None), (8, "nourl", "x"), (9, "http://net", ""), (9, "http://net", "")]
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(spark.createDataFrame(rows[:4] + rows[6:], PAGES), RULES).collect())
    assert got == [(1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "a.example.net", "/de", "net/", "block"), (3, "q.com", "/1", None, "block"), (4, "q.com", "/2", None, "block"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "net", "", None, "allow"), (9, "net", "", None, "allow")]
    clash = spark.createDataFrame(rows, PAGES).withColumn("node", F.lit(1)).withColumn("label", F.lit(2)).withColumn("host", F.lit("h"))
    whole = {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(clash, RULES).collect()}
    assert whole[3] == whole[4] == whole[5] == "allow" and whole[6] == "block"  # an allowed alias frees the rest, not a ruled page
    assert url_filter.url_verdicts(spark.createDataFrame([], PAGES), RULES).count() == 0


def test_links_of_pages(spark):
    base = "http://h.com/a/b/c.html?x=1#f"
    meta = '<META content="{}" HTTP-EQUIV=Refresh>'
    cases = [("<link href='../d' rel='nofollow canonical'>", "http://h.com/a/d"), ('<link rel=canonical href=./e/?y=2#z>', "http://h.com/a/b/e/?y=2"), ('<link rel="canonical" href="//k.org">', "http://k.org"), ('<link rel="canonical" href="/go?u=http://z.net/q">', "http://h.com/go?u=http://z.net/q"), ('<link rel="canonical" href="?p=2">', "http://h.com/a/b/c.html?p=2"), ('<link rel="canonical" href="mailto:me@h.com">', None), ('<link rel="canonical" href="#top">', None), ('<!-- <link rel="canonical" href="http://no.com/"> -->', None), ('<link rel="stylesheet" href="http://no.com/canonical">', None), (meta.format("0; url='http://t.com/1'"), "http://t.com/1"), (meta.format("1;URL=http://t.com/?a=1&amp;b=2"), "http://t.com/?a=1&b=2"), (meta.format("300; url=http://t.com/2"), None), (meta.format("5"), None), ('<link rel="canonical" href="../../../../up/.">', "http://h.com/up/")]
    rows = [(i, base, h) for i, (h, _) in enumerate(cases)] + [(98, None, cases[0][0]), (99, "nourl", cases[0][0])]
    for i, (h, want) in enumerate(cases):
        rows[i] = (i, base.replace("#f", f"#{i}"), h)
    got = {int(r["src"].split("#")[1]): r["dst"] for r in url_filter.page_edges(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases) if want}
    two = '<link rel="canonical" href="http://a.com/1"><meta http-equiv="refresh" content="0;url=http://a.com/2"><link rel="canonical" href="http://a.com/3">'
    assert {r["dst"] for r in url_filter.page_edges(spark.createDataFrame([(1, "http://a.com/0", two)], PAGES)).collect()} == {f"http://a.com/{k}" for k in (1, 2, 3)}


def test_url_components_against_brute_force_and_sql(spark, tmp_path):
    """Injected redirects and canonical links on real pages: components by hand, and the registered SQL."""
    rng = np.random.default_rng(3)
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").limit(120).collect()]
    rows += [(10_000 + k, u, "") for k, u in enumerate(["https://x.net/a", "https://y.org/fr/b", "https://sub.example.net/en/c", "https://w.example.com/de/d", "https://clean.io/e"] * 2)]
    links, out = {}, []
    for i, (n, u, h) in enumerate(rows):
        if i % 2:
            v = rows[int(rng.integers(0, len(rows)))][1]
            tag = f'<link rel="canonical" href="{v}">' if i % 4 == 1 else f'<meta http-equiv="refresh" content="0; url={v}">'
            links.setdefault(u, set()).add(v)
            h = tag + (h or "")
        out.append((n, u, h))
    df = spark.createDataFrame(out, PAGES)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    assert compare(spark, str(tmp_path), "op3", queries.op3_url_filter, queries.OP3_SQL) == ""
    split = lambda u: re.fullmatch(r"(?s).*?://([^/?#]*)([^?#]*)(\?[^#]*)?.*", u).groups("")
    node = lambda u: split(u)[0].lower() + (split(u)[1] or "/") + split(u)[2]
    at = {}

    def root(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    def ruled(u):
        host, path, _ = split(u)
        fit = [(len(h + p), a) for h, p, a in RULES if (host.lower() == h or host.lower().endswith("." + h)) and path.startswith(p)]
        return max(fit)[1] if fit else None

    for u, vs in links.items():
        for v in vs:
            at[max(root(node(u)), root(node(v)))] = min(root(node(u)), root(node(v)))
    acts = {}
    for u in {*links, *(v for vs in links.values() for v in vs)}:
        acts.setdefault(root(node(u)), set()).add(ruled(u))
    for r in url_filter.url_verdicts(df, RULES).collect():
        u = next(x[1] for x in out if x[0] == r["page_id"])
        of = acts.get(root(node(u)), set())
        assert r["verdict"] == (ruled(u) or ("allow" if "allow" in of else "block" if "block" in of else "allow"))


def test_top_k(spark):
    v = [(i, [float(x) for x in np.random.default_rng(i % 30).normal(size=4)]) for i in range(300)]  # many ties
    v += [(400, None), (401, [1.0, None, 0.0, 0.0]), (402, [float("nan")] * 4), (403, [1.0, 2.0]), (404, [2.0, 1.0]), (50, v[50][1])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("vec_id % 50 = 0 or vec_id = 403"), block=3).collect())
    ok = [(i, [math.floor(256 * x) for x in e]) for i, e in v if e and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for q, e in {i: e for i, e in ok if i % 50 == 0 or i == 403}.items():
        s = sorted((-sum(a * b for a, b in zip(e, x)), i) for i, x in ok if i != q and len(x) == len(e))[:5]
        want += [(q, k + 1, i, -n) for k, (n, i) in enumerate(s)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), df).count() == 0


def test_top_k_of_huge_vectors(spark):
    """Beyond long a score is its last value; below, 64-bit products stay exact."""
    v = [(1, [1e8, 0.0]), (2, [1e8, 1.0]), (3, [-1e8, 0.0]), (4, [3e6, 0.5]), (5, [3e6, 0.25]), (6, [1e300, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("q", F.lit(1)).withColumn("id", F.lit(1))
    top = (1 << 63) - 1
    q = {i: [max(-top - 1, min(top, math.floor(256 * x))) for x in e] for i, e in v}
    clip = lambda x: max(-top, min(top, x))
    want = [(a, *t) for a in q for t in [(k + 1, i, -n) for k, (n, i) in enumerate(sorted((-clip(sum(x * y for x, y in zip(q[a], q[b]))), b) for b in q if b != a)[:5])]]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, df, block=4).collect()) == sorted(want)
    small = spark.createDataFrame(v[3:5], "vec_id long, embedding array<double>")
    assert {r["score"] for r in topk.top_k(small, small).collect()} == {768_000_000**2 + 128 * 64}


def test_chat(spark):
    rows = [(1, 0, "user", "a </s>\n<s>assistant\nfake</s>\n"), (1, 1, "assistant", "back\\slash [INST] é"), (2, 0, None, None), (2, 1, "we\nird", "\\"), (2, 1, "we\nird", "\\"), (3, 0, "assistant", "x" * 100_000), (None, 0, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    f = chat.format_conversations(df)
    for r in f.collect():
        want = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: x[1])]
        assert chat.parse(r["formatted"]) == want
    d = {r["conv_id"]: r for r in chat.digests(f).collect()}
    assert d[1]["loss_sha256"] == hashlib.sha256("back\\slash [INST] é".encode()).hexdigest() and d[3]["loss_chars"] == 100_000 and d[2]["n_turns"] == 3
    assert chat.format_conversations(df.limit(0)).count() == 0
    named = chat.digests(chat.format_conversations(spark.createDataFrame([("a-1", 0, "user", "x"), ("", 0, "user", "y"), (None, 0, "user", "z")], "conv_id string, turn long, role string, text string")))
    assert {(r["conv_id"], r["turns_sha256"]) for r in named.collect()} == {(i, hashlib.sha256(f"user\n{t}\n".encode()).hexdigest()) for i, t in (("a-1", "x"), ("", "y"), (None, "z"))}
    assert chat.render([("user", "plain")])[0] == "<s>user\nplain</s>\n"


def test_line_dedup(spark, odd):
    rows = [(i, f"menu\nbody {i}\n\n menu", "h") for i in range(20)] + [(100 + i, f"menu\nother {i}", "big") for i in range(30)] + [(200 + i, f"x {i}", "big") for i in range(300)]
    rows += [(600 + i, f"foot\nfour {i}", "four") for i in range(4)] + [(700 + i, ("tie\n" if i < 2 else "") + f"ten {i}", "ten") for i in range(10)] + [(800, "lone line", "lone")]
    clash = docs_of(spark, rows)
    for c in ("_all", "_host", "_lines", "_known", "_left", "_row", "pages"):
        clash = clash.withColumn(c, F.lit(c))
    out = line_dedup.drop_lines(clash)
    assert out.columns == [*clash.columns, "_lines_", "_dropped"] and out.where("_all <> '_all' or _host <> '_host' or _lines <> '_lines' or _row <> '_row'").count() == 0
    got = {r["doc_id"]: (r["text"], r["_dropped"]) for r in out.collect()}
    assert got[3] == ("body 3\n", 2) and got[103] == ("menu\nother 3", 0)
    assert got[602] == ("four 2", 1) and got[701] == ("tie\nten 1", 0) and got[800] == ("lone line", 0)  # all of 4 pages; exactly the ratio; one page
    plain = odd.where("doc_id is null or doc_id <> 5")
    texts = Counter(r["text"] for r in odd.collect())
    texts["one"], texts[""] = 0, texts[""] + 2  # a repeated row is two pages of four
    assert Counter(r["text"] for r in line_dedup.drop_lines(odd).collect()) == +texts
    assert Counter(r["text"] for r in line_dedup.drop_lines(plain).collect()) == Counter(r["text"] for r in plain.collect())
    assert line_dedup.drop_lines(odd.limit(0)).count() == 0


def test_repeated_lines(spark, odd):
    """A long passage on few pages, a shorter line on a small share, and hosts of 2 and 3 pages; copies do not count."""
    passage, phrase = " ".join(f"p{i}" for i in range(60)), "this page was printed from the archive of the town"
    rows = [(i, f"body {i}\nyes" + (f"\n{passage}" if i % 100 == 0 else "") + (f"\n{phrase}" if i % 20 == 0 else ""), "big") for i in range(400)]
    rows += [(1000 + i, f"menu\nshort {i}", "three") for i in range(3)] + [(2000 + i, f"menu\npair {i}", "two") for i in range(2)] + [(3000 + i, "copied whole and often", "copy") for i in range(9)]
    got = {r["doc_id"]: (r["text"], r["_dropped"]) for r in line_dedup.drop_repeats(docs_of(spark, rows)).collect()}
    before = {i: t for i, t, _ in rows}
    assert len(got) == len(rows)
    for line, n in ((passage, 4), (phrase, 20)):
        assert sum(line in t for t in before.values()) == n and sum(line in t for t, _ in got.values()) == 1
    assert all("yes" not in t for i, (t, _) in got.items() if i < 1000)
    assert {got[1000 + i] for i in range(3)} == {(f"short {i}", 1) for i in range(3)}
    assert sum("menu" in got[2000 + i][0] for i in range(2)) == 1
    assert all(got[3000 + i] == ("copied whole and often", 0) for i in range(9))
    assert Counter(r["text"] for r in line_dedup.drop_repeats(odd).collect()) == Counter(r["text"] for r in odd.collect())
    assert line_dedup.drop_repeats(odd.limit(0)).count() == 0


def test_pipeline_drops_repeated_lines(spark):
    """At the size where one ratio of 0.2 dropped no line at all."""
    import corpus_pipeline as p

    docs = docs_of(spark, [(i, f"body {i}" + ("\nthis page was printed from the archive of the town" if i % 20 == 0 else ""), "big") for i in range(400)])
    got = p.drop_boilerplate(spark, docs, SF)
    assert got.where("text like '%archive%'").count() == 1 and got.where("n_chars <> length(text)").count() == 0 and got.count() == 400


def leaked(docs, bench):
    return sorted((r["doc_id"], r["item_id"], r["n_found"], r["n_windows"]) for r in decontaminate.leaks(docs, bench).collect())


def test_decontamination(spark, odd):
    item = "A train leaves at 5 km from the old Boston station and Boston waits 5 km more for it"
    bench = spark.createDataFrame([(1, item), (1, item), (2, "short one"), (3, None), (4, "1 2 3 4 5 6 7 8 9"), (None, item), (6, "")], "item_id long, text string")
    rows = [(1, "x y z. A train leaves at 7 km from the old Paris station and Paris waits 7 km more for it, end", "s"), (2, "A train leaves at 7 km from the old Paris station and London waits 9 km more for it", "s"), (3, "clean words only and nothing else to see in this text", "s"), (4, "9 8 7 6 5 4 3 2 1", "s"), (5, None, "s"), (None, item, "s"), (6, "", "s"), (7, "see 1 2 3 4 5 6 7 8 9 there", "s"), (8, "short one", "s")]
    d = docs_of(spark, rows + rows[:1]).withColumn("toks", F.lit(1)).withColumn("_text", F.lit(2)).withColumn("item_id", F.lit(1))
    got = leaked(d, bench)
    assert [x[:2] for x in got] == [(1, 1), (7, 4)] and all(x[2] == x[3] for x in got)  # slots only: word for word; two words: in any prose
    assert sorted(r["doc_id"] or 0 for r in decontaminate.drop_leaking(d, bench).collect()) == [0, 2, 3, 4, 5, 6, 8]
    assert decontaminate.drop_leaking(d, bench).columns == d.columns
    assert leaked(odd, bench) == leaked(d, bench.limit(0)) == leaked(d.limit(0), bench) == []
    long = odd.where("doc_id = 7").select(F.lit(9).cast("long").alias("item_id"), "text")
    assert [x[:2] for x in leaked(odd, long)] == [(7, 9), (8, 9)]


def test_decontamination_slots(spark):
    """Whole numbers, runs of names, signs, spelled numbers and line ends are one placeholder each."""
    item = "Yesterday at the market Anna bought 12 apples for $5 and kept 20% of them while Tom walked 3 km to the old mill"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")

    def swap(*pairs):
        t = item
        for a, b in pairs:
            assert a in t
            t = t.replace(a, b)
        return t

    rows = [swap(("12", "12.5"), ("Anna", "Anna Lee")), swap(("12", "1,250.75"), ("$5", "€ 7.20")), swap(("12", "twelve"), ("3 km", "nine miles")), swap(("Tom", "Mary Ann van")), swap(("market Anna", "market\nAnna"), ("20%", "35 %")), swap(("3 km", "3 Stunden".lower())), swap(("market", "harbour"), ("apples", "pears"), ("old", "new"), ("kept", "lost"))]
    got = leaked(docs_of(spark, [(i, f"Before it. {t} after it", "s") for i, t in enumerate(rows)]), bench)
    assert [x[0] for x in got if x[2] == x[3]] == [0, 1, 2, 4, 5] and {x[0] for x in got} >= {0, 1, 2, 4, 5} and 6 not in {x[0] for x in got}


def test_decontamination_tie_and_exact_hits(spark):
    """Half of the windows is enough, less is not; three or four tokens are found word for word."""
    words_ = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)][:17]  # ten windows of eight
    bench = spark.createDataFrame([(1, " ".join(words_)), (2, "blue moon rising")], "item_id long, text string")
    rows = [(1, " ".join(words_[:12]), "s"), (2, " ".join(words_[:11]), "s"), (3, "The BLUE, moon rising over", "s"), (4, "blue moon, not rising", "s")]
    assert leaked(docs_of(spark, rows), bench) == [(1, 1, 5, 10), (3, 2, 1, 1)]


def test_decontamination_in_any_case(spark):
    item = "In spring, Anna Berg and Carl walk to Old Town, Boston, then Paris, where Maria, Otto, and Lena wait 5 km away for them"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = docs_of(spark, [(1, "x. " + item.upper() + " y", "s"), (2, item.lower(), "s"), (3, item, "s"), (4, "NOTHING, OF, ALL THIS IS, IN, THE ITEM, AT ALL, YOU SEE, IS IT", "s")])
    assert [x[0] for x in leaked(d, bench)] == [1, 2, 3]
    assert [r["doc_id"] for r in decontaminate.drop_leaking(d, bench).collect()] == [4]


def test_mixing(spark, odd):
    rows = [(i, "w " * (1 + i % 5), "a") for i in range(900)] + [(1000 + i, "w " * 3, "b") for i in range(60)]
    got = mixing.mix(docs_of(spark, rows), repeats=2.0).collect()
    size = {"a": sum(1 + i % 5 for i in range(900)), "b": 180}
    drawn = Counter()
    for r in got:
        drawn[r["_source"]] += r["_tokens"]
    alpha = got[0]["_alpha"]
    share = {s: (n / sum(size.values())) ** alpha for s, n in size.items()}
    target = {s: math.floor(x / sum(share.values()) * sum(size.values())) for s, x in share.items()}
    assert abs(target["b"] / size["b"] - 2) < 1e-6 or target["b"] <= 2 * size["b"]
    key = lambda e, i: hashlib.md5(f"mix:{e}:{i}".encode()).hexdigest()
    for s in size:
        assert target[s] - 5 <= drawn[s] <= target[s]
        order = sorted((key(target[s] // size[s], i), n, i) for i, n in [(i, len(t.split())) for i, t, x in rows if x == s])
        left, part = target[s] % size[s], set()
        for _, n, i in order:
            if left < n:
                break
            left -= n
            part.add(i)
        assert {r["doc_id"] for r in got if r["_source"] == s and r["_epoch"] == target[s] // size[s]} == part
    for r in got:  # the place in the mixture, by hand
        s = r["_source"]
        want = (r["_epoch"] + int(key(r["_epoch"], r["doc_id"])[:13], 16) / 16**13) / (target[s] / size[s])
        assert abs(r["_order"] - min(1.0, want)) < 1e-12


def test_mixture_holds_its_weights_everywhere(spark):
    rows = [(i, "w w", "a") for i in range(9000)] + [(20_000 + i, "w w", "b") for i in range(1000)]
    got = [r["_source"] for r in mixing.mix(docs_of(spark, rows), repeats=2.0).orderBy("_order", "doc_id").select("_source").collect()]
    share = got.count("b") / len(got)
    assert share > 0.19
    n = len(got) // 10
    for k in range(10):  # 4 deviations of a random tenth
        assert abs(got[k * n : (k + 1) * n].count("b") / n - share) < 4 * math.sqrt(share * (1 - share) / n)


def test_mixing_edges(spark, odd):
    """Nulls, empties, repeats, a long text, clashing columns: whole epochs of what has tokens."""
    clash = odd
    for c in ("rest", "whole", "cut", "_n", "_order", "_source", "tokens"):
        clash = clash.withColumn(c, F.lit(c))
    out = mixing.mix(clash, repeats=1.0)
    assert out.columns == [*clash.columns, "_source_", "_tokens", "_epoch", "_order_", "_alpha"]
    got = Counter((r["doc_id"], r["rest"], r["_order"], r["_epoch"]) for r in out.collect())
    assert got == Counter([(i, "rest", "_order", 0) for i in (None, 5, 5, 7, 8)])  # sources without tokens give none
    assert mixing.mix(odd.limit(0)).count() == 0


def test_entropy_target(spark):
    shares = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "_source string, tokens long")
    x = mixing.temperature(shares, 1000, entropy=1.2)
    w = [(n / 1000) ** x for n in (900, 90, 10)]
    p = [v / sum(w) for v in w]
    assert abs(-sum(v * math.log2(v) for v in p) - 1.2) < 1e-3


def test_chain_marginals():
    """Forward-backward against the sum over all taggings."""
    rng = np.random.default_rng(0)
    c = toxicity.Chain(np.zeros(3), 0.3, rng.normal(size=(2, 2)), rng.normal(size=2))
    e, bounds = rng.normal(size=9), np.array([0, 5, 5, 9])
    p = c.marginals(e, bounds)
    for a, b in ((0, 5), (5, 9)):
        total, hit = 0.0, np.zeros(b - a)
        for tags in np.ndindex(*[2] * (b - a)):
            s = c.start * tags[0] + sum(e[a + i] * t for i, t in enumerate(tags)) + sum(c.trans[x, y] for x, y in zip(tags, tags[1:])) + c.end[tags[-1]]
            total += math.exp(s)
            hit += math.exp(s) * np.array(tags)
        assert np.allclose(hit / total, p[a:b])


def test_toxicity(spark, odd, labels):
    rng = np.random.default_rng(2)
    rows, marks = [], []
    for i in range(400):
        w = [f"w{x}" for x in rng.integers(0, 300, 40)]
        bad = i % 5 == 0
        if bad:
            w[3], w[20] = "Grobian!", "grobiane"
        rows.append((i, " ".join(w), "s"))
        marks.append((i, 1, int(bad)))
    got = toxicity.toxicity(docs_of(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held)
    texts = {i: t for i, t, _ in rows}
    assert {texts[r["doc_id"]][a:b] for r in got for a, b in zip(r["span_starts"], r["span_ends"])} == {"Grobian!", "grobiane"}
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity(odd, labels).collect())
    assert toxicity.toxicity(odd, labels.limit(0)).count() == 8 and toxicity.toxicity(odd.limit(0), labels).count() == 0
    clash = odd.withColumn("_score", F.lit(1)).withColumn("_starts", F.lit(2)).withColumn("toxic", F.lit(3))
    assert toxicity.drop_toxic(clash, labels).columns == clash.columns
    docs, y = docs_of(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    dealt = [{r["doc_id"]: r["score"] for r in toxicity.toxicity(docs.repartition(n), y).collect()} for n in (1, 7)]
    assert all(abs(x - dealt[1][i]) < 1e-12 for i, x in dealt[0].items())  # the layout does not matter, but for rounding


def test_toxicity_score_against_brute_force(spark):
    """A document's score from all taggings of its lines: noisy-or and expected count, through the fitted weights."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 30, 6)) + (" vile" if i % 3 == 0 else "") + "\n" + f"end w{i % 4}", "s") for i in range(60)] + [(90, None, "s"), (91, "", "s")]
    docs = docs_of(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int"), Scratch(spark))
    got = {r["doc_id"]: r["_score"] for r in toxicity.with_scores(docs, model).collect()}
    c = model.chain
    for i, t, _ in rows:
        log_clean, count = 0.0, 0.0
        for line in (t or "").split("\n"):
            data = np.frombuffer(line.encode(), np.uint8)
            starts, ends, _ = hashing.words(data, np.array([0, len(data)]))
            e = c.emissions(toxicity.features(data, starts, ends))
            total, hit = 0.0, np.zeros(len(e))
            for tags in np.ndindex(*[2] * len(e)):
                w = math.exp(c.start * tags[0] + sum(x * y for x, y in zip(e, tags)) + sum(c.trans[x, y] for x, y in zip(tags, tags[1:])) + c.end[tags[-1]]) if tags else 1.0
                total += w
                hit += w * np.array(tags)
            log_clean += sum(math.log1p(-min(p, 1 - 1e-9)) for p in hit / total)
            count += float((hit / total).sum())
        none = min(log_clean, -1e-9)
        x = [max(-12, min(12, math.log(-math.expm1(none)) - none)), math.log1p(count)]
        assert abs(got[i] - 1 / (1 + math.exp(-(np.dot(x, model.weights[:2]) + model.weights[2])))) < 1e-6
    assert got[90] == got[91]


def test_quality(spark, odd, labels):
    got = quality.quality(odd, labels).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality(odd, labels.limit(0)).count() == 8 and quality.quality(odd.limit(0), labels).count() == 0
    d, y = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality(d, y).join(y, "doc_id").collect()
    assert np.mean([r["keep"] == (r["quality"] == 1) for r in rows]) > 0.95
    n, s = Counter(), Counter()
    for r in (all_rows := quality.quality(d, y).collect()):
        n[r["host"]] += 1
        s[r["host"]] += r["doc_score"]
    mu = sum(s.values()) / sum(n.values())
    for r in all_rows:  # shrunk between the host's own mean and the global one
        lo, hi = sorted((mu, s[r["host"]] / n[r["host"]]))
        assert lo - 1e-9 <= r["host_posterior"] <= hi + 1e-9


def test_quality_posteriors_against_brute_force(spark):
    """Strengths, posteriors and scores from the document scores, by hand; clashing columns and a hot host."""
    d = spark.read.parquet(f"{SF}/documents.parquet").withColumn("host", F.lit("x")).withColumn("p", F.lit(1)).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    rows = quality.quality(d, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    group = lambda *ks: {k: [r["doc_score"] for r in rows if tuple(r[x] for x in ks) == k] for k in {tuple(r[x] for x in ks) for r in rows}}
    paths, hosts, t = group("host", "path"), group("host"), len(rows)
    mu = sum(r["doc_score"] for r in rows) / t
    within = max(1e-9, sum(sum((x - np.mean(v)) ** 2 for x in v) for v in paths.values()) / (t - len(paths)))

    def strength(groups, prior):
        ss = sum(len(v) * (np.mean(v) - prior(k)) ** 2 for k, v in groups.items())
        between = max(0.0, (ss - (len(groups) - 1) * within) / (t - sum(len(v) ** 2 for v in groups.values()) / t))
        return min(1e6, max(0.1, within / between)) if between else 1e6

    kh = strength(hosts, lambda k: mu)
    host_of = {k[0]: (sum(v) + kh * mu) / (len(v) + kh) for k, v in hosts.items()}
    kp = strength(paths, lambda k: host_of[k[0]])
    logit = lambda p: math.log(min(1 - 1e-6, max(1e-6, p)) / (1 - min(1 - 1e-6, max(1e-6, p))))
    for r in rows:
        v, p = paths[(r["host"], r["path"])], r["doc_score"]
        path = (sum(v) - p + kp * host_of[r["host"]]) / (len(v) - 1 + kp)
        assert abs(r["host_posterior"] - host_of[r["host"]]) < 1e-9 and abs(r["path_posterior"] - path) < 1e-9
        assert abs(r["score"] - 1 / (1 + math.exp(-(logit(p) + 0.5 * (logit(path) - logit(mu)))))) < 1e-9


def test_lm(spark, odd):
    got = lm.lm_scores(odd.where("text is null or length(text) < 100").unionByName(docs_of(spark, [(20 + i, f"The cat sat {i}", "s") for i in range(30)]))).collect()
    texts = {20 + i: f"the cat sat {i}" for i in range(30)} | {1: "", 2: "", 3: "", None: "some words here", 5: "one"}
    tokens = {i: [*WORD.findall(t), None] for i, t in texts.items()}
    c = Counter()
    for i, w in tokens.items():
        if zlib.crc32(str("" if i is None else i).encode()) % 10:
            c.update(w + (w if i == 5 else []))
    n, v = sum(c.values()), len(c)
    for r in got:
        w = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r["base_score"] - sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-9 and r["score"] < 0
    assert lm.lm_scores(odd.limit(0)).count() == 0


def test_lm_learns_from_all_texts(spark):
    """Subword counts are of all training texts, the model of the sample is moved by texts outside it, ids of the tail go by their counts."""
    rows = [(i, " ".join(f"word{(i * 7 + k) % 50} grain" for k in range(12)), "s") for i in range(60)]
    own = docs_of(spark, rows).select("doc_id", "text").repartition(3)
    raw = lm.tokenizer_bytes()
    sub = lm.Subwords(raw)
    want = np.zeros(sub.end + 1, np.int64)
    for _, t, _ in rows:
        want[sub.end] += 1
        for x in sub.model.encode(t.split()):
            np.add.at(want, x, 1)
    got = np.zeros_like(want)
    for r in lm.word_counts(own, raw).where("piece").collect():
        got[r["h"]] = r["c"]
    assert got.tolist() == want.tolist()
    learn = own.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    kept = learn.orderBy(F.xxhash64("key", F.lit(11)), "key").limit(4)
    few, all_of = lm.fit(kept, raw, want, 100, sample=4, part=1), lm.fit(learn, raw, want, 1440, sample=4, part=1)
    assert set(few.compact.nonzero()[0]) == set(all_of.compact.nonzero()[0])
    assert not np.allclose(few.flat(), all_of.flat())
    dealt = [lm.fit(learn.repartition(n), raw, want, 1440, sample=4, part=2).flat() for n in (1, 7)]
    assert np.allclose(*dealt, atol=1e-6)  # the layout does not matter
    m = lm.Attention(np.arange(10), 40, counts=np.arange(40.0))
    assert abs(np.exp(m.tail[10:]).sum() / 30 - 1) < 1e-9 and m.tail[39] > m.tail[10] and not m.tail[:10].any()
    assert np.allclose(m.token_scores(np.array([39, 11]), np.array([0, 1, 2])) @ [1, -1] / math.log(10), (m.tail[39] - m.tail[11]) / math.log(10), atol=1e-5)


def test_lm_segments():
    """One run of words in ``part``; all runs together are the text; windows follow each other and each token is a target once."""
    import pyarrow as pa

    data, off = hashing.packed(pa.array(["", " ".join(f"a{i}" for i in range(300)), "x y"]))
    got = [lm.segments(data, off, np.array([0, 5, 2]), 4)] + [lm.segments(data, off, np.array([0, 5 + k, 2 + k]), 4) for k in (1, 2, 3)]
    runs = sorted((int(t), int(k), bytes(d[a:b]).decode(), bool(z)) for d, o, text, ks, last in got for t, k, a, b, z in zip(text, ks, o[:-1], o[1:], last))
    assert [r[0] for r in runs] == [1] * 5 + [2] and [r[3] for r in runs] == [False] * 4 + [True, True]
    assert " ".join(r[2] for r in runs[:5]).split() == [f"a{i}" for i in range(300)] and runs[5][2] == "x y"
    ids, bounds = np.arange(60), np.array([0, 20, 40, 60])
    w = lm.spans(ids, bounds, np.array([True, False, False]), np.array([False, False, True]))
    assert sorted(x for x in w[:, 1:].ravel() if x >= 0) == [*range(19), *range(21, 39), *range(41, 60)] and (w == -2).sum() == 1 and w[0, 0] == -2


def test_lm_score_against_brute_force(spark):
    """The attention, written out token by token, mixed with the counted base."""
    rows = [(i, " ".join(f"w{(i * 5 + k * k) % 23}" for k in range(3 + i)), "s") for i in range(30)] + [(90, None, "s"), (91, "unseen words stand here", "s")]
    docs = docs_of(spark, rows)
    got = {r["doc_id"]: r for r in lm.lm_scores(docs, share=0.3).collect()}
    raw = lm.tokenizer_bytes()
    sub = lm.Subwords(raw)
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows}
    words_of = {i: WORD.findall((t or "").lower()) for i, t, _ in rows}
    c, counts = Counter(), np.zeros(sub.end + 1, np.int64)
    for i, w in words_of.items():
        if not held[i]:
            c.update([*w, None])
            for x in [*sub.model.encode(w), [sub.end]]:
                np.add.at(counts, x, 1)
    n, v = sum(c.values()), len(c)
    own = docs.where(~F.col("doc_id").isin([i for i in held if held[i]])).select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    m = lm.fit(own, raw, counts, n)
    p, d = {k: x.astype(np.float64) for k, x in m.p.items()}, lm.DIM

    def softmax_at(z, k):
        z = np.exp(z - z.max())
        return z[k] / z.sum()

    def next_probability(before, y):
        """P(y | before), before: compact ids with the start id."""
        h = p["e"][before] + p["pos"][: len(before)]
        a = (h[-1] @ p["q"]) @ (h @ p["k"]).T / math.sqrt(d)
        a = np.exp(a - a.max())
        o = np.maximum(h[-1] @ p["r"] + (a / a.sum()) @ (h @ p["v"]) + p["b"], 0)
        k = m.compact[y]
        if k == lm.HEAD:
            return softmax_at(o @ p["c"] + p["cb"], lm.CLASSES) / m.rare * math.exp(m.tail[y])
        return softmax_at(o @ p["c"] + p["cb"], k % lm.CLASSES) * softmax_at(p["u"][k % lm.CLASSES] @ o + p["ub"][k % lm.CLASSES], k // lm.CLASSES)

    for i, w in words_of.items():
        cut = [*sub.model.encode(w), [sub.end]] if w else [[sub.end]]
        ids = [lm.HEAD + 1, *[m.compact[x] for piece in cut for x in piece]]
        total, at = 0.0, 0
        for word, piece in zip([*w, None], cut):
            att = 1.0
            for x in piece:
                k = max(0, -(-(at + 1 - lm.WINDOW) // lm.STEP))  # the first window that scores the token
                att *= next_probability(np.array(ids[k * lm.STEP : at + 1]), x)
                at += 1
            total += math.log10(0.3 * att + 0.7 * (c[word] + 0.1) / (n + 0.1 * (v + 1)))
        assert abs(got[i]["score"] - total) < 1e-3 * max(1, abs(total)), i
        assert got[i]["score"] >= got[i]["base_score"] + len(cut) * math.log10(0.7) - 1e-6


def test_attention_is_a_distribution():
    m = lm.Attention(np.arange(500), 900)
    m.tables()
    o = m.hidden(np.zeros((1, lm.WINDOW), int), 0)[0, :1]
    total = sum(math.exp(m.log_probability(o, np.array([y]))[0]) for y in range(500)) + 400 * math.exp(m.log_probability(o, np.array([lm.HEAD]))[0])
    assert abs(total - 1) < 1e-4
    x = np.array([[lm.HEAD + 1, *range(lm.WINDOW)]])
    assert np.allclose(m.forward(x[:, :-1])["o"], m.hidden(x[:, :-1], 0)[:, :, : lm.DIM], atol=1e-4)
    y = x.copy()
    y[0, 10] = 77  # what comes later does not count
    assert np.allclose(m.forward(x[:, :-1])["o"][0, :10], m.forward(y[:, :-1])["o"][0, :10])
    ids = np.arange(100)
    got, first, _ = lm.windows(ids, np.array([0, 100]), -2)
    assert sorted(t for row, f in zip(got, first) for t in row[1 + f :] if t >= 0) == list(range(100))  # each token once


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    for i, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns[:5] == cols and (name == "mixing" or docs.columns == cols)
    assert docs.count() > 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """Planted toxic, boilerplate, copied and leaked documents: each stage's rows by hand."""
    import corpus_pipeline as p

    rng = np.random.default_rng(9)
    item = " ".join(f"ask{x}" for x in "abcdefghijklmnop")
    rows = []
    for i in range(240):
        words_ = [f"{s}{x}" for s, x in zip("uvwxyz" * 10, rng.integers(0, 4000, 60))]
        if i % 6 == 0:
            words_[5], words_[30] = "Grobian!", "grobiane"
        rows.append((i, " ".join(words_) + ("\nread more in our shop" if i % 2 else ""), f"s{i % 2}"))
    rows += [(300 + i, rows[10 + i][1] + (" tail" if i % 2 else ""), "s0") for i in range(8)]
    rows += [(400, f"before {item.upper()} after", "s0"), (401, f"x {item}", "s1")]
    docs = docs_of(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = docs
    alive = {i: t for i, t, _ in rows}
    for name, stage in p.STAGES:
        got = stage(spark, got, str(tmp_path))
        got.write.parquet(f"{tmp_path}/{name}")
        got = spark.read.parquet(f"{tmp_path}/{name}")
        seen = {r["doc_id"]: r["text"] for r in got.collect()}
        if name == "toxicity":
            alive = {i: t for i, t in alive.items() if "robian" not in t}
        elif name == "line_dedup":
            alive = {i: t.replace("\nread more in our shop", "") if i < 240 else t for i, t in alive.items()}
        elif name == "near_dup":
            sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in alive.items() for w in [t.lower().split()]}
            alive = {i: t for i, t in alive.items() if not any(j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets)}
        elif name == "decontamination":
            alive = {i: t for i, t in alive.items() if i not in (400, 401)}
        if name == "mixing":
            assert set(seen) <= set(alive) and len(seen) >= 0.85 * len(alive) and got.where("position < 0 or position > 1").count() == 0
        elif name == "line_dedup":
            assert set(seen) == set(alive) and all(seen[i] == t for i, t in alive.items() if i < 240)
            alive = seen
        else:
            assert seen == alive, name


def test_pipeline_stages_on_odd_tables(spark, odd, tmp_path):
    """Nulls, empties, repeats, long texts and clashing columns pass every stage; an empty table stays empty."""
    import corpus_pipeline as p

    clash = odd
    for c in ("_score", "_lines", "_dropped", "_host", "node", "rest", "cut", "item_id", "label"):
        clash = clash.withColumn(c, F.lit(c))
    left = {"toxicity": [None, 1, 2, 3, 5, 5, 7, 8], "line_dedup": [None, 1, 2, 3, 5, 5, 7, 8], "near_dup": [None, 1, 2, 3, 5, 7], "decontamination": [None, 1, 2, 3, 5, 5, 7, 8], "mixing": [None, 5, 5, 7, 8]}
    for name, stage in p.STAGES:
        out = stage(spark, clash, SF)
        assert out.columns[: len(clash.columns)] == clash.columns
        rows = out.collect()
        assert {r["doc_id"] for r in rows} == set(left[name]) and (name == "mixing" or Counter(r["doc_id"] for r in rows) == Counter(left[name])), name
        assert stage(spark, clash.limit(0), SF).count() == 0

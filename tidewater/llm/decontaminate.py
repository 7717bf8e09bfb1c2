"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, everything else lower-case words: a whole number (digits,
groups, decimals, or a spelled one in one of four languages), a run of capitalised words inside a sentence, a sign
beside a number and the word behind it, be it a unit or what is counted, are one placeholder each. Windows of eight template tokens of the benchmark are hash-joined with those of the
documents. Windows with the same shift between item and document form an alignment; an alignment in which one
slot value of the item stands for two values of the document is not a re-parameterised question and is dropped.
A document leaks an item when the remaining windows cover enough of the item. Names are told by their capitals,
so a copy in other case has other templates: windows of plain lower-case tokens are joined too, and they alone
stand for items too short, or windows too full of slots, to be told by a template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, broadcast_if, need_whole_numbers

#: Spelled numbers in English, German, French and Spanish, but for those that are common words of another kind.
NUMBER_WORDS = """two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty
sixty seventy eighty ninety hundred thousand million
zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig
siebzig achtzig neunzig hundert tausend millionen
deux trois quatre cinq huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante mille
dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta
ochenta noventa cien ciento mil""".split()
NAME, NUMBER, UNIT, JOIN = "\u0002", "\u0003", "\u0004", "\u0005"  # the first three begin slot tokens, the last joins the parts of a number
_GAP = r"[ \t\n\r]"


def with_tokens(df: DataFrame, text: str) -> DataFrame:
    """df with ``toks``, its raw tokens, slots beginning with a marker, and ``words``, all lower-case words, instead of ``text``."""
    clean = F.coalesce(F.col(text), F.lit(""))
    clean = F.when(clean.rlike("[\u0002-\u0005]"), F.translate(clean, NAME + NUMBER + UNIT + JOIN, "    ")).otherwise(clean)
    sub = F.regexp_replace
    joined = lambda c: sub(c, r"(\p{Nd})[.,](?=\p{Nd})", "$1" + JOIN)
    signs = lambda c: sub(sub(c, rf"[$€£]{_GAP}*(\p{{Nd}}[\p{{Nd}}{JOIN}]*)", f"$1 {UNIT}sign "), rf"(\p{{Nd}}){_GAP}*[$€£%]", f"$1 {UNIT}sign ")
    df = df.withColumn("_a", clean).withColumn("_d", F.col("_a").rlike(r"\p{Nd}"))
    df = df.withColumn("_b", F.when(F.col("_d"), joined(F.col("_a"))).otherwise(F.col("_a")))
    df = df.withColumn("_b", F.when(F.col("_d") & F.col("_b").rlike("[$€£%]"), signs(F.col("_b"))).otherwise(F.col("_b")))
    df = df.withColumn("_c", sub("_b", rf"([\p{{Ll}}\p{{Nd}},;:]{_GAP})(?:\p{{Lu}}[\p{{L}}\p{{M}}'’-]*{_GAP}+(?=\p{{Lu}}))*+(\p{{Lu}})", f"$1{NAME}$2"))
    counted = lambda c: sub(sub(c, rf"(\p{{Nd}}){_GAP}?(\p{{L}})", f"$1 {UNIT}$2"), rf"(\p{{Nd}}[\p{{Nd}}{JOIN}]*)", f"{NUMBER}$1")
    df = df.withColumn("_e", F.when(F.col("_d"), counted(F.col("_c"))).otherwise(F.col("_c")))
    cut = lambda c, marks: F.array_remove(F.split(F.lower(c), rf"[^\p{{L}}\p{{M}}\p{{Nd}}{marks}]+"), "")
    behind = lambda ts: F.transform(ts, lambda t, i: F.when((i > 0) & (t > JOIN) & ~t.isin(*NUMBER_WORDS) & F.get(ts, i - 1).isin(*NUMBER_WORDS), F.concat(F.lit(UNIT), t)).otherwise(t))
    df = df.withColumn("_f", cut("_e", f"{NAME}-{JOIN}")).withColumn("toks", F.when(F.arrays_overlap("_f", F.lit(NUMBER_WORDS)), behind(F.col("_f"))).otherwise(F.col("_f")))
    return df.withColumn("words", cut("_a", "")).drop(text, "_a", "_b", "_c", "_d", "_e", "_f")


def is_slot(t: Column) -> Column:
    return (t < JOIN) | t.isin(*NUMBER_WORDS)


def template(t: Column) -> Column:
    return F.when(t < JOIN, F.substring(t, 1, 1)).when(t.isin(*NUMBER_WORDS), NUMBER).otherwise(t)


def windows(df: DataFrame, lengths: list[int], own: str) -> DataFrame:
    """(own, t, len, exact, pos, h): hashes of all windows of the given lengths, of templates and (exact) of plain words; t counts the tokens.

    Runs of 2, 4, 8, ... tokens are hashed from their halves, and a window from such runs, each in a column of its
    own, so that none is computed twice.
    """
    z = df.select(own, F.transform("toks", lambda t: F.xxhash64(template(t))).alias("x1"), F.transform("words", lambda t: F.xxhash64(t)).alias("y1"))
    size = lambda c: F.size(f"{c}1")
    pair = lambda c, a, b, k: F.zip_with(a, F.slice(b, F.lit(k + 1), F.greatest(size(c), F.lit(1))), lambda p, q: F.xxhash64(p, q))
    k = 1
    while 2 * k <= max(lengths):
        z, k = z.withColumns({f"{c}{2 * k}": pair(c, f"{c}{k}", f"{c}{k}", k) for c in "xy"}), 2 * k
    forms = []
    for n in lengths:
        bits = [1 << i for i in reversed(range(n.bit_length())) if n >> i & 1]
        for c in "xy":
            h, have = F.col(f"{c}{bits[0]}"), bits[0]
            for bit in bits[1:]:
                h, have = pair(c, h, f"{c}{bit}", have), have + bit
            forms.append(F.struct(size(c).alias("t"), F.lit(n).alias("len"), F.lit(c == "y").alias("exact"), F.slice(h, F.lit(1), F.greatest(size(c) - (n - 1), F.lit(0))).alias("hs")))
    return z.select(own, F.inline(F.array(*forms))).select(own, "t", "len", "exact", F.posexplode("hs").alias("pos", "h"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, coverage: float = 0.5, least: int = 5, shortest: int = 3) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, n_slots): one row for each leaked item of a document.

    n_windows of the item, n_found of them in the document: template windows in consistent alignments, or windows of
    words, case aside, whichever cover more; n_found >= coverage * n_windows. n_slots: distinct slot values of the item
    that the document fills (0 where words decide). An item shorter than ``window`` is one window. Templates of which
    over half are slots, and of items of fewer than ``least`` tokens, take no part; words do from ``shortest`` on, since
    fewer stand in any prose. Null or empty texts and an empty table on either side leak nothing; repeated rows of a
    doc_id or item_id count as one text set (a window is found if any has it); null ids take no part, and ids must be whole
    numbers. Other columns are not read.
    """
    need_whole_numbers(docs, id_col)
    need_whole_numbers(benchmark, "item_id")
    scratch = Scratch(docs.sparkSession)
    items = with_tokens(benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("_text")), "_text")
    items = scratch.cut(items.where(F.size("words") >= shortest).distinct())
    short = [r["n"] for r in items.select(F.explode(F.array(F.size("toks"), F.size("words"))).alias("n")).where(F.col("n").between(1, window)).distinct().collect()]  # at most ``window``
    wanted = windows(items, sorted({window, *short}), "item_id").where(F.least("t", F.lit(window)) == F.col("len"))
    own = F.when(F.col("exact"), F.col("words")).otherwise(F.col("toks"))
    wanted = wanted.join(items, "item_id").where(F.size(own) == F.col("t")).select("item_id", "t", "pos", "len", "exact", "h", F.slice(own, F.col("pos") + 1, F.col("len")).alias("want"))
    few = F.aggregate("want", F.lit(0), lambda a, t: a + is_slot(t).cast("int")) * 2 <= F.col("len")
    wanted = scratch.cut(wanted.where(F.col("exact") | (few & (F.col("t") >= least))).drop("t").distinct())
    n_wanted = wanted.count()

    raw = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    lengths = [r["len"] for r in wanted.select("len").distinct().collect()] or [window]  # at most ``window``
    forms = wanted.select("h", "len", "exact", "item_id", "pos").distinct()
    found = windows(with_tokens(raw, "_text"), lengths, "doc_id").withColumnRenamed("pos", "at").join(broadcast_if(forms, n_wanted, 1_000_000), ["h", "len", "exact"])
    found = scratch.cut(found.select("doc_id", "item_id", "exact", "pos", "at", "len").distinct())

    form = ["doc_id", "item_id", "exact"]
    total = wanted.groupBy("item_id", "exact").agg(F.countDistinct("pos").alias("n_windows"))
    enough = F.col("n_found") >= F.col("n_windows") * coverage
    likely = scratch.cut(found.groupBy(*form).agg(F.countDistinct("pos").alias("n_found")).join(total, ["item_id", "exact"]).where(enough).select(*form))
    near = scratch.cut(likely.select("doc_id").distinct())
    texts = with_tokens(raw.join(broadcast_if(near, near.count(), 2_000_000), "doc_id", "left_semi"), "_text")
    seen = found.join(likely, form).join(texts, "doc_id").withColumn("got", F.slice(own, F.col("at") + 1, F.col("len"))).where(F.size("got") == F.col("len")).drop("toks", "words")
    seen = seen.join(broadcast_if(wanted.drop("h"), n_wanted), ["item_id", "exact", "pos", "len"]).withColumn("shift", F.col("at") - F.col("pos"))
    same = F.when(F.col("exact"), F.col("got") == F.col("want")).otherwise(F.transform("got", template) == F.transform("want", template))
    seen = scratch.cut(seen.where(same))  # the words decide, not their hashes
    slot = seen.where("not exact").select("doc_id", "item_id", "shift", F.explode(F.arrays_zip("want", "got")).alias("z")).where(is_slot(F.col("z.want"))).groupBy("doc_id", "item_id", "shift", F.col("z.want").alias("value")).agg(F.countDistinct("z.got").alias("n"))
    per = slot.groupBy("doc_id", "item_id", "shift").agg(F.max("n").alias("worst"), F.count("*").alias("n_slots")).withColumn("exact", F.lit(False))
    whole = seen.join(per, [*form, "shift"], "left").where("worst is null or worst = 1")
    whole = whole.groupBy(*form).agg(F.countDistinct("pos").alias("n_found"), F.max(F.coalesce("n_slots", F.lit(0))).cast("long").alias("n_slots")).join(total, ["item_id", "exact"]).where(enough)
    best = F.max_by(F.struct("n_windows", "n_found", "n_slots"), F.struct(F.col("n_found") / F.col("n_windows"), ~F.col("exact"))).alias("b")
    scratch.free(seen, wanted)
    return whole.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that leak a benchmark item; rows with a null id stay."""
    bad = Scratch(docs.sparkSession).cut(leaks(docs, benchmark).select("doc_id").distinct())
    return docs.join(broadcast_if(bad, bad.count(), 2_000_000), "doc_id", "left_anti").select(docs.columns)

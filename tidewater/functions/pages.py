"""What a fetched page is, and rows made of pages, feeds and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.variants import has_field, tree_nodes

#: What only such pages say.
CAPTCHA_PHRASES = ("our systems have detected unusual traffic", 'id="captcha-form"')
RATE_PHRASES = ("error 429", "too many requests")
CONSENT_TITLE = "before you continue"


def block_kind(url: Column, status: Column, html: Column, head: int | None = None) -> Column:
    """captcha, consent, rate-limited, blocked, unauthorized, http-error or ok: the first that fits.

    ``head`` bounds the characters looked at; by default the whole page is. A consent page stands on a host for consent,
    or has a form that saves a choice there, or one that saves it anywhere under a title or path that asks for it.
    """
    low = F.lower(F.coalesce(html if head is None else F.substring(html, 1, head), F.lit("")))
    u = F.lower(F.coalesce(url, F.lit("")))
    says = lambda words: [F.contains(low, F.lit(w)) for w in words]
    captcha = u.rlike("/sorry/") | says(CAPTCHA_PHRASES)[0] | says(CAPTCHA_PHRASES)[1]
    forms = F.transform(F.regexp_extract_all(low, F.lit(r"<form\b[^>]*>"), F.lit(0)), lambda f: F.regexp_extract(f, r'\saction\s*=\s*["\']?([^"\'\s>]*)', 1))
    savers = F.filter(forms, lambda a: F.endswith(F.regexp_replace(a, "[?#].*$", ""), F.lit("/save")))  # where a choice is sent to
    own = lambda address: F.startswith(F.coalesce(F.try_parse_url(address, F.lit("HOST")), F.lit("")), F.lit("consent."))
    titles = F.regexp_extract_all(low, F.lit(r"<title>\s*([^<]*)"), F.lit(1))
    asks = F.exists(titles, lambda t: F.startswith(t, F.lit(CONSENT_TITLE))) | F.startswith(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), F.lit("/consent"))
    consent = own(u) | (F.exists(savers, own)) | ((F.size(savers) > 0) & asks)
    rate = (status == 429) | (says(RATE_PHRASES)[0] & says(RATE_PHRASES)[1])
    code = F.coalesce(status, F.lit(200))
    return F.when(captcha, "captcha").when(consent, "consent").when(F.coalesce(rate, F.lit(False)), "rate-limited").when(code == 403, "blocked").when(code == 401, "unauthorized").when(code >= 400, "http-error").otherwise("ok")


def page_info(tree: Column, page_key: str, total_key: str, depth: int = 60) -> Column:
    """struct<token, total, place>: the first of each in a JSON text, in document order.

    Under ``page_key`` stands an array of token and, third, total; under ``total_key`` one of total and, third, place.
    """
    of = lambda node, key, i, kind: F.try_variant_get(node, f"$.{key}[{i}]", kind)
    nodes = F.transform(tree_nodes(tree, lambda v: has_field(page_key)(v) | has_field(total_key)(v), depth, into_hits=True), lambda t: F.parse_json(t))
    first = lambda values: F.get(F.array_compact(values), F.lit(0))
    whole = lambda node, key, i: F.when(of(node, key, i, "variant").cast("string").rlike("^-?[0-9]+$") & ~F.startswith(F.to_json(of(node, key, i, "variant")), F.lit('"')), of(node, key, i, "long"))
    word = lambda node, key, i: F.when(F.startswith(F.to_json(of(node, key, i, "variant")), F.lit('"')), F.nullif(of(node, key, i, "string"), F.lit("")))

    def read(ns: Column) -> Column:
        total = first(F.flatten(F.transform(ns, lambda n: F.array(whole(n, page_key, 2), whole(n, total_key, 0)))))
        return F.struct(first(F.transform(ns, lambda n: word(n, page_key, 0))).alias("token"), total.alias("total"), first(F.transform(ns, lambda n: word(n, total_key, 2))).alias("place"))

    return F.transform(F.array(nodes), read)[0]


def article_rows(items: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """items with snippet, image and author of their details; the feed's own snippet stands in where there is none."""
    d = details.select(key, F.col("snippet").alias("_s"), F.col("image").alias("image"), F.col("author").alias("author"))
    out = items.join(d, key, "left")
    return out.withColumn("snippet", F.coalesce("_s", "snippet")).withColumn("decoded", F.col("article_url").isNotNull()).drop("_s")


def vector_rows(chunks: DataFrame) -> DataFrame:
    """(text, source, page, heading) of chunks (status, text, file_name, source_url, page_start, heading_path) that did not fail and hold text."""
    rows = chunks.where((F.coalesce("status", F.lit("")) != "failed") & (F.coalesce("text", F.lit("")) != ""))
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select("text", F.coalesce(F.nullif(F.col("file_name"), F.lit("")), empty("source_url")).alias("source"), empty("page_start").alias("page"), empty("heading_path").alias("heading"))

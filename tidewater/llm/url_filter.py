"""URL filters by redirect equivalence.

Rules (host, path prefix, action) decide the urls they fit. Redirects and canonical links make urls
aliases of one page: connected components over those edges carry a block to every alias, unless a rule
allows the alias itself or another member of its component (explicit allow has precedence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, ascii_lower, broadcast_if
from tidewater.llm.components import components

MAX_RULES = 10_000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """Identity of a url among aliases: host, path and query; scheme and fragment do not count."""
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), F.when(path_of(url) == "", "/").otherwise(path_of(url)), F.coalesce(F.regexp_extract(url, _URL, 3), F.lit(""))))


def absolute(base: Column, href: Column) -> Column:
    """A link resolved against its page: full, scheme-relative, root-relative, beside the page, or a query of it.

    ``.`` and ``..`` are resolved, the fragment goes; null for an empty link and for schemes other than http and https.
    """
    href = F.regexp_replace(F.trim(href), r"(?s)#.*$", "")
    scheme, host, path = F.regexp_extract(base, r"^([^:/?#]*)://", 1), F.regexp_extract(base, _URL, 1), F.regexp_extract(base, _URL, 2)
    site = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    full = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(href.rlike(r"(?i)^https?://."), href))
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(site, path, href))
        .when(href != "", F.concat(site, F.when(folder == "", "/").otherwise(folder), href))
    )
    steps = F.split(F.regexp_replace(F.regexp_extract(full, _URL, 2), "^/", ""), "/")
    up = lambda done: F.regexp_replace(done, r"/[^/]*$", "")
    dots = r"^\.{1,2}$"
    walked = F.aggregate(steps, F.lit(""), lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.lit("/"), x)))
    walked = F.when(F.element_at(steps, -1).rlike(dots), F.concat(walked, F.lit("/"))).otherwise(walked)
    return F.when(F.exists(steps, lambda x: x.rlike(dots)), F.concat(F.regexp_extract(full, r"^([^:/?#]*://[^/?#]*)", 1), walked, F.regexp_extract(full, _URL, 3))).otherwise(full)


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, in double, single or no quotes; empty if there is none."""
    one = lambda p: F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*{p}", 1)
    found = F.coalesce(F.nullif(one('"([^"]*)"'), F.lit("")), F.nullif(one("'([^']*)'"), F.lit("")), one("([^\\s\"'>]+)"))
    for name_, sign in (("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        found = F.replace(found, F.lit(name_), F.lit(sign))
    return found


def page_edges(pages: DataFrame, url: str = "url", html: str = "html", most_seconds: int = 1) -> DataFrame:
    """(src, dst) urls of all canonical links and of the redirects after at most ``most_seconds`` that pages declare outside comments."""
    h = F.when(F.col(html).rlike("(?i)canonical|http-equiv"), F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", ""))
    tags = lambda name: F.regexp_extract_all("_h", F.lit(rf"(?is)<{name}\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"), F.lit(0))
    links = F.transform(F.filter(tags("link"), lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical")), lambda t: _attribute(t, "href"))
    contents = F.transform(F.filter(tags("meta"), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh"), lambda t: _attribute(t, "content"))
    wait = r"(?is)^\s*(\d*)(?:\.\d*)?\s*[;,\s]\s*url\s*=\s*(.*)$"
    soon = F.filter(contents, lambda c: F.coalesce(F.regexp_extract(c, wait, 1).try_cast("int"), F.lit(0)).between(0, most_seconds) & c.rlike(wait))
    targets = F.transform(soon, lambda c: F.regexp_replace(F.trim(F.regexp_extract(c, wait, 2)), r"""(?s)^["']|["'].*$""", ""))
    rows = pages.select(F.col(url).alias("src"), h.alias("_h")).where(F.col("_h").isNotNull() & F.contains("src", F.lit("://"))).select("src", F.explode(F.concat(links, targets)).alias("href"))
    return rows.select("src", absolute(F.col("src"), F.col("href")).alias("dst")).where("dst is not null")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct<n, rule, action>, or null. rules: (host, path, allow|block)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<n:int,rule:string,action:string>")
    by_host: dict[str, list] = {}
    for h, p, a in rules:
        by_host.setdefault(h, []).append(F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(a).alias("action"), F.lit(p).alias("path")))
    lookup = F.create_map(*[x for h, own in by_host.items() for x in (F.lit(h), F.array(*own))])
    labels = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.flatten(F.array_compact(F.transform(ends, lambda e: F.try_element_at(lookup, e)))), lambda r: path.startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["n"].alias("n"), r["rule"].alias("rule"), r["action"].alias("action"))))
    return best


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame | None = None, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, alias_of) of every row of pages.

    edges (src, dst urls) default to those the pages declare. Verdict: the rule's; else of its component
    allow if a rule allows a member, block if a rule blocks one; else allow. A url that is null, empty or
    without ``://`` has empty host and path, no aliases, no rule and is allowed. Members of a component
    that only occur as a redirect target count too. alias_of is the least host, path and query of the component.
    Repeated rows each get their verdict; other columns of pages are neither read nor returned.
    """
    scratch = Scratch(pages.sparkSession)
    edges = page_edges(pages, url) if edges is None else edges
    links = scratch.cut(edges.select(node_of(F.col("src")).alias("u"), node_of(F.col("dst")).alias("v"), "src", "dst").distinct())
    labels = components(links.select("u", "v"), scratch)
    ends = links.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("src").alias("url")), F.struct(F.col("v").alias("node"), F.col("dst").alias("url"))))).where("node is not null").distinct()
    ruled = ends.withColumn("action", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["action"]).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    verdict = ruled.groupBy("label").agg(F.when(F.bool_or(F.col("action") == "allow"), "allow").when(F.bool_or(F.col("action") == "block"), "block").alias("own"))
    members = scratch.cut(ruled.select("node", "label").distinct().join(verdict, "label"))
    n = members.count()
    u = F.col("_url")
    judged = pages.select(F.col(id_col), F.col(url).alias("_url")).select(id_col, host_of(u).alias("host"), path_of(u).alias("path"), node_of(u).alias("node")).withColumn("best", rule_of(F.col("host"), F.col("path"), rules))
    out = judged.join(broadcast_if(members, n), "node", "left")
    return out.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", "own", F.lit("allow")).alias("verdict"), F.coalesce("label", "node").alias("alias_of"))

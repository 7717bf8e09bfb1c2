"""URLs given by users: the frontier of valid ones and direct-download forms of share links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.variants import elements, members

#: Share links (pattern) and the direct link they stand for; the first that fits wins.
DIRECT = (
    (r"^https?://drive\.google\.com/file/d/([\w-]+).*$", "https://drive.usercontent.google.com/download?id=$1&export=download&confirm=t"),
    (r"^https?://drive\.google\.com/[^?]*\?(?:[^#]*&)?id=([\w-]+).*$", "https://drive.usercontent.google.com/download?id=$1&export=download&confirm=t"),
    (r"^https?://docs\.google\.com/document/d/([\w-]+)(?!.*/export).*$", "https://docs.google.com/document/d/$1/export?format=docx"),
    (r"^https?://docs\.google\.com/spreadsheets/d/([\w-]+)(?!.*/export).*$", "https://docs.google.com/spreadsheets/d/$1/export?format={sheet}"),
    (r"^https?://docs\.google\.com/presentation/d/([\w-]+)(?!.*/export).*$", "https://docs.google.com/presentation/d/$1/export/pptx"),
    (r"^https?://(?:www\.)?github\.com/([^/]+)/([^/]+)/blob/([^?#]+).*$", "https://raw.githubusercontent.com/$1/$2/$3"),
    (r"^https?://app\.box\.com/s/([\w-]+).*$", "https://app.box.com/shared/static/$1"),
)
#: Hosts whose links become direct by a parameter that is set beside all others.
BY_PARAMETER = ((r"^https?://(?:www\.)?dropbox\.com/", "dl"), (r"^https?://[^/?#]*\.sharepoint\.com/", "download"))
ONEDRIVE = r"^https?://(?:1drv\.ms|onedrive\.live\.com)/"


def with_parameter(url: Column, name: str, value: str) -> Column:
    """The url with the query parameter set once, where it stood or at the end; all other parameters and the fragment stay."""
    front, fragment = F.regexp_extract(url, r"^([^#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    bare = F.regexp_replace(front, rf"(?<=[?&]){name}(?:=[^&]*)?(?:&|$)", "")
    bare = F.regexp_replace(bare, r"[?&]+$", "")
    put = F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.lit(f"{name}={value}"))
    return F.concat(put, fragment)


def direct_link(url: Column, sheet: str = "xlsx") -> Column:
    """The direct download of a share link, its access keys kept; other urls as they are. Sheets come as ``sheet``."""
    url = F.trim(url)
    encoded = F.regexp_replace(F.translate(F.base64(F.encode(url, "UTF-8")), "/+\r\n", "_-"), "=+$", "")
    out = F.when(url.rlike(ONEDRIVE), F.concat(F.lit("https://api.onedrive.com/v1.0/shares/u!"), encoded, F.lit("/root/content")))
    for pattern, name in BY_PARAMETER:
        out = out.when(url.rlike(pattern), with_parameter(url, name, "1"))
    for pattern, to in DIRECT:
        out = out.when(url.rlike(pattern), F.regexp_replace(url, pattern, to.replace("{sheet}", sheet)))
    return out.otherwise(url)


def absolute(url: Column) -> Column:
    """An http(s) url with its scheme; null where another scheme is named or the host is a bare word.

    ``//host`` and ``host:port`` get https; hosts are names with a dot, localhost or addresses in brackets.
    """
    raw = F.trim(url)
    has_port = raw.rlike(r"^[^:/?#@\s]+:\d+(?:[/?#]|$)")
    named = raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~has_port
    full = F.when(F.startswith(raw, F.lit("//")), F.concat(F.lit("https:"), raw)).when(named, raw).otherwise(F.concat(F.lit("https://"), raw))
    host = F.lower(F.regexp_replace(F.regexp_extract(full, r"(?i)^https?://(?:[^/?#@\s]*@)?(\[[^\]\s]*\]|[^/?#\s]*)", 1), r":\d*$", ""))
    known = host.isin("localhost") | F.startswith(host, F.lit("[")) | host.rlike(r"^[^.:]+(?:\.[^.:]+)+$")
    return F.when((raw != "") & known & ~full.rlike(r"\s"), full)


def urls_in(item: Column, path: str) -> Column:
    """The urls of a VARIANT record at a dotted path, arrays on the way and at its end flattened, in order."""
    flat = lambda vs: F.flatten(F.transform(vs, lambda v: F.coalesce(elements(v), F.array(v))))
    below = lambda vs, name: F.array_compact(F.transform(flat(vs), lambda v: F.try_element_at(members(v), F.lit(name))))
    found = flat(reduce(below, path.split("."), F.array(item)))
    return F.filter(F.transform(found, lambda v: F.when(F.startswith(F.to_json(v), F.lit('"')), F.trim(F.try_variant_get(v, "$", "string")))), lambda x: x != "")


def readable_key(url: Column, most: int = 180) -> Column:
    """Host and path of a url in letters, digits and a few marks, at most ``most`` characters, and ten of its sha1."""
    host, path = F.lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    name = F.regexp_replace(F.concat(host, F.when(path == "/", "").otherwise(path)), "[^a-zA-Z0-9!_.'()-]+", "-")
    name = F.left(F.regexp_replace(F.regexp_replace(name, "-+", "-"), "^[-.]+|[-.]+$", ""), F.lit(most))
    return F.concat(F.when(name == "", "page").otherwise(name), F.lit("-"), F.left(F.sha1(url), F.lit(10)))


def frontier(df: DataFrame, url: str, order: str, most: int | None = 100_000) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): http(s) urls with a scheme, exact repeats once (the first in order), at most ``most`` unless it is None; and the rest.

    Other schemes and bare words are invalid; a null or empty url is in neither.
    """
    rows = df.withColumn("_url", absolute(F.col(url) if isinstance(url, str) else url)).where(F.trim(url) != "")
    valid = rows.where("_url is not null").groupBy(F.col("_url").alias("url")).agg(F.min(order).alias(order))
    valid = valid if most is None else valid.orderBy(order, "url").limit(most)
    return valid, rows.where("_url is null").select(df.columns)

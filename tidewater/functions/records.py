"""Mappings of collected records to flat ones: auctions, permits, groceries, hotels, trends, ads and news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.values import round_half_up
from tidewater.functions.variants import has_field, tree_nodes

#: The order in which awards and contracts are looked at, and what a lot's status comes to.
AWARD_ORDER = ("active", "signed", "pending", "pending_waiting", "pending_admission")
CONTRACT_ORDER = ("active", "signed", "pending")
OUTCOMES = {"complete": "sold", "unsuccessful": "no_winner", "cancelled": "cancelled", "active_qualification": "winner_pending", "qualification": "winner_pending", "active_awarded": "winner_confirmed", "pending_payment": "winner_confirmed"}


def pick_lang(c: Column, first: str, second: str) -> Column:
    """The text of a language map: the first language, else the second; blank and "-" are null, masked is [redacted]."""
    one = lambda k: F.nullif(F.nullif(F.trim(F.try_element_at(c, F.lit(k))), F.lit("")), F.lit("-"))
    text = F.coalesce(one(first), one(second))
    return F.when(text.rlike(r"^[*\s]+$"), "[redacted]").otherwise(text)


def unless_masked(c: Column) -> Column:
    """Null for empty and masked e-mails and phones."""
    return F.when((F.trim(c) != "") & ~F.contains(c, F.lit("*")), F.trim(c))


def organisation(**fields: Column) -> Column:
    """A struct of the fields; null if all of them are."""
    return F.when(F.coalesce(*[f.cast("string") for f in fields.values()]).isNotNull(), F.struct(*[f.alias(n) for n, f in fields.items()]))


def with_origin(**documents: Column) -> Column:
    """One array of the documents of several origins, each with the name of its origin; null arrays are empty."""
    def tagged(origin: str, docs: Column) -> Column:
        return F.transform(docs, lambda d: F.struct(F.lit(origin).alias("origin"), d["id"].alias("id"), d["title"].alias("title"), d["url"].alias("url")))

    return F.flatten(F.array_compact(F.array(*[tagged(o, c) for o, c in documents.items()])))


def by_status(rows: Column, order: tuple[str, ...]) -> Column:
    """The first struct of the array whose status comes first in the order; others are passed over."""
    return F.coalesce(*[F.get(F.filter(rows, lambda r: r["status"] == s), F.lit(0)) for s in order])  # noqa: B023 - used at once; later ones are looked for where no earlier one is


def auction_result(status: Column, start: Column, awards: Column, contracts: Column, bids: Column) -> Column:
    """struct<outcome, final_price, top_bid, increase_pct>: the contract's value counts before the award's."""
    final = F.coalesce(by_status(contracts, CONTRACT_ORDER)["amount"], by_status(awards, AWARD_ORDER)["amount"])
    outcome = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair]), status), F.lit("in_progress"))
    pct = F.when(start != 0, round_half_up((final - start) / start * 100))
    return F.struct(outcome.alias("outcome"), final.alias("final_price"), F.array_max(F.transform(bids, lambda b: b["amount"])).alias("top_bid"), pct.alias("increase_pct"))


def method_parts(method: Column) -> Column:
    """struct<family, kind>: a selling method split at its first hyphen."""
    return F.struct(F.regexp_extract(method, r"^([^-]*)", 1).alias("family"), F.nullif(F.regexp_extract(method, r"^[^-]*-(.*)$", 1), F.lit("")).alias("kind"))


def without_persons(details: Column, labels: str = r"(?i)\b(applicant|owner|contact|phone|e-?mail)\b") -> Column:
    """A map without the entries whose label names a person; null if nothing is left."""
    kept = F.map_filter(details, lambda k, v: ~k.rlike(labels))
    return F.when(F.size(kept) > 0, kept)


#: What the last word of a street may be.
STREET_ENDS = """st street ave avenue rd road dr drive blvd boulevard ln lane ct court way pl place cir circle hwy highway pkwy parkway ter terrace trl trail loop sq pt point
run pass path row xing aly cv cove pike walk""".split()


def address_parts(address: Column, states: tuple[str, ...]) -> Column:
    """struct<street, city, state, zip>: "street, city ST zip", with commas anywhere between; without one the city follows the street's last word, its direction or unit.

    The state must be one of ``states``; else the street is all and only a zip at the end is told. A zip has five digits.
    """
    a = F.trim(F.regexp_replace(F.regexp_replace(address, r"\s*\*\s*$", ""), r"\s+", " "))
    zip_ = F.nullif(F.regexp_extract(a, r"(?:^|[,\s])(\d{5})(?:-\d{4})?$", 1), F.lit(""))
    bare = F.regexp_replace(a, r"[,\s]+\d{5}(?:-\d{4})?$", "")
    state = F.upper(F.regexp_extract(bare, r"[,\s]([A-Za-z]{2})$", 1))
    head = F.regexp_replace(bare, r"[,\s]+[A-Za-z]{2}$", "")
    comma = F.contains(head, F.lit(","))
    parts = F.filter(F.transform(F.split(head, ","), lambda x: F.trim(x)), lambda x: x != "")
    end = rf"(?i)^(.*\b(?:{'|'.join(STREET_ENDS)})\b\.?(?:\s+(?:[NSEW]{{1,2}}|north|south|east|west|#\S*|(?:unit|apt|ste|suite|bldg|lot)\s+\S+|\d+[a-z]?))*)\s+([A-Za-z][A-Za-z .'-]*)$"
    street = F.when(comma, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ", ")).when(head.rlike(end), F.regexp_extract(head, end, 1)).otherwise(head)
    city = F.when(comma, F.element_at(parts, -1)).when(head.rlike(end), F.regexp_extract(head, end, 2))
    found = state.isin(*states)
    return F.struct(F.when(found, street).otherwise(a).alias("street"), F.when(found, F.initcap(F.lower(city))).alias("city"), F.when(found, state).alias("state"), zip_.alias("zip"))


def contact(lines: Column) -> Column:
    """struct<name, company, phone, email, license, address> of the lines of a contact block."""
    first = lambda p, i=1: F.try_element_at(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, p, i)), lambda x: x != ""), F.lit(1))
    company = r"(?i)^(.*\b(?:INC|LLC|CORP|CO|LTD|COMPANY|SERVICES|ROOFING|CONSTRUCTION|PLUMBING)\b\.?.*)$"
    labelled = r"(?i)(phone|fax|e-?mail|licen[sc]e)|@"
    street = r"^(\d+\s+\S.*)$"
    name = F.try_element_at(F.filter(lines, lambda x: ~x.rlike(labelled) & ~x.rlike(company) & ~x.rlike(r"\d") & (F.trim(x) != "")), F.lit(1))
    address = F.nullif(F.array_join(F.filter(lines, lambda x: x.rlike(street) | x.rlike(r"\b[A-Z]{2},?\s+\d{5}")), ", "), F.lit(""))
    return F.struct(name.alias("name"), first(company).alias("company"), first(r"(\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4})").alias("phone"), first(r"([\w.+-]+@[\w-]+\.[\w.]+)").alias("email"), first(r"(?i)licen[sc]e\s*(?:#|no\.?|number)?:?\s*#?\s*([A-Z]*\d[\w-]*)").alias("license"), address.alias("address"))


def promotion(price: Column, was: Column, half_price: Column | None = None, kinds: dict[str, Column] | None = None) -> Column:
    """struct<was, save, kind>: a former price counts only above the price; half price first, then kinds in order, then SPECIAL."""
    above = F.when(was > price, was)
    kind = F.when(half_price, "HALF_PRICE") if half_price is not None else F.when(F.lit(False), "")
    for name, holds in (kinds or {}).items():
        kind = kind.when(holds, name)
    return F.struct(above.alias("was"), round_half_up(above - price).alias("save"), kind.when(above.isNotNull(), "SPECIAL").alias("kind"))


def promo_text(*parts: Column) -> Column:
    """The distinct parts that say something, joined; null if none does."""
    said = F.filter(F.array_distinct(F.array_compact(F.array(*[F.trim(p) for p in parts]))), lambda p: p != "")
    return F.nullif(F.array_join(said, " · "), F.lit(""))


def branded_name(brand: Column, name: Column) -> Column:
    return F.when(brand.isNull() | (brand == "") | F.startswith(F.lower(name), F.lower(brand)), name).otherwise(F.concat_ws(" ", brand, name))


def unwrap_groups(df: DataFrame, groups: str, inner: str = "products", sponsored: str = "is_ad") -> DataFrame:
    """The products inside one level of groups, without ad tiles."""
    rows = df.select(F.explode(groups).alias("_g")).select(F.explode(F.col(f"_g.{inner}")).alias("_p")).select("_p.*")
    return rows.where(~F.coalesce(F.col(sponsored), F.lit(False)))


def image_of(assets: Column, kinds: tuple[str, ...], width: int, most: int = 2000) -> Column:
    """The url of the asset of the first kind present, {width} filled in and clamped."""
    found = F.flatten(F.transform(F.lit(list(kinds)), lambda k: F.filter(assets, lambda a: a["kind"] == k)))
    return F.replace(F.try_element_at(found, F.lit(1))["url"], F.lit("{width}"), F.lit(str(max(1, min(width, most)))))


def stay_price(total: Column, per_night: Column, nights: Column) -> Column:
    """struct<per_night, total>: the total of a stay, else nights times the nightly price, and back."""
    whole = F.coalesce(total, round_half_up(per_night * nights))
    return F.struct(F.coalesce(per_night, round_half_up(F.when(nights > 0, total / nights))).alias("per_night"), whole.alias("total"))


def best_rate(rooms: Column) -> Column:
    """The room with the lowest price; rooms without a price are passed over, ties go to the first."""
    priced = F.filter(F.transform(rooms, lambda r, i: F.struct(r["price"].alias("price"), i.alias("i"), r.alias("room"))), lambda x: x["price"].isNotNull())
    return F.array_min(F.transform(priced, lambda x: F.struct(x["price"].alias("price"), x["i"].alias("i"), x["room"]["name"].alias("name"))))


def timeline_rows(df: DataFrame, keys: list[str], points: str, terms: Column, resolution: Column) -> DataFrame:
    """(keys, term, at, value, partial): a row a term and point; points have time, values, has_data and partial.

    The date keeps its time only for MINUTE and HOUR resolution; missing has_data means there is data.
    """
    p = df.select(*keys, terms.alias("_t"), resolution.alias("_r"), F.explode(points).alias("p"))
    rows = p.select(*keys, "_t", "_r", "p", F.posexplode("p.values").alias("i", "value"))
    at = F.timestamp_seconds(F.col("p.time").cast("long"))
    shown = F.when(F.col("_r").isin("MINUTE", "HOUR"), F.date_format(at, "yyyy-MM-dd'T'HH:mm")).otherwise(F.date_format(at, "yyyy-MM-dd"))
    has = F.coalesce(F.try_element_at("p.has_data", F.col("i") + 1), F.lit(True))
    return rows.select(*keys, F.try_element_at("_t", F.col("i") + 1).alias("term"), shown.alias("at"), F.when(has, F.col("value")).alias("value"), F.coalesce("p.partial", F.lit(False)).alias("partial"))


def related_rows(df: DataFrame, keys: list[str], kinds: tuple[str, ...], base: str) -> DataFrame:
    """(keys, kind, rank, query, value, breakout, link): ranked entries of the array columns named in kinds."""
    out = None
    for kind in kinds:
        rows = df.select(*keys, F.lit(kind).alias("kind"), F.posexplode(kind).alias("i", "e"))
        link = F.when(F.startswith(F.col("e.link"), F.lit("/")), F.concat(F.lit(base), F.col("e.link"))).otherwise(F.col("e.link"))
        rows = rows.select(*keys, "kind", (F.col("i") + 1).alias("rank"), F.col("e.query").alias("query"), F.regexp_replace("e.value", r"[^\d]", "").try_cast("long").alias("value"), (F.lower("e.value") == "breakout").alias("breakout"), link.alias("link"))
        out = rows if out is None else out.union(rows)
    return out


def term_status(**parts: Column) -> Column:
    """ok if all requested parts came, failed if none did, else partial."""
    got = sum((p.isNotNull().cast("int") for p in parts.values()), F.lit(0))
    return F.when(got == len(parts), "ok").when(got == 0, "failed").otherwise("partial")


def video_id(record: Column) -> Column:
    """The id of a video link anywhere in a record's JSON."""
    return F.nullif(F.regexp_extract(F.to_json(record), r"(?:youtube(?:-nocookie)?\.com\\?/(?:watch\?v=|embed\\?/|vi\\?/)|youtu\.be\\?/|ytimg\.com\\?/vi\\?/)([\w-]{11})", 1), F.lit(""))


def count_range(least: Column, most: Column) -> Column:
    """"100-200", "100+" without an end, "100" where both ends agree."""
    return F.when(least == most, least.cast("string")).when(most.isNull(), F.concat(least.cast("string"), F.lit("+"))).otherwise(F.concat_ws("-", least.cast("string"), most.cast("string")))


def related_coverage(html: Column) -> Column:
    """array<struct<url, title>> of the links of a list, without the first, which is the article itself."""
    entries = F.regexp_extract_all(html, F.lit(r'(?s)<li>\s*<a[^>]*href="([^"]*)"[^>]*>.*?</a>'), F.lit(0))
    pairs = F.transform(entries, lambda e: F.struct(F.regexp_extract(e, r'href="([^"]*)"', 1).alias("url"), F.regexp_replace(e, r"<[^>]*>", "").alias("title")))
    return F.slice(pairs, F.lit(2), F.greatest(F.size(pairs), F.lit(1)))


def head_meta(html: Column) -> Column:
    """struct<description, image, author, canonical, lang>: the first key that is filled; an author that is a url is none.

    The page is read once for its meta, link and html tags; the fields are looked up in these.
    """
    attribute = lambda tag, names: F.regexp_extract(tag, rf'(?is)\s(?:{names})\s*=\s*["\']([^"\']*)', 1)

    def fields(tags: Column) -> Column:
        first = lambda found: F.nullif(F.trim(F.get(found, F.lit(0))), F.lit(""))
        of = lambda key: first(F.transform(F.filter(tags, lambda t: (t["name"] == key) & (F.trim(t["content"]) != "")), lambda t: t["content"]))
        meta = lambda *keys: F.coalesce(*[of(k) for k in keys])
        author = F.transform(F.array(meta("author", "article:author")), lambda x: F.when(~x.rlike("(?i)^https?://"), x))[0]
        return F.struct(meta("description", "og:description", "twitter:description").alias("description"), meta("og:image", "twitter:image").alias("image"), author.alias("author"), of("<link canonical").alias("canonical"), first(F.transform(F.filter(tags, lambda t: t["name"] == "<html"), lambda t: t["content"])).alias("lang"))

    def read(tag: Column) -> Column:
        kind = F.lower(F.substring(tag, 1, 5))
        name = F.when(kind == "<meta", F.lower(attribute(tag, "name|property"))).when(kind == "<link", F.concat(F.lit("<link "), F.lower(attribute(tag, "rel")))).otherwise(kind)
        return F.struct(name.alias("name"), F.when(kind == "<meta", attribute(tag, "content")).when(kind == "<link", attribute(tag, "href")).otherwise(attribute(tag, "lang")).alias("content"))

    tags = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<(?:meta|link|html)\b[^>]*>"), F.lit(0)), read)
    return F.transform(F.array(tags), fields)[0]


def page_title(html: Column) -> Column:
    """struct<title, charset> of a page's head; null where they are missing or empty."""
    one = lambda p: F.nullif(F.trim(F.regexp_extract(html, p, 1)), F.lit(""))
    return F.struct(one("(?is)<title>(.*?)</title>").alias("title"), one('(?i)charset=["\']?([a-z0-9-]+)').alias("charset"))


def objects_with(tree: Column, key: str, depth: int = 60) -> Column:
    """The JSON objects that hold ``key``, anywhere in a JSON text, in document order; a hit is not searched further."""
    return tree_nodes(tree, has_field(key), depth)

"""Grocery products of three stores as one record, and the money texts in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions import records as rc
from tidewater.functions.text import slug
from tidewater.functions.values import round_half_up

#: Promotions that a list stands for, and words of badges that are one.
LIST_PROMOTIONS = {"special-buys": "SPECIAL_BUY", "super-savers": "SUPER_SAVER", "lower-prices": "LOWER_PRICE", "limited-time-only": "LIMITED_TIME"}
BADGE_WORDS = ("special buy", "super saver", "price drop", "lower price", "save", "was ", "reduced", "half price", "clearance", "limited time")


def said(c: Column) -> Column:
    """Trimmed text with single blanks; empty, "none" and "null" are null."""
    t = F.trim(F.regexp_replace(c.cast("string"), r"\s+", " "))
    return F.when((t != "") & ~F.lower(t).isin("none", "null"), t)


def money(text: Column) -> Column:
    """The first amount in a text ("$1,250.00", "AUD 3.99", "3,99 €") as double: a comma before two last digits is decimal, others group."""
    first = F.regexp_extract(text, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    cents = F.regexp_extract(first, r",([0-9]{2})$", 1)
    whole = F.when(cents != "", F.left(first, F.length(first) - 3)).otherwise(first)
    return F.concat(F.translate(whole, ",", ""), F.when(cents != "", F.concat(F.lit("."), cents)).otherwise("")).try_cast("double")


def from_cents(c: Column) -> Column:
    return round_half_up(c.cast("double") / 100)


def joined(sep: str, *parts: Column) -> Column:
    """The parts that say something; null if none does."""
    kept = F.array_compact(F.array(*[said(p) for p in parts]))
    return F.when(F.size(kept) > 0, F.array_join(kept, sep))


def _record(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def coles(p: Column, site: str = "", images: str = "") -> Column:
    """Record of a product with id, name, description, brand, size, pricing, online_heirs, image_uris, availability and ad_id.

    A former price counts only above the price; without pricing the product is out of stock.
    """
    pr, brand, base = p["pricing"], said(p["brand"]), F.coalesce(said(p["name"]), said(p["description"]))
    was = F.when(pr["was"] > pr["now"], pr["was"])
    heir = F.try_element_at(p["online_heirs"], F.lit(1))
    image = F.try_element_at(p["image_uris"], F.lit(1))
    address = slug(F.concat_ws(" ", brand, said(p["name"]), said(p["size"])))
    special = was.isNotNull() | F.coalesce(pr["promotion_type"] == "SPECIAL", F.lit(False)) | F.coalesce(pr["online_special"], F.lit(False)) | pr["multi_buy"].isNotNull()
    return _record(
        store=F.lit("coles"), product_id=p["id"].cast("string"), name=rc.branded_name(brand, base), brand=brand, size=said(p["size"]), price=pr["now"], was_price=was,
        savings=F.coalesce(round_half_up(was - pr["now"]), F.nullif(pr["save_amount"], F.lit(0.0))), unit_price=pr["unit_price"], unit_text=said(pr["comparable"]), on_special=special, promo_type=pr["promotion_type"],
        promo_text=rc.promo_text(pr["multi_buy"], pr["offer"], pr["save_statement"], pr["price_description"]), in_stock=pr.isNotNull() & F.coalesce(p["availability"], F.lit(True)), sponsored=p["ad_id"].isNotNull(),
        category=joined(" > ", heir["sub_category"], heir["category"], heir["aisle"]), image=F.when(image != "", F.concat(F.lit(images), F.when(image.startswith("/"), "").otherwise("/"), image)),
        url=F.concat(F.lit(site), F.lit("/product/"), F.when(address != "", F.concat(address, F.lit("-"))).otherwise(""), p["id"].cast("string")),
    )


def woolworths(p: Column, site: str = "") -> Column:
    """Record of a product with stockcode, names, price and was_price (which repeats the price without a discount), flags and attribute texts.

    Categories come from the JSON lists in ``pies_*``, else from the plain ``sap_*`` texts.
    """
    was = F.when(p["was_price"] > p["price"], p["was_price"])
    save = round_half_up(was - p["price"])
    half, special = F.coalesce(p["half_price"], F.lit(False)), F.coalesce(p["on_special"], F.lit(False))
    first = lambda c: F.try_element_at(F.array_compact(F.transform(F.from_json(c, "array<string>"), said)), F.lit(1))
    pies = joined(" > ", *[first(p[f"pies_{k}"]) for k in ("department", "category", "subcategory")])
    sap = joined(" > ", *[p[f"sap_{k}"] for k in ("department", "category", "subcategory")])
    code = p["stockcode"].cast("string")
    return _record(
        store=F.lit("woolworths"), product_id=code, name=F.coalesce(said(p["display_name"]), said(p["name"])), brand=said(p["brand"]), size=said(p["size"]), price=p["price"], was_price=was, savings=save,
        on_special=special | was.isNotNull() | half, promo_type=F.when(half, "HALF_PRICE").when(special | was.isNotNull(), "SPECIAL"),
        promo_text=rc.promo_text(F.when(half, "Half price"), said(p["tag"]), F.when(save > 0, F.concat(F.lit("Save $"), F.format_string("%.2f", save)))),
        in_stock=F.coalesce(p["in_stock"], p["available"]), sponsored=F.coalesce(p["sponsored"], F.lit(False)), category=F.coalesce(pies, sap), barcode=said(p["barcode"]),
        image=F.coalesce(said(p["large_image"]), said(p["medium_image"]), said(p["small_image"])), url=F.concat_ws("/", F.concat(F.lit(site), F.lit("/shop/productdetails")), code, said(p["slug"])),
    )


def aldi(p: Column, list_type: Column, site: str = "", width: int = 600) -> Column:
    """Record of a product with sku, brand, name, cents in price, was_text, badges, sale_from, categories, assets and discontinued.

    The promotion is the first of: a former price above the price, the list, a sale date, a badge; a list of limited
    time alone is no special.
    """
    price, was_text = from_cents(F.coalesce(p["cents_relevant"], p["cents"])), money(p["was_text"])
    was = F.when(was_text > price, was_text)
    badges = F.array_distinct(F.array_compact(F.transform(F.coalesce(p["badges"], F.array().cast("array<string>")), said)))
    listed = F.try_element_at(F.create_map(*[F.lit(x) for pair in LIST_PROMOTIONS.items() for x in pair]), F.coalesce(list_type, F.lit("")))
    flagged = F.exists(badges, lambda b: F.lower(b).rlike("|".join(BADGE_WORDS)))
    promo = F.when(was.isNotNull(), "PRICE_DROP").otherwise(F.coalesce(listed, F.when(said(p["sale_from"]).isNotNull(), "SPECIAL_BUY"), F.when(flagged, "PROMOTION")))
    brand, address = said(p["brand"]), said(p["slug"])
    text = F.array_distinct(F.array_compact(F.concat(badges, F.array(F.concat(F.lit("Save "), said(p["savings_text"])), F.when(was.isNotNull(), F.concat(F.lit("Was $"), F.format_string("%.2f", was))), said(p["sale_from"])))))
    cats = F.array_compact(F.transform(F.coalesce(p["categories"], F.array().cast("array<string>")), said))
    return _record(
        store=F.lit("aldi"), product_id=p["sku"].cast("string"), name=rc.branded_name(brand, said(p["name"])), brand=brand, size=said(p["size"]), price=price, was_price=was, savings=round_half_up(was - price),
        on_special=F.coalesce(promo != "LIMITED_TIME", F.lit(False)), promo_type=promo, promo_text=F.when(F.size(text) > 0, F.array_join(text, " · ")), in_stock=~F.coalesce(p["discontinued"], F.lit(False)),
        category=F.when(F.size(cats) > 0, F.array_join(cats, " > ")), badges=badges, image=rc.image_of(p["assets"], ("FR01",), width), url=F.concat(F.lit(site), F.lit("/product/"), F.when(address.isNotNull(), F.concat(address, F.lit("-"))).otherwise(""), p["sku"].cast("string")),
    )

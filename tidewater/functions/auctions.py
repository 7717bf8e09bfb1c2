"""Auction procedures as flat records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions import records as rc


def ordered_distinct(values: Column) -> Column:
    """The values of an array in their order, each once, without nulls and empty texts."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def seller_of(top: Column, related: Column) -> Column:
    """The organisation that sells: the one named at the top if any of its fields is set, else the related one."""
    return F.coalesce(top, related)


def line_items(items: Column, first: str = "uk", second: str = "en") -> Column:
    """Items (id, description map, code, scheme, quantity, unit, region, city) flat, language maps as texts; null arrays are empty."""
    flat = lambda i: F.struct(
        i["id"].alias("id"), rc.pick_lang(i["description"], first, second).alias("description"), F.when(i["code"].isNotNull(), F.struct(i["code"].alias("code"), i["scheme"].alias("scheme"))).alias("classification"),
        i["quantity"].alias("quantity"), i["unit"].alias("unit"), i["region"].alias("region"), i["city"].alias("city"))
    return F.coalesce(F.transform(items, flat), F.transform(F.slice(items, F.lit(1), F.lit(0)), flat))


def procedure(p: Column, page: str = "") -> Column:
    """One flat record of a procedure: parts of the method, first bidding period, places of the items else the seller's, and the result."""
    items = line_items(p["items"])
    each = lambda name: ordered_distinct(F.transform(p["items"], lambda i: i[name]))  # of the items as they came: flat ones are made only for themselves
    regions, cities = each("region"), each("city")
    seller = seller_of(p["seller"], p["related_seller"])
    parts = rc.method_parts(p["method"])
    period = F.coalesce(p["tender_period"], p["enquiry_period"])
    result = rc.auction_result(p["status"], p["start_price"], p["awards"], p["contracts"], p["bids"])
    return F.struct(
        p["id"].alias("auction_id"), F.concat(F.lit(page), p["id"].cast("string")).alias("url"), rc.pick_lang(p["title"], "uk", "en").alias("title"), p["status"].alias("status"), F.nullif(parts["family"], F.lit("")).alias("procedure_type"), parts["kind"].alias("auction_type"),
        p["start_price"].alias("start_price"), period["start"].alias("bidding_start"), period["end"].alias("bidding_end"), F.coalesce(F.try_element_at(regions, F.lit(1)), seller["region"]).alias("region"), F.coalesce(F.try_element_at(cities, F.lit(1)), seller["city"]).alias("city"),
        regions.alias("regions"), each("code").alias("codes"), F.size(p["items"]).alias("n_items"), items.alias("items"), seller.alias("seller"), result.alias("result"))


def participants(p: Column) -> Column:
    """struct<organiser, winner, n_bids, documents> of a procedure with awards, bids, documents and an organiser.

    The winner is the supplier of the award that comes first by status, signed and pending ones too; organisations are
    null where nothing of them is told, masked e-mails and phones are left out. Documents carry their origin.
    """
    told = lambda o: rc.organisation(name=F.nullif(F.trim(o["name"]), F.lit("")), id=F.nullif(o["id"], F.lit("")), email=rc.unless_masked(o["email"]), phone=rc.unless_masked(o["phone"]))
    award = rc.by_status(p["awards"], rc.AWARD_ORDER)
    of_awards = F.array_compact(F.flatten(F.array_compact(F.transform(p["awards"], lambda a: a["documents"]))))
    documents = rc.with_origin(procedure=p["documents"], award=of_awards)
    return F.struct(told(p["organiser"]).alias("organiser"), F.when(award.isNotNull(), told(award["supplier"])).alias("winner"), F.coalesce(F.size(p["bids"]), F.lit(0)).alias("n_bids"), documents.alias("documents"))


def permit(row: Column, detail: Column, states: tuple[str, ...], personal: bool = False, rules: dict[str, list[str]] | None = None) -> Column:
    """One record of a permit: the detail page before the grid row, the address in parts, a company before a person.

    ``detail`` may be null. The person of a contractor counts only beside another company; applicants and owners are
    named only with ``personal``, and without it labels of persons leave the further details.
    """
    from tidewater.functions.text import category

    pick = lambda f: F.coalesce(F.nullif(detail[f], F.lit("")), F.nullif(row[f], F.lit("")))
    address = pick("address")
    parts = rc.address_parts(address, states)
    company, person = detail["contractor_company"], detail["contractor_name"]
    more = detail["more"] if personal else rc.without_persons(detail["more"])
    return F.struct(
        F.trim(F.coalesce(row["record_number"], detail["record_number"])).alias("record_number"), pick("record_type").alias("record_type"), category(pick("record_type"), rules or {}, pick("description")).alias("category"), pick("status").alias("status"),
        F.coalesce(parts["street"], address).alias("address"), parts["city"].alias("city"), parts["state"].alias("state"), parts["zip"].alias("zip"), address.alias("full_address"), pick("description").alias("description"),
        F.coalesce(company, person, row["contractor_name"]).alias("contractor"), F.when(company.isNotNull() & (person != company), person).alias("contractor_person"),
        (detail["applicant"] if personal else F.lit(None).cast("string")).alias("applicant"), more.alias("more"), detail.isNotNull().alias("details_fetched"))

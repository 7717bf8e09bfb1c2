"""Invoices as rows: labelled fields, totals, roles of columns, currency and the type of a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import values as v
from tidewater.operators.documents import segments
from tidewater.scratch import Scratch

#: What columns, fields, totals and documents are called. The first that fits wins.
ROLES = {
    "line_number": r"#|no\.?|nr\.?|pos\.?|line|crt",
    "sku": r"sku|code|art\.? ?n[or]\.?|item code|cod",
    "unit": r"unit|uom|einheit|u\.?m\.?|unité|unidad",
    "description": r"description|item|product|article|bezeichnung|beschreibung|descriere|denumire|désignation|descripción",
    "quantity": r"qty|quantity|menge|anzahl|cantitate|quantité|cantidad|pcs|units",
    "unit_price": r"unit price|price|rate|einzelpreis|preis|pre[tț] unitar|pre[tț]|prix unitaire|prix|precio",
    "discount": r"discount|rabatt|reducere|remise|descuento",
    "tax": r"vat|tax|mwst|ust|tva|iva|gst",
    "line_total": r"amount|total|sum|betrag|summe|gesamt|valoare|montant|importe",
}
FIELDS = {
    "number": r"(?i)\b(?:invoice|rechnung|factur[aă]|facture)\s*(?:no\.?|nr\.?|number|n°|#)?\s*:?\s*#?\s*([A-Z0-9][\w/-]*\d[\w/-]*)",
    "po_number": r"(?i)\b(?:p\.?o\.?|purchase order|order)\s*(?:no\.?|number|#)\s*:?\s*([\w/-]*\d[\w/-]*)",
    "due_date": r"(?i)\b(?:due date|due|payable by|fällig am|scaden[tț][aă])\s*:?\s*(.{6,30})",
    "date": r"(?i)\b(?:invoice date|date|datum|data)\s*:?\s*(.{6,30})",
    "tax_id": r"(?i)\b(?:vat|tax|ust|tva)[ .-]*(?:id|no|nr|reg)\w*\.?\s*:?\s*([A-Z]{0,2}\d[\d ]{6,14})",
    "iban": r"\b([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b",
}
#: What the parties of an invoice are called, and other labels that end a value.
PARTIES = {
    "customer": "bill to, billed to, invoice to, sold to, customer, client, buyer, kunde, cumpărător, beneficiar, facturé à, klant, cliente, destinatario",
    "supplier": "from, seller, supplier, vendor, sold by, issued by, bill from, lieferant, verkäufer, furnizor, vânzător, fournisseur, vendeur, leverancier, proveedor, fornitore",
}
OTHER_LABELS = "invoice, invoice no, invoice number, invoice date, date, due date, payment due, order number, purchase order, vat no, vat id, tax id, iban, total, subtotal, rechnung, rechnungsnummer, datum"
TOTALS = {"subtotal": r"sub-?\s?total|net amount|zwischensumme|nettobetrag", "total": r"grand total|amount due|total due|balance due|gesamtbetrag|total de plat[aă]", "tax": r"vat|tax|mwst|ust|tva|iva|gst", "plain_total": r"total|summe|gesamt"}
TYPES = {"credit_note": r"credit note|gutschrift", "receipt": r"receipt|quittung|bon fiscal", "quote": r"quotation|quote|angebot|ofert[aă]", "purchase_order": r"purchase order|bestellung", "invoice": r"invoice|rechnung|factur[aăe]"}


def document_type(text: Column) -> Column:
    low, out = F.lower(text), None
    for kind, words in TYPES.items():
        hit = low.rlike(rf"\b(?:{words})\b")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def header_roles(headers: DataFrame, keys: list[str], position: str, text: str) -> DataFrame:
    """(keys, role, position): one column a role: the first that fits, for line totals the right-most."""
    low, role = F.lower(F.trim(text)), None
    for name, words in ROLES.items():
        whole = name in ("line_number", "sku", "unit")  # short words that also stand inside other headers
        hit = low.rlike(rf"^(?:{words})$" if whole else rf"(?:^|\b)(?:{words})(?:\b|$)")
        role = F.when(hit, name) if role is None else role.when(hit, name)
    found = headers.withColumn("role", role).where("role is not null").groupBy(*keys, "role").agg(F.min(position).alias("_a"), F.max(position).alias("_b"))
    return found.select(*keys, "role", F.when(F.col("role") == "line_total", F.col("_b")).otherwise(F.col("_a")).alias(position))


def labelled_fields(lines: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, one column a field): the value beside a label, from the first line that has it; dates as dates."""
    value = lambda p: F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit(""))
    date = lambda t: F.when(t.isNotNull(), v.parse_date(t))  # few lines have one, and reading it is the dear part
    rows = lines.select(*keys, order, *[(date(value(p)) if n.endswith("date") else value(p)).alias(n) for n, p in FIELDS.items()])
    return rows.groupBy(*keys).agg(*[F.min_by(n, F.when(F.col(n).isNotNull(), F.col(order))).alias(n) for n in FIELDS])


def party_names(words: DataFrame, keys: list[str], below: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """(keys, party, name): the supplier and the customer named on a page of words (keys, x0, x1, y, size, text).

    A label is a segment that says nothing else, or stands before a colon. Its value is the rest of the segment, else
    the next segment of the line unless that is a label, else the first segment under it within ``below`` lines and
    three sizes; a label there ends the search. The first label of a party that has a value counts.
    The result reads a table of ``scratch``.
    """
    seg = (scratch or Scratch(words.sparkSession)).cut(segments(words, keys))  # read for labels and for the values beside and under them
    part = F.split("text", ":", 2)
    head, rest = F.lower(F.trim(F.regexp_replace(part[0], r"[\s.#]+$", ""))), F.trim(F.coalesce(F.try_element_at(part, F.lit(2)), F.lit("")))
    known = {name: [w.strip() for w in names.split(",")] for name, names in PARTIES.items()}
    party = reduce(lambda c, x: c.when(head.isin(x[1]), x[0]), list(known.items())[1:], F.when(head.isin(known["customer"]), "customer"))
    labels = [w for ws in known.values() for w in ws] + [w.strip() for w in OTHER_LABELS.split(",")]
    seg = seg.withColumn("_party", party).withColumn("_rest", rest).withColumn("_label", head.isin(labels))
    asked = seg.where("_party is not null").select(*keys, F.col("line_no").alias("_line"), F.col("segment_no").alias("_seg"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("y").alias("_y"), F.col("size").alias("_size"), F.col("_party").alias("party"), F.col("_rest").alias("_own"))
    label = [*keys, "party", "_line", "_seg"]
    own = asked.where("_own <> ''").select(*label, F.lit(0).alias("_far"), F.lit(0.0).alias("_at"), F.col("_own").alias("name"))
    other = seg.select(*keys, "line_no", "segment_no", "x0", "x1", "y", F.col("text").alias("name"), "_label")
    right = asked.withColumn("line_no", F.col("_line")).withColumn("segment_no", F.col("_seg") + 1).join(other, [*keys, "line_no", "segment_no"]).where("not _label").select(*label, F.lit(1).alias("_far"), F.lit(0.0).alias("_at"), "name")
    under = asked.select("*", F.explode(F.sequence(F.col("_line") + 1, F.col("_line") + below)).alias("line_no")).join(other, [*keys, "line_no"])
    under = under.where((F.col("x0") < F.col("_x1") + 20) & (F.col("x1") > F.col("_x0") - 5) & (F.col("y") - F.col("_y") <= 3 * F.col("_size") * (F.col("line_no") - F.col("_line"))))
    under = under.select(*label, (F.lit(1) + F.col("line_no") - F.col("_line")).cast("int").alias("_far"), F.col("x0").cast("double").alias("_at"), F.when(~F.col("_label"), F.col("name")).alias("name"))
    found = own.unionByName(right).unionByName(under).groupBy(*label).agg(F.min_by(F.struct("name"), F.struct("_far", "_at")).alias("v"))
    return found.where("v.name is not null").groupBy(*keys, "party").agg(F.min_by("v.name", F.struct("_line", "_seg")).alias("name"))


def totals(lines: DataFrame, keys: list[str], order: str, text: str, decimal_comma: Column | bool = False) -> DataFrame:
    """(keys, subtotal, tax, total): of label and amount lines; the last of each counts, taxes add up.

    A line is a subtotal before a strong total, that before a tax, that before a plain total; a plain total
    counts where no strong one is. A missing total is subtotal plus tax.
    """
    label = F.lower(F.regexp_extract(text, r"^\s*(\D+?)[\s:]*[-(]?[$€£]?\s*\d", 1))

    def kind(x: Column) -> Column:
        out = F.when((x == "") | x.rlike(r"\b(?:id|no|nr|reg|number)\b"), F.lit(None).cast("string"))
        for name, words in TOTALS.items():
            out = out.when(x.rlike(rf"\b(?:{words})\b"), name)
        return out

    # lines that name no total go first; of the others the numbers are read, once
    amount = v.parse_number(F.regexp_extract(text, r"((?:[A-Z]{3}\s*|[$€£]\s*)?[-(]?[$€£]?\d[\d.,' ]*\)?(?:\s*(?:[$€£]|[A-Z]{3}))?)\s*$", 1), decimal_comma)
    named = lines.select(*keys, order, text, label.alias("_l")).where(F.col("_l").rlike(rf"\b(?:{'|'.join(TOTALS.values())})\b"))
    kinds = named.select(*keys, order, text, kind(F.col("_l")).alias("_k"))
    rows = kinds.select(*keys, order, "_k", F.when(F.col("_k").isNotNull(), amount).alias("_v"))
    last = lambda k: F.max_by("_v", F.when((F.col("_k") == k) & F.col("_v").isNotNull(), F.col(order)))
    out = rows.groupBy(*keys).agg(last("subtotal").alias("subtotal"), F.sum(F.when(F.col("_k") == "tax", F.col("_v"))).alias("tax"), F.coalesce(last("total"), last("plain_total")).alias("total"), F.count("_v").alias("_n")).where("_n > 0").drop("_n")
    return out.withColumn("total", F.coalesce("total", F.round(F.col("subtotal") + F.coalesce("tax", F.lit(0)), 2)))


def document_currency(lines: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, currency): the currency named most often by code or symbol; of equals the first met."""
    named = F.regexp_extract_all(text, F.lit("([$€£¥₹₽₴₺]|\\b(?:" + "|".join(v.CODES) + ")\\b)"), F.lit(1))
    each = lines.select(*keys, order, F.explode(named).alias("_s")).select(*keys, order, v.currency_of(F.col("_s")).alias("currency"))
    counted = each.groupBy(*keys, "currency").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(*keys).agg(F.min_by("currency", F.struct((-F.col("n")).alias("n"), "first", "currency")).alias("currency"))


def line_check(quantity: Column, price: Column, amount: Column, discount: Column | None = None) -> Column:
    """struct<status, amount>: ok if quantity x price is the amount, or is so less the discount or less that many percent; else differs.

    Half a percent of the amount, and at least 0.011, may be missing. Without an amount it is computed; without a
    quantity or price the status is null.
    """
    full = quantity * price
    near = lambda x: F.coalesce(F.abs(x - amount) <= F.greatest(F.lit(0.011), F.abs(amount) * 0.005), F.lit(False))
    less = F.lit(False) if discount is None else near(full - discount) | near(full * (1 - discount / 100))
    status = F.when(full.isNull(), None).when(amount.isNull(), "computed").when(near(full) | less, "ok").otherwise("differs")
    return F.struct(status.alias("status"), F.coalesce(amount, F.round(full, 2)).alias("amount"))


def totals_check(line_sum: Column, subtotal: Column, tax: Column, total: Column) -> Column:
    """struct<lines_ok, total_ok, total>: whether the lines make up the subtotal (else the total), and subtotal and tax the total.

    The first allows a tenth of a percent, and at least 0.02, the second 0.02; checks without both sides are null. A
    missing total is computed.
    """
    base = F.coalesce(subtotal, total)
    return F.struct((F.abs(line_sum - base) <= F.greatest(F.lit(0.02), F.abs(base) * 0.001)).alias("lines_ok"), (F.abs(subtotal + tax - total) <= 0.02).alias("total_ok"), F.coalesce(total, F.round(subtotal + F.coalesce(tax, F.lit(0.0)), 2)).alias("total"))

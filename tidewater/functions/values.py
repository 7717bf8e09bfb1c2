"""Numbers, dates and typed cells out of text, as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currencies by symbol and by code.
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₽": "RUB", "₴": "UAH", "₺": "TRY", "zł": "PLN", "lei": "RON", "kr": "SEK", "Kč": "CZK"}
CODES = "USD EUR GBP CHF CAD AUD NZD JPY CNY INR RON MDL PLN CZK HUF SEK NOK DKK UAH RUB TRY BGN KZT ZAR BRL MXN SGD HKD AED ILS".split()
#: Beginnings of month names in the languages of invoices.
MONTHS = {1: "jan ian janv", 2: "feb févr", 3: "mar mär mrz", 4: "apr avr", 5: "may mai", 6: "jun iun juin", 7: "jul iul juil", 8: "aug août", 9: "sep sept", 10: "oct okt", 11: "nov noi", 12: "dec dez déc"}

_CURRENCY = "(?:[$€£¥₹₽₴₺]|zł|lei|kr|Kč|\\b(?:" + "|".join(CODES) + ")\\b)"
#: The signs of a printed number, the marks that may stand between its digits, and white space.
SIGNS, MARKS, SPACE = "-−–", " ,.'\u2019\u00a0\u202f", " \t\n\r\f\x0b"
LONGEST = 40  # characters of a printed number
_HERE = "\x01"  # stands for the digits
_CURRENCIES = [*(k.lower() for k in SYMBOLS), *(c.lower() for c in CODES)]
#: What may be around the digits, signs and white space aside: brackets, a currency on either side, a mark before the first digit.
_AROUND = [x for m in ("", ".", ",") for c in ["", *_CURRENCIES] for x in {f"{c}{m}{_HERE}", f"{m}{_HERE}{c}", f"({c}{m}{_HERE})", f"({m}{_HERE}{c})", f"{c}({m}{_HERE})", f"({m}{_HERE}){c}"}]
#: Most numbers: digits alone, or before one or two decimals, there also in threes by commas; they read the same by either rule.
_PLAIN = r"^[$]?(?:[0-9]{1,15}|(?:[0-9]{1,15}|[0-9]{1,3}(?:,[0-9]{3}){1,4})[.][0-9]{1,2})$"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated once, however often it is used, also after plans are merged."""
    return F.transform(F.array(value), use)[0]


def _scanned(text: Column, comma: Column) -> Column:
    """The value of a printed number by what stands before, between and after its digits."""
    ends = F.struct(text.alias("t"), F.regexp_extract(text, "^[^0-9]*", 0).alias("before"), F.regexp_extract(text, "[^0-9]*$", 0).alias("after"))

    def middle(x: Column) -> Column:
        core = F.substring(x["t"], F.length(x["before"]) + 1, F.length(x["t"]) - F.length(x["before"]) - F.length(x["after"]))
        around = F.translate(F.lower(F.concat(x["before"], F.lit(_HERE), x["after"])), SPACE + SIGNS + "%", "")
        minus = (F.translate(x["before"], SIGNS + "(", "") != x["before"]) | F.endswith(x["after"], F.lit("-"))
        return F.struct(F.when((F.length(x["t"]) <= LONGEST) & around.isin(_AROUND), core).alias("core"), F.translate(core, "0123456789", "").alias("marks"), F.endswith(x["before"], F.lit(".")) | F.endswith(x["before"], F.lit(",")), minus).cast("struct<core:string,marks:string,point:boolean,minus:boolean>")

    def grouped(x: Column) -> Column:
        return F.struct(x["core"].alias("core"), x["marks"].alias("marks"), x["point"].alias("point"), x["minus"].alias("minus"), F.right(x["marks"], F.lit(1)).alias("last"), F.split(F.translate(x["core"], MARKS, "," * len(MARKS)), ",").alias("g"))

    def decided(x: Column) -> Column:
        last, tail = x["last"], F.element_at(x["g"], -1)
        several, alone = F.replace(x["marks"], last, F.lit("")) != "", F.length(x["marks"]) == 1
        unclear = (F.length(tail) == 3) & F.length(x["g"][0]).between(1, 3) & ~F.startswith(x["g"][0], F.lit("0"))
        decimal = last.isin(".", ",") & (several | (alone & (~unclear | ((last == ",") == comma))))
        return F.struct(x.alias("x"), F.coalesce(decimal, F.lit(False)).alias("decimal"))

    def valued(y: Column) -> Column:
        x, decimal = y["x"], y["decimal"]
        whole = F.when(decimal, F.slice(x["g"], F.lit(1), F.size(x["g"]) - 1)).otherwise(x["g"])
        threes = (F.size(x["g"]) == 1 + decimal.cast("int")) | (F.length(x["g"][0]).between(1, 3) & F.forall(F.slice(whole, 2, LONGEST), lambda g: F.length(g) == 3))
        known = (F.translate(x["marks"], MARKS, "") == "") & (~x["point"] | (x["marks"] == ""))
        digits = F.concat(F.when(x["minus"], "-").otherwise(""), F.when(x["point"], "0.").otherwise(""), F.array_join(whole, ""), F.when(decimal, F.concat(F.lit("."), F.element_at(x["g"], -1))).otherwise(""))
        return F.when(threes & known & (x["core"] != ""), digits.try_cast("double"))

    found = lambda x: F.when(x["core"].isNotNull(), _once(grouped(x), lambda g: _once(decided(g), valued)))
    return _once(ends, lambda e: _once(middle(e), found))


def parse_number(text: Column, decimal_comma: Column | bool = False) -> Column:
    """A printed number as double: sign or parentheses, a currency on either side, percent, grouped digits.

    With two kinds of marks the last is the decimal one; a single one before three digits follows
    ``decimal_comma``; a repeated one, a space or an apostrophe groups. Anything else, and texts of over 40
    characters, are null. The text is scanned once and every part of it is evaluated once.
    """
    comma = decimal_comma if isinstance(decimal_comma, Column) else F.lit(decimal_comma)
    t = F.trim(text)
    return F.when(t.rlike(_PLAIN), F.translate(t, "$,", "").try_cast("double")).otherwise(_scanned(t, comma))


def is_percent(text: Column) -> Column:
    return parse_number(text).isNotNull() & F.contains(text, F.lit("%"))


def currency_of(text: Column) -> Column:
    """The code of the first currency in the text, else null."""
    codes = {c.lower(): c for c in CODES} | {k.lower(): c for k, c in SYMBOLS.items()}
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    named = lambda c: F.try_element_at(known, F.lower(c))
    # most texts name nothing but a currency beside a number; only others are searched
    return F.coalesce(named(F.regexp_extract(text, r"[^\s0-9.,'()%+-]+", 0)), named(F.regexp_extract(text, "(?i)(" + _CURRENCY + ")", 1)))


def price_text(text: Column) -> Column:
    """A displayed price ("1.234 €", "€ 99,50") as double: the last separator is decimal before one or two digits."""
    n = F.regexp_extract(text, r"(\d[\d.,'   ]*)", 1)
    cut = F.regexp_extract(n, r"^(.*?)[.,](\d{1,2})\s*$", 1)
    cents = F.regexp_extract(n, r"^.*?[.,](\d{1,2})\s*$", 1)
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    return F.when(cents != "", F.concat(digits(cut), F.lit("."), cents)).otherwise(digits(n)).try_cast("double")


def traffic_number(label: Column) -> Column:
    """"10K+" as 10000, "2M+" as 2000000, "500+" as 500."""
    n = F.regexp_extract(label, r"(\d[\d,.]*)\s*[KkMm]?\+?", 1)
    unit = F.lower(F.regexp_extract(label, r"\d\s*([KkMm])", 1))
    return (F.replace(n, F.lit(","), F.lit("")).try_cast("double") * F.when(unit == "k", 1000).when(unit == "m", 1_000_000).otherwise(1)).cast("long")


def decimal_comma_votes(text: Column) -> tuple[Column, Column]:
    """(comma, dot): weighted counts of numbers written with a decimal comma and with a decimal dot."""
    runs = F.regexp_extract_all(text, F.lit("[0-9.,]+"), F.lit(0))
    n = lambda p: F.size(F.filter(runs, lambda x: x.rlike(p)))
    comma = n("^[0-9]+,[0-9]{1,2}$") + 2 * F.regexp_count(text, F.lit(r"[0-9]\.[0-9]{3},[0-9]"))
    dot = n(r"^[0-9]+\.[0-9]{1,2}$") + 2 * F.regexp_count(text, F.lit(r"[0-9],[0-9]{3}\.[0-9]")) + n("^[0-9]{1,3}(,[0-9]{3})+$")
    return comma, dot


#: Signs of kinds in a date: numbers of 1, 2 and 4 digits, other numbers, months, endings of ordinals, words, white space.
_ONE, _TWO, _YEAR, _LONG, _MONTH, _ORDINAL, _WORD, _GAP = "124#moW_"
#: A date that is nothing but day, month by name and year needs no scan: it is clear.
_NAMED = r"^([0-9]{1,2}) ((?:" + "|".join(" ".join(MONTHS.values()).split()) + r")\p{L}*) ([0-9]{4})$"


def _kind(token: Column) -> Column:
    """The kind of a token as one sign; marks stand for themselves."""
    digits = F.translate(token, "0123456789", "") == ""
    size = F.length(token)
    number = F.when(size == 1, _ONE).when(size == 2, _TWO).when(size == 4, _YEAR).otherwise(_LONG)
    month = token.rlike("^(?:" + "|".join(" ".join(MONTHS.values()).split()) + ")")
    word = F.when(month, _MONTH).when(token.isin("st", "nd", "rd", "th"), _ORDINAL).otherwise(_WORD)
    return F.when(digits, number).when(F.trim(F.translate(token, "\t\n\r\f\x0b", " ")) == "", _GAP).when(token.rlike(r"^\p{L}"), word).when(token.isin("-", "/", "."), token).otherwise(",")


def parse_date(text: Column, prefer: str = "auto", decimal_comma: Column | bool = False) -> Column:
    """The first of an ISO date, a numeric date, "15 September 2026" or "September 15, 2026" in the text.

    The text is cut into numbers, words and marks; the kinds of these tell where a date stands. A numeric date with a
    part over 12 is clear; else ``prefer`` (DMY or MDY) decides, and with auto slashes mean month first unless decimals
    are commas. Impossible dates are null.
    """
    comma = decimal_comma if isinstance(decimal_comma, Column) else F.lit(decimal_comma)
    day, part, gap = f"[{_ONE}{_TWO}]", "[-./]", f"{_GAP}?,?{_GAP}?"
    orders = [f"{_YEAR}{part}{day}{part}{day}", f"{day}{part}{day}{part}[{_TWO}{_YEAR}]", f"{day}{_ORDINAL}?[.]?{_GAP}{_MONTH}[.]?{gap}{_YEAR}", f"{_MONTH}[.]?{_GAP}{day}{_ORDINAL}?{gap}{_YEAR}"]
    letters = f"[{_MONTH}{_ORDINAL}{_WORD}]"
    pattern = f"(?<!{letters})(?:{'|'.join(orders)})(?!{letters})"
    cut = lambda t: F.regexp_extract_all(t, F.lit(r"(?s)[0-9]+|\p{L}+|\s+|."), F.lit(0))

    def hit(x: Column) -> Column:
        kinds = x["kinds"]
        shape = F.regexp_extract(kinds, pattern, 0)
        return F.struct(shape.alias("shape"), F.slice(x["tokens"], F.greatest(F.regexp_instr(kinds, F.lit(pattern)), F.lit(1)), F.length(shape)).alias("tokens"))

    kinds = lambda t: F.struct(t.alias("tokens"), F.array_join(F.transform(t, _kind), "").alias("kinds"))
    scanned = lambda t: _once(cut(t), lambda x: _once(kinds(x), lambda k: _once(hit(k), lambda h: _date_of(h["shape"], h["tokens"], prefer, comma))))
    part = lambda t, i: F.regexp_extract(t, _NAMED, i)
    named = lambda t: _day(part(t, 3).try_cast("int"), _once(part(t, 2), _month_of), part(t, 1).try_cast("int"))
    return _once(F.lower(text), lambda t: F.when(t.rlike(_NAMED), named(t)).otherwise(scanned(t)))


def _month_of(name: Column) -> Column:
    month = F.lit(None).cast("int")
    for number, starts in MONTHS.items():
        month = F.when(name.rlike("^(" + "|".join(starts.split()) + ")"), number).otherwise(month)
    return month


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in ((year, 4), (month, 2), (day, 2))]), "yyyy-MM-dd")


def _date_of(shape: Column, tokens: Column, prefer: str, comma: Column) -> Column:
    """The date of tokens of a known shape; null for the empty shape."""
    numbers = F.filter(tokens, lambda t: F.translate(t, "0123456789", "") == "")
    named = F.filter(tokens, lambda t: t.rlike(r"^\p{L}{3}"))

    def made(n: Column, month: Column) -> Column:
        number = lambda i: F.try_element_at(n, F.lit(i)).try_cast("int")
        a, b, y = number(1), number(2), number(3)
        year = F.when(F.endswith(shape, F.lit(_TWO)), y + 2000).otherwise(y)
        first = F.lit(prefer == "DMY") if prefer in ("DMY", "MDY") else comma | ~F.contains(shape, F.lit("/"))
        first = F.when(a > 12, True).when(b > 12, False).otherwise(first)
        parts = F.when(month.isNotNull(), F.struct(b.alias("y"), month.alias("m"), a.alias("d"))).when(F.startswith(shape, F.lit(_YEAR)), F.struct(a.alias("y"), b.alias("m"), y.alias("d")))
        parts = parts.when(first, F.struct(year.alias("y"), b.alias("m"), a.alias("d"))).otherwise(F.struct(year.alias("y"), a.alias("m"), b.alias("d")))
        return _once(parts, lambda p: _day(p["y"], p["m"], p["d"]))

    month = F.when(F.contains(shape, F.lit(_MONTH)), _month_of(F.try_element_at(named, F.lit(1))))
    return F.when(shape != "", _once(F.struct(numbers.alias("n"), month.alias("m")), lambda x: made(x["n"], x["m"])))


def typed_cell(text: Column, first_column: Column | bool = False, code_column: Column | bool = False, decimal_comma: Column | bool = False) -> Column:
    """The number in a table cell, or null where it stays text.

    Codes with leading zeros, "(18)" in a first column, percents and columns named as codes stay text.
    """
    as_col = lambda c: c if isinstance(c, Column) else F.lit(c)
    stays = F.trim(text).rlike(r"^0\d") | (as_col(first_column) & F.trim(text).rlike(r"^\(\d+\)$")) | as_col(code_column) | F.contains(text, F.lit("%"))
    return F.when(~stays, F.round(parse_number(text, decimal_comma), 6))


def preview(text: Column, most: int = 300) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def round_half_up(c: Column, digits: int = 2) -> Column:
    """Half up toward +infinity, also below zero."""
    f = 10**digits
    return F.floor(c * f + 0.5) / f


def epoch_instant(seconds: Column, nanos: Column) -> Column:
    return F.timestamp_micros(seconds.cast("long") * 1_000_000 + F.floor(F.coalesce(nanos, F.lit(0)) / 1000))


def drop_days(day: Column, weekdays: tuple[int, ...] = (4, 7), back: int = 2, ahead: int = 2) -> Column:
    """The dates of the given weekdays (1 is Sunday): the last ``back`` up to the day itself, then the next ``ahead``."""
    week = lambda a, b: F.filter(F.sequence(a, b), lambda x: F.dayofweek(x).isin(*weekdays))
    before, after = week(F.date_sub(day, 7 * back), day), week(F.date_add(day, 1), F.date_add(day, 7 * ahead))
    return F.concat(F.slice(before, -back, back), F.slice(after, 1, ahead))

"""Text columns: folding, slugs, html, padding, categories, templates and typed values, all as expressions."""

from __future__ import annotations

import re
import unicodedata
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F


def _base_letters() -> tuple[str, str]:
    """Lower-case letters with marks and, in the same order, the letters that are left without them."""
    pairs = {}
    for code in range(0xC0, 0x2000):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c == c.lower() and len(base) == 1 and base != c and base.isalpha():
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


ACCENTS, PLAIN = _base_letters()


def without_accents(c: Column) -> Column:
    """Lower-case letters without their marks, whether the marks are part of the letter or follow it."""
    return F.regexp_replace(F.translate(c, ACCENTS, PLAIN), r"\p{M}+", "")


def fold(c: Column) -> Column:
    """Lower case, accents off, apostrophes unified, spaces collapsed."""
    return F.trim(F.regexp_replace(F.translate(without_accents(F.lower(c)), "’ʼ`", "'''"), r"\s+", " "))


def slug(c: Column) -> Column:
    text = without_accents(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")))
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-|-$", "")


def unescaped(c: Column) -> Column:
    """A text with its HTML entities decoded, each once: decimal, hexadecimal and the named ones of HTML 4; others stay."""
    names = F.create_map(*[F.lit(x) for name, code in {**name2codepoint, "apos": 39}.items() for x in (name, chr(code))])
    point = lambda n: F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def decoded(part: Column) -> Column:
        body = F.regexp_extract(part, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        number = F.when(F.lower(F.left(body, F.lit(2))) == "#x", F.conv(F.substring(body, 3, 8), 16, 10)).when(F.startswith(body, F.lit("#")), F.substring(body, 2, 8)).try_cast("long")
        sign = F.when(body == "", None).when(F.startswith(body, F.lit("#")), point(number)).otherwise(F.try_element_at(names, body))
        return F.coalesce(F.concat(sign, F.substring(part, F.length(body) + 2, F.length(part))), F.concat(F.lit("&"), part))

    parts = F.split(c, "&")
    whole = F.concat(F.array(F.get(parts, F.lit(0))), F.transform(F.slice(parts, F.lit(2), F.size(parts)), decoded))
    return F.when(F.contains(c, F.lit("&")), F.array_join(whole, "")).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Scripts, styles and comments dropped, blocks on lines of their own, tags stripped, entities decoded."""
    x = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)<br[^>]*>|</?(p|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer)[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    x = F.replace(unescaped(x), F.lit("\u00a0"), F.lit(" "))
    x = F.regexp_replace(x, r"[ \t\r]+", " ")
    return F.trim(F.regexp_replace(x, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def starts_word(text: Column, keywords: list[str]) -> Column:
    """A keyword begins the text or follows a character that is neither letter nor digit."""
    return F.coalesce(F.lower(text).rlike(r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(re.escape(k.lower()) for k in keywords) + ")"), F.lit(False))


def category(first: Column, rules: dict[str, list[str]], *rest: Column) -> Column:
    """The first rule one of whose keywords starts a word of the first text, else of the texts after it in order; else other."""
    out = F.lit(None).cast("string")
    for text in reversed((first, *rest)):
        for name, keywords in reversed(rules.items()):
            out = F.when(starts_word(text, keywords), name).otherwise(out)
    return F.coalesce(out, F.lit("other"))


def fill_template(template: str, fields: dict[str, Column]) -> Column:
    """The template with each {{field}} as the field's text; unknown fields and nulls are empty."""
    known = {k.lower(): c for k, c in fields.items()}
    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*([^{}]+?)\s*\}\}", template):
        parts.append(F.lit(template[at : m.start()]))
        if m.group(1).lower() in known:
            parts.append(F.coalesce(known[m.group(1).lower()].cast("string"), F.lit("")))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def dehyphenate(c: Column) -> Column:
    """Words that a hyphen parts at the end of a line, joined."""
    return F.regexp_replace(c, r"(\p{Ll})-\n(\p{Ll})", "$1$2")


def pad_id(c: Column, n: int) -> Column:
    """Digits only, zero-padded to n; longer ids stay whole."""
    digits = F.regexp_replace(c.cast("string"), r"\D", "")
    return F.when(F.length(digits) < n, F.lpad(digits, n, "0")).otherwise(digits)


def traffic_label(n: Column) -> Column:
    """1234567 -> 1M+, 10234 -> 10K+, 99 -> 99+."""
    t = lambda d, s: F.concat(F.floor(n / d).cast("bigint").cast("string"), F.lit(s))
    return F.when(n >= 1_000_000, t(1_000_000, "M+")).when(n >= 1000, t(1000, "K+")).otherwise(t(1, "+"))


def strip_suffix(title: Column, source: Column) -> Column:
    """A headline without `` - Source`` at its end (hyphen, en dash, em dash or bar)."""
    out = title
    for sep in (" - ", " – ", " — ", " | "):
        tail = F.concat(F.lit(sep), source)
        out = F.when((source != "") & F.endswith(title, tail), F.left(title, F.length(title) - F.length(tail))).otherwise(out)
    return out

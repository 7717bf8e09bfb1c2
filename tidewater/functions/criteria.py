"""Search criteria as conditions: lists are alternatives, criteria are combined, missing values fail bounds."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.text import fold


def every(*conditions: Column | None) -> Column:
    """All of the conditions that are given; true without any."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def exact_or_prefix(c: Column, wanted: list[str]) -> Column | None:
    """Equal to one of the names, or a longer name of its family ("lease" fits "lease-english")."""
    return reduce(or_, [(c == w) | F.startswith(c, F.lit(w + "-")) for w in wanted]) if wanted else None


def one_of(c: Column, wanted: list[str]) -> Column | None:
    return c.isin(*wanted) if wanted else None


def bounds(c: Column, least: float | None = None, most: float | None = None) -> Column | None:
    """Within the bounds; a missing value fails them."""
    if least is None and most is None:
        return None
    low = c >= least if least is not None else F.lit(True)
    high = c <= most if most is not None else F.lit(True)
    return F.coalesce(low & high, F.lit(False))


def holds_all(text: Column, keywords: list[str]) -> Column | None:
    """Every keyword is in the text, case and accents aside."""
    return reduce(and_, [F.contains(fold(text), fold(F.lit(k))) for k in keywords]) if keywords else None


def in_region(places: Column, fallback: Column, wanted: list[str]) -> Column | None:
    """A place of an item holds one of the regions; the fallback is asked only where no item has a place."""
    if not wanted:
        return None
    near = lambda c: reduce(or_, [F.contains(fold(c), fold(F.lit(w))) for w in wanted])
    known = F.filter(F.coalesce(places, F.array().cast("array<string>")), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(known) > 0, F.exists(known, near)).otherwise(F.coalesce(near(fallback), F.lit(False)))


def search_text(*parts: Column) -> Column:
    """One text of strings and arrays of strings."""
    return F.concat_ws(" ", *parts)


def in_window(ts: Column, since: str | None = None, until: str | None = None) -> Column | None:
    """From since up to, without, until; rows without a time pass."""
    if since is None and until is None:
        return None
    low = ts >= F.lit(since).cast("timestamp_ntz") if since else F.lit(True)
    high = ts < F.lit(until).cast("timestamp_ntz") if until else F.lit(True)
    return ts.isNull() | (low & high)


def shares_word(a: Column, b: Column) -> Column:
    """A word of over two letters of one begins a word of the other that is at most two letters longer."""
    words = lambda c: F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2)
    near = lambda x, y: (F.startswith(x, y) | F.startswith(y, x)) & (F.abs(F.length(x) - F.length(y)) <= 2)
    return F.exists(words(a), lambda x: F.exists(words(b), lambda y: near(x, y)))


def query_kind(c: Column) -> Column:
    """What a typed query is: id, url, domain or name."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[A-Z]{2}\d{10,}$"), "id").when(t.rlike("(?i)^https?://"), "url").when(t.rlike(r"(?i)^([a-z0-9-]+\.)+[a-z]{2,}$"), "domain").otherwise("name")


def resolve_date(text: str | None, now: dt.date) -> dt.date | None:
    """"today", "7 days" (before now), "+14 days" (after) or an ISO date, once for a run; a ValueError else."""
    t = (text or "").strip().lower()
    if not t:
        return None
    if t in ("today", "yesterday"):
        return now - dt.timedelta(days=t == "yesterday")
    m = re.fullmatch(r"([+-]?)\s*(\d+)\s*(day|week|month|year)s?(?:\s+ago)?", t)
    if m:
        days = int(m.group(2)) * {"day": 1, "week": 7, "month": 30, "year": 365}[m.group(3)]
        return now + dt.timedelta(days=days if m.group(1) == "+" else -days)
    return dt.date.fromisoformat(t)

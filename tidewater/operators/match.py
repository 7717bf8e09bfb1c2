"""Matching names: by shared tokens, exact then prefix, and families of hyphenated names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import starts_word, without_accents

#: Words that say nothing about a name.
STOP_WORDS = ("hotel", "the", "and", "by")


def normal_name(c: Column) -> Column:
    """Lower case, accents off, everything but letters and digits to single spaces."""
    return F.trim(F.regexp_replace(without_accents(F.lower(c)), "[^a-z0-9]+", " "))


def _tokens(normal: Column) -> Column:
    words = F.array_distinct(F.split(normal, " "))
    return F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def token_match(wanted: DataFrame, name: str, listing: DataFrame, listed: str, order: str, least: float = 0.5) -> DataFrame:
    """(name, match, score): for every distinct wanted name the listed name that holds most of its tokens.

    The score is the share of wanted tokens present; below ``least`` there is no match (nulls). Ties go to
    the lower ``order``. A name without tokens matches an equal normalised name only. Candidates share one
    of the rarest tokens: of n tokens a match shares ceil(n * least), so n - ceil(n * least) + 1 of them
    are enough to meet every match, and the frequent tokens are never joined on.
    """
    want = wanted.select(F.col(name).alias("_w")).where("_w is not null").distinct()
    want = want.withColumn("_n", normal_name(F.col("_w"))).withColumn("_t", _tokens(F.col("_n")))
    have = listing.where(F.col(listed).isNotNull()).groupBy(F.col(listed).alias("_l")).agg(F.min(order).alias("_o"))
    have = have.withColumn("_m", normal_name(F.col("_l"))).withColumn("_u", F.array_distinct(F.split("_m", " ")))
    have_tokens = have.select("_l", "_o", "_u", F.explode("_u").alias("token"))
    often = have_tokens.groupBy("token").agg(F.count("*").alias("_f"))
    each = want.select("_w", "_t", F.explode("_t").alias("token")).join(often, "token")
    missing = F.size("_t") - F.ceil(F.size("_t") * F.lit(least)) + 1
    rare = each.groupBy("_w", "_t").agg(F.sort_array(F.collect_list(F.struct("_f", "token"))).alias("_a"))
    rare = rare.select("_w", "_t", F.explode(F.slice("_a", F.lit(1), F.greatest(missing, F.lit(1)).cast("int"))).alias("_e")).select("_w", "_t", F.col("_e.token").alias("token"))
    scored = rare.join(have_tokens, "token").select("_w", "_l", "_o", (F.size(F.array_intersect("_t", "_u")) / F.size("_t")).alias("_s")).where(F.col("_s") >= least)
    bare = want.where(F.size("_t") == 0).join(have, F.col("_n") == F.col("_m")).select("_w", "_l", "_o", F.lit(1.0).alias("_s"))
    best = scored.union(bare).groupBy("_w").agg(F.min(F.struct((-F.col("_s")).alias("_neg"), F.col("_o"), F.col("_l"))).alias("_b"))
    return want.select("_w").join(best, "_w", "left").select(F.col("_w").alias(name), F.col("_b._l").alias("match"), (-F.col("_b._neg")).alias("score"))


def exact_then_prefix(wanted: DataFrame, name: str, listing: DataFrame, listed: str, weight: str, order: str, k: int = 6) -> DataFrame:
    """(name, match, how): the heaviest row of the same normalised name, else of a name that starts with it.

    ``how`` is exact, prefix or null. Rows meet on their first k characters or fewer, so that a wanted name
    is compared only with names that begin alike; equal names are first reduced to their heaviest row.
    """
    want = wanted.select(F.col(name).alias("_w")).where("_w is not null").distinct().withColumn("_n", normal_name(F.col("_w"))).where("_n <> ''")
    rank = F.struct((-F.coalesce(F.col(weight), F.lit(0))).alias("_x"), F.col(order).alias("_o"), F.col(listed).alias("_l"))
    have = listing.withColumn("_m", normal_name(F.col(listed))).where("_m <> ''").groupBy("_m").agg(F.min(rank).alias("_r"))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.substring("_m", F.lit(1), i)))
    have = have.withColumn("_k", F.explode(starts))
    met = want.join(have, (F.substring("_n", 1, k) == F.col("_k")) & F.startswith("_m", F.col("_n")))
    best = met.groupBy("_w").agg(F.min(F.struct((F.col("_n") != F.col("_m")).alias("far"), "_r")).alias("_b"))
    how = F.when(F.col("_b").isNotNull(), F.when(F.col("_b.far"), "prefix").otherwise("exact"))
    return want.select("_w").join(best, "_w", "left").select(F.col("_w").alias(name), F.col("_b._r._l").alias("match"), how.alias("how"))


def family_expand(wanted: DataFrame, name: str, known: DataFrame, listed: str) -> DataFrame:
    """(name, value): the known name equal but for case, else all names ``name-...``, else the name as given."""
    want = wanted.select(F.col(name).alias("_w")).where("_w is not null").distinct().withColumn("_n", F.lower("_w"))
    have = known.select(F.col(listed).alias("_v")).where("_v is not null").distinct()
    parts = F.split(F.lower("_v"), "-")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "-"))
    met = want.join(have.withColumn("_k", F.explode(heads)), F.col("_n") == F.col("_k"), "left").withColumn("_same", F.lower("_v") == F.col("_n"))
    exact = met.groupBy("_w").agg(F.coalesce(F.bool_or("_same"), F.lit(False)).alias("_exact"))
    return met.join(exact, "_w").where(~F.col("_exact") | F.col("_same")).select(F.col("_w").alias(name), F.coalesce("_v", "_w").alias("value"))


def matched_keywords(text: Column, wanted: dict[str, list[str]], exclude: list[str], category: Column | None = None, generic: tuple[str, ...] = ("other",), status: Column | None = None, statuses: tuple[str, ...] = ()) -> Column:
    """The wanted names that fit; empty if an excluded word starts a word of the text or no status word is in the status.

    A name that is a category fits its category, or a text of a ``generic`` category one of whose words it starts;
    without a category, names go by the text alone.
    """
    def fits(name: str, words: list[str]) -> Column:
        said = starts_word(text, words)
        return said if category is None else (category == name) | (category.isin(*generic) & said)

    found = F.array_compact(F.array(*[F.when(fits(n, words), F.lit(n)) for n, words in wanted.items()]))
    barred = starts_word(text, exclude) if exclude else F.lit(False)
    if statuses:
        inside = F.lit(False)
        for word in statuses:
            inside = inside | F.contains(F.lower(status), F.lit(word.lower()))
        barred = barred | ~F.coalesce(inside, F.lit(False))
    return F.when(barred, F.array().cast("array<string>")).otherwise(found)

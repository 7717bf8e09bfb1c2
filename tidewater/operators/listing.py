"""Listings: sponsored rows, empty names, unknown values, orders, paths of a tree, ideas and columns brought back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators import windows


def fresh_products(df: DataFrame, key: str, order: str, sponsored: str, special: str, with_sponsored: bool = False, only_specials: bool = False) -> DataFrame:
    """The first row of each key; sponsored rows go before that (and take no key), rows that are no special after it."""
    rows = df if with_sponsored else df.where(~F.coalesce(F.col(sponsored), F.lit(False)))
    first = windows.top_n(rows, [key], [order], 1, "_n").drop("_n")
    return first.where(F.coalesce(F.col(special), F.lit(False))) if only_specials else first


def named_rows(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a name, one row with the counts n_rows and n_skipped)."""
    has = F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) != ""
    return df.where(has), df.agg(F.count("*").alias("n_rows"), F.count_if(~has).alias("n_skipped"))


def unknown_values(used: DataFrame, value: str, known: list[str]) -> DataFrame:
    """(value, n): the lower-cased values in use that the known ones lack; they are used all the same."""
    rows = used.select(F.lower(F.trim(value)).alias(value)).where(F.col(value) != "")
    return rows.where(~F.col(value).isin(*known) if known else F.lit(True)).groupBy(value).agg(F.count("*").alias("n"))


def by_price(price: str, *then: str) -> list[Column]:
    """Order: the lowest price first, rows without one last."""
    return [F.asc_nulls_last(price), *[F.col(c) for c in then]]


def by_rank(value: str, order: list[str], *then: str) -> list[Column]:
    """Order: by the place of the value in a list, other values last."""
    place = F.array_position(F.lit(order), F.col(value))
    return [F.when(place > 0, place).asc_nulls_last(), *[F.col(c) for c in then]]


def chosen_order(choice: str, name: str, price: str, seq: str) -> list[Column]:
    """The order that a caller chose: relevance (as given), name_asc, name_desc, price_asc or price_desc; missing values last, ties as given."""
    orders = {"relevance": [], "name_asc": [F.asc_nulls_last(name)], "name_desc": [F.desc_nulls_last(name)], "price_asc": [F.asc_nulls_last(price)], "price_desc": [F.desc_nulls_last(price)]}
    if choice not in orders:
        raise ValueError(f"unknown order {choice}: one of {', '.join(orders)}")
    return [*orders[choice], F.asc(seq)]


def enrich_by_title(rows: DataFrame, extra: DataFrame, title: str, order: str, fields: list[str]) -> DataFrame:
    """rows with the fields of the extra row of the same title, case aside; of several the last in ``order`` counts."""
    last = extra.where(F.col(title).isNotNull()).groupBy(F.lower(title).alias("_t")).agg(*[F.max_by(F.struct(F.col(f).alias("v")), order).alias(f"_x_{f}") for f in fields])
    out = rows.withColumn("_t", F.lower(title)).join(last, "_t", "left").drop("_t")
    return out.withColumns({f: F.col(f"_x_{f}.v") for f in fields}).drop(*[f"_x_{f}" for f in fields])


def restore_columns(results: DataFrame, source: DataFrame, key: str, fields: list[str], required: list[str]) -> DataFrame:
    """results with fields of the source row of their id; rows without one of the ``required`` fields go."""
    out = results.join(source.select(key, *fields), key)
    for f in required:
        out = out.where(F.coalesce(F.col(f).cast("string"), F.lit("")) != "")
    return out


def resolve_paths(edges: DataFrame, paths: DataFrame, path: str, depth: int) -> DataFrame:
    """(path, id): the node that a slug path names in a tree of edges (parent, slug, id; null parent at the top), else null.

    Each level is one join on parent and slug, case aside; of nodes with one slug under a parent the least id counts.
    Paths deeper than ``depth`` are not found.
    """
    e = edges.groupBy(F.coalesce(F.col("parent").cast("string"), F.lit("")).alias("_p"), F.lower("slug").alias("_s")).agg(F.min("id").alias("_id"))
    want = paths.select(path).distinct().withColumn("_parts", F.filter(F.split(F.lower(path), "/"), lambda x: x != ""))
    out = want.withColumn("_at", F.when(F.size("_parts").between(1, depth), F.lit("")))
    out = out.withColumn("id", F.lit(None).cast(edges.schema["id"].dataType))
    for k in range(depth):
        step = out.withColumn("_s", F.try_element_at("_parts", F.lit(k + 1)))
        met = step.join(e, (F.col("_at") == F.col("_p")) & (step["_s"] == e["_s"]), "left").drop(e["_s"])
        more = F.size("_parts") > k
        out = met.withColumn("id", F.when(more, F.col("_id")).otherwise(F.col("id"))).withColumn("_at", F.when(more, F.col("_id").cast("string")).otherwise(F.col("_at"))).select(path, "_parts", "_at", "id")
    return out.select(path, F.when(F.size("_parts").between(1, depth), F.col("id")).alias("id"))


def idea_scores(queries: DataFrame, seeds: DataFrame, saved: DataFrame, most: int) -> DataFrame:
    """(key, query, score, position): the best ideas of queries (order, query, rising, breakout, value).

    A rising query scores its growth, a breakout 100000, a top query a tenth of its value. Of queries equal but for
    case the best counts, of equals the first; seeds (query) are none. The first 3 x most are taken, those already
    saved (query) go, and the first ``most`` of the rest stay.
    """
    key = F.lower(F.trim("query"))
    number = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    score = F.when(F.col("rising"), F.when(F.col("breakout"), F.lit(100000.0)).otherwise(number)).otherwise(number / 10)
    rows = queries.where(F.trim("query") != "").select(key.alias("key"), F.trim("query").alias("query"), score.alias("score"), "order")
    known = lambda df: df.select(key.alias("key")).distinct()
    best = rows.join(known(seeds), "key", "left_anti").groupBy("key").agg(F.max_by(F.struct("query", "score", "order"), F.struct("score", -F.col("order"))).alias("b")).select("key", "b.*")
    few = best.orderBy(F.desc("score"), "order").limit(3 * most)
    left = few.join(known(saved), "key", "left_anti").orderBy(F.desc("score"), "order").limit(most)
    return windows.ranked(left.withColumn("_one", F.lit(1)), ["_one"], [F.desc("score"), "order"], "position").select("key", "query", "score", "position")

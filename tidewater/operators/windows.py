"""Row choices by window: first, latest, ranked, top-N, running lists and gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.scratch import Scratch

Order = Sequence[Column | str]


def ranked(df: DataFrame, keys: list[str], order: Order, name: str = "rank") -> DataFrame:
    """df with the position of each row within its key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def _free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores at their ends where df has such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def numbered(df: DataFrame, order: Order, name: str = "position", keys: Sequence[str] = (), size: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """df with the position of each row, from 1, in one order over all or over each key; ``size``: a column for the rows of the key.

    Rows are dealt by ranges that Spark samples, sorted there and written with their place; the counts of the ranges
    (a row for each range and key in it) then say where each range starts. Rows equal in keys and order keep the order
    of the input, so that even one value in a third of all rows is spread over ranges. Null keys are one key; nulls
    stand where ``order`` puts them; an empty table stays empty. The result reads a table of ``scratch``.
    """
    tie, at, part, start, total = _free(df, "_tie", "_at", "_part", "_start", "_total")
    by = [*[F.asc(k) for k in keys], *order, F.asc(tie)]
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id())
    placed = (scratch or Scratch(df.sparkSession)).cut(dealt.select(*df.columns, F.shiftright(at, 33).alias(part), (F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).alias(at)))
    sizes = placed.groupBy(*keys, part).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    over = Window.partitionBy(*keys)
    before = F.sum("n").over(over.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(part).alias("_p"), (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias(start), F.sum("n").over(over).alias(total))
    same = placed[part] == starts["_p"]
    for i, k in enumerate(keys):
        same = same & placed[k].eqNullSafe(starts[f"_k{i}"])
    added = [(placed[at] + starts[start]).alias(name), *([starts[total].alias(size)] if size else [])]
    return placed.join(starts, same).select(*[placed[c] for c in df.columns if c not in (name, size)], *added)


def anchor_groups(terms: DataFrame, term: str, most: int) -> DataFrame:
    """(grp, term): the terms after the first, in their order, in groups of ``most``, each group with the first term too.

    The first term is the anchor that all groups share; null terms are no terms; a single term makes no group.
    """
    n = numbered(terms.where(F.col(term).isNotNull()).select(F.col(term).alias("term")), ["term"], "n")
    rest = n.where("n > 1").select(F.floor((F.col("n") - 2) / most).alias("grp"), "term")
    anchor = n.where("n = 1").select("term")  # one row
    return rest.union(rest.where((F.col("grp") >= 0)).select("grp").distinct().join(F.broadcast(anchor)).select("grp", "term"))


def top_n(df: DataFrame, keys: list[str], order: Order, n: int, name: str = "rank") -> DataFrame:
    """At most n rows of each key."""
    return ranked(df, keys, order, name).where(F.col(name) <= n)


def latest_revision(df: DataFrame, keys: list[str], order: Order, keep: Column) -> DataFrame:
    """The latest row of each key, if it passes: a newer revision that fails removes the key."""
    return top_n(df, keys, order, 1, "_rn").where(keep).drop("_rn")


def unique_names(df: DataFrame, name: str, order: Order, sep: str = "_") -> DataFrame:
    """df with ``unique_name``: second and later holders of a name get a numbered suffix."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("unique_name", F.when(n > 1, F.concat(F.col(name), F.lit(sep), n.cast("string"))).otherwise(F.col(name)))


def compact_ranges(df: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(keys, ranges): the distinct integers of each key as "1-3, 7"."""
    w, at = Window.partitionBy(*keys).orderBy(n), F.col(n)
    ends = df.select(*keys, n).where(at.isNotNull()).withColumn("_a", F.coalesce(at - F.lag(n).over(w) > 1, F.lit(True))).withColumn("_b", F.coalesce(F.lead(n).over(w) - at > 1, F.lit(True))).where("_a or _b")
    parts = ends.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(n, (~F.col("_a")).alias("_end")))).alias("p"))  # the first and last of each run
    again = lambda e, i: e["_end"] & (F.get("p", i - 1)[n] == e[n])  # a run of one integer that stands there twice
    text = F.transform("p", lambda e, i: F.when(again(e, i), "").otherwise(F.concat(F.when(e["_end"], "-").otherwise(", "), e[n].cast("string"))))
    return parts.select(*keys, F.substring(F.array_join(text, ""), F.lit(3), F.lit(2**31 - 1)).alias("ranges"))


def line_context(lines: DataFrame, keys: list[str], order: str, text: str, above: int = 2) -> DataFrame:
    """lines with ``context``: the lines above joined by `` / ``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-above, -1)
    return lines.withColumn("context", F.array_join(F.collect_list(text).over(w), " / "))


def line_changes(before: DataFrame, after: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, order, text, change): lines found on one side only, each counted once a page."""
    first = lambda df, flag: df.groupBy(*keys, text).agg(F.min(order).alias(order)).withColumn(flag, F.lit(True)).withColumnRenamed(order, f"{order}{flag}")
    both = first(after, "_a").join(first(before, "_b"), [*keys, text], "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed")
    return both.select(*keys, F.coalesce(f"{order}_a", f"{order}_b").alias(order), text, change.alias("change")).where("change is not null")


def changes_by_page(changes: DataFrame, keys: list[str], order: str, text: str, most: int = 60) -> DataFrame:
    """(keys, n_added, n_removed, added, removed): all are counted, the first ``most`` of each are listed."""
    n = F.row_number().over(Window.partitionBy(*keys, "change").orderBy(order, text))
    listed = lambda kind: F.transform(F.sort_array(F.collect_list(F.when((F.col("change") == kind) & (F.col("_k") <= most), F.struct("_k", text)))), lambda x: x[text]).alias(kind)
    return changes.withColumn("_k", n).groupBy(*keys).agg(F.count_if(F.col("change") == "added").alias("n_added"), F.count_if(F.col("change") == "removed").alias("n_removed"), listed("added"), listed("removed"))

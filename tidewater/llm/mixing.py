"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent and normalised. The exponent is bisected until the
mixture has a target entropy, or until no source is repeated more often than a limit; each pass tries a
grid of exponents in one aggregate over the sources, which never leave the executors. The weights are
realised as block permutations: whole epochs of a source, then the start of one more permutation, ordered
by blocks of a keyed hash, up to the source's token budget; the draws of each source are spread evenly over the
mixture, so that every block of it meets the weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import Scratch, broadcast_if, packed_rows, unpacked

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 3  # hex digits of the permutation that name a block: 4,096 blocks a source


def temperature(shares: DataFrame, budget: float, entropy: float | None = None, repeats: float | None = None, grid: int = 33, passes: int = 6) -> float:
    """The exponent in 0..1 for shares (_source, tokens): with ``entropy`` (bits) the largest that reaches
    it, with ``repeats`` the smallest that repeats no source more than so often (both: the larger). Where
    none does, the nearest end. Exponent 0 is uniform, 1 keeps the shares.
    """
    total = shares.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    p = F.log(F.col("tokens") / float(total))

    def fits(xs: list[float]) -> list[tuple[float, float]]:
        """For each exponent the entropy in bits and the highest number of epochs."""
        agg = []
        for i, x in enumerate(xs):
            w = F.exp(p * x)
            agg += [F.sum(w).alias(f"z{i}"), F.sum(w * p * x).alias(f"e{i}"), F.max(w / F.col("tokens")).alias(f"r{i}")]
        row = shares.where("tokens > 0").agg(*agg).first()
        return [((math.log(row[f"z{i}"]) - row[f"e{i}"] / row[f"z{i}"]) / math.log(2), budget * row[f"r{i}"] / row[f"z{i}"]) for i in range(len(xs))]

    def bisect(good) -> float:
        """The border between exponents for which ``good`` holds (from 0 on) and the rest."""
        lo, hi = 0.0, 1.0
        for _ in range(passes):
            xs = [lo + (hi - lo) * i / (grid - 1) for i in range(grid)]
            ok = [good(*f) for f in fits(xs)]
            if all(ok):
                return hi
            k = ok.index(False)
            if not k:
                return lo
            lo, hi = xs[k - 1], xs[k]
        return lo

    found = []
    if entropy is not None:
        found.append(bisect(lambda h, r: h >= entropy))
    if repeats is not None:
        found.append(min(1.0, bisect(lambda h, r: r > repeats + 1e-9) + (1 / (grid - 1)) ** passes))
    return max(found, default=1.0)


def _order(seed: str, epoch: Column, doc_id: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def mix(docs: DataFrame, budget_ratio: float = 1.0, entropy: float | None = None, repeats: float | None = 4.0, seed: str = "mix", doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs once for every epoch they are drawn in, plus _source, _tokens, _epoch, _order and _alpha, the last five columns.

    The budget is budget_ratio times the tokens of docs. A source with weight w gets w * budget tokens: whole
    epochs first, then the documents of one more permutation up to the first that would exceed the rest. Read the
    mixture by _order (0 to 1), ties by id: a draw stands at (epoch + its place in the epoch's permutation) / the
    source's epochs, so every stretch of the mixture holds the sources by their weights. Documents without tokens
    are drawn with whole epochs, and with the part before the cut. A null source is the empty one; repeated rows with
    one doc_id are drawn together; sources without tokens, and an empty table, give no rows. Other columns are kept;
    where one has the name of an added column, that gets an underscore more.
    """
    scratch = Scratch(docs.sparkSession)
    row = F.col("_row")
    own = packed_rows(docs).select("_row", F.coalesce(row[source].cast("string"), F.lit("")).alias("_source"), F.regexp_count(F.coalesce(row[text], F.lit("")), F.lit(WORD)).cast("long").alias("_tokens"), row[doc_id].alias("_id"))
    lean = scratch.cut(own.select("_source", "_tokens", "_id"))
    shares = scratch.cut(lean.groupBy("_source").agg(F.sum("_tokens").alias("tokens")).where("tokens > 0"))
    got = shares.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    budget = (got["t"] or 0) * budget_ratio
    alpha = temperature(shares, budget, entropy, repeats)
    w = F.exp(F.log(F.col("tokens") / float(got["t"] or 1)) * alpha)
    z = shares.agg(F.sum(w)).first()[0] or 1.0
    plan = shares.withColumn("target", F.floor(w / z * budget).cast("long")).withColumn("whole", F.floor(F.col("target") / F.col("tokens")).cast("int")).withColumn("rest", F.col("target") - F.col("whole") * F.col("tokens"))
    plan = broadcast_if(scratch.cut(plan), got["n"])

    last = lean.join(plan, "_source").withColumn("u", _order(seed, F.col("whole"), "_id")).withColumn("b", F.substring("u", 1, BLOCK))
    last = last.select("_source", "rest", "u", "b", "_tokens")
    blocks = last.groupBy("_source", "rest", "b").agg(F.sum("_tokens").alias("n"))
    before = blocks.withColumn("upto", F.sum("n").over(Window.partitionBy("_source").orderBy("b")))
    edge = scratch.cut(before.where("upto > rest").groupBy("_source").agg(F.min("b").alias("b"), F.min_by(F.col("rest") - F.col("upto") + F.col("n"), "b").alias("room")))
    inside = last.join(broadcast_if(edge, got["n"]), ["_source", "b"]).groupBy("_source", "b", "room", "u").agg(F.sum("_tokens").alias("n"))
    inside = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("_source").orderBy("u"))).where("upto > room")
    cut = scratch.cut(inside.groupBy("_source").agg(F.min("u").alias("cut")))  # the first document that does not fit

    drawn = own.join(plan.select("_source", "whole", "rest", (F.col("target") / F.col("tokens")).alias("epochs")), "_source").join(broadcast_if(cut, got["n"]), "_source", "left")
    more = F.when(F.col("cut").isNull() | (_order(seed, F.col("whole"), "_id") < F.col("cut")), 1).otherwise(0)
    drawn = drawn.withColumn("_n", F.col("whole") + F.when(F.col("rest") > 0, more).otherwise(0)).where("_n > 0")
    drawn = drawn.withColumn("_e", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_u", _order(seed, F.col("_e"), "_id"))
    place = F.conv(F.substring("_u", 1, 13), 16, 10).cast("double") / float(16**13)
    order = F.least((F.col("_e") + place) / F.col("epochs"), F.lit(1.0))
    return unpacked(drawn, docs.columns, {"_source": F.col("_source"), "_tokens": F.col("_tokens"), "_epoch": F.col("_e"), "_order": order, "_alpha": F.lit(alpha)})

"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join on the same key, which
adaptive execution splits when one node holds many edges. No edge, node or label leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch


def _state(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """edges (u, v) -> (node, label): for each node that is not the least of its component, the least.

    Null ends and loops are ignored, repeated edges count once, an empty table gives an empty result.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, path = scratch.put(e)
    state = _state(e)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), "m"), F.struct(F.col("v").alias("a"), "m"))).alias("s"))
        small = small.where("s.a <> s.m").select(F.col("s.a").alias("u"), F.col("s.m").alias("v")).distinct()
        new, new_path = scratch.put(small)
        new_state = _state(new)
        scratch.drop(path)
        same, e, path, state = new_state == state, new, new_path, new_state
        if same:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    if state[0]:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label"))

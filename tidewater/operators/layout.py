"""Tables without lines on pages of words: blocks by line gaps, columns by a sweep over segment ends, headers split, prose rejected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators.documents import joined_words, segments, word_lines
from tidewater.scratch import Scratch


def line_gaps(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gap): the median distance between the lines of a page; pages of one line have none."""
    y = segments(words, keys).groupBy(*keys, "line_no").agg(F.min("y").alias("y"))
    steps = y.withColumn("_d", F.col("y") - F.lag("y").over(Window.partitionBy(*keys).orderBy("line_no"))).where("_d > 0")
    return steps.groupBy(*keys).agg(F.median("_d").alias("gap"))


def _blocks(seg: DataFrame, keys: list[str], wide: float) -> DataFrame:
    """(keys, line_no, table_no, row_no, n_rows): runs of lines of two or more segments, no further apart than ``wide`` median gaps."""
    lines = seg.groupBy(*keys, "line_no").agg(F.count("*").alias("_n"), F.min("y").alias("y"))
    order = Window.partitionBy(*keys).orderBy("line_no")
    lines = lines.withColumn("_step", F.col("y") - F.lag("y").over(order)).withColumn("_before", F.lag("_n").over(order))
    lines = lines.withColumn("_gap", F.median(F.when(F.col("_step") > 0, F.col("_step"))).over(Window.partitionBy(*keys)))
    starts = (F.col("_n") >= 2) & (F.coalesce(F.col("_before") < 2, F.lit(True)) | (F.col("_step") > wide * F.col("_gap")))
    lines = lines.withColumn("table_no", F.sum(starts.cast("int")).over(order)).where("_n >= 2").drop("_before", "_step", "_gap")
    table = Window.partitionBy(*keys, "table_no")
    return lines.select(*keys, "line_no", "table_no", F.row_number().over(table.orderBy("line_no")).alias("row_no"), F.count("*").over(table).alias("n_rows"))


def _columns(body: DataFrame, table: list[str]) -> DataFrame:
    """(table, column_no, x0, x1, until): the ranges that segments cover, parted by the gutters that are free on all rows.

    Every segment opens a range at its left end (+1) and closes it at its right end (-1); where the running sum is back
    at zero a gutter begins. ``until`` is the middle of the gutter to the right.
    """
    ends = body.select(*table, F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")))).alias("e")).select(*table, "e.x", "e.d")
    by_x = Window.partitionBy(*table).orderBy("x", F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    swept = ends.withColumn("_open", F.sum("d").over(by_x)).withColumn("column_no", F.sum(F.when((F.col("d") == 1) & (F.sum("d").over(by_x) == 1), 1).otherwise(0)).over(by_x))
    cols = swept.groupBy(*table, "column_no").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return cols.withColumn("until", (F.col("x1") + F.lead("x0").over(Window.partitionBy(*table).orderBy("column_no"))) / 2)


def layout_tables(words: DataFrame, keys: list[str], least_rows: int = 3, fill: float = 0.5, longest: float = 60.0, wide: float = 2.5) -> DataFrame:
    """(keys, table_no, line_no, column_no, is_header, text): the cells of tables without lines on pages of words.

    A table is a block of at least ``least_rows`` lines below its first, whose segments leave a gutter free on all of
    them. The first line is the header: its words go to the column that their middle lies over, so a heading may reach
    over a gutter. Prose is no table: at least the share ``fill`` of the cells must be filled, and cells hold ``longest``
    characters on average at most. Words come as in ``word_lines``; pages without tables give no rows.
    """
    lined = Scratch(words.sparkSession).cut(word_lines(words, keys))  # read many times below; its Python runs once
    seg = joined_words(lined, keys)
    lines = _blocks(seg, keys, wide).where(F.col("n_rows") > least_rows)
    table = [*keys, "table_no"]
    body = seg.join(lines.where("row_no > 1").select(*table, "line_no"), [*keys, "line_no"])
    columns = _columns(body, table)
    heads = lined.join(lines.where("row_no = 1").select(*table, "line_no"), [*keys, "line_no"]).select(*table, "line_no", "x0", "x1", "text")
    pieces = heads.withColumn("is_header", F.lit(True)).unionByName(body.select(*table, "line_no", "x0", "x1", "text").withColumn("is_header", F.lit(False)))
    ranges = columns.groupBy(*table).agg(F.sort_array(F.collect_list(F.struct("column_no", F.coalesce("until", F.lit(float("inf"))).alias("until")))).alias("_cols"))
    place = F.filter("_cols", lambda c: F.col("_mid") < c["until"])[0]["column_no"]
    placed = pieces.join(ranges, table).withColumn("_mid", (F.col("x0") + F.col("x1")) / 2).withColumn("column_no", place).withColumn("_width", F.size("_cols"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    cells = placed.groupBy(*table, "line_no", "column_no", "is_header", "_width").agg(text.alias("text"))
    own = Window.partitionBy(*table)
    body_only = lambda c: F.when(~F.col("is_header"), c)
    first = F.row_number().over(Window.partitionBy(*table, "is_header", "line_no").orderBy("column_no")) == 1
    cells = cells.withColumn("_first", first.cast("int")).withColumn("_n", F.count(body_only(F.lit(1))).over(own)).withColumn("_rows", F.sum(body_only(F.col("_first"))).over(own)).withColumn("_long", F.avg(body_only(F.length("text"))).over(own))
    good = cells.where((F.col("_width") >= 2) & (F.col("_n") >= fill * F.col("_rows") * F.col("_width")) & (F.col("_long") <= longest))
    numbered = good.withColumn("_no", F.dense_rank().over(Window.partitionBy(*keys).orderBy("table_no")))
    return numbered.select(*keys, F.col("_no").alias("table_no"), "line_no", F.col("column_no").cast("int").alias("column_no"), "is_header", "text")

"""Documents as lines and blocks: headings, broken lines, running headers, Markdown blocks and chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Words around a page number.
PAGE_WORDS = ("page", "of")
_CUT = "\u0001"
#: What a word looks like that may end a sentence, one that only seems to (an initial, an ordinal), and one that goes on.
_ENDS = r"[.!?…]['\"”’)\]»]*$"
_SEEMS = r"^['\"“‘(\[«]*(?:\p{L}|[0-9]+)\.['\"”’)\]»]*$"
_GOES_ON = r"^['\"“‘(\[«]*\p{Ll}"


def _sentence_marks(c: Column) -> Column:
    """The words of a text between single blanks, with a mark instead of a blank after each word that ends a sentence."""
    words = F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    ends = lambda w, after: F.coalesce(w.rlike(_ENDS) & ~w.rlike(_SEEMS) & ~after.rlike(_GOES_ON), F.lit(False))
    glue = lambda ws, w, i: F.when(i + 1 == F.size(ws), "").when(ends(w, F.try_element_at(ws, i + 2)), _CUT).otherwise(" ")
    return F.transform(F.array(words), lambda ws: F.array_join(F.transform(ws, lambda w, i: F.concat(w, glue(ws, w, i))), ""))[0]


def _ends_sentence(word: str, after: str) -> bool:
    """The rule of ``sentences`` for two words."""
    begins = after.lstrip("'\"“‘([«")[:1]
    bare = word.rstrip("'\"”’)]»")
    seems = bare.endswith(".") and (len(core := bare[:-1].lstrip("'\"“‘([«")) == 1 and core.isalpha() or core.isdecimal() and core.isascii())
    return bare[-1:] in tuple(".!?…") and not seems and not begins.islower()


def is_page_number(line: Column) -> Column:
    """A line of one or two numbers of up to four digits, apart from page words, dashes and slashes."""
    rest = F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), rf"\b(?:{'|'.join(PAGE_WORDS)})\b", " "), r"[-–/\s]+", " "))
    parts = F.split(rest, " ")
    return (rest != "") & (F.size(parts) <= 2) & F.forall(parts, lambda x: F.length(x).between(1, 4) & (F.translate(x, "0123456789", "") == ""))


def lines_of(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, n, line): the lines of each text, numbered from 1."""
    return docs.select(*keys, F.posexplode(F.split(text, "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


def heading_path(lines: DataFrame, keys: list[str], order: str, level: str, text: str, depth: int = 6, sep: str = " > ") -> DataFrame:
    """lines with ``path``: the headings in effect; a heading ends those of its own and deeper levels.

    ``level`` is 1 to depth for headings, else 0 or null. A level's last heading counts if no higher
    heading followed it.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col(level) == k, F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).over(w) for k in range(1, depth + 1)]
    out = lines.withColumns({f"_h{k + 1}": c for k, c in enumerate(last)})
    parts, higher = [], F.lit(None).cast(lines.schema[order].dataType)
    for k in range(1, depth + 1):
        own = F.col(f"_h{k}")
        parts.append(F.when(own.isNotNull() & (higher.isNull() | (own["o"] > higher)), own["t"]))
        higher = F.greatest(higher, own["o"])
    return out.withColumn("path", F.concat_ws(sep, *parts)).drop(*[f"_h{k}" for k in range(1, depth + 1)])


def runs(lines: DataFrame, keys: list[str], order: str, starts: Column, name: str = "block_no") -> DataFrame:
    """lines with the number of the run they belong to; a run begins wherever ``starts`` holds."""
    w = Window.partitionBy(*keys).orderBy(order)
    return lines.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def join_broken_lines(lines: DataFrame, keys: list[str], order: str = "n", text: str = "line") -> DataFrame:
    """(keys, block_no, text): a line that starts lower-case continues the one before; a hyphen at the cut goes."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    marked = lines.withColumn("_new", first | ~F.coalesce(F.col(text), F.lit("")).rlike(r"^\p{Ll}"))
    joined = runs(marked, keys, order, F.col("_new")).groupBy(*keys, "block_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("text"))
    return joined.withColumn("text", F.replace(F.regexp_replace("text", r"(\p{Ll})-\n(\p{Ll})", "$1$2"), F.lit("\n"), F.lit(" ")))


def edge_lines(lines: DataFrame, document: str, page: str, order: str = "n", text: str = "line", edge: int = 2, longest: int = 100, large: Column | None = None) -> DataFrame:
    """(document, edge_text, n_pages, running, page_number): what stands at the top or bottom of pages.

    Digits become '#', so numbered headers fall together. A text is a running header or footer if it is
    on at least max(3, half) of the document's pages, no longer than ``longest`` and not ``large`` (over 1.15 times
    the size of the body, say); bare page numbers always are. The two edges come from line numbers and one count a page, not from a sort of all lines.
    """
    sizes = lines.groupBy(document, page).agg(F.max(order).alias("_last"))
    pages = sizes.groupBy(document).agg(F.count("*").alias("_pages"))
    at_edge = lines.join(sizes, [document, page]).where((F.col(order) <= edge) | (F.col(order) > F.col("_last") - edge))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "#"), r"\s+", " "))
    seen = at_edge.select(document, page, plain.alias("edge_text"), is_page_number(F.col(text)).alias("_number"), ((F.length(text) <= longest) & ~(F.lit(False) if large is None else F.coalesce(large, F.lit(False)))).alias("_short"))
    seen = seen.groupBy(document, page, "edge_text").agg(F.bool_or("_number").alias("_number"), F.bool_or("_short").alias("_short"))
    found = seen.groupBy(document, "edge_text").agg(F.count("*").alias("n_pages"), F.bool_or("_number").alias("page_number"), F.bool_or("_short").alias("_short")).join(pages, document)
    running = F.col("_short") & (F.col("n_pages") >= F.greatest(F.lit(3), F.ceil(F.col("_pages") / 2)))
    return found.select(document, "edge_text", "n_pages", (running | F.col("page_number")).alias("running"), "page_number")


def drop_running_lines(lines: DataFrame, document: str, page: str, order: str = "n", text: str = "line") -> DataFrame:
    """lines without the running headers, footers and page numbers at the edges of pages."""
    drop = edge_lines(lines, document, page, order, text).where("running").select(document, F.col("edge_text").alias("_e"), F.lit(True).alias("_hit"))
    sizes = lines.groupBy(document, page).agg(F.max(order).alias("_last"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "#"), r"\s+", " "))
    marked = lines.join(sizes, [document, page]).withColumn("_e", plain).join(drop, [document, "_e"], "left")
    gone = F.col("_hit").isNotNull() & ((F.col(order) <= 2) | (F.col(order) > F.col("_last") - 2)) & (F.length(text) <= 100)
    return marked.where(~gone).select(lines.columns)


def sentences(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, n, sentence): a word with a stop at its end, closing quotes aside, ends a sentence before one in no small letter.

    Initials ("J.") and numbers with a stop ("3.") end none. Words stand between single blanks; a text without words is
    one empty sentence, a null text has none.
    """
    return docs.select(*keys, F.posexplode(F.split(_sentence_marks(F.col(text)), _CUT)).alias("n", "sentence")).withColumn("n", F.col("n") + 1)


def md_blocks(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, block_no, md, level, is_table): blocks cut at blank lines; fences whole, headings alone.

    Fences are found by the parity of the fence lines so far; block_no rises but may leave gaps.
    """
    line = lines_of(docs.withColumn(text, F.regexp_replace(text, r"[ \t\r]+(\n|$)", "$1")), keys, text)
    w = Window.partitionBy(*keys).orderBy("n")
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    parity = F.sum(F.when(fence, 1).otherwise(0)).over(w)
    inside = (parity - F.when(fence, 1).otherwise(0)) % 2 == 1
    line = line.withColumn("_in", inside | fence).withColumn("_level", F.when(~F.col("_in"), F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))).otherwise(0))
    line = line.withColumn("_blank", ~F.col("_in") & (F.trim("line") == ""))
    after = F.lag(F.col("_blank") | (F.col("_level") > 0), 1, True).over(w)
    line = line.withColumn("_new", F.col("_blank") | (F.col("_level") > 0) | after)
    line = runs(line, keys, "n", F.col("_new")).where(~F.col("_blank"))
    block = line.groupBy(*keys, "block_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("md"), F.max("_level").alias("level"))
    row = F.split("md", "\n")
    return block.withColumn("is_table", F.coalesce(_is_row(row[0]) & _is_rule(F.try_element_at(row, F.lit(2))), F.lit(False)))


def _is_row(line: Column) -> Column:
    """A line between two bars."""
    t = F.trim(line)
    return (F.length(t) > 1) & F.startswith(t, F.lit("|")) & F.endswith(t, F.lit("|"))


def _is_rule(line: Column) -> Column:
    """The line under a table's header: bars and dashes, perhaps colons and blanks."""
    return F.contains(line, F.lit("|")) & F.contains(line, F.lit("-")) & (F.translate(line, "|:- \t", "") == "")


def _block_text(line: Column) -> Column:
    """A line by its kind: null for fences and table rules, cells as "a | b", else without the marks that begin it."""
    t = F.trim(line)
    cells = F.array_join(F.transform(F.split(F.substring(t, F.lit(2), F.length(t) - 2), r"(?<!\\)\|"), lambda x: F.trim(x)), " | ")
    bare = F.regexp_replace(line, r"^\s*(?:>\s?)+", "")
    plain = F.regexp_replace(bare, r"^#{1,6}\s+", "")
    indent = F.regexp_extract(plain, r"^([ \t]*)[*+-][ \t]", 1)
    listed = F.when(plain.rlike(r"^[ \t]*[*+-][ \t]"), F.concat(indent, F.lit("- "), F.ltrim(F.substring(plain, F.length(indent) + 2, F.lit(1 << 30))))).otherwise(plain)
    return F.when(F.startswith(t, F.lit("```")) | F.startswith(t, F.lit("~~~")) | _is_rule(line), None).when(_is_row(line), cells).otherwise(F.rtrim(listed))


def markdown_to_text(c: Column) -> Column:
    """Readable text of Markdown, line by line, then the marks inside lines.

    Comments, fences, table rules, heading and quote marks, emphasis, code ticks, backslashes of escapes and link
    targets go; bullets become "- ", cells stay as "a | b", several blank lines become one.
    """
    lines = F.array_compact(F.transform(F.split(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), "\n"), _block_text))
    out = F.regexp_replace(F.array_join(lines, "\n"), r"!?\[([^\]\n]*)\]\([^)\n]*\)", "$1")
    for mark in (r"\*\*", "__", r"\*", "`"):
        out = F.regexp_replace(out, rf"(?<!\\){mark}(\S|\S[^\n]*?[^\s\\]){mark}", "$1")
    out = F.regexp_replace(out, r"\\([!-/:-@\[-`{-~])", "$1")
    return F.trim(F.regexp_replace(out, r"\n(?:[ \t]*\n){2,}", "\n\n"), F.lit(" \n"))


def _pieces(block: str, most: int, table: bool) -> Iterator[str]:
    """A block in pieces of at most ``most`` characters: table rows under their header, else sentences, else words."""
    head, glue, units = "", " ", []
    if table:
        rows = block.split("\n")
        head, glue, units = "\n".join(rows[:2]) + "\n", "\n", rows[2:] or rows[:1]
    else:
        start = 0
        words = [(m.start(), m.group()) for m in re.finditer(r"\S+", block)]
        for (at, word), (then, after) in zip(words, [*words[1:], (len(block), "A")]):
            if then == len(block) or _ends_sentence(word, after):
                sentence = block[start : at + len(word)]
                units += [sentence] if len(sentence) <= most else sentence.split()
                start = then
    room, held = max(1, most - len(head)), ""
    for unit in (u[i : i + room] for u in units for i in range(0, max(1, len(u)), room)):
        if held and len(held) + len(glue) + len(unit) > room:
            yield head + held
            held = unit
        else:
            held = held + glue + unit if held else unit
    if held:
        yield head + held


def _pack(blocks: list[tuple[str, int, bool, str]], size: int, overlap: int, by_heading: int) -> list[tuple[str, str]]:
    """(md, path) chunks of the blocks of one document, in order; held headings go with the text after them."""
    out, held, path, body = [], [], "", False

    def used() -> int:
        return sum(len(h) + 2 for h in held)

    def close(table: bool) -> None:
        nonlocal held, body
        out.append(("\n\n".join(held), path))
        last = held[-1]
        if not overlap or table:
            held = []
        elif len(last) <= overlap:
            held = [last]
        else:
            held = last[-overlap - 1 :].split(None, 1)[1:]
        body = False

    for md, level, table, where in blocks:
        if level and by_heading and level <= by_heading and body:
            close(True)
        level = 0 if len(md) > size // 2 else level
        rest = [md]
        while rest:
            piece = rest.pop(0)
            if used() + len(piece) > size and (body or used() > size - 25):
                body, path = True, path or where
                close(table)
            if used() + len(piece) > size:
                room = size - max(used(), overlap + 2 if overlap else 0)
                piece, *more = _pieces(piece, max(20, room), table)
                rest = more + rest
            held.append(piece)
            if not level:
                path = path if body else where
                body = True
    if body:
        close(True)
    return out


def chunk_rows(blocks: list[tuple[str, int, bool, str]], mode: str = "fixed", size: int = 800, overlap: int = 0, heading_level: int = 3) -> list[tuple[str, str]]:
    """(md, path) chunks of one document's blocks (md, level, is_table, path), in order."""
    size = max(50, size)
    if mode == "none":
        first = next((path for _, level, _, path in blocks if not level), None)
        return [("\n\n".join(b[0] for b in blocks), first)] if blocks else []
    return _pack(blocks, size, max(0, min(overlap, size // 2)), heading_level if mode == "heading" else 0)


def pathed_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block_no, md, level, is_table, path): the blocks of ``md_blocks`` with the headings above them."""
    titled = blocks.withColumn("_title", F.regexp_replace("md", r"^#{1,6}\s+", ""))
    return heading_path(titled, keys, "block_no", "level", "_title").select(*keys, "block_no", "md", F.coalesce("level", F.lit(0)).alias("level"), "is_table", "path")


def chunk_blocks(blocks: DataFrame, keys: list[str], mode: str = "fixed", size: int = 800, overlap: int = 0, heading_level: int = 3) -> DataFrame:
    """(keys, chunk_no, md, path): chunks of the blocks of ``md_blocks``; mode none, heading or fixed.

    ``size`` is at least 50 characters and ``overlap`` at most half of it. Chunks end between blocks; a
    longer block is cut by sentences and words, a table by rows under its header. Chunks of headings alone
    are not made. A document's blocks meet in one task, so bound the length of texts before.
    """
    pathed = pathed_blocks(blocks, keys)
    if mode == "none":
        return pathed.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "md"))), lambda x: x["md"]), "\n\n").alias("md"), F.min_by("path", F.when(F.col("level") == 0, F.col("block_no"))).alias("path")).withColumn("chunk_no", F.lit(1)).select(*keys, "chunk_no", "md", "path")
    types = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted, so a document ends where its key changes; only its own blocks are held."""
        names, now, blocks = [*keys, "chunk_no", "md", "path"], None, []

        def rows_of(made: list) -> pd.DataFrame:
            return pd.DataFrame({n: pd.Series([r[i] for r in made], dtype=object) for i, n in enumerate(names)})

        def close() -> list:
            return [(*now, i + 1, md, path) for i, (md, path) in enumerate(chunk_rows(blocks, mode, size, overlap, heading_level))] if blocks else []

        for pdf in batches:
            made = []
            for *key, md, level, table, path in zip(*[pdf[c] for c in [*keys, "md", "level", "is_table", "path"]]):
                if key != now:
                    made += close()
                    now, blocks = key, []
                blocks.append((md, int(level or 0), bool(table), path))
            if made:
                yield rows_of(made)
        if made := close():
            yield rows_of(made)

    ordered = pathed.repartition(*keys).sortWithinPartitions(*keys, "block_no")
    return ordered.mapInPandas(pack, f"{types}, chunk_no int, md string, path string")


def body_size(words: DataFrame, keys: list[str], size: str = "size", text: str = "text") -> DataFrame:
    """(keys, body_size, heading_sizes): the size of most characters, and the four largest at least 1.15 times it."""
    chars = words.groupBy(*keys, F.col(size).alias("_s")).agg(F.sum(F.length(text)).alias("_c"))
    every = chars.groupBy(*keys).agg(F.max_by("_s", F.struct("_c", "_s")).alias("body_size"), F.reverse(F.sort_array(F.collect_set("_s"))).alias("_all"))
    return every.select(*keys, "body_size", F.slice(F.filter("_all", lambda s: s >= F.col("body_size") * 1.15), 1, 4).alias("heading_sizes"))


def word_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """words (keys, x0, x1, y, size, text) with ``line_no`` and ``segment_no``.

    In order of y, a word begins a line where it stands over max(1.5, 0.35 of the size) from the first word of the
    line; within a line a gap of over 0.9 of the size starts a segment. Words come sorted by page, so a task keeps
    only the first word of the line at hand.
    """
    schema = T.StructType([*words.schema.fields, T.StructField("line_no", T.LongType())])

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, first, line = None, 0.0, 0
        for pdf in batches:
            numbers = []
            for *key, y, size in zip(*[pdf[c] for c in (*keys, "y", "size")]):
                if key != now:
                    now, first, line = key, y, 1
                elif abs(y - first) > max(1.5, 0.35 * size):
                    first, line = y, line + 1
                numbers.append(line)
            yield pdf.assign(line_no=numbers)

    lined = words.repartition(*keys).sortWithinPartitions(*keys, "y", "x0").mapInPandas(number, schema)
    by_x = Window.partitionBy(*keys, "line_no").orderBy("x0", "x1")
    gap = F.coalesce(F.col("x0") - F.lag("x1").over(by_x) > F.col("size") * 0.9, F.lit(True))
    return lined.withColumn("_g", gap).withColumn("segment_no", F.sum(F.col("_g").cast("int")).over(by_x)).drop("_g")


def segments(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, segment_no, x0, x1, y, size, text): the words of ``word_lines`` that stand together."""
    return joined_words(word_lines(words, keys), keys)


def joined_words(lined: DataFrame, keys: list[str]) -> DataFrame:
    """``segments`` of words that went through ``word_lines``."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    return lined.groupBy(*keys, "line_no", "segment_no").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y").alias("y"), F.max("size").alias("size"), text.alias("text"))


def line_tables(words: DataFrame, keys: list[str], least_rows: int = 3) -> DataFrame:
    """(keys, table_no, line_no, column_no, text): cells of borderless tables.

    A table is a run of at least ``least_rows`` lines of two or more segments. Its columns are the
    islands left when the x-ranges of all its segments are merged, so gutters free on every row part them.
    """
    seg = segments(words, keys)
    lines = seg.groupBy(*keys, "line_no").agg(F.count("*").alias("_n")).where("_n >= 2")
    at = Window.partitionBy(*keys).orderBy("line_no")
    lines = lines.withColumn("_g", F.col("line_no") - F.row_number().over(at))
    kept = lines.groupBy(*keys, "_g").agg(F.count("*").alias("_c"), F.min("line_no").alias("_a"), F.max("line_no").alias("_b")).where(F.col("_c") >= least_rows)
    kept = kept.withColumn("table_no", F.row_number().over(Window.partitionBy(*keys).orderBy("_a")))
    cells = seg.join(lines.select(*keys, "line_no", "_g"), [*keys, "line_no"]).join(kept.select(*keys, "_g", "table_no"), [*keys, "_g"])
    by_x = Window.partitionBy(*keys, "table_no").orderBy("x0", "x1", "line_no")
    reach = F.max("x1").over(by_x.rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("_new", F.coalesce(F.col("x0") > reach, F.lit(True))).withColumn("column_no", F.sum(F.col("_new").cast("int")).over(by_x))
    return cells.groupBy(*keys, "table_no", "line_no", "column_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("text"))


def carry_roles(tables: DataFrame, document: str, order: str, roles: str, width: str) -> DataFrame:
    """tables with the roles of the last header table where a table without any has the same width."""
    w = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(roles).isNotNull(), F.struct(F.col(roles).alias("r"), F.col(width).alias("w"))), True).over(w)
    return tables.withColumn("_l", last).withColumn(roles, F.coalesce(F.col(roles), F.when(F.col("_l.w") == F.col(width), F.col("_l.r")))).drop("_l")


def join_descriptions(rows: DataFrame, keys: list[str], order: str, has_numbers: Column, text: str) -> DataFrame:
    """(keys, item_no, text): a row without numbers continues the description of the item above it."""
    marked = runs(rows.withColumn("_has", has_numbers), keys, order, F.col("_has"), "item_no")
    return marked.groupBy(*keys, "item_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias(text))


def token_count(text: Column, model: str) -> Column:
    """Tokens of a text by the sentencepiece model at the path ``model``, which every worker must be able to read; null has none."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        for texts in batches:
            yield pd.Series([len(x) for x in pieces.encode(texts.fillna("").tolist(), num_threads=1)])

    return counted(text)

"""Registered queries over the lines and blocks of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import markdown, tables
from tidewater.operators import documents as dc
from tidewater.operators import layout, windows
from tidewater.plans.records import _dealt, _t
from tidewater.plans.registry import registry

QUERIES, ORACLE, query = registry()


_LINES = "with l as (select doc_id, source, generate_subscripts(a, 1)::int as n, unnest(a) as line from (select doc_id, source, string_split(text, chr(10)) as a from documents))"


def _lines(spark, d):
    return dc.lines_of(_t(spark, d, "documents"), ["doc_id", "source"])


@query(_LINES + """, s as (select doc_id, max(n) as last from l group by 1), p as (select source, count(*) as pages from (select distinct source, doc_id from l) group by 1),
e as (select source, doc_id, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) as edge_text, bool_or(length(line) <= 100) as short from l join s using (doc_id) where n <= 2 or n > last - 2 group by all),
f as (select source, edge_text, count(*) as n_pages, bool_or(short) as short from e group by 1, 2)
select source, md5(edge_text) as edge, n_pages, short and n_pages >= greatest(3, ceil(pages / 2)) as running from f join p using (source)""")
def boilerplate_lines(spark, d):
    edges = dc.edge_lines(_lines(spark, d), "source", "doc_id")
    return edges.select("source", F.md5("edge_text").alias("edge"), "n_pages", (F.col("running") & ~F.col("page_number")).alias("running"))


@query(_LINES + """, h as (select doc_id, n, line, case when length(line) between 1 and 60 then 1 + length(line) % 3 else 0 end as level from l),
m as (select *, max(case when level = 1 then n end) over w as n1, max(case when level = 2 then n end) over w as n2, max(case when level = 3 then n end) over w as n3,
 arg_max(line, case when level = 1 then n end) over w as t1, arg_max(line, case when level = 2 then n end) over w as t2, arg_max(line, case when level = 3 then n end) over w as t3 from h window w as (partition by doc_id order by n rows between unbounded preceding and current row))
select doc_id, n, concat_ws(' > ', t1, case when n1 is null or n2 > n1 then t2 end, case when (n1 is null or n3 > n1) and (n2 is null or n3 > n2) then t3 end) as path from m""")
def heading_path(spark, d):
    level = F.when(F.length("line").between(1, 60), 1 + F.length("line") % 3).otherwise(0)
    return dc.heading_path(_lines(spark, d).withColumn("level", level), ["doc_id"], "n", "level", "line", 3).select("doc_id", "n", "path")


@query(_LINES + """, b as (select doc_id, n, line, sum(case when n = 1 or not regexp_matches(line, '^\\p{Ll}') then 1 else 0 end) over (partition by doc_id order by n)::bigint as block_no from l)
select doc_id, block_no, replace(regexp_replace(string_agg(line, chr(10) order by n), '(\\p{Ll})-\\n(\\p{Ll})', '\\1\\2', 'g'), chr(10), ' ') as text from b group by 1, 2""")
def join_broken_lines(spark, d):
    return dc.join_broken_lines(_lines(spark, d), ["doc_id"])


@query(r"""with w as (select doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as ws from documents where text is not null),
s as (select doc_id, array_to_string(list_transform(ws, lambda w, i: w || case when i = len(ws) then '' when regexp_matches(w, '[.!?…][''"”’)\]»]*$') and not regexp_matches(w, '^[''"“‘(\[«]*(\p{L}|[0-9]+)\.[''"”’)\]»]*$') and not regexp_matches(ws[i + 1], '^[''"“‘(\[«]*\p{Ll}') then chr(1) else ' ' end), '') as t from w)
select doc_id, generate_subscripts(string_split(t, chr(1)), 1)::int as n, unnest(string_split(t, chr(1))) as sentence from s""")
def sentence_split(spark, d):
    return dc.sentences(_t(spark, d, "documents"), ["doc_id"])


@query(r"""with d as (select doc_id, source, regexp_replace(replace(replace(text, '*', ''), '`', ''), '(?s)<!--.*?-->', '', 'g') as t from documents),
l as (select doc_id, source, list_transform(string_split(t, chr(10)), lambda x: rtrim(regexp_replace(regexp_replace(regexp_replace(x, '^\s*(?:>\s?)+', ''), '^#{1,6}\s+', ''), '^([ \t]*)[+-][ \t]+', '\1- '), ' ')) as ls from d),
k as (select doc_id, source, array_to_string(list_filter(ls, lambda x: not (trim(x) like '~~~%' or (contains(x, '|') and contains(x, '-') and translate(x, '|:- ' || chr(9), '') = ''))), chr(10)) as body from l),
m as (select doc_id, 'Title of ' || doc_id || chr(10) || 'quoted words' || chr(10) || 'a | b' || chr(10) || source || ' | x' || chr(10) || '- link alt' || chr(10) || body || chr(10) || chr(10) || chr(10) || 'end #1' as t from k),
i as (select doc_id, regexp_replace(regexp_replace(regexp_replace(t, '!?\[([^\]\n]*)\]\([^)\n]*\)', '\1', 'g'), '__([^\s]|[^\s][^\n]*?[^\s\\])__', '\1', 'g'), '\\([!-/:-@\[-`{-~])', '\1', 'g') as t from m)
select doc_id, trim(regexp_replace(t, '\n([ \t]*\n){2,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) as plain from i""")
def markdown_to_text(spark, d):
    """Documents under a head of Markdown of every kind, read as text."""
    c = F.concat
    body = F.replace(F.replace("text", F.lit("*"), F.lit("")), F.lit("`"), F.lit(""))
    head = c(F.lit("# Title of "), F.col("doc_id").cast("string"), F.lit("\n> *quoted* **words**\n| a | b |\n|---|:-:|\n| "), "source", F.lit(" | x |\n* [link](http://x.y/z) ![alt](i.png) <!-- gone -->\n```\n"))
    marked = c(head, body, F.lit("\n~~~\n\n\nend \\#1"))
    return _t(spark, d, "documents").select("doc_id", dc.markdown_to_text(marked).alias("plain"))


def _blocks(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return dc.md_blocks(docs, ["doc_id"])


@query(r"""with l as (select doc_id, generate_subscripts(a, 1)::bigint as n, unnest(a) as line from (select doc_id, string_split(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '[ \t\r]+(\n|$)', '\1', 'g'), chr(10)) as a from documents)),
f as (select *, regexp_matches(line, '^\s*(```|~~~)') as fence, sum(case when regexp_matches(line, '^\s*(```|~~~)') then 1 else 0 end) over (partition by doc_id order by n) as fences from l),
g as (select *, fence or fences % 2 = 1 as inside from f), h as (select *, case when inside then 0 else length(regexp_extract(line, '^(#{1,6})\s', 1)) end as level, not inside and trim(line) = '' as blank from g),
i as (select *, sum(case when blank or level > 0 or after then 1 else 0 end) over (partition by doc_id order by n) as block_no from (select *, lag(blank or level > 0, 1, true) over (partition by doc_id order by n) as after from h))
select doc_id, row_number() over (partition by doc_id order by block_no)::int as block, md, level from (select doc_id, block_no, string_agg(line, chr(10) order by n) as md, max(level)::int as level from i where not blank group by 1, 2)""")
def md_blocks(spark, d):
    return windows.ranked(_blocks(spark, d), ["doc_id"], ["block_no"], "block").select("doc_id", "block", "md", "level")


@query(None)
def chunk_blocks(spark, d):
    """Chunks of at most 800 characters, 100 of them from the chunk before."""
    return dc.chunk_blocks(_blocks(spark, d), ["doc_id"], "fixed", 800, 100).select("doc_id", "chunk_no", "md", "path")


_CHANGED = """, b as (select doc_id, line, min(n) as n from l where n % 7 <> 0 group by 1, 2), a as (select doc_id, line, min(n) as n from l where n % 5 <> 0 group by 1, 2),
c as (select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.line, b.line) as line, coalesce(a.n, b.n) as n, b.line is null as added, a.line is null as removed from a full join b on a.doc_id = b.doc_id and a.line = b.line),
r as (select doc_id, added, md5(line) as h, row_number() over (partition by doc_id, added order by n) as k from c where added or removed)"""


@query(_LINES + _CHANGED + " select doc_id, count_if(added) as n_added, count_if(not added) as n_removed, coalesce(string_agg(h, ',' order by k) filter (added and k <= 60), '') as added, coalesce(string_agg(h, ',' order by k) filter (not added and k <= 60), '') as removed from r group by 1")
def changes_by_page(spark, d):
    lines = _lines(spark, d)
    changes = windows.line_changes(lines.where("n % 7 <> 0"), lines.where("n % 5 <> 0"), ["doc_id"], "n", "line")
    grouped = windows.changes_by_page(changes.withColumn("line", F.md5("line")), ["doc_id"], "n", "line", 60)
    return grouped.select("doc_id", "n_added", "n_removed", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query(None)
def html_to_markdown(spark, d):
    return _t(spark, d, "pages").select("page_id", markdown.html_to_markdown(F.col("html")).alias("markdown"))


@query(r"""select page_id, len(list_distinct(list_transform(regexp_extract_all(html, '<li><a[^>]*href="([^"]*)"', 1), lambda x: lower(x))))::int as n_links from pages""")
def page_links(spark, d):
    links = F.regexp_extract_all("html", F.lit('<li><a[^>]*href="([^"]*)"'), F.lit(1))
    return _t(spark, d, "pages").select("page_id", F.size(F.array_distinct(F.transform(links, F.lower))).alias("n_links"))


@query("""select p_partkey, p_name as title, '# ' || p_name || chr(10) || chr(10) || '- ' || p_brand || chr(10) || '  3. ' || p_type || chr(10) || '     - size ' || p_size || chr(10) || '     - [mail](mailto:a@b.c)' || chr(10) || '  4. **last**' || chr(10) || '- code' || chr(10) || '  ```' || chr(10) || '  ' || p_type || '  x' || chr(10) || chr(10) || '  y' || chr(10) || '  ```' || chr(10) || chr(10)
 || '> said' || chr(10) || '>' || chr(10) || '> > ' || p_brand || chr(10) || chr(10) || '| h |  |' || chr(10) || '| --- | --- |' || chr(10) || '| a\\|b | ' || p_size || ' |' as markdown from part""")
def nested_markdown(spark, d):
    """Pages with lists three deep, numbered from three, code in an item, quotes in quotes and a wide header cell."""
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    col, size = F.col, F.col("p_size").cast("string")
    items = c("<ul><li>", col("p_brand"), "<ol start='3'><li>", col("p_type"), "<ul><li>size ", size, "<li><a href='mailto:a@b.c'>mail</a></ul><li><b>last</b></ol></li><li>code<pre><code>", col("p_type"), "  x\n\ny</code></pre></ul>")
    html = c("<html><head><title> ", col("p_name"), " </title></head><body><nav>menu</nav><h1>", col("p_name"), "</h1>", items, "<blockquote>said<blockquote>", col("p_brand"), "</blockquote></blockquote><table><tr><th colspan=2>h</th></tr><tr><td>a|b</td><td>", size, "</td></tr></table><div aria-hidden='true'>no</div></body></html>")
    return _dealt(_t(spark, d, "part"), "p_partkey").select("p_partkey", markdown.page_markdown(html).alias("m")).select("p_partkey", "m.title", "m.markdown")


@query(None)
def chunk_document_sql(spark, d):
    """The chunks of ``chunk_blocks`` by the SQL table function."""
    tables.register(spark)
    dc.pathed_blocks(_blocks(spark, d), ["doc_id"]).createOrReplaceTempView("tidewater_blocks")
    return spark.sql("select * from chunk_document(table(tidewater_blocks), 'fixed', 400, 40)")


@query(r"""with w as (select doc_id, n_chars, string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ') as ws from documents)
select doc_id, 1 as table_no, 2::bigint as line_no, c[1]::int as column_no, true as is_header, c[2] as text from w, (select unnest([['1', 'Name'], ['2', 'Value of it'], ['3', 'Count']]) as c)
union all select doc_id, 1, (2 + r)::bigint, 1, false, 'r' || r from w, (select unnest(range(1, 5)) as r)
union all select doc_id, 1, (2 + r)::bigint, 2, false, case when coalesce(ws[r], '') = '' then '-' else ws[r] end from w, (select unnest(range(1, 5)) as r)
union all select doc_id, 1, (2 + r)::bigint, 3, false, (n_chars + r)::varchar from w, (select unnest(range(1, 4)) as r)""")
def layout_tables(spark, d):
    """Pages with a title, a table whose heading reaches over a gutter and that lacks a cell, and prose set with wide gaps."""
    word = lambda x0, x1, y, text, size=10.0: F.struct(F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), F.lit(float(y)).alias("y"), F.lit(size).alias("size"), (F.lit(text) if isinstance(text, str) else text).alias("text"))
    ws = F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), " ")
    value = lambda r: F.coalesce(F.nullif(F.get(ws, F.lit(r - 1)), F.lit("")), F.lit("-"))
    title = [word(0, 120, 10, F.concat(F.lit("T"), F.col("doc_id").cast("string")), 14.0), word(124, 180, 10, "paper", 14.0)]
    head = [word(0, 30, 40, "Name"), word(100, 125, 40, "Value"), word(128, 138, 40, "of"), word(141, 147, 40, "it"), word(155, 205, 40, "Count")]
    rows = [w for r in range(1, 5) for w in (word(0, 20, 40 + 14 * r, f"r{r}"), word(100, 140, 40 + 14 * r, value(r)), *([word(200, 230, 40 + 14 * r, (F.col("n_chars") + r).cast("string"))] if r < 4 else []))]
    prose = [w for i in range(5) for w in (word(0, 60 + 40 * i, 150 + 14 * i, "some prose that runs on"), word(80 + 40 * i, 260, 150 + 14 * i, "and on"))]
    pages_ = _t(spark, d, "documents").select("doc_id", F.explode(F.array(*title, *head, *rows, *prose)).alias("w"))
    return layout.layout_tables(pages_.select("doc_id", "w.*"), ["doc_id"])

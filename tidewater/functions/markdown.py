"""HTML to Markdown, and tables of either."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements and roles that are no content, and texts of images that say nothing.
CHROME = {"script", "style", "noscript", "template", "iframe", "svg", "canvas", "form", "button", "nav", "footer", "header", "aside"}
CHROME_ROLES = {"navigation", "banner", "contentinfo"}
DULL_IMAGE = re.compile(r"(?:image|img|picture|photo)\d*", re.IGNORECASE)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {f"h{i}": "#" * i + " " for i in range(1, 7)}
BLOCKS = {"p", "div", "section", "article", "main", "figure", "figcaption", "body", "html", "dl", "dd", "dt", "address", "details", "summary"}
ENDS_P = BLOCKS | {"ul", "ol", "pre", "blockquote", "table"} | HEADINGS.keys()  # what an open paragraph ends at
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "del": "~~", "s": "~~"}
#: What an element ends by beginning, up to the container it stands in.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
LEAST_MAIN = 200  # characters of text from which main or article stands for the page


class _Node:
    """An open element: what has been written in it, its items or rows, and the characters of its text."""

    __slots__ = ("attrs", "chars", "parts", "rows", "start", "tag")

    def __init__(self, tag: str, attrs: dict, start: int):
        self.tag, self.attrs, self.start, self.parts, self.rows, self.chars = tag, attrs, start, [], [], 0


def _tidy(text: str) -> str:
    """Lines without blanks at their ends, at most one empty line in a row, none at either end; fenced code as it is."""
    out, fenced = [], False
    for line in text.split("\n"):
        fence = line.lstrip("> \t").startswith("```")
        if not fenced:
            line = line.rstrip()
            if not line and (not out or not out[-1]):
                continue
        out.append(line)
        fenced ^= fence
    while out and not out[-1].strip():
        out.pop()
    return "\n".join(out)


def _indented(marker: str, text: str) -> str:
    """An item: its first line behind the marker, the others as far in; empty lines go outside fenced code."""
    lines, fenced = [], False
    for line in _tidy(text).strip("\n").split("\n"):
        if line or fenced:
            lines.append(line)
        fenced ^= line.lstrip("> \t").startswith("```")
    pad = " " * len(marker)
    return "\n".join((marker if i == 0 else pad if line else "") + (line.lstrip() if i == 0 else line) for i, line in enumerate(lines))


class _Writer(HTMLParser):
    """Markdown of one page, built from the innermost element outwards over a stack of open ones."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.seen, self.skipped, self.main, self.titles, self.h1 = [_Node("", {}, 0)], 0, [], None, [], ""

    def put(self, text: str) -> None:
        self.stack[-1].parts.append(text)

    def within(self, *tags: str) -> bool:
        return any(n.tag in tags for n in self.stack)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if self.skipped or tag in CHROME or a.get("role") in CHROME_ROLES or a.get("aria-hidden") == "true":
            if tag not in VOID:
                self.skipped.append(tag)
            return
        if tag == "br":
            self.put("\n")
        elif tag == "hr":
            self.put("\n\n* * *\n\n")
        elif tag == "img":
            alt = a.get("alt", "").strip()
            self.put(f"[Image: {alt}]" if alt and not DULL_IMAGE.fullmatch(alt) else "")
        if tag in VOID:
            return
        ended, until = ENDS.get(tag, ((), ()))
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in until:
                break
            if self.stack[i].tag in ended:
                self.ended(i)
        if tag in ENDS_P and self.stack[-1].tag == "p":
            self.ended(len(self.stack) - 1)
        self.seen += 1
        self.stack.append(_Node(tag, a, self.seen))

    def handle_endtag(self, tag):
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self.ended(i)
                return

    def ended(self, at: int) -> None:
        while len(self.stack) > at:
            node = self.stack.pop()
            text = self.written(node)
            if node.tag in ("main", "article") or node.attrs.get("role") == "main":
                if node.chars > LEAST_MAIN and (self.main is None or node.start < self.main[0]):
                    self.main = (node.start, text)
            self.stack[-1].parts.append(text)
            self.stack[-1].chars += node.chars

    def written(self, node: _Node) -> str:
        text, tag = "".join(node.parts), node.tag
        if tag == "title":
            self.titles.append(" ".join(text.split()))
            return ""
        if tag == "head":
            return ""
        if tag in HEADINGS:
            line = " ".join(text.split())
            self.h1 = self.h1 or (line if tag == "h1" else "")
            return f"\n\n{HEADINGS[tag]}{line}\n\n" if line else ""
        if tag in MARKS and not self.within("pre"):
            core = text.strip()
            mark = MARKS[tag]
            return f"{text[: len(text) - len(text.lstrip())]}{mark}{core}{mark}{text[len(text.rstrip()) :]}" if core else text
        if tag == "a":
            href = node.attrs.get("href", "").strip()
            label = text.strip()
            return text.replace(label, f"[{label}]({href})", 1) if label and re.match(r"(?i)https?:|mailto:", href) else text
        if tag == "pre":
            return "\n\n```\n" + text.strip("\n") + "\n```\n\n"
        if tag == "blockquote":
            lines = _tidy(text).strip("\n").split("\n")
            return "\n\n" + "\n".join(f"> {x}".rstrip() for x in lines) + "\n\n" if any(lines) else ""
        if tag == "li":
            parent = self.stack[-1]
            ordered = parent.tag == "ol"
            first = parent.attrs.get("start", "1")
            marker = f"{int(first) + len(parent.rows) if first.isdigit() else len(parent.rows) + 1}. " if ordered else "- "
            parent.rows.append(_indented(marker, text))
            return ""
        if tag in ("ul", "ol"):
            items = [r for r in node.rows if r.strip()]
            return "\n\n" + "\n".join(items) + "\n\n" + text.strip() if items else text
        if tag in ("td", "th"):
            cell = " ".join(_tidy(text).split()).replace("|", "\\|")
            span = node.attrs.get("colspan", "")
            self.stack[-1].rows += [cell] + [""] * (min(int(span), 20) - 1 if span.isdigit() and span != "0" else 0)
            return ""
        if tag == "tr":
            table = next((n for n in reversed(self.stack) if n.tag == "table"), None)
            if table is not None and node.rows:
                table.rows.append(node.rows)
            return ""
        if tag == "table":
            width = max(map(len, node.rows), default=0)
            rows = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in node.rows]
            return "\n\n" + "\n".join([*rows[:1], "|" + " --- |" * width, *rows[1:]]) + "\n\n" if rows else text
        return f"\n\n{text.strip(' ')}\n\n" if tag in BLOCKS else text

    def handle_data(self, data):
        if self.skipped:
            return
        self.stack[-1].chars += len(" ".join(data.split()))
        self.put(data if self.within("pre") else re.sub(r"\s+", " ", data))


def _page(html: str | None) -> tuple[str | None, str | None]:
    if html is None:
        return None, None
    w = _Writer()
    w.feed(html)
    w.close()
    w.ended(1)
    text = w.main[1] if w.main else "".join(w.stack[0].parts)
    return (next((t for t in w.titles if t), "") or w.h1), _tidy(text).strip("\n")


def page_markdown(html: Column) -> Column:
    """struct<title, markdown> of a page: main or article if it holds over 200 characters of text, else the body.

    Lists, quotes and code keep their nesting; navigation, headers, footers, forms, hidden parts and scripts go; images
    become ``[Image: alt]``; only http and mailto links stay links; tables keep their rows, the first as their header.
    The title is that of the head, else of the first h1. Runs in Arrow batches; null stays null.
    """

    @F.pandas_udf("title string, markdown string")
    def written(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            made = [_page(x) for x in pages]
            yield pd.DataFrame({n: pd.Series([m[i] for m in made], dtype=object) for i, n in enumerate(("title", "markdown"))})

    return written(html)


def html_to_markdown(html: Column) -> Column:
    """The Markdown of ``page_markdown``."""
    return page_markdown(html)["markdown"]


def html_tables(df: DataFrame, html: str, keys: list[str]) -> DataFrame:
    """(keys, table_no, row_no, cells): the rows of the tables of a page as arrays of text."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))
    t = df.select(*keys, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))).alias("t", "_t"))
    r = t.select(*keys, "t", F.posexplode(F.regexp_extract_all("_t", F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0))).alias("r", "_r"))
    cells = F.transform(F.regexp_extract_all("_r", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), plain)
    return r.select(*keys, (F.col("t") + 1).alias("table_no"), (F.col("r") + 1).alias("row_no"), cells.alias("cells"))


def table_row(cells: Column) -> Column:
    """A Markdown row: bars escaped, line ends as spaces."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")), " | "), F.lit(" |"))

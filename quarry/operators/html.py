"""HTML pages to documents: sections under their headings, and table rows as sentences.

A page's tree is walked inside an Arrow batch (one page is one row, so nothing is
shuffled); what comes out is arrays, and titles, prefixes, sentences and numbering
are Columns over them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions import readable
from quarry.functions.dom import SCRIPTS, Node, parse
from quarry.functions.pieces import pieces
from quarry.functions.readable import Readability, summary
from quarry.operators import records
from quarry.schema import NO_TITLE, free, others

# Fixed values.
RANK = {"title": 100, "h1": 6, "h2": 5, "h3": 4, "h4": 3, "h5": 2, "h6": 1}
SPLIT_TAGS = ("h1", "h2", "h3", "h4")
ONE_BREAK = frozenset("article aside br dd details div dt fieldset figcaption footer form header hr legend li main nav table tr".split())
TWO_BREAKS = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre title ul".split())
CITATION = re.compile(r"^\[(\d+|\d+[-～]\d+)([,，](\d+|\d+[-～]\d+))*\]$")
NO_SPACE_BEFORE = re.compile(r'^[,:;.!?")]')


@dataclass(frozen=True)
class HtmlConfig:
    remove_hyperlinks: bool = True
    fix_check: bool = True
    contain_closest_title_levels: int = 0
    title_convert_to_markdown: bool = False
    use_first_header_as_title: bool = False
    separate_tables: bool = True
    cut_table_to_line: bool = True
    split_tags: tuple[str, ...] = SPLIT_TAGS
    prevent_duplicate_header: bool = True
    use_summary: bool = True
    #: Text right behind a closing heading belongs to no section unless this is set.
    keep_heading_tails: bool = False
    #: Pages of files that end in .html are tried for medical records first.
    sniff_records: bool = False
    readability: Readability = Readability()


#: How the pages of medical records are read.
RECORD = HtmlConfig()


def push(stack: list[tuple[str, str]], tag: str, title: str) -> None:
    """Close the titles that ``tag`` ends and open its own."""
    while stack and RANK[stack[-1][0]] <= RANK[tag]:
        stack.pop()
    stack.append((tag, title))


# Tables.


def _count(n: Node, name: str) -> int:
    v = n.attrs.get(name, "").strip()
    return max(int(v), 1) if v.isdecimal() else 1


def grid(table: Node) -> list[list[str]]:
    """Cells with their spans filled in; a cell takes the first free place of its row, and what is taken stays. Short rows end in empty cells."""
    taken: dict[tuple[int, int], str] = {}
    rows = table.all("tr")
    for r, row in enumerate(rows):
        c = 0
        for cell in row.nodes():
            if cell.tag not in ("td", "th"):
                continue
            while (r, c) in taken:
                c += 1
            high, wide, value = _count(cell, "rowspan"), _count(cell, "colspan"), cell.text()
            for i in range(r, min(r + high, len(rows))):
                for j in range(c, c + wide):
                    taken.setdefault((i, j), value)
            c += wide
    width = [0] * len(rows)
    for i, j in taken:
        width[i] = max(width[i], j + 1)
    return [[taken.get((i, j), "") for j in range(w)] for i, w in enumerate(width) if w]


def markdown_of(table: Node) -> str:
    """Rows between pipes; a rule after the first and after every row with a header cell."""
    out = []
    for i, row in enumerate(table.all("tr")):
        cells = row.all("th", "td")
        out.append("| " + " | ".join(c.stripped() for c in cells) + " |")
        if i == 0 or any(c.tag == "th" for c in cells):
            out.append("| " + " | ".join("---" for _ in cells) + " |")
    return "\n".join(out)


def caption(table: Node) -> tuple[str, str] | None:
    """The neighbour before, else that behind, whose only text begins or ends with the sign for a table."""
    around = table.parent.nodes() if table.parent is not None else [table]
    at = next(i for i, n in enumerate(around) if n is table)
    for n in [*around[max(at - 1, 0) : at], *around[at + 1 : at + 2]]:
        s = n.only_string()
        if s and (s.startswith("表") or s.endswith("表")):
            return n.tag, s
    return None


def take_tables(root: Node, title: str) -> list[dict]:
    """Detach the outermost tables, each with the titles it stands under."""
    stack = [("title", title)] if title and title != NO_TITLE else []
    out, gone = [], set()
    for n in root.all("h1", "h2", "h3", "h4", "h5", "h6", "table"):
        if n in gone:
            continue
        if n.tag != "table":
            push(stack, n.tag, n.stripped())
            continue
        gone.update(n.all())
        name = caption(n)
        out.append({"titles": [*stack, *([name] if name else [])], "cells": grid(n), "md": markdown_of(n)})
        n.drop()
    return out


# Preparation.


def page_title(root: Node, file_name: str | None) -> str:
    """The title element's text, else the file's name up to its first dot."""
    title = readable.title(root)
    if title != NO_TITLE or not file_name:
        return title
    return file_name.rsplit("/", 1)[-1].split(".")[0]


def _one_line(n: Node) -> str:
    return n.text().replace("\n", " ").replace("\r", "")


def prepare(root: Node, title: str, cfg: HtmlConfig) -> tuple[str, list[dict]]:
    """The title in force and the tables taken out, after headings and links became plain text and unchecked choices went with their labels."""
    first = next(iter(root.all("h1", "h2")), None)
    if first is not None and cfg.use_first_header_as_title:
        title = first.text().strip()
        if cfg.prevent_duplicate_header:
            first.drop()
    for h in root.all("h1", "h2", "h3", "h4", "h5", "h6"):
        h.kids = [_one_line(h)]
    if cfg.remove_hyperlinks:
        for a in root.all("a"):
            if a.parent is not None:
                a.replace([_one_line(a)])
    if cfg.fix_check:
        for box in root.all("input"):
            if box.attrs.get("type") in ("checkbox", "radio") and "checked" not in box.attrs:
                around = box.parent.nodes()
                at = next(i for i, n in enumerate(around) if n is box)
                label = next((n for n in around[at + 1 :] if n.tag == "span"), None)
                if label is not None:
                    label.drop()
                box.drop()
    return title, take_tables(root, title) if cfg.separate_tables else []


# Text.


class Layout:
    """Text with line breaks and spaces as a reader sees them, cut at headings."""

    def __init__(self, title: str | None, split_tags, keep_tails: bool):
        self.split, self.keep_tails = split_tags, keep_tails
        self.titles = [("title", title)] if title and title != NO_TITLE else []
        self.full: list[str] = []
        self.part: list[str] = []
        self.sections: list[tuple[list, str]] = []
        self.breaks, self.last = 2, ""

    def _put(self, s: str, inside: bool = True) -> None:
        self.full.append(s)
        if inside:
            self.part.append(s)

    def cut(self) -> None:
        text = "".join(self.part).strip()
        if text:
            self.sections.append((list(self.titles), text))
        self.part = []

    def heading(self, n: Node) -> None:
        self.cut()
        if n.first_text():
            push(self.titles, n.tag, " ".join(n.first_text().split()))

    def line(self, tag: str) -> None:
        want = 2 if tag in TWO_BREAKS else 1 if tag in ONE_BREAK else 0
        if want > self.breaks:
            self._put("\n" * (want - self.breaks))
            self.breaks = want

    def say(self, raw: str, tag: str, tail: bool) -> None:
        text = " ".join(raw.split())
        if not text:
            return
        close = text.replace(" ", "") if tag == "sup" else ""
        if CITATION.match(close):
            return
        note = close.isdigit()
        tight = not self.last[-1:].isspace() and (NO_SPACE_BEFORE.match(text) or self.last.endswith("(") or note)
        inside = tag not in self.split or (tail and self.keep_tails)
        self._put(("" if self.breaks or tight else " ") + ("^" if note else "") + text, inside)
        self.breaks, self.last = 0, raw


def extract_text(root: Node, title: str | None = None, split_tags=SPLIT_TAGS, keep_tails: bool = False) -> tuple[str, list[tuple[list, str]]]:
    """The whole text, and sections as (titles, text)."""
    out = Layout(title, frozenset(split_tags), keep_tails)
    for kind, x, owner in root.events():
        if kind in ("text", "tail"):
            out.say(x, owner.tag, kind == "tail")
            continue
        if kind == "start" and x.tag in out.split:
            out.heading(x)
        out.line(x.tag)
    out.cut()
    return "".join(out.full).strip(), out.sections


def extract_page(html: str | None, file_name: str | None, cfg: HtmlConfig) -> dict:
    """title, sections of (titles, text), tables of (titles, cells, md), and the kind of a medical record."""
    root = parse(html, SCRIPTS)
    kind = records.kind_of(root) if cfg.sniff_records and (file_name or "").endswith(".html") else None
    if kind:
        cfg = RECORD
    title, tables = prepare(root, page_title(root, file_name), cfg)
    article = summary(root, cfg.readability) if cfg.use_summary else root
    _, sections = extract_text(article.prune(), title, cfg.split_tags, cfg.keep_heading_tails)
    for used in {root, article}:
        used.release()
    return {"title": title, "kind": kind, "sections": [{"titles": t, "text": s} for t, s in sections], "tables": tables}


TITLES = "array<struct<tag:string,title:string>>"
PAGE = f"struct<title:string,kind:string,sections:array<struct<titles:{TITLES},text:string>>,tables:array<struct<titles:{TITLES},cells:array<array<string>>,md:string>>>"


def page_udf(cfg: HtmlConfig):
    """A function of (html, name) and, if given, whether the main content is selected as the configuration says: of a null or false row all is kept."""

    @F.pandas_udf(PAGE)
    def pages(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        plain = replace(cfg, use_summary=False)
        for some in pieces(batches):
            yield pd.DataFrame([extract_page(h, n, cfg if s else plain) for h, n, s in zip(*some, strict=True)], columns=["title", "kind", "sections", "tables"])

    return lambda html, names, selected=None: pages(html, names, F.lit(True) if selected is None else F.coalesce(selected, F.lit(False)))


def page_facts(how: Readability | None = None):
    """A function of (html, url) to title, author, short_title, content (the body's HTML) and summary (the article's HTML), addresses made absolute."""
    how = how or Readability()

    @F.pandas_udf("struct<title:string,author:string,short_title:string,content:string,summary:string>")
    def facts(html: pd.Series, urls: pd.Series) -> pd.DataFrame:
        def one(h, url):
            own = replace(how, url=url) if url else how
            root = readable.read(h, own)
            return readable.title(root), readable.author(root), readable.short_title(root), readable.content(root), summary(h, own).html()

        return pd.DataFrame([one(h, u) for h, u in zip(html, urls, strict=True)], columns=["title", "author", "short_title", "content", "summary"])

    return facts


def shown(titles: Column, markdown: bool) -> Column:
    """Non-empty titles, with number signs for headings if wanted."""
    some = F.filter(titles, lambda t: F.coalesce(t["title"], F.lit("")) != "")
    level = lambda t: F.coalesce(F.try_to_number(F.substring(t["tag"], 2, 1), F.lit("9")).cast("int"), F.lit(0))
    signs = lambda t: F.when(t["tag"].rlike("^h[0-9]+$"), F.concat(F.rpad(F.lit(""), level(t), F.lit("#")), F.lit(" "), t["title"])).otherwise(t["title"])
    return F.transform(some, signs if markdown else lambda t: t["title"])


def _prefixed(titles: Column, text: Column, cfg: HtmlConfig) -> Column:
    n = cfg.contain_closest_title_levels
    if not n:
        return text
    last = F.slice(titles, F.greatest(F.size(titles) - n + 1, F.lit(1)), F.lit(n))
    return F.concat(F.array_join(F.transform(shown(last, cfg.title_convert_to_markdown), lambda t: F.concat(t, F.lit("\n"))), ""), text)


def extract_html(pages: DataFrame, cfg: HtmlConfig | None = None, html: str = "html", file_name: str | None = None, selected: str | None = None) -> DataFrame:
    """One row per document of a page: the other columns, ord, titles, content_type, row, page_content; sections first, then tables.

    ``selected`` names a column that says of which rows the main content is selected, where the configuration does so.

    With ``sniff_records`` a page that is a medical record gives its one record, if it is
    long enough, and ``record`` has its metadata; that is null elsewhere.
    """
    cfg = cfg or HtmlConfig()
    made = ["titles", "content_type", "row", "page_content", *(["record"] if cfg.sniff_records else [])]
    kept, p, d = others(pages, html, "ord", *made), free(pages, "_p"), free(pages, "_d")
    name = F.col(file_name) if file_name else F.lit(None).cast("string")
    null = F.lit(None)

    def doc(titles, kind, row, text, record=null):
        x = [titles.cast("array<string>").alias("titles"), kind.cast("string").alias("content_type"), row.cast("int").alias("row"), text.alias("page_content")]
        return F.struct(*x, *([record.cast(records.METADATA).alias("record")] if cfg.sniff_records else []))

    sections = F.transform(f"{p}.sections", lambda s: doc(shown(s["titles"], cfg.title_convert_to_markdown), null, null, _prefixed(s["titles"], s["text"], cfg)))

    def rows(t):
        cells = X.merged_header(t["cells"])
        head = F.get(cells, F.lit(0))
        body = F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))
        fits = ~F.exists(body, lambda r: F.size(r) > F.size(head))
        made = F.transform(body, lambda r, i: doc(shown(t["titles"], False), F.lit("table"), i, X.row_sentence(head, r)))
        return F.when(fits, made).otherwise(F.slice(made, 1, 0))

    whole = lambda t: F.array(doc(shown(t["titles"], cfg.title_convert_to_markdown), F.lit("table"), null, t["md"]))
    docs = F.concat(sections, F.flatten(F.transform(f"{p}.tables", rows if cfg.cut_table_to_line else whole)))
    if cfg.sniff_records:
        texts = F.concat(F.transform(f"{p}.sections", lambda s: s["text"]), F.transform(f"{p}.tables", lambda t: t["md"]))
        record = F.array(records.page_record(texts, F.col(f"{p}.kind")))
        one = F.transform(F.filter(record, lambda r: r["page_content"].isNotNull()), lambda r: doc(F.array(), F.lit("record"), null, r["page_content"], r["record"]))
        docs = F.when(F.col(f"{p}.kind").isNull(), docs).otherwise(one)
    read = pages.select(*kept, page_udf(cfg)(F.col(html), name, F.col(selected) if selected else None).alias(p))
    # not by posexplode: a test for empty arrays would be pushed below it and make all documents twice more
    return read.select(*kept, F.posexplode_outer(docs).alias("ord", d)).filter("ord IS NOT NULL").select(*kept, "ord", f"{d}.*")

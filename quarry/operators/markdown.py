"""Markdown texts to documents: sections under their headers, then tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions.pieces import pieces
from quarry.schema import free, others

# A table with outer pipes, and one without.
BORDERED = re.compile(r"(?:\n|^)(?:\|.*?\|.*?\|.*?\n)(?:\|(?:\s*[:-]+[-| :]*\s*)\|.*?\n)(?:\|.*?\|.*?\|.*?\n)+")
BORDERLESS = re.compile(r"(?:\n|^)(?:\S.*?\|.*?\n)(?:(?:\s*[:-]+[-| :]*\s*).*?\n)(?:\S.*?\|.*?\n)+")
HEADER = re.compile(r"^(#+)\s")
FENCE = "```"


@dataclass(frozen=True)
class MarkdownConfig:
    remove_hyperlinks: bool = False
    remove_images: bool = False
    contain_closest_title_levels: int = 0


def take_tables(text: str) -> tuple[str, list[str]]:
    """The text without its tables, and the tables; those in fences go too."""
    found = []
    for pattern in (BORDERED, BORDERLESS):
        found += pattern.findall(text)
        text = pattern.sub("", text)
    return text, found


def sections(text: str) -> list[tuple[list[str], str]]:
    """(headers in force, text) between header lines outside fences; a fence stands between blank lines."""
    out, open_, held, fenced = [], [], [], False

    def close():
        if held:
            out.append((list(open_), "".join(held)))
            held.clear()

    for line in text.split("\n"):
        if line.startswith(FENCE):
            fenced = not fenced
            held.append(f"\n{line}\n" if fenced else f"{line}\n\n")
        elif not fenced and (header := HEADER.match(line)):
            close()
            while open_ and len(HEADER.match(open_[-1] + " ")[1]) >= len(header[1]):
                open_.pop()
            if line.strip("# "):
                open_.append(line)
        else:
            held.append(line + "\n")
    close()
    return out


def sections_udf():
    @F.pandas_udf("struct<sections:array<struct<titles:array<string>,text:string>>,tables:array<string>>")
    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def one(text, no_links, no_images):
            rest, tables = take_tables(text or "")
            clean = lambda s: re.sub(r"!\[\[(.*)\]\]", "", unlinked(s)) if no_images else unlinked(s)
            unlinked = lambda s: re.sub(r"\[(.*?)\]\((.*?)\)", r"\1", s) if no_links else s
            parts = [(t, s.strip()) for t, s in sections(clean(rest))]
            return [(t, s) for t, s in parts if s], [s for s in (clean(t).strip() for t in tables) if s]

        for some in pieces(batches):
            yield pd.DataFrame([one(*r) for r in zip(*some, strict=True)], columns=["sections", "tables"])

    return read


def extract_markdown(docs: DataFrame, cfg: MarkdownConfig | None = None, text: str = "page_content") -> DataFrame:
    """One row per document: the other columns, ord, titles, content_type, page_content; narrow, nothing is shuffled."""
    cfg = cfg or MarkdownConfig()
    kept, m, d = others(docs, text, "ord", "titles", "content_type", "page_content"), free(docs, "_m"), free(docs, "_d")
    doc = lambda titles, kind, s: F.struct(titles.cast("array<string>").alias("titles"), kind.cast("string").alias("content_type"), s.alias("page_content"))
    texts = F.transform(f"{m}.sections", lambda s: doc(s["titles"], F.lit(None), X.title_prefix(s["titles"], s["text"], cfg.contain_closest_title_levels)))
    tables = F.transform(f"{m}.tables", lambda t: doc(F.lit(None), F.lit("table"), t))
    read = docs.select(*kept, sections_udf()(F.col(text), F.lit(cfg.remove_hyperlinks), F.lit(cfg.remove_images)).alias(m))
    # not by posexplode: a test for empty arrays would be pushed below it and make all documents twice more
    return read.select(*kept, F.posexplode_outer(F.concat(texts, tables)).alias("ord", d)).filter("ord IS NOT NULL").select(*kept, "ord", f"{d}.*")

"""Splitters and page extraction as SQL table functions, for LATERAL joins."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quarry.operators.html import HtmlConfig, extract_page
from quarry.operators.markdown import sections
from quarry.operators.split import SplitConfig, recursive_chunks


class Chunks:
    def eval(self, text: str, size: int, overlap: int):
        cfg = SplitConfig(size, overlap, keep_separator=True)
        yield from enumerate(recursive_chunks(text, ["\n\n", "\n", " ", ""], cfg) if text else [])


class HtmlSections:
    def eval(self, html: str):
        found = extract_page(html, None, HtmlConfig())["sections"]
        yield from ((i, [t for _, t in s["titles"] if t], s["text"]) for i, s in enumerate(found))


class MarkdownSections:
    def eval(self, text: str):
        yield from ((i, t, s.strip()) for i, (t, s) in enumerate(sections(text or "")) if s.strip())


def register(spark: SparkSession) -> None:
    """``recursive_chunks(text, size, overlap)``, ``html_sections(html)``, ``markdown_sections(text)``."""
    spark.udtf.register("recursive_chunks", udtf(Chunks, returnType="ord: int, page_content: string"))
    spark.udtf.register("html_sections", udtf(HtmlSections, returnType="ord: int, titles: array<string>, page_content: string"))
    spark.udtf.register("markdown_sections", udtf(MarkdownSections, returnType="ord: int, titles: array<string>, page_content: string"))

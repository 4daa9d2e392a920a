"""Block-level PDF operators, relational over blocks(doc_id, page_idx, block_idx, y0, y1, text) and toc(doc_id, toc_ord, level, title, page)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import is_readable, repair_pdf_text, strip

SPLIT_LEVELS = (1, 2, 3)
MAX_WORDS, MAX_HAN = 10, 20
#: Number of the pattern for summaries, which has no rank.
SUMMARY = 0
# Words of summary headings; "keywords" is matched in the plural only.
SUMMARIES = ["introduction", "abstract", "keywords", "contents", "摘要", "引言", "关键词", "前言", "目录"]
# Numbers that go on with one of three digits are an address, no heading's.
_NO_ADDRESS = r"(?!([0-9]+\.)*[0-9]{3})"
# Heading patterns, in order of their trial. Letters of summary words may stand apart.
HEADINGS = [
    r"^[0-9. 一、i]*(" + "|".join(r"\s*".join(["", *word, ""]) for word in SUMMARIES) + ")",
    r"^第[零一二三四五六七八九十百0-9]+(分?编|部分)",
    r"^第[零一二三四五六七八九十百0-9]+章",
    r"^第[零一二三四五六七八九十百0-9]+节",
    r"^第[零一二三四五六七八九十百0-9]+条",
    r"^第[0-9]+章",
    r"^第[0-9]+节",
    r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{1,2}[\.、](?=\S|$)" + _NO_ADDRESS,
    r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{1,2}[\.、](?=\S|$)" + _NO_ADDRESS,
    r"^[0-9]{1,2}\.[0-9]{1,2}[\.、](?=\S|$)" + _NO_ADDRESS,
    r"^[0-9]{1,2}[\.、](?!\d)(\S+)",
    r"^[\(（【［\[][零一二三四五六七八九十百]+[\)）】］\]]",
    r"^[零一二三四五六七八九十百]+[\.。:：、]",
    r"^PART (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)",
    r"^Chapter (I+V?|VI*|XI|IX|X)",
    r"^Section [0-9]+",
    r"^Article [0-9]+",
]


def page_metrics(blocks: DataFrame) -> DataFrame:
    """The topmost and the lowest block of each page, the first of ties, and their heights."""
    top = F.min(F.struct("y0", "block_idx", (F.col("y1") - F.col("y0")).alias("height")))
    low = F.max(F.struct("y1", (-F.col("block_idx")).alias("back"), (F.col("y1") - F.col("y0")).alias("height")))
    return blocks.groupBy("doc_id", "page_idx").agg(top.alias("t"), low.alias("b")).select("doc_id", "page_idx", F.col("t.block_idx").alias("header_idx"), F.col("t.height").alias("header_height"), (-F.col("b.back")).alias("footer_idx"), F.col("b.height").alias("footer_height"))


def header_vote(metrics: DataFrame, share: float = 0.9) -> DataFrame:
    """Whether a document's most common header (footer) height stands on enough of its pages."""
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_height").alias("height")) for s in ("header", "footer")))).alias("x")
    n = metrics.filter("doc_id IS NOT NULL").select("doc_id", sides).select("doc_id", "x.*").groupBy("doc_id", "side", "height").count()
    of = lambda side: F.when(F.col("side") == side, F.col("count"))
    return n.groupBy("doc_id").agg(*((F.max(of(s)) >= share * F.sum(of(s))).alias(f"has_{s}") for s in ("header", "footer")))


def filtered_blocks(blocks: DataFrame, share: float = 0.9) -> DataFrame:
    """Blocks without voted headers and footers; pages left empty disappear and later ones move up.

    Pages are measured and votes counted by windows over one shuffle by document, so that the blocks are made once.
    """
    page = W.partitionBy("doc_id", "page_idx")
    first = F.row_number().over(page.orderBy("y0", "block_idx")) == 1
    height = (F.col("y1") - F.col("y0")).alias("height")
    b = blocks.filter("doc_id IS NOT NULL AND page_idx IS NOT NULL").select(
        "*", F.min(F.struct("y0", "block_idx", height)).over(page).alias("_t"), F.max(F.struct("y1", (-F.col("block_idx")).alias("back"), height)).over(page).alias("_b"), first.cast("int").alias("_one")
    )
    whole = W.partitionBy("doc_id")
    # each page counts once, by the block that comes first
    for side, top in (("header", "_t"), ("footer", "_b")):
        b = b.withColumn("_n", F.sum("_one").over(W.partitionBy("doc_id", F.col(top)["height"])))
        b = b.withColumn(f"_has_{side}", F.max("_n").over(whole) >= share * F.sum("_one").over(whole))
    keep = b.filter(~((F.col("_has_header") & (F.col("block_idx") == F.col("_t.block_idx"))) | (F.col("_has_footer") & (F.col("block_idx") == -F.col("_b.back")))))
    return keep.select(*blocks.columns, F.dense_rank().over(W.partitionBy("doc_id").orderBy("page_idx")).alias("page"))


def lines(kept: DataFrame, readable: bool = True) -> DataFrame:
    """doc_id, line_idx, page, text of the blocks, unreadable and empty ones left out unless ``readable`` is off."""
    if readable:
        kept = kept.filter(is_readable(F.col("text")))
    w = W.partitionBy("doc_id").orderBy("page", "block_idx")
    return kept.select("doc_id", (F.row_number().over(w) - 1).alias("line_idx"), (F.col("page") - 1).alias("page"), F.replace("text", F.lit("\n"), F.lit("")).alias("text"))


def toc_lines(toc: DataFrame, line: DataFrame, levels: tuple[int, ...] = SPLIT_LEVELS) -> DataFrame:
    """The first line of each entry's page that holds its title, with or without spaces."""
    t = toc.filter(F.col("level").isin(*levels)).select("doc_id", "toc_ord", "level", "title", (F.col("page") - 1).alias("page"))
    match = F.contains("text", "title") | F.contains("text", F.replace("title", F.lit(" "), F.lit("")))
    return t.join(line, ["doc_id", "page"]).filter(match).groupBy("doc_id", "toc_ord", "level", "title").agg(F.min("line_idx").alias("line_idx"))


def title_matches(toc: DataFrame, line: DataFrame, levels: tuple[int, ...] = SPLIT_LEVELS) -> DataFrame:
    """doc_id, toc_ord, level, title, line_idx of every line that holds an entry's title, with or without spaces, on whatever page.

    A document's entries travel to its lines, and one automaton of all their titles (Aho and Corasick's) reads
    each line once. An empty title matches nothing.
    """
    entries = toc.filter(F.col("level").isin(*levels) & (F.col("title") != "")).select("doc_id", F.struct("toc_ord", "level", "title").alias("_e"))
    entries = entries.groupBy("doc_id").agg(F.array_sort(F.collect_set("_e")).alias("_e"))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def found(texts: pd.Series, titles: pd.Series) -> pd.Series:
        import ahocorasick

        @lru_cache(64)
        def automaton(own: tuple[str, ...]):
            at: dict[str, set[int]] = {}
            for k, t in enumerate(own):
                for x in {t, t.replace(" ", "")} - {""}:
                    at.setdefault(x, set()).add(k)
            made = ahocorasick.Automaton()
            for x, ks in at.items():
                made.add_word(x, ks)
            made.make_automaton()
            return made

        return pd.Series([sorted(set().union(*(ks for _, ks in automaton(tuple(own)).iter(t)))) if t else [] for t, own in zip(texts, titles, strict=True)], dtype=object)

    rows = line.select("doc_id", "line_idx", "text").join(entries, "doc_id")
    rows = rows.withColumn("_k", found("text", F.transform("_e", lambda e: e["title"]))).select("doc_id", "line_idx", "_e", F.explode("_k").alias("_k"))
    return rows.select("doc_id", F.get("_e", F.col("_k")).alias("e"), "line_idx").select("doc_id", "e.toc_ord", "e.level", "e.title", "line_idx")


def longest_chain(matches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest choice of (entry, line) that grows in both; of equal ones that whose lines end earliest."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    rows = sorted(set(matches), key=lambda m: (m[0], -m[1]))  # an entry's later lines first, so that it is taken once
    for i, (_, at) in enumerate(rows):
        k = bisect_left(tails, at)
        tails[k : k + 1] = [at]
        before.append(ends[k - 1] if k else -1)
        ends[k : k + 1] = [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(rows[i])
        i = before[i]
    return out[::-1]


def toc_chain(toc: DataFrame, line: DataFrame, levels: tuple[int, ...] = SPLIT_LEVELS) -> DataFrame:
    """Lines of a table of contents without page numbers: of all matches the longest chain that keeps the entries' order. What is gathered of a document is its matches' numbers."""

    @F.pandas_udf("array<struct<toc_ord:long,line_idx:long>>")
    def chain(matches: pd.Series) -> pd.Series:
        return matches.map(lambda m: [{"toc_ord": a, "line_idx": b} for a, b in longest_chain([(x["toc_ord"], x["line_idx"]) for x in m])])

    found = title_matches(toc, line, levels)
    pair = F.struct(F.col("toc_ord").cast("long").alias("toc_ord"), F.col("line_idx").cast("long").alias("line_idx"))
    kept = found.groupBy("doc_id").agg(F.collect_set(pair).alias("_m")).select("doc_id", F.explode(chain("_m")).alias("_c")).select("doc_id", "_c.*")
    return found.join(kept, ["doc_id", "toc_ord", "line_idx"], "left_semi").select("doc_id", "toc_ord", "level", "title", "line_idx")


def sections(headings: DataFrame, line: DataFrame, levels: tuple[int, ...] = SPLIT_LEVELS) -> DataFrame:
    """doc_id, first, titles, page_content: the text between headings of these levels, with the nearest open headings of lower levels as titles; a preface of two or more lines is a section.

    What a window keeps of a document is its last heading of each level, and lines
    find their heading by a running window, so nothing of a document is gathered but
    a section's lines.
    """
    h = headings.filter(F.col("level").isin(*levels))
    before = W.partitionBy("doc_id").orderBy("line_idx", "toc_ord")
    last = {k: F.last(F.when(F.col("level") == k, F.struct("line_idx", "toc_ord", "title")), ignorenulls=True).over(before.rowsBetween(W.unboundedPreceding, -1)) for k in levels}
    h = h.select("doc_id", "level", "title", F.col("line_idx").alias("first"), "toc_ord", *[x.alias(f"_{k}") for k, x in last.items()])

    def open_(k):
        """The last heading of level k, unless one of a lower level came after it."""
        closed = F.lit(False)
        for j in levels:
            if j < k:
                closed = closed | F.coalesce(F.struct(f"_{j}.line_idx", f"_{j}.toc_ord") > F.struct(f"_{k}.line_idx", f"_{k}.toc_ord"), F.lit(False))
        return F.when((F.col("level") > k) & ~closed, F.col(f"_{k}.title"))

    titles = F.filter(F.array(*map(open_, sorted(levels)), F.col("title")), lambda t: t.isNotNull())
    h = h.select("doc_id", "first", "toc_ord", titles.alias("titles"))
    # of headings in one line the last has the text behind it
    marks = h.groupBy("doc_id", F.col("first").alias("line_idx")).agg(F.max("toc_ord").alias("mark"))
    running = W.partitionBy("doc_id").orderBy("line_idx")
    at = F.last(F.when(F.col("mark").isNotNull(), F.struct(F.col("line_idx").alias("first"), F.col("mark").alias("toc_ord"))), ignorenulls=True).over(running)
    body = line.join(marks, ["doc_id", "line_idx"], "left").withColumn("at", at).filter("mark IS NULL")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda x: x["text"]), "")
    body = body.select("doc_id", F.coalesce("at.first", F.lit(-1)).alias("first"), F.coalesce("at.toc_ord", F.lit(-1)).alias("toc_ord"), "line_idx", "text").groupBy("doc_id", "first", "toc_ord").agg(text.alias("page_content"))
    preface = h.groupBy("doc_id").agg(F.min("first").alias("next")).filter("next > 1").select("doc_id", F.lit(-1).alias("first"), F.lit(-1).alias("toc_ord"), F.array().cast("array<string>").alias("titles"))
    return h.unionByName(preface).join(body, ["doc_id", "first", "toc_ord"], "left").select("doc_id", "first", "titles", F.coalesce("page_content", F.lit("")).alias("page_content"))


def extract_pdf(blocks: DataFrame, toc: DataFrame | None = None, levels: tuple[int, ...] = SPLIT_LEVELS, segment: Callable[[str], list[str]] | None = None) -> DataFrame:
    """doc_id, first, titles, page_content: blocks to documents.

    Headers and footers go, then unreadable blocks; a document's own table of contents
    finds its headings, or, if it has none, the lines that look like headings; a
    document without any is one text without titles.  Texts and titles are repaired,
    with ``segment`` protecting the characters of words.
    """
    line = lines(filtered_blocks(blocks))
    found = generated_toc(line if toc is None else line.join(toc.select("doc_id").distinct(), "doc_id", "left_anti"), levels)
    if toc is not None:
        found = toc_lines(toc, line, levels).select(found.columns).unionByName(found)
    whole = line.join(found.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda x: x["text"]), "").alias("page_content"))
    rows = sections(found, line, levels).unionByName(whole.select("doc_id", F.lit(-1).alias("first"), F.array().cast("array<string>").alias("titles"), "page_content"))
    if segment is None:
        titles = F.transform("titles", lambda t: repair_pdf_text(t))
    else:
        # a function of Python can't run inside an array: titles are joined by a character that nothing repairs
        titles = F.split(repair_pdf_text(F.array_join("titles", "\ue000"), segment=segment), "\ue000")
        titles = F.when(F.size("titles") == 0, F.col("titles")).otherwise(titles)
    return rows.select("doc_id", "first", titles.alias("titles"), repair_pdf_text(F.col("page_content"), segment=segment).alias("page_content"))


def heading_pattern(text: Column) -> Column:
    """Number of the first heading pattern that fits a short line and isn't followed by a sentence; null if none."""
    text = strip(text)
    short = (F.size(F.split(text, r"\s+")) <= MAX_WORDS) & (~text.rlike(r"[一-鿿]") | (F.length(text) < MAX_HAN)) & (text != "")
    found = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(HEADINGS))):
        rest = strip(F.regexp_replace(text, p, ""))
        sentence = (F.length(rest) > 2) & rest.rlike(r"[，,。：:；;!！?？]")
        found = F.when(text.rlike(p), F.when(~sentence, i)).otherwise(found)
    # most lines fit none: one pattern of all says so before they are tried in turn
    return F.when(text.rlike("|".join(f"(?:{p})" for p in HEADINGS)), F.when(short, found))


def outline_levels(patterns: list[int]) -> list[int]:
    """Levels of a document's headings: patterns rank by first appearance, and a heading stands as much deeper than the nearest open one of an earlier pattern as their ranks differ. Summary headings keep the level in force."""
    rank: dict[int, int] = {}
    for p in patterns:
        if p != SUMMARY:
            rank.setdefault(p, len(rank))
    open_, level, out = [], 1, []
    for p in patterns:
        if p != SUMMARY:
            while open_ and open_[-1] >= rank[p]:
                open_.pop()
            level = rank[p] - open_[-1] + 1 if open_ else 1
            open_.append(rank[p])
        out.append(level)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _outline(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: outline_levels([int(x) for x in p]))


def generated_toc(line: DataFrame, levels: tuple[int, ...] = SPLIT_LEVELS) -> DataFrame:
    """doc_id, toc_ord, level, title, line_idx of lines that look like headings, for documents without a table of contents.

    What is gathered for a document is its headings only.
    """
    h = line.withColumn("_p", heading_pattern(F.col("text"))).filter("_p IS NOT NULL").select("doc_id", F.struct("line_idx", strip(F.col("text")).alias("title"), "_p").alias("_h"))
    h = h.groupBy("doc_id").agg(F.array_sort(F.collect_list("_h")).alias("_h"))
    h = h.withColumn("_l", _outline(F.transform("_h", lambda x: x["_p"])))
    rows = h.select("doc_id", F.posexplode(F.arrays_zip("_h", "_l")).alias("toc_ord", "_x"))
    return rows.select("doc_id", "toc_ord", F.col("_x._l").alias("level"), F.col("_x._h.title").alias("title"), F.col("_x._h.line_idx").alias("line_idx")).filter(F.col("level").isin(*levels))

"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.dictionary import Dictionary
from quarry.functions.pieces import pieces

#: White space as Python's ``\\s`` has it.
SPACE = r"(?U)[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+\z|\A{SPACE}+", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def non_blank(c: Column) -> Column:
    return F.length(F.regexp_replace(c, f"{SPACE}+", "")) > 0


def title_prefix(titles: Column, content: Column, levels: int, separator: str | None = None) -> Column:
    """The last ``levels`` titles, empty ones left out, a line each before the content."""
    if levels <= 0:
        return content
    last = F.filter(F.slice(titles, F.greatest(F.size(titles) - levels + 1, F.lit(1)), F.lit(levels)), lambda t: F.coalesce(t, F.lit("")) != "")
    mid = "\n" if separator is None else f"\n{separator}\n"
    return F.when(F.size(F.coalesce(titles, F.array().cast("array<string>"))) == 0, content).when(F.size(last) == 0, content).otherwise(F.concat(F.array_join(last, "\n"), F.lit(mid), content))


def strip_wiki_images(c: Column) -> Column:
    return F.regexp_replace(c, r"!\[\[(.*)\]\]", "")


def strip_links(c: Column) -> Column:
    return F.regexp_replace(c, r"\[(.*?)\]\((.*?)\)", "$1")


def normal_title(c: Column) -> Column:
    """Dashes to ``-``, no-break space to a space, guillemets to quotes, spaces collapsed."""
    c = F.translate(c, "—– «»", '-- ""')
    c = F.replace(F.replace(F.replace(c, F.lit("&mdash;"), F.lit("-")), F.lit("&ndash;"), F.lit("-")), F.lit("&nbsp;"), F.lit(" "))
    for entity in ("&laquo;", "&raquo;", "&quot;"):
        c = F.replace(c, F.lit(entity), F.lit('"'))
    return collapse(c)


# What a wrong decoding made of punctuation and symbols, and what was meant.
PUNCTUATION = {"袁": "，", "遥": "。", "院": "：", "渊": "（", "冤": "）", "尧": "、", "揖": "【", "铱": "】", "耀": "~", "曰": "；", "鄄": "-", "覬": "∅"}
CIRCLED = {"淤": "①", "于": "②", "盂": "③", "榆": "④", "虞": "⑤", "愚": "⑥", "舆": "⑦", "余": "⑧", "俞": "⑨", "逾": "⑩"}
ROMAN = {"玉": "Ⅰ", "域": "Ⅱ", "芋": "Ⅲ", "郁": "Ⅳ"}
CIRCLE_GAP = 500
SIGNS = re.compile("[" + "".join(PUNCTUATION) + "]")


def repair_spaces(c: Column) -> Column:
    c = F.translate(c, " 　  ", "  ")
    return F.replace(c, F.lit("\U001001b0"), F.lit("."))


#: Characters on either side that a segmenter sees, and how many of its answers a worker remembers.
CONTEXT, SEGMENTS, PROTECTED = 3, 2048, 4096


def protected_punctuation(segment: Callable[[str], list[str]]):
    """A function of a text that leaves a listed character alone where a word of the segmentation of its surroundings has it beside others."""
    words = lru_cache(SEGMENTS)(segment)
    kept = lru_cache(PROTECTED)(lambda around, c: any(len(w) > 1 and c in w for w in words(around)))

    def repair(t: str) -> str:
        return "".join(PUNCTUATION[c] if c in PUNCTUATION and not kept(t[max(0, i - CONTEXT) : i + CONTEXT + 1], c) else c for i, c in enumerate(t))

    return repair


def _repaired(texts: list[str | None], words: Dictionary) -> list[str | None]:
    """The same for a batch of texts by a dictionary: each context that they have is segmented once."""
    at = [[m.start() for m in SIGNS.finditer(t)] if t else [] for t in texts]
    seen: dict[tuple[str, str], int] = {}
    which = [[seen.setdefault((t[max(0, i - CONTEXT) : i + CONTEXT + 1], t[i]), len(seen)) for i in own] for t, own in zip(texts, at, strict=True)]
    kept = words.protects([a for a, _ in seen], [c for _, c in seen]).tolist()
    out = []
    for t, own, ks in zip(texts, at, which, strict=True):
        if own:
            parts, done = [], 0
            for i, k in zip(own, ks, strict=True):
                if not kept[k]:
                    parts += [t[done:i], PUNCTUATION[t[i]]]
                    done = i + 1
            t = "".join([*parts, t[done:]])
        out.append(t)
    return out


def repair_punctuation(c: Column, segment: Callable[[str], list[str]] | Dictionary | None = None) -> Column:
    """Listed characters as punctuation, but where a word of their surroundings has them; without a segmenter all."""
    if segment is None:
        return F.translate(c, "".join(PUNCTUATION), "".join(PUNCTUATION.values()))

    @F.pandas_udf(T.StringType())
    def repaired(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        repair = None if isinstance(segment, Dictionary) else protected_punctuation(segment)
        for (texts,) in pieces(batches):
            yield pd.Series(_repaired(texts.tolist(), segment) if repair is None else [None if t is None else repair(t) for t in texts], dtype=object)

    return repaired(c)


def repair_units(c: Column, legacy: bool = False) -> Column:
    """Degrees, plus-minus, micrograms, times, title marks, bounds; ``legacy`` drops the number after a bound."""
    number = "" if legacy else "$1"
    c = F.regexp_replace(c, r"(?U)(?<=\d\s)益", "℃")
    c = F.regexp_replace(c, r"(?U)(\d)依", "$1±")
    c = F.replace(c, F.lit("滋g"), F.lit("μg"))
    c = F.regexp_replace(c, r"(?U)伊(\d+)", "x$1")
    c = F.regexp_replace(c, r"(?s)叶(.*?)曳", "《$1》")
    c = F.regexp_replace(c, r"(?U)逸(\d+)", f"≥{number}")
    c = F.regexp_replace(c, r"(?U)臆(\d+)", f"≤{number}")
    return F.replace(c, F.lit(""), F.lit("●"))


def repair_circled(c: Column) -> Column:
    """Runs of listed digits in order, the longest first, at most ``CIRCLE_GAP`` characters apart."""
    signs = list(CIRCLED)
    for n in range(len(signs), 1, -1):
        gap = f"(.{{0,{CIRCLE_GAP}}}?)"
        new = "".join(CIRCLED[s] + (f"${i + 1}" if i < n - 1 else "") for i, s in enumerate(signs[:n]))
        c = F.regexp_replace(c, "(?s)" + gap.join(signs[:n]), new)
    return c


def repair_brackets(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)咱(.{0,30}?)暂", "[$1]")


def repair_roman(c: Column) -> Column:
    han = r"[一-龥]"
    for sign, roman in ROMAN.items():
        c = F.regexp_replace(c, f"(?<!{han}){sign}|{sign}(?!{han})|{sign}(?=期)", roman)
    return c


def repair_pdf_text(c: Column, legacy: bool = False, segment: Callable[[str], list[str]] | Dictionary | None = None) -> Column:
    c = repair_units(repair_punctuation(repair_spaces(c), segment), legacy)
    return F.replace(repair_roman(repair_brackets(repair_circled(c))), F.lit("\n"), F.lit(""))


# Characters that readable text is made of, beside Han from 一 to 龥. Fixed values.
COMMON = "＞、abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,!?;:'\"-，。！？；：”“‘’\n\t+-*\\/·[]{}【】()（）@#$%^&<>《》`~］′＜～‐='αβγδεζηθικλμνξοπρστυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"
MAX_UNCOMMON = 0.3


def _uncommon() -> np.ndarray:
    table = np.ones(0x110000, bool)
    table[[ord(x) for x in COMMON]] = False
    table[ord("一") : ord("龥") + 1] = False
    return table


UNCOMMON = _uncommon()


def readable(text: str | None) -> bool | None:
    if not text:
        return None if text is None else False
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    bad = UNCOMMON[points]
    total = int(bad.sum())
    if not total:
        return True
    if not total < MAX_UNCOMMON * len(points):
        return False
    at = np.flatnonzero(UNCOMMON[np.sort(points)]) + 1
    return bool((np.arange(1, total + 1) <= MAX_UNCOMMON * at).all())


@F.pandas_udf(T.BooleanType())
def _readable(texts: pd.Series) -> pd.Series:
    return texts.map(readable)


def is_readable(c: Column) -> Column:
    """Whether in code point order at most 0.3 of the characters up to every uncommon one are uncommon, and fewer than 0.3 of all. Empty text isn't readable; null gives null."""
    return _readable(c)


# Tables: cells ARRAY<ARRAY<STRING>>.


def table_markdown(cells: Column) -> Column:
    """Rows between pipes, and a separator after the first."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda x: F.coalesce(x, F.lit(""))), " | "), F.lit(" |"))
    first = F.get(cells, F.lit(0))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(first, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(row(first), rule), F.transform(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), row)), "\n")


def table_csv(cells: Column) -> Column:
    """Rows of cells between commas, each row with a line end; a cell with a comma, quote or line end stands in quotes."""
    cell = lambda x: F.when(x.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    row = lambda r: F.concat(F.array_join(F.transform(r, lambda x: cell(F.coalesce(x, F.lit("")))), ","), F.lit("\r\n"))
    return F.array_join(F.transform(cells, row), "")


def row_sentence(header: Column, row: Column) -> Column:
    """One column: name and value; else a sentence for each further column, a blank line between."""
    cell = lambda a, i: strip(F.coalesce(F.get(a, i), F.lit("")))
    one = F.concat(cell(header, F.lit(0)), F.lit("是"), cell(row, F.lit(0)))
    index = F.sequence(F.lit(1), F.greatest(F.size(header) - 1, F.lit(1)))
    more = F.array_join(F.transform(index, lambda i: F.concat(cell(header, F.lit(0)), F.lit("为"), cell(row, F.lit(0)), F.lit("的"), cell(header, i), F.lit("是"), cell(row, i))), "\n\n")
    return F.when(F.size(header) == 0, "").when(F.size(header) == 1, one).otherwise(more)


def merged_header(cells: Column) -> Column:
    """The first two rows as one where they begin alike and are equally wide."""
    a, b = F.get(cells, F.lit(0)), F.get(cells, F.lit(1))
    two = (F.size(cells) > 1) & (F.size(a) == F.size(b)) & (F.get(a, F.lit(0)) == F.get(b, F.lit(0)))
    both = F.zip_with(a, b, lambda x, y: F.when(x == y, x).otherwise(F.concat(x, F.lit(" "), y)))
    return F.when(F.coalesce(two, F.lit(False)), F.concat(F.array(both), F.slice(cells, F.lit(3), F.greatest(F.size(cells) - 2, F.lit(0))))).otherwise(cells)


# Main-content scoring. Fixed values.
POSITIVE = "article|body|content|entry|hentry|main|page|pagination|post|text|blog|story"
NEGATIVE = "combx|comment|com-|contact|foot|footer|footnote|masthead|media|meta|outbrain|promo|related|scroll|shoutbox|sidebar|sponsor|shopping|tags|tool|widget"


def class_weight(cls: Column, node_id: Column, tag: Column | None = None, positive: str | None = None, negative: str | None = None) -> Column:
    """25 up or down for each of class and id that a pattern is found in; patterns of one's own count too, and for the tag where they match ``tag-`` and its name."""
    weight = F.lit(0)
    found = lambda c, p: F.when(c.rlike(p), 25).otherwise(0)
    for c in (cls, node_id):
        c = F.coalesce(c, F.lit(""))
        weight = weight - found(c, f"(?i){NEGATIVE}") + found(c, f"(?i){POSITIVE}")
        if positive:
            weight = weight + found(c, positive)
        if negative:
            weight = weight - found(c, negative)
    if tag is not None:
        named = F.concat(F.lit("tag-"), tag)
        for p, way in ((positive, 1), (negative, -1)):
            if p:
                weight = weight + way * found(named, f"\\A(?:{p})")
    return weight


def tag_prior(tag: Column) -> Column:
    t = F.lower(tag)
    return F.when(t.isin("div", "article"), 5).when(t.isin("pre", "td", "blockquote"), 3).when(t.isin("address", "ol", "ul", "dl", "dd", "dt", "li", "form", "aside"), -3).when(t.isin("h1", "h2", "h3", "h4", "h5", "h6", "th", "header", "footer", "nav"), -5).otherwise(0)


def link_density(link_text: Column, text: Column) -> Column:
    return F.length(link_text) / F.greatest(F.length(text), F.lit(1))


# Record fields.


#: A key is a whole run of word characters and its bracket closes, so a run or a bracket is not tried again from each of its
#: characters. The letter beside the class is one of it; for its sake the pattern goes by characters, not by halves of them.
PAIR = r"(?U)(?<![\w𠀀])(\w++)\s*+[:：]\s*+\[(?=[^\]]++\])\s*([^\]]*[^\]\s]|\s)\s*+\]"


def bracketed_pairs(c: Column) -> Column:
    """``key: [value]`` pairs as a map; of repeated keys the last counts."""
    pattern = F.lit(PAIR)
    pairs = F.arrays_zip(F.regexp_extract_all(c, pattern, F.lit(1)).alias("k"), F.regexp_extract_all(c, pattern, F.lit(2)).alias("v"))
    last = F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda s, p: F.concat(F.filter(s, lambda x: x["k"] != p["k"]), F.array(p)))
    return F.map_from_entries(last)


def diagnosis(revised: Column, initial: Column, supplementary: Column) -> Column:
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(revised), F.concat(some(initial), F.lit("，"), some(supplementary)), some(initial), F.lit(""))


def treatment(plan: Column, procedure: Column) -> Column:
    return F.coalesce(F.nullif(plan, F.lit("")), F.nullif(procedure, F.lit("")), F.lit(""))


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def overlap(before: str, after: str) -> int:
    """Length of the shortest end of one text that the other begins with; 0 if there is none.

    Ends and beginnings of every length are compared by a rolling hash, and those that
    agree by their characters, so the time grows with the texts' length.
    """
    n = min(len(before), len(after))
    if not n:
        return 0
    code = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    up, down = (np.full(n, x, np.uint64) for x in (_ODD, _INVERSE))
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    begins = np.cumsum(code(after[:n]) * up)
    ends = np.cumsum(code(before[-n:])[::-1] * down) * up
    return next((k for k in (np.flatnonzero(begins == ends) + 1).tolist() if before.endswith(after[:k])), 0)


def splice_texts(before: str, after: str) -> str:
    """Joined over the shortest overlap of one's end with the other's beginning."""
    return before + after[overlap(before, after) :]


@F.pandas_udf(T.StringType())
def _spliced(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else splice_texts(a, b) for a, b in zip(before, after, strict=True)], dtype=object)


def splice(before: Column, after: Column) -> Column:
    """The texts joined over the shortest overlap of one's end with the other's beginning; null if either is."""
    return _spliced(before, after)

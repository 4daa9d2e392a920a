"""Files of a folder to documents: HTML, Markdown, CSV, Excel, Word and EPUB.

A file is a row of ``binaryFile`` (path, content). Each becomes HTML or Markdown text
inside its Arrow batch, and the operators for those take it from there. Files whose
kind isn't known, or that can't be opened, give no document and say why in ``error``.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import struct
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import replace
from datetime import datetime, timedelta
from html import escape
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.charsets import Charsets
from quarry.functions.dom import parse
from quarry.functions.md_html import convert
from quarry.functions.pieces import ROWS, SIZE, pieces
from quarry.operators.html import HtmlConfig, extract_html
from quarry.operators.markdown import MarkdownConfig, extract_markdown
from quarry.sources import xls

#: The first that decodes the bytes is the file's; the last decodes any. Fixed values.
CODECS = ("utf-8", "gb2312", "gbk", "utf_16", "ascii", "big5", "big5hkscs", "cp037")
KINDS = ("html", "htm", "md", "markdown", "csv", "xlsx", "xls", "docx", "epub")
# Where a page states its character set, and larger sets that stand for what is stated.
DECLARED = (re.compile(rb"""<meta.*?charset=["']*(.+?)["'>]""", re.I), re.compile(rb"""<meta.*?content=["']*;?charset=(.+?)["'>]""", re.I), re.compile(rb"""^<\?xml.*?encoding=["']*(.+?)["'>]"""))
LARGER = {"big5": "big5hkscs", "gb2312": "gb18030", "ascii": "utf-8", "maccyrillic": "cp1251", "win1251": "cp1251", "win-1251": "cp1251", "windows-1251": "cp1251"}
# Numbers of the built-in formats of days and of times.
DAYS, TIMES = (14, 15, 16, 17, 22), (18, 19, 20, 21, 45, 46, 47)
#: Rows of a spreadsheet that are read as one page.
PART = 2_000


def find_codec(content: bytes, model: Charsets | None = None) -> str:
    """The first listed codec that decodes the content; with a model the likeliest of its sets."""
    if model is not None:
        return model.find(content)
    for name in CODECS:
        try:
            content.decode(name)
        except UnicodeDecodeError:
            continue
        return name
    return "utf-8"


def find_charset(content: bytes, model: Charsets | None = None) -> str:
    """The character set that a page states, in its larger form, if it decodes the page; else the likeliest by a model, or the first codec that does."""
    for name in (x.decode("ascii", "replace").strip().lower() for p in DECLARED for x in p.findall(content)):
        name = LARGER.get(name, name)
        try:
            content.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
        return name
    if model is None:
        return find_codec(content)
    name = model.find(content, markup=True)
    return LARGER.get(name, name)


@F.pandas_udf(T.StringType())
def charset(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else find_charset(bytes(b)))


def page_charset(content: Column, model: Charsets) -> Column:
    """A page's character set as it states it, else the likeliest."""

    @F.pandas_udf(T.StringType())
    def find(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: None if b is None else find_charset(bytes(b), model))

    return find(content)


def decode(content: bytes, model: Charsets | None = None) -> str:
    return content.decode(find_codec(content, model), "replace")


@F.pandas_udf(T.StringType())
def codec(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else find_codec(bytes(b)))


def _table(rows: list[list[str]]) -> str:
    return "<table>" + "".join("<tr>" + "".join(f"<td>{escape(c, quote=False)}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def csv_rows(text: str) -> list[list[str]]:
    """The rows that are as wide as the header; wider ones are bad lines, narrower ones end in empty cells."""
    rows = [r for r in csv.reader(io.StringIO(text)) if r]
    head = rows[0] if rows else []
    return [r + [""] * (len(head) - len(r)) for r in rows if len(r) <= len(head)]


def csv_html(text: str) -> str:
    return _table(csv_rows(text))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _under(root, name):
    return (e for e in root.iter() if _local(e.tag) == name)


def _string(e) -> str:
    return "".join(t.text or "" for t in _under(e, "t"))


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def number_text(value: float, style: int = 0, code: str = "", late: bool = False) -> str:
    """A cell's number as it is read: days and times by its format, whole numbers without a point."""
    signs = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.', "", code).lower() if style > 163 or code else ""
    day = style in DAYS or bool(re.search("[yd]", signs)) or ("m" in signs and not re.search("[hs]", signs))
    if day or style in TIMES or re.search("[hs]", signs):
        try:
            at = (datetime(1904, 1, 1) if late else datetime(1899, 12, 30 if value >= 60 else 31)) + timedelta(seconds=round(value * 86400))
        except OverflowError:
            return repr(value)
        return str(at) if day or value >= 1 else str(at.time())
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def _numbers(z: zipfile.ZipFile) -> tuple[list[tuple[int, str]], bool]:
    """(format, code) of each cell style, and whether day 0 is in 1904."""
    names, styles, late = z.namelist(), [], False
    if "xl/styles.xml" in names:
        root = ElementTree.fromstring(z.read("xl/styles.xml"))
        codes = {int(e.get("numFmtId", 0)): e.get("formatCode", "") for e in _under(root, "numFmt")}
        for cells in _under(root, "cellXfs"):
            styles = [(int(e.get("numFmtId", 0)), codes.get(int(e.get("numFmtId", 0)), "")) for e in cells]
    if "xl/workbook.xml" in names:
        late = any(e.get("date1904") in ("1", "true") for e in _under(ElementTree.fromstring(z.read("xl/workbook.xml")), "workbookPr"))
    return styles, late


def _each(z: zipfile.ZipFile, part: str, name: str):
    """The elements of this name as the part is read; each is emptied behind its use."""
    with z.open(part) as f:
        for _, e in ElementTree.iterparse(f):
            if _local(e.tag) == name:
                yield e
                e.clear()


def _xlsx_sheets(content: bytes) -> Iterator[Iterable[dict[int, str]]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = [_string(e) for e in _each(z, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
        numbers = _numbers(z)
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        for n in sheets:
            yield _sheet(_each(z, n, "row"), shared, *numbers)


def xlsx_html(content: bytes, last_sheet_only: bool = False) -> str:
    """A table for each sheet with rows, days and times as such; rows without a value go."""
    return "".join(map(_table, _tables(_xlsx_sheets(content), last_sheet_only)))


def xls_html(content: bytes, last_sheet_only: bool = False) -> str:
    return "".join(map(_table, _tables(xls.each_sheet(content, number_text), last_sheet_only)))


def _tables(sheets: Iterable[Iterable[dict[int, str]]], last_only: bool) -> list[list[list[str]]]:
    """Rows of each sheet that has any, all as wide as its widest."""
    tables = []
    for cells in sheets:
        rows = [[r.get(i, "") for i in range(max(r) + 1)] for r in cells if any(r.values())]
        width = max(map(len, rows), default=0)
        for r in rows:
            r += [""] * (width - len(r))
        if rows:
            tables = [rows] if last_only else [*tables, rows]
    return tables


def _sheet(rows: Iterable, shared: list[str], styles: list[tuple[int, str]], late: bool) -> Iterator[dict[int, str]]:
    for row in rows:
        cells: dict[int, str] = {}
        for c in _under(row, "c"):
            value, kind = next((v.text or "" for v in _under(c, "v")), ""), c.get("t", "n")
            if kind == "s":
                value = shared[int(value)]
            elif kind == "inlineStr":
                value = _string(c)
            elif kind == "b":
                value = str(value == "1")
            elif kind == "n" and value:
                style = int(c.get("s", 0))
                value = number_text(float(value), *(styles[style] if style < len(styles) else (0, "")), late)
            cells[_column(c.get("r", "")) if c.get("r") else len(cells)] = value
        yield cells


# Word.


def _value(e, name: str) -> str:
    """The value of the first element of this name below."""
    return next((v for x in _under(e, name) for k, v in x.items() if _local(k) == "val"), "")


def _attribute(e, name: str) -> str:
    return next((v for k, v in e.items() if _local(k) == name), "")


def docx_html(content: bytes, name: str = "") -> str:
    """Paragraphs, headings by their style, lists, links and tables in order, under the file's name as title; the document's own title goes where it stands first."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        part = lambda n: ElementTree.fromstring(z.read(n)) if n in z.namelist() else None
        root, numbering, relations = ElementTree.fromstring(z.read("word/document.xml")), part("word/numbering.xml"), part("word/_rels/document.xml.rels")
    links = {e.get("Id"): e.get("Target", "") for e in relations} if relations is not None else {}
    body = next(_under(root, "body"), root)
    blocks = [e for e in body if _local(e.tag) in ("p", "tbl")]
    if blocks and _value(blocks[0], "pStyle") == "Title":
        blocks = blocks[1:]
    out, items = [], []
    for e in blocks:
        if _local(e.tag) == "p" and (number := next(_under(e, "numPr"), None)) is not None and not _level(e):
            items.append((int(_value(number, "ilvl") or 0), _ordered(numbering, _value(number, "numId"), _value(number, "ilvl") or "0"), _text(e, links)))
            continue
        out.append(_lists(items))
        items = []
        out.append(_block(e, links))
    out.append(_lists(items))
    title = posixpath.splitext(posixpath.basename(name))[0]
    return (f"<title>{escape(title)}</title>" if title else "") + "".join(out)


def _ordered(numbering, num: str, level: str) -> bool:
    if numbering is None:
        return False
    abstract = next((_value(e, "abstractNumId") for e in _under(numbering, "num") if _attribute(e, "numId") == num), "")
    kind = next((_value(x, "numFmt") for e in _under(numbering, "abstractNum") if _attribute(e, "abstractNumId") == abstract for x in _under(e, "lvl") if _attribute(x, "ilvl") == level), "bullet")
    return kind not in ("bullet", "none")


def _lists(items: list[tuple[int, bool, str]]) -> str:
    """Nested lists of (depth, whether numbered, HTML)."""
    out, open_ = [], []
    for depth, ordered, html in items:
        tag = "ol" if ordered else "ul"
        while open_ and (open_[-1][0] > depth or (open_[-1][0] == depth and open_[-1][1] != tag)):
            out.append(f"</li></{open_.pop()[1]}>")
        if open_ and open_[-1][0] == depth:
            out.append("</li>")
        else:
            out.append(f"<{tag}>")
            open_.append((depth, tag))
        out.append(f"<li>{html}")
    out += [f"</li></{tag}>" for _, tag in reversed(open_)]
    return "".join(out)


def _text(e, links: dict[str, str]) -> str:
    """HTML of runs: links, raised text, line breaks and tabs."""
    out = []
    for x in e:
        kind = _local(x.tag)
        if kind == "hyperlink":
            to, inner = links.get(_attribute(x, "id"), ""), _text(x, links)
            out.append(f'<a href="{escape(to)}">{inner}</a>' if to else inner)
        elif kind == "r" and _value(x, "vertAlign") == "superscript":
            out.append(f"<sup>{_text(x, links)}</sup>")
        elif kind == "t":
            out.append(escape(x.text or "", quote=False))
        elif kind in ("br", "cr"):
            out.append("<br>")
        elif kind == "tab":
            out.append(" ")
        elif kind in ("r", "ins", "smartTag", "sdt", "sdtContent", "fldSimple"):
            out.append(_text(x, links))
    return "".join(out)


def _level(e) -> int:
    level = re.fullmatch(r"(?i)heading\s*([1-6])|([1-6])", _value(e, "pStyle"))
    return int(level[1] or level[2]) if level else 0


def _block(e, links: dict[str, str]) -> str:
    if _local(e.tag) == "tbl":
        return _word_table(e, links)
    tag = f"h{n}" if (n := _level(e)) else "p"
    return f"<{tag}>{_text(e, links)}</{tag}>"


def _word_table(e, links: dict[str, str]) -> str:
    rows, above = [], {}
    for r in (x for x in e if _local(x.tag) == "tr"):
        row, at = [], 0
        for c in (x for x in r if _local(x.tag) == "tc"):
            wide = int(_value(c, "gridSpan") or 1)
            merged = next(_under(c, "vMerge"), None)
            if merged is not None and _attribute(merged, "val") != "restart" and at in above:
                above[at]["rowspan"] += 1
            else:
                cell = {"html": " ".join(filter(None, (_text(p, links) for p in _under(c, "p")))), "colspan": wide, "rowspan": 1}
                row.append(cell)
                above[at] = cell
            at += wide
        rows.append(row)
    show = lambda c: "<td" + "".join(f' {k}="{c[k]}"' for k in ("colspan", "rowspan") if c[k] > 1) + f">{c['html']}</td>"
    return "<table>" + "".join("<tr>" + "".join(map(show, r)) + "</tr>" for r in rows) + "</table>"


def epub_html(content: bytes, name: str) -> str:
    """The bodies of its pages in the archive's order, under the book's title or the file's name."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        opf = next((n for n in z.namelist() if n.endswith(".opf")), None)
        found = next((e.text for e in _under(ElementTree.fromstring(z.read(opf)), "title") if e.text), None) if opf else None
        title = (found or "").strip().lstrip("#").strip() or posixpath.basename(name).split(".")[0]
        bodies = []
        for n in z.namelist():
            if n.endswith((".html", ".xhtml")):
                root = parse(decode(z.read(n)))
                body = next(iter(root.all("body")), root)
                for e in [body, *body.all()]:
                    for k in ("xmlns", "xml:lang"):
                        e.attrs.pop(k, None)
                body.tag = "div"
                bodies.append(body.html())
    return f"<html><head><title>{escape(title)}</title></head><body>{''.join(bodies)}</body></html>"


#: What tells that a file can't be opened.
_BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, struct.error)


def file_text(path: str, content: bytes, last_sheet_only: bool = False, markdown_as_html: bool = False, charsets: Charsets | None = None) -> tuple[str | None, str | None]:
    """(text, error): HTML, or the Markdown itself; ``charsets`` finds the character set of what states none."""
    kind = path.rsplit(".", 1)[-1].lower()
    try:
        if kind in ("html", "htm"):
            return content.decode(find_charset(content, charsets), "replace"), None
        if kind in ("md", "markdown"):
            return convert(decode(content, charsets)) if markdown_as_html else decode(content, charsets), None
        if kind == "csv":
            return csv_html(decode(content, charsets)), None
        if kind == "xlsx":
            return xlsx_html(content, last_sheet_only), None
        if kind == "xls":
            return xls_html(content, last_sheet_only), None
        if kind == "docx":
            return docx_html(content, path), None
        if kind == "epub":
            return epub_html(content, path), None
        return None, f"no reader for .{kind}"
    except _BROKEN as e:
        return None, f"{type(e).__name__}: {e}"


def file_pages(path: str, content: bytes, last_sheet_only: bool = False, markdown_as_html: bool = False, charsets: Charsets | None = None) -> Iterator[tuple[str, int, int, int]]:
    """The texts that stand for a file where tables are cut to their rows: (text, skip, what ord is larger by, what row is larger by).

    A spreadsheet gives one for about ``PART`` rows of each table, so that only its cells are held whole. Each begins with the
    table's first two rows, by which its header is found; where the second is none of it, later ones skip it. A file that
    can't be read gives nothing.
    """
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "xlsx", "xls"):
        text, error = file_text(path, content, last_sheet_only, markdown_as_html, charsets)
        if error is None:
            yield text, 0, 0, 0
        return
    try:
        tables = [csv_rows(decode(content, charsets))] if kind == "csv" else _tables(_xlsx_sheets(content) if kind == "xlsx" else xls.each_sheet(content, number_text), last_sheet_only)
    except _BROKEN:
        return
    ord_ = 0
    for k, rows in enumerate(tables):
        if not rows or not rows[0]:
            continue
        # a neighbour of one cell may be the caption
        behind = "".join(_table(t) for t in tables[k + 1 : k + 2] if len(t) == len(t[0]) == 1)
        # as text.merged_header does, over what the page keeps of a cell
        head = 2 if len(rows) > 1 and rows[0][0].replace("\0", "") == rows[1][0].replace("\0", "") else 1
        for at in range(0, len(rows), PART):
            top, skip = ([], 0) if at == 0 else (rows[:2], 2 - head)
            before = 0 if at == 0 else at - head - skip
            yield _table(top + rows[at : at + PART]) + behind, skip, ord_ + before, before
        ord_ += max(0, len(rows) - head)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")


def texts(files: DataFrame, last_sheet_only: bool = False, markdown_as_html: bool = False, charsets: Charsets | None = None) -> DataFrame:
    """path, kind, text, error."""

    @F.pandas_udf("struct<text:string,error:string>")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for some in pieces(batches):
            yield pd.DataFrame([file_text(p, bytes(c or b""), last_sheet_only, markdown_as_html, charsets) for p, c in zip(*some, strict=True)], columns=["text", "error"])

    return files.select("path", _kind().alias("kind"), read("path", "content").alias("_t")).select("path", "kind", "_t.*")


def _pages(files: DataFrame, *how) -> DataFrame:
    """path, kind, text, _skip, _ord, _row of what ``file_pages`` makes of each file."""
    schema = pa.schema([("path", pa.string()), ("text", pa.string()), ("_skip", pa.int32()), ("_ord", pa.int32()), ("_row", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, have = [], 0
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                for page in file_pages(path.as_py(), content.as_py() or b"", *how):
                    rows.append((path.as_py(), *page))
                    have += len(page[0])
                    if len(rows) >= ROWS or have > SIZE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, have = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(read, "path string, text string, _skip int, _ord int, _row int").withColumn("kind", _kind())


def _kind() -> Column:
    return F.lower(F.substring_index("path", ".", -1))


def extract_files(files: DataFrame, html: HtmlConfig | None = None, markdown: MarkdownConfig | None = None, last_sheet_only: bool = False, markdown_as_html: bool = False, charsets: Charsets | None = None) -> DataFrame:
    """path, ord, titles, content_type, row, page_content, record of every file that could be read.

    Main-content selection is for HTML and Word only.  HTML, Word and EPUB files are
    tried for medical records first.  Markdown is read as it is, its links kept, or with
    ``markdown_as_html`` by way of HTML, without a title of the file.
    """
    html, markdown = replace(html or HtmlConfig(), sniff_records=True), markdown or MarkdownConfig()
    how = last_sheet_only, markdown_as_html, charsets
    name = F.regexp_replace("path", r"^.*/", "")
    # what Word and EPUB files become is a page; its title is in it
    page = F.when(F.col("kind").isin("docx", "epub"), F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(".html"))).otherwise(name)
    # a spreadsheet has no title, whatever its name; books and tables are taken whole
    named, chosen = F.col("kind").isin("html", "htm", "docx", "epub"), F.col("kind").isin("html", "htm", "docx")
    marked = () if markdown_as_html else ("md", "markdown")
    some = files.filter(~_kind().isin(*marked)) if marked else files
    if html.separate_tables and html.cut_table_to_line:
        t = _pages(some, *how)
    else:  # a table is one text
        t = texts(some, *how).filter("error IS NULL").withColumns(dict.fromkeys(("_skip", "_ord", "_row"), F.lit(0)))
    out = extract_html(t.select("path", "text", "_skip", "_ord", "_row", F.when(named, page).alias("_n"), chosen.alias("_s")), html, "text", "_n", "_s")
    own = {"ord": F.col("ord") + F.col("_ord"), "row": F.col("row") + F.col("_row")}
    out = out.filter("ord >= _skip").withColumns(own).drop("_n", "_s", "_skip", "_ord", "_row")
    if markdown_as_html:
        return out
    t = texts(files.filter(_kind().isin(*marked)), *how).filter("error IS NULL")
    return out.unionByName(extract_markdown(t.select("path", "text"), markdown, "text"), allowMissingColumns=True)

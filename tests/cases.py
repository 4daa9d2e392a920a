"""Small fixtures with known rows: one case each for what operators decide, beside the registered queries over tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from quarry.functions import readable
from quarry.functions import text as X
from quarry.functions.dom import parse
from quarry.operators import html as H
from quarry.operators import markdown as M
from quarry.operators import pdf as P
from quarry.operators import records as E
from quarry.operators import retrieval as R
from quarry.operators import split as S
from quarry.schema import TITLE_SEPARATOR
from quarry.sources import files, rest
from quarry.sources.office import archive, xls

from tests import fixtures as FX

CASES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        CASES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def expect(schema: str, rows: list[tuple]):
    """A case whose rows are known."""
    return query("WITH " + FX.values("expected", (schema, rows)) + " SELECT * FROM expected")


def _rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("titles", F.array_join("titles", " > "))


DOCS = "id INT, ord INT, titles STRING, page_content STRING"
TABLES = "id INT, ord INT, titles STRING, row INT, page_content STRING"


def _pages(spark, pages, **cfg):
    html = _rows(spark, "id INT, html STRING", list(enumerate(pages, 1)))
    return _flat(H.extract_html(html, H.HtmlConfig(**({"use_summary": False} | cfg))))


# HTML: layout, headings, links, choices.

LAYOUT = [
    "<h1>A <b>x</b></h1>lost<p>Hello <b>W</b>, see<sup>[1-3]</sup> m<sup>2</sup> (ok).<br>x</p><h3>C</h3>c<p>d<h2>B</h2><p>b",
    "<p>a</p><p>b</p><div>c</div><ul><li>d<li>e</ul>f",
    "<p>a<b>b</b><i>, c</i> ( <u>d</u> ) <s>e</s></p>",
    "<p>x<sup>12</sup>y<sup>[1,3-5]</sup>z<sup>ab</sup>5</p>",
    "<p><input type=checkbox checked><span>yes</span><input type=radio><span>no</span> <a href=x>li\nnk</a>",
    "<title>T &amp; U</title><h2>B\r\nC</h2><p>p<script>s</script><!-- c --><style>t</style><iframe>f</iframe>q",
    None,
    "",
    "\0<p>n\0ul</p>",
    "<h5>deep</h5><p>a<h1></h1><p>b",
]


@expect(DOCS, [
    (1, 0, "A x", "Hello W, see m^2 (ok).\nx"), (1, 1, "A x > C", "d"), (1, 2, "A x > B", "b"),
    (2, 0, "", "a\n\nb\n\nc\n\nd\ne\n\nf"),
    (3, 0, "", "a b, c ( d) e"),
    (4, 0, "", "x^12 y z ab^5"),
    (5, 0, "", "yes li nk"),
    (6, 0, "T & U", "T & U"), (6, 1, "T & U > B C", "p q"),
    (9, 0, "", "nul"),
    (10, 0, "", "deep\n\na"), (10, 1, "", "b"),
])
def html_layout_cases(spark, sf_dir):
    return _pages(spark, LAYOUT).select("id", "ord", "titles", "page_content")


@expect(DOCS, [(1, 0, "H", "T\n\ni\n\nb"), (2, 0, "H", "T\n\ni"), (2, 1, "H > H", "b"), (3, 0, "T", "T\n\nonly")])
def html_first_header_cases(spark, sf_dir):
    """The first heading as title, taken out or left; without one the title element's."""
    page = "<title>T</title><p>i</p><h2>H</h2><p>b"
    one = _pages(spark, [page], use_first_header_as_title=True)
    two = _pages(spark, ["", page, "<title>T</title><p>only"], use_first_header_as_title=True, prevent_duplicate_header=False)
    return one.unionByName(two).select("id", "ord", "titles", "page_content")


@expect(DOCS, [(1, 0, "# A > ## B", "# A\n## B\nx"), (1, 1, "# A > ## B > #### D", "## B\n#### D\ny"), (1, 2, "# A > ## E", "# A\n## E\nz"), (2, 0, "", "plain")])
def html_title_prefix_cases(spark, sf_dir):
    return _pages(spark, ["<h1>A</h1><h2>B</h2><p>x<h4>D</h4><p>y<h2>E</h2><p>z", "<p>plain"], contain_closest_title_levels=2, title_convert_to_markdown=True).select("id", "ord", "titles", "page_content")


@expect("id INT, titles STRING, page_content STRING", [(1, "name", "x"), (2, "T", "T\n\nx"), (3, "", "x")])
def html_file_title_cases(spark, sf_dir):
    """The title element's text, the file's name up to its first dot, or none."""
    pages = _rows(spark, "id INT, html STRING, file STRING", [(1, "<p>x", "a/name.tar.html"), (2, "<title>T</title><p>x", "f.html"), (3, "<p>x", None)])
    return _flat(H.extract_html(pages, H.HtmlConfig(use_summary=False), file_name="file")).select("id", "titles", "page_content")


# HTML: tables.

GRIDS = [
    "<title>T</title><h2>B</h2><p>表1</p><table><tr><th colspan=2>k<th>v<tr><td rowspan=2>1<td>2<td>3<tr><td>4<td>5</table><p>end",
    "<table><tr><th rowspan=2>a<th colspan=2>g<tr><th>x<th>y<tr><td>1<td>2<td>3</table>",
    "<h1>H</h1><table><tr><td>c<tr><td> v </table><div>见表</div><h1>I</h1><table><tr><td>p<td>q<tr><td>1</table>",
]


@expect(TABLES, [
    (1, 2, "T > B > 表1", 0, "k为1的k是2\n\nk为1的v是3"), (1, 3, "T > B > 表1", 1, "k为1的k是4\n\nk为1的v是5"),
    (2, 0, "", 0, "a为1的g x是2\n\na为1的g y是3"),
    (3, 1, "H > 见表", 0, "c是v"), (3, 2, "I", 0, "p为1的q是"),
])
def html_table_cases(spark, sf_dir):
    """Spans, captions, two-row headers, one column, short rows."""
    return _pages(spark, GRIDS).filter("content_type = 'table'").select("id", "ord", "titles", "row", "page_content")


@expect(TABLES, [
    (1, 2, "T > ## B > 表1", None, "| k | v |\n| --- | --- |\n| 1 | 2 | 3 |\n| 4 | 5 |"),
    (2, 0, "", None, "| a | g |\n| --- | --- |\n| x | y |\n| --- | --- |\n| 1 | 2 | 3 |"),
    (3, 1, "# H > 见表", None, "| c |\n| --- |\n| v |"), (3, 2, "# I", None, "| p | q |\n| --- | --- |\n| 1 |"),
])
def html_whole_table_cases(spark, sf_dir):
    return _pages(spark, GRIDS, cut_table_to_line=False, title_convert_to_markdown=True).filter("content_type = 'table'").select("id", "ord", "titles", "row", "page_content")


@expect("id INT, cells STRING, csv STRING", [(1, "k,k,v|1,2,3|1,4,5", "k,k,v\r\n1,2,3\r\n1,4,5\r\n"), (2, "a,g,g|a,x,y|1,2,3", "a,g,g\r\na,x,y\r\n1,2,3\r\n"), (3, 'a,"b"', '"a,""b"""\r\n')])
def html_grid_cases(spark, sf_dir):
    """Cells with spans filled in, and the table as CSV, before any header is merged."""
    pages = _rows(spark, "id INT, html STRING", list(enumerate([*GRIDS[:2], "<table><tr><td>a,&quot;b&quot;</table>"], 1)))
    cells = F.get(H.page_udf(H.HtmlConfig(use_summary=False))("html", F.lit(None).cast("string")).getField("tables"), F.lit(0))["cells"]
    return pages.select("id", cells.alias("c")).select("id", F.array_join(F.transform("c", lambda r: F.array_join(r, ",")), "|").alias("cells"), X.table_csv(F.col("c")).alias("csv"))


@expect("id INT, titles STRING, page_content STRING", [(1, "", "| a | | b |")])
def html_tables_in_place(spark, sf_dir):
    """With separation off a table's text stays in its section."""
    return _pages(spark, ["<table><tr><td>| a |<td>| b |</table>"], separate_tables=False).select("id", "titles", "page_content")


@expect("id INT, tree STRING", [
    (1, "<html><p>a</p><p>b <b>c</b></p></html>"), (2, "<html></html>"), (3, "<html></html>"),
    (4, "<html><ul><li>x</li><li>y</li></ul></html>"), (5, "<html><table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table></html>"), (6, "<html><p>1 &lt; 2 &amp; é</p></html>"),
])
def html_tree_cases(spark, sf_dir):
    """Trees of broken markup: tags that close others, nothing, entities."""
    pages = _rows(spark, "id INT, html STRING", list(enumerate(["<p>a<p>b <b>c", None, "  ", "<ul><li>x<li>y", "<table><tr><td>1<td>2<tr><td>3", "<p>1 &lt; 2 &amp; &eacute;<script>x</script>"], 1)))

    @F.pandas_udf("string")
    def tree(html: pd.Series) -> pd.Series:
        return html.map(lambda h: parse(h).html())

    return pages.select("id", tree("html").alias("tree"))


# Main content.

NEWS = "<p>Words, that matter, and more of them here.</p>"
MAIN = [
    f"<body><div class=sidebar>{'<p>Noise, noise, noise and more of it.</p>' * 9}</div><div id=content>{NEWS * 6}</div></body>",
    f"<body><div class=one>{'<p>First, first, first and more of it.</p>' * 4}</div><div class=two>{NEWS * 4}</div></body>",
    "<body><p>short</p></body>",
    f"<body><div id=content><form><p>Name, first name, and all the others.</p></form><h2><a href=x>all link</a></h2><h2>kept</h2>{NEWS * 7}<iframe src=https://www.youtube.com/v></iframe><iframe src=http://x></iframe></div></body>",
    f"<body><div>A long text, without any blocks in it, that counts.</div>{NEWS * 6}</body>",
]
_NEWS = "Words, that matter, and more of them here."


@expect("id INT, how STRING, article STRING", [
    (1, "default", " ".join([_NEWS] * 6)),
    (2, "default", " ".join(["First, first, first and more of it."] * 4 + [_NEWS] * 4)),
    (2, "against one", " ".join([_NEWS] * 4)),
    (3, "default", "short"),
    (4, "default", "kept " + " ".join([_NEWS] * 7) + " VIDEO"),
    (5, "default", "A long text, without any blocks in it, that counts. " + " ".join([_NEWS] * 6)),
])
def main_content_cases(spark, sf_dir):
    """Unlikely names, names against, too little text, forms, link headings and foreign frames, text in divisions."""
    pages = _rows(spark, "id INT, html STRING", list(enumerate(MAIN, 1)))

    def article(how):
        @F.pandas_udf("string")
        def text(html: pd.Series) -> pd.Series:
            return html.map(lambda h: " ".join(" ".join(readable.summary(h, how).strings()).split()))

        return text

    some = pages.select("id", F.lit("default").alias("how"), article(readable.Readability())("html").alias("article"))
    return some.unionByName(pages.filter("id = 2").select("id", F.lit("against one").alias("how"), article(readable.Readability(negative="one,tag-x", retry=100))("html").alias("article")))


@expect("id INT, weight INT", [(1, 25), (2, -25), (3, 50), (4, 0), (5, 25), (6, -50), (7, 0)])
def class_weight_cases(spark, sf_dir):
    """Names that speak for and against an element, words of one's own, and the tag by ``tag-``."""
    nodes = [(1, "div", "article", None), (2, "div", "sidebar", None), (3, "div", "post", "main"), (4, "div", "footer", "body"), (5, "ins", "mine", "plain"), (6, "aside", "widget", ""), (7, "aside", "yours-mine", "mine")]
    n = _rows(spark, "id INT, tag STRING, class STRING, node_id STRING", nodes)
    return n.select("id", X.class_weight(F.col("class"), F.col("node_id"), F.col("tag"), "mine", "yours|tag-aside").alias("weight"))


FACTS = [
    ("<title>A fine long title for all - Site</title><meta name=author content='N. N.'><h1>A fine long title</h1><body><p style=x width=1 bgcolor=y onclick=z class=k>t<script>s</script><a href='b?c'>l</a></body>", "http://h/a/"),
    ("<base href='http://b/x/'><title>one two three four | five</title><body><img src=i.png></body>", None),
    ("<title>«A—B»  c</title><body></body>", None),
    ("<title>Site: the news of the whole day</title><body>x</body>", None),
    ("<title></title><meta name=author content=''><body>x</body>", None),
    ("<title>short: t</title><h2>no match here at all</h2>", None),
]


@expect("id INT, title STRING, author STRING, short_title STRING, content STRING", [
    (1, "A fine long title for all - Site", "N. N.", "A fine long title", '<body><p class="k">t<a href="http://h/a/b?c">l</a></p></body>'),
    (2, "one two three four | five", "[no-author]", "one two three four", '<body><img src="http://b/x/i.png"></body>'),
    (3, '"A-B" c', "[no-author]", '"A-B" c', "<body></body>"),
    (4, "Site: the news of the whole day", "[no-author]", "the news of the whole day", "<body>x</body>"),
    (5, "[no-title]", "[no-author]", "", "<body>x</body>"),
    (6, "short: t", "[no-author]", "short: t", "<html><title>short: t</title><h2>no match here at all</h2></html>"),
])
def page_facts_cases(spark, sf_dir):
    pages = _rows(spark, "id INT, html STRING, url STRING", [(i, h, u) for i, (h, u) in enumerate(FACTS, 1)])
    return pages.select("id", H.page_facts()("html", "url").alias("f")).select("id", "f.title", "f.author", "f.short_title", "f.content")


@expect("id INT, title STRING", [(1, 'a - b "c" d'), (2, "x - y"), (3, ""), (4, None)])
def title_normal_cases(spark, sf_dir):
    return _rows(spark, "id INT, t STRING", [(1, " a —\nb «c»  d "), (2, "x &ndash; y"), (3, ""), (4, None)]).select("id", X.normal_title(F.col("t")).alias("title"))


# Markdown.

MARKDOWN = [
    "intro [l](u)\n# A\na ![[pic]] x\n```\n# not\n```\n## B\n\n##  \nb\n# C\n",
    "x\n| a | b |\n| - | - |\n| 1 | [2](u) |\ny\n\nc | d\n--- | ---\n3 | 4\nz",
    "# T\n```py\n## in\n```\nafter",
    "",
    None,
    "# only",
]


@expect("id INT, ord INT, titles STRING, content_type STRING, page_content STRING", [
    (1, 0, "", None, "intro l"), (1, 1, "# A", None, "# A\na  x\n\n```\n# not\n```"), (1, 2, "# A", None, "# A\nb"),
    (2, 0, "", None, "xy\nz"), (2, 1, None, "table", "| a | b |\n| - | - |\n| 1 | 2 |"), (2, 2, None, "table", "c | d\n--- | ---\n3 | 4"),
    (3, 0, "# T", None, "# T\n```py\n## in\n```\n\nafter"),
])
def markdown_cases(spark, sf_dir):
    """Header stack, an empty header, fences, both kinds of tables, links and images out, one title in front."""
    docs = _rows(spark, "id INT, page_content STRING", list(enumerate(MARKDOWN, 1)))
    return _flat(M.extract_markdown(docs, M.MarkdownConfig(remove_hyperlinks=True, remove_images=True, contain_closest_title_levels=1)))


AS_HTML = "# Head *one*\n\nA [link](http://u) and `code <b>`,\nsecond **line**.\n\n- x\n- y\n  1. z\n\nSub\n---\n\n> quote\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\n# no head\n```\n"


@expect("ord INT, titles STRING, content_type STRING, row INT, page_content STRING", [
    (0, "Head one", None, None, "A link and code <b>, second line.\n\nx\ny\n\nz"), (1, "Head one > Sub", None, None, "quote\n\n# no head"), (2, "Head one > Sub", "table", 0, "a为1的b是2"),
])
def markdown_as_html_cases(spark, sf_dir):
    """Markdown by way of HTML: marks, lists, both kinds of headings, quotes, tables as sentences, fences."""
    rows = _rows(spark, "path STRING, content BINARY", [("/d/a.md", AS_HTML.encode())])
    return _flat(files.extract_files(rows, markdown_as_html=True)).select("ord", "titles", "content_type", "row", "page_content")


# Files.


XLSX = archive({
    "xl/sharedStrings.xml": "<sst><si><t>k</t></si><si><t>v</t></si></sst>",
    "xl/styles.xml": '<s><numFmts><numFmt numFmtId="164" formatCode="yyyy&quot;y&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="20"/></cellXfs></s>',
    "xl/worksheets/sheet1.xml": '<w><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row/><row><c r="A3"><v>7</v></c><c r="B3" s="1"><v>43831</v></c><c r="C3"><v>1.50</v></c></row></w>',
    "xl/worksheets/sheet2.xml": '<w><row><c t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" s="3"><v>0.5</v></c></row><row><c r="A3" t="b"><v>1</v></c></row></w>',
})
DOCX = archive({
    "word/document.xml": '<w:d xmlns:w="u" xmlns:r="v"><w:body><w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>Own title</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>a &amp; b</w:t></w:r><w:r><w:rPr><w:vertAlign w:val="superscript"/></w:rPr><w:t>2</w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t xml:space="preserve"> link</w:t></w:r></w:hyperlink></w:p>'
    '<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>one of the things in a list</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>two of the things under it</w:t></w:r></w:p>'
    '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>3</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:d>',
    "word/_rels/document.xml.rels": '<R><Relationship Id="r1" Target="http://x"/></R>',
})
EPUB = archive({"c.opf": '<p xmlns:dc="u"><dc:title># Book</dc:title></p>', "1.xhtml": '<html xmlns="u"><body xmlns="v" xml:lang="en"><h1>One</h1><p>text</p></body></html>', "2.html": "<body><h1>Two</h1><p>more"})
UNTITLED = archive({"1.xhtml": "<body><p>text"})


XLS = xls([(0, 0, "k"), (0, 1, "值"), (1, 0, 7), (1, 1, 43831.0), (3, 0, -2), (3, 1, "s")])
FILES = [
    ("/d/book.a.xlsx", XLSX), ("/d/old.xls", XLS), ("/d/word.a.docx", DOCX), ("/d/c.epub", EPUB), ("/d/u.v.epub", UNTITLED), ("/d/t.csv", "k,v,w\n1,2\n1,2,3,4\n3,,5\n".encode("utf-16")),
    ("/d/p.html", '<meta charset="big5"><title>中文</title><p>臺灣</p>'.encode("big5")), ("/d/m.md", "# 标\n文 [l](u)".encode("gbk")), ("/d/bad.xlsx", b"PK"), ("/d/x.bin", b"x"),
]


@expect("file STRING, ord INT, titles STRING, row INT, page_content STRING", [
    ("book.a.xlsx", 0, "", 0, "k为7的是2020-01-01 00:00:00\n\nk为7的v是1.5"), ("book.a.xlsx", 1, "", 0, "n是12:00:00"), ("book.a.xlsx", 2, "", 1, "n是True"),
    ("old.xls", 0, "", 0, "k为7的值是2020-01-01 00:00:00"), ("old.xls", 1, "", 1, "k为-2的值是s"),
    ("word.a.docx", 0, "word.a", None, "word.a"), ("word.a.docx", 1, "word.a > Head", None, "a & b^2 link\n\none of the things in a list\n\ntwo of the things under it"), ("word.a.docx", 2, "word.a > Head", 0, "k为1的v是2"), ("word.a.docx", 3, "word.a > Head", 1, "k为1的v是3"),
    ("c.epub", 0, "Book", None, "Book"), ("c.epub", 1, "Book > One", None, "text"), ("c.epub", 2, "Book > Two", None, "more"), ("u.v.epub", 0, "u", None, "u\n\ntext"),
    ("t.csv", 0, "", 0, "k为1的v是2\n\nk为1的w是"), ("t.csv", 1, "", 1, "k为3的v是\n\nk为3的w是5"),
    ("p.html", 0, "中文", None, "中文\n\n臺灣"), ("m.md", 0, "# 标", None, "文 [l](u)"),
])
def file_cases(spark, sf_dir):
    """Workbooks old and new, Word, EPUB with and without a title, CSV with bad lines, a page in a stated character set, Markdown in one that is found."""
    return _flat(files.extract_files(_rows(spark, "path STRING, content BINARY", FILES))).select(F.regexp_replace("path", ".*/", "").alias("file"), "ord", "titles", "row", "page_content")


@expect("file STRING, error STRING", [("bad.xlsx", "BadZipFile"), ("x.bin", "no reader for .bin")])
def file_error_cases(spark, sf_dir):
    t = files.texts(_rows(spark, "path STRING, content BINARY", FILES)).filter("error IS NOT NULL")
    return t.select(F.regexp_replace("path", ".*/", "").alias("file"), F.substring_index("error", ":", 1).alias("error"))


@expect("id INT, codec STRING, charset STRING", [(1, "utf-8", "utf-8"), (2, "gb2312", "gb2312"), (3, "gbk", "gbk"), (4, "cp037", "cp037"), (5, "utf-8", "utf-8"), (6, "utf-8", "cp1251"), (7, "gb2312", "gb18030"), (8, "utf-8", "utf-8")])
def codec_cases(spark, sf_dir):
    """The first codec that decodes, and the character set that a page states, in its larger form, if that decodes it."""
    some = ["é中".encode(), "中文".encode("gb2312"), "镕".encode("gbk"), b"\xff\xff\xff", b"", b"<meta charset=win-1251>x", '<meta charset="gb2312">中文'.encode("gb2312"), b"<?xml version='1.0' encoding='nonsense'?>x"]
    d = _rows(spark, "id INT, content BINARY", list(enumerate(some, 1)))
    return d.select("id", files.codec("content").alias("codec"), files.charset("content").alias("charset"))


# Medical records.

_FILL = "持续不断，" * 20
RECORDS = [
    ("a.html", f'<header>[入院记录]</header><p data-name="主诉">主诉：头痛三天</p><p data-id="现病史">现病史：三天前开始，{_FILL}</p><p>性别：[女] 年龄：[40] 诊疗方案：[休息]</p><table><tr><td>初步诊断：<td>x<tr><td>初步诊断：y<td>[感冒]<tr><td>补充诊断：1.发热 医师签名<td>z</table>'),
    ("t.html", f'<header>[谈 话记录]</header><table data-name="基本信息"><tr><td>性别：[男] 科室：[内科]</table><table data-id="谈话记录"><tr><td>谈话记录<td>[{_FILL}]<td>e</table>'),
    ("s.html", f"<header>[手术知情同意书]</header><p>简要病情：[{_FILL}]</p><p>术前诊断：[疝]</p><p>拟实施手术名称：[修补]</p>"),
    ("no.html", "<header>[入院记录]</header><p>主诉：头痛</p>"),
    ("short.html", "<header>[手术知情同意书]</header><p>简要病情：[短]</p><p>术前诊断：[疝]</p><p>拟实施手术名称：[修补]</p>"),
    ("a.htm", "<header>[手术知情同意书]</header><p>简要病情：[短]</p><p>术前诊断：[疝]</p><p>拟实施手术名称：[修补]</p>"),
]


@expect("id INT, kind STRING, found STRING", [(1, "入院记录", "现病史：三"), (2, "谈话记录", None), (3, "手术知情同意书", None), (4, None, None), (5, "手术知情同意书", None), (6, "手术知情同意书", None)])
def record_kind_cases(spark, sf_dir):
    """By the header and all elements that a kind needs; what is found of one of them."""
    d = _rows(spark, "id INT, html STRING", [(i, h) for i, (_, h) in enumerate(RECORDS, 1)])

    @F.pandas_udf("string")
    def found(html: pd.Series) -> pd.Series:
        return html.map(lambda h: n.text()[:5] if (n := E.find_element(parse(h), E.ADMISSION.required[1])) else None)

    return d.select("id", E.record_kind("html").alias("kind"), found("html").alias("found"))


@expect("id INT, content_type STRING, page_content STRING, gender STRING, age STRING, department STRING, diagnosis STRING, treatment STRING", [
    (1, "record", f"## 入院记录\n\n### 基本信息\n\n性别：女 年龄：40 \n\n### 主诉\n\n头痛三天\n\n### 现病史\n\n三天前开始，{_FILL}\n\n### 初步诊断\n\n感冒\n\n### 补充诊断\n\n1.发热\n\n### 诊疗方案\n\n休息\n\n", "女", "40", "", "感冒，1.发热", "休息"),
    (2, "record", f"## 谈话记录\n\n### 基本信息\n\n性别：男 科室：内科 \n\n{_FILL}\n\n", "男", "", "内科", "", ""),
    (3, "record", f"## 手术知情同意书\n\n### 基本信息\n\n\n\n### 简要病情\n\n{_FILL}\n\n### 术前诊断\n\n疝\n\n### 拟实施手术名称\n\n修补\n\n", "", "", "", "", "修补"),
    (4, None, "主诉：头痛", None, None, None, None, None),
    (6, None, "简要病情：[短]\n\n术前诊断：[疝]\n\n拟实施手术名称：[修补]", None, None, None, None, None),
])
def record_page_cases(spark, sf_dir):
    """From the page to the record, where it is one and long enough, and the file is named as a page; else the page's documents."""
    d = _rows(spark, "id INT, file STRING, html STRING", [(i, f, h) for i, (f, h) in enumerate(RECORDS, 1)])
    got = H.extract_html(d, H.HtmlConfig(sniff_records=True), file_name="file")
    return got.select("id", "content_type", "page_content", "record.gender", "record.age", "record.department", "record.diagnosis", "record.treatment")


@expect("id INT, fields STRING", [(1, "主诉=头痛：重|既往史=二|术后=无"), (2, ""), (3, "")])
def record_field_cases(spark, sf_dir):
    """Paragraphs that begin with a field's name; the last of a name counts, a colon in what follows stays."""
    d = _rows(spark, "id INT, c STRING", [(1, "主诉：头痛：重\n\n既往史：一\n\n既往史：二 \n\n术后：无\n\n无冒号\n\n其他：x"), (2, "无"), (3, None)])
    f = E.paragraph_fields(F.col("c"), ("主诉", "既往史", "术后"))
    return d.select("id", F.array_join(F.array_sort(F.transform(F.map_entries(f), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|").alias("fields"))


# PDF.


@expect("id INT, pattern INT", [(1, 0), (2, 0), (3, 0), (4, 1), (5, 2), (6, 3), (7, 4), (8, 7), (9, 8), (10, 9), (11, 10), (12, 11), (13, 12), (14, 13), (15, 14), (16, 15), (17, 16), (18, None), (19, 10), (20, None), (21, 10), (22, None), (23, None), (24, 0)])
def pdf_heading_cases(spark, sf_dir):
    """The first pattern that fits; long lines, sentences and other case fit none. Word characters may stand apart."""
    some = ["摘 要", "introduction", "1. 前言", "第一部分 总论", "第3章", "第二节 范围", "第十条", "1.2.3.4.标", "1.2.3.标", "1.2、标", "1.标题", "（一）总", "一、总则", "PART ONE", "Chapter IV", "Section 2", "Article 9", "chapter IV", "1.Scope, which runs on", "one two three four five six seven eight nine ten eleven", "1.a，b", "keyword: x", "第一章" + "长" * 20, "k e y w o r d s"]
    return _rows(spark, "id INT, t STRING", list(enumerate(some, 1))).select("id", P.heading_pattern(F.col("t")).alias("pattern"))


PDF_LINES = ("doc_id INT, line_idx INT, text STRING", [(d, i, t) for d in (1, 2) for i, t in enumerate(["摘要", "第一章 总则", "正文", "第一节 范围", "更多，正文。", "第二节 对象", "第二章 附则", "1. Scope", "1. Scope, which runs on and on", "第一条"][d - 1 :])])


@expect("doc_id INT, toc_ord INT, level INT, title STRING, line_idx INT", [
    (1, 0, 1, "摘要", 0), (1, 1, 1, "第一章 总则", 1), (1, 2, 2, "第一节 范围", 3), (1, 3, 2, "第二节 对象", 5), (1, 4, 1, "第二章 附则", 6), (1, 5, 3, "第一条", 9),
    (2, 0, 1, "第一章 总则", 0), (2, 1, 2, "第一节 范围", 2), (2, 2, 2, "第二节 对象", 4), (2, 3, 1, "第二章 附则", 5), (2, 4, 3, "第一条", 8),
])
def pdf_outline_cases(spark, sf_dir):
    """A table of contents made of lines; levels by the order in which patterns first appear, those out of 1 to 3 left out."""
    return P.generated_toc(_rows(spark, *PDF_LINES)).withColumn("line_idx", F.col("line_idx").cast("int"))


HEADS = [(1, 0, 1, "A", 2), (1, 1, 2, "B", 3), (1, 2, 3, "C", 5), (1, 3, 3, "D", 6), (1, 4, 1, "E", 7), (1, 5, 3, "F", 8), (2, 0, 2, "X", 1), (2, 1, 1, "Y", 1), (2, 2, 3, "Z", 3), (3, 0, 1, "P", 0)]


@expect("doc_id INT, first INT, titles STRING, page_content STRING", [
    (1, -1, "", "01"), (1, 2, "A", ""), (1, 3, "A > B", "4"), (1, 5, "A > B > C", ""), (1, 6, "A > B > D", ""), (1, 7, "E", ""), (1, 8, "E > F", "9"),
    (2, 1, "X", ""), (2, 1, "Y", "2"), (2, 3, "Y > Z", "456789"), (3, 0, "P", "123456789"),
])
def pdf_section_cases(spark, sf_dir):
    """A preface of two lines, one of one, none; open headings; two headings in a line; empty sections."""
    heads = _rows(spark, "doc_id INT, toc_ord INT, level INT, title STRING, line_idx INT", HEADS)
    line = _rows(spark, "doc_id INT, line_idx INT, text STRING", [(d, i, str(i)) for d in (1, 2, 3) for i in range(10)])
    return P.sections(heads, line).withColumn("titles", F.array_join("titles", " > ")).select("doc_id", "first", "titles", "page_content")


PDF_BLOCKS = [
    (d, p, b, float(y0), float(y1), t)
    for d in (1, 2, 3)
    for p in range(3)
    for b, (y0, y1, t) in enumerate([(0, 10, f"head {d}"), (20, 40, f"第{'一二三'[p]}章 事" if d == 2 else f"{p + 1} Part {p}"), (40, 60, f"body袁\nof {d}.{p}"), (60, 70, "؀؁؂"), (70, 80, ""), (90, 100, f"page {p}")])
]


@expect("doc_id INT, first INT, titles STRING, page_content STRING", [
    (1, 0, "1 Part 0", "body，of 1.0"), (1, 2, "1 Part 0 > 2 Part 1", "body，of 1.13 Part 2body，of 1.2"),
    (2, 0, "第一章 事", "body，of 2.0"), (2, 2, "第二章 事", "body，of 2.1"), (2, 4, "第三章 事", "body，of 2.2"),
    (3, -1, "", "1 Part 0body，of 3.02 Part 1body，of 3.13 Part 2body，of 3.2"),
])
def pdf_document_cases(spark, sf_dir):
    """Blocks to documents: a given table of contents, a made one, none; headers, footers and unreadable blocks left out, texts repaired."""
    blocks = _rows(spark, "doc_id INT, page_idx INT, block_idx INT, y0 DOUBLE, y1 DOUBLE, text STRING", PDF_BLOCKS)
    toc = _rows(spark, "doc_id INT, toc_ord INT, level INT, title STRING, page INT", [(1, 0, 1, "1 Part 0", 1), (1, 1, 2, "2 Part 1", 2), (1, 2, 4, "3 Part 2", 3)])
    return _flat(P.extract_pdf(blocks, toc)).select("doc_id", F.col("first").cast("int").alias("first"), "titles", "page_content")


@expect("id INT, fixed STRING", [(1, "①a②b③"), (2, "①②x"), (3, "[a]"), (4, "咱" + "x" * 31 + "暂"), (5, "Ⅰ期"), (6, "中玉中"), (7, "aⅡb"), (8, "院长。xxxx：")])
def pdf_sign_cases(spark, sf_dir):
    """Runs of circled digits, brackets up to 30 characters, Roman numerals beside Han, and characters that a segmenter protects."""
    some = ["淤a于b盂", "淤于x", "咱a暂", "咱" + "x" * 31 + "暂", "玉期", "中玉中", "a域b"]
    d = _rows(spark, "id INT, t STRING", list(enumerate(some, 1)))
    plain = d.select("id", X.repair_roman(X.repair_brackets(X.repair_circled(F.col("t")))).alias("fixed"))
    words = lambda s: ["院长", *s] if "院长" in s else list(s)
    kept = _rows(spark, "id INT, t STRING", [(8, "院长遥xxxx院")]).select("id", X.repair_punctuation(F.col("t"), words).alias("fixed"))
    return plain.unionByName(kept)


@expect("id INT, readable BOOLEAN", [(1, True), (2, False), (3, False), (4, None), (5, False), (6, True), (7, False)])
def readable_text_cases(spark, sf_dir):
    """Empty text, null, control characters, a third of uncommon ones."""
    some = ["plain 文本", "؀؁", "", None, "abc\r", "aaaaaaaé", "aaé"]
    return _rows(spark, "id INT, t STRING", list(enumerate(some, 1))).select("id", X.is_readable(F.col("t")).alias("readable"))


# Requests.

_AUTO = '"process_rule":{"mode":"automatic","rules":null}'
_OWN = '"process_rule":{"mode":"custom","rules":{"pre_processing_rules":[{"id":"remove_extra_spaces","enabled":true},{"id":"remove_urls_emails","enabled":false}],"segmentation":{"separator":"--","max_tokens":7}}}'


@expect("name STRING, method STRING, path STRING, body STRING, file STRING", [
    ("create_by_text", "POST", "/v1/datasets/s/document/create_by_text", f'{{"name":"n","indexing_technique":"high_quality",{_OWN},"text":"t"}}', None),
    ("create_by_file", "POST", "/v1/datasets/s/document/create_by_file", f'{{"name":null,"indexing_technique":"economy",{_AUTO}}}', "f.txt:abc"),
    ("update_by_text", "POST", "/v1/datasets/s/documents/d/update_by_text", f'{{"name":"n","indexing_technique":"high_quality",{_AUTO},"text":"t"}}', None),
    ("update_by_file", "POST", "/v1/datasets/s/documents/d/update_by_file", f'{{"name":null,"indexing_technique":"high_quality",{_AUTO}}}', "f.txt:abc"),
    ("create_dataset", "POST", "/v1/datasets", '{"name":"n","indexing_technique":"high_quality","description":null,"permission":"all_team_members","provider":"external","external_knowledge_api":"a","external_knowledge_id":"i"}', None),
    ("list_datasets", "GET", "/v1/datasets?page=1&limit=20", None, None),
    ("delete_dataset", "DELETE", "/v1/datasets/s", None, None),
    ("batch_status", "GET", "/v1/datasets/s/documents/b/indexing-status", None, None),
    ("delete_document", "DELETE", "/v1/datasets/s/documents/d", None, None),
    ("list_documents", "GET", "/v1/datasets/s/documents?page=2&keyword=a+b", None, None),
    ("list_documents_all", "GET", "/v1/datasets/s/documents", None, None),
    ("add_segments", "POST", "/v1/datasets/s/documents/d/segments", '{"segments":[{"content":"c","answer":null,"keywords":["k"],"enabled":true}]}', None),
    ("update_segment", "POST", "/v1/datasets/s/documents/d/segments/g", '{"segment":{"content":"c","answer":"a","keywords":null,"enabled":false}}', None),
    ("list_segments", "GET", "/v1/datasets/s/documents/d/segments", '{"keyword":"k"}', None),
    ("delete_segment", "DELETE", "/v1/datasets/s/documents/d/segments/g", None, None),
])
def rest_request_cases(spark, sf_dir):
    """Every call's method, path, body and file."""
    c = lambda x: F.lit(x)
    s, d, g, n, t, content = c("s"), c("d"), c("g"), c("n"), c("t"), c(b"abc")
    calls = {
        "create_by_text": rest.create_by_text(s, n, t, rest.process_rule("--", 7, urls_emails=False)),
        "create_by_file": rest.create_by_file(s, c("/x/f.txt"), content, indexing="economy"),
        "update_by_text": rest.update_by_text(s, d, n, t),
        "update_by_file": rest.update_by_file(s, d, c("f.txt"), content),
        "create_dataset": rest.create_dataset(n, permission="all_team_members", provider="external", external_api="a", external_id="i"),
        "list_datasets": rest.list_datasets(1, c(20)),
        "delete_dataset": rest.delete_dataset(s),
        "batch_status": rest.batch_status(s, c("b")),
        "delete_document": rest.delete_document(s, d),
        "list_documents": rest.list_documents(s, keyword="a b", page=2),
        "list_documents_all": rest.list_documents(s),
        "add_segments": rest.add_segments(s, d, F.array(rest.segment(c("c"), keywords=F.array(c("k"))))),
        "update_segment": rest.update_segment(s, d, g, rest.segment(c("c"), c("a"), enabled=False)),
        "list_segments": rest.list_segments(s, d, keyword="k"),
        "delete_segment": rest.delete_segment(s, d, g),
    }
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(c(k).alias("name"), q.alias("q")) for k, q in calls.items()])).alias("x"))
    return rows.select("x.name", "x.q.method", "x.q.path", "x.q.body", F.concat("x.q.file.name", c(":"), F.col("x.q.file.content").cast("string")).alias("file"))


@expect("path STRING, target STRING, file STRING, bytes INT", [("/d/a.md", "/v1/datasets/set/document/create_by_file", "a.md", 3), ("/d/s/b.txt", "/v1/datasets/set/document/create_by_file", "b.txt", 0)])
def folder_upload_cases(spark, sf_dir):
    got = rest.upload(_rows(spark, "path STRING, content BINARY", [("/d/a.md", b"# a"), ("/d/s/b.txt", b"")]), "set")
    return got.select("path", F.col("request.path").alias("target"), F.col("request.file.name").alias("file"), F.length("request.file.content").alias("bytes"))


# Splitters.


def _texts(spark, texts):
    return _rows(spark, "id INT, page_content STRING", list(enumerate(texts, 1)))


@expect("id INT, ord INT, start_index INT, page_content STRING", [
    (1, 0, 0, "a b"), (1, 1, 2, "b c"), (1, 2, 4, "c d"), (2, 0, 0, "long-part"), (2, 1, 10, "x y"), (2, 2, 12, "y x"), (2, 3, 14, "x y"), (5, 0, 1, "z"),
])
def char_overlap_cases(spark, sf_dir):
    """Chunks of three characters that share one part with the last, where they begin, a part that is too long, nothing."""
    return S.split_by_character(_texts(spark, ["a b c d", "long-part x y x y", "", None, " z "]), " ", S.SplitConfig(3, 1, add_start_index=True))


@expect("id INT, part STRING, ord INT", [(1, "a\x01b", 0), (1, ".*c", 1), (1, ".*", 2), (2, ".*", 0), (2, ".*", 1), (3, "x", 0)])
def keep_separator_cases(spark, sf_dir):
    """A separator as it stands, glued to what follows; no character of the text is lost."""
    return _texts(spark, ["a\x01b.*c.*", ".*.*", "x", "", None]).select("id", F.posexplode(S.split_parts(F.col("page_content"), ".*", True)).alias("ord", "part"))


@expect("id INT, ord INT, page_content STRING", [
    (1, 0, "aa"), (1, 1, "bb cc"), (1, 2, "dd"), (2, 0, "abcdef"), (2, 1, "ghijk"), (3, 0, "p1"), (3, 1, "p2 q"), (3, 2, "p3"),
])
def recursive_cases(spark, sf_dir):
    """By blank lines, lines, spaces and characters, each only where a part is still too long."""
    return S.split_recursively(_texts(spark, ["aa\nbb cc dd", "abcdefghijk", "p1\n\np2 q\n\np3"]), cfg=S.SplitConfig(6, 0, keep_separator=True)).select("id", "ord", F.trim("page_content").alias("page_content"))


@expect("id INT, by_json INT, by_ranks INT, by_model INT", [(1, 2, 2, 3), (2, 0, 0, 0), (3, 3, 3, 3)])
def token_length_cases(spark, sf_dir):
    """Lengths in tokens of three vocabularies, as a splitter counts them."""
    import public_tokenizers as T

    lengths = {"by_json": S.Tokens(T.path("byte_bpe_50k.json")), "by_ranks": S.Tokens(T.path("byte_bpe_50k.tiktoken"), T.PATTERN), "by_model": S.Tokens(T.path("piece_bpe_32k.model"))}
    counted = {k: F.pandas_udf(lambda s, n=n: s.map(n), "int") for k, n in lengths.items()}
    return _texts(spark, ["hello world", "", "split this!"]).select("id", *[f("page_content").alias(k) for k, f in counted.items()])


@expect("id INT, ord INT, page_content STRING", [(1, 0, "one two"), (1, 1, "three four"), (1, 2, "five"), (2, 0, "hello")])
def token_chunk_cases(spark, sf_dir):
    """Chunks of at most two tokens of a vocabulary."""
    import public_tokenizers as T

    return S.split_by_character(_texts(spark, ["one two three four five", "hello"]), " ", S.SplitConfig(2, 0, length=_NoSpaces(S.Tokens(T.path("byte_bpe_50k.json")))))


class _NoSpaces:
    """Tokens of a text; a single space is part of the token behind it."""

    def __init__(self, tokens):
        self.tokens = tokens

    def __call__(self, text: str) -> int:
        return 0 if text == " " else self.tokens(" " + text)


@expect("id INT, ord INT, page_content STRING", [(1, 0, "one two three"), (1, 1, " three four five"), (1, 2, " five"), (2, 0, "hello")])
def token_window_cases(spark, sf_dir):
    """Windows of three tokens that share one."""
    import public_tokenizers as T

    t = S.Tokens(T.path("byte_bpe_50k.json"))
    return S.split_by_tokens(_texts(spark, ["one two three four five", "hello", "", None]), t.encode, t.decode, 3, 1).select("id", "ord", "page_content")


@expect("id INT, ord INT, headers STRING, page_content STRING", [(1, 0, "1=a", "x  \ny"), (1, 1, "1=a,2=b", "z"), (1, 2, "1=c", "w"), (2, 0, "", "no\nheader"), (3, 0, "1=a", "#b\nx"), (3, 1, "1=,2=d", "y")])
def markdown_header_cases(spark, sf_dir):
    """Blank lines within a header's text, levels that close, marks without a space, a level left out."""
    d = S.split_markdown_headers(_texts(spark, ["# a\nx\n\ny\n## b\nz\n# c\nw", "no\n header ", "# a\n#b\nx\n#\n## d\ny", "", None]), [("#", "1"), ("##", "2")])
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return d.select("id", "ord", shown.alias("headers"), "page_content")


@expect("id INT, ord INT, page_content STRING", [(1, 0, f"b\n{TITLE_SEPARATOR}\nx"), (2, 0, f"a\nb\n{TITLE_SEPARATOR}\nx"), (3, 0, "x"), (4, 0, "x"), (5, 0, f"b\nc\n{TITLE_SEPARATOR}\nx")])
def chunk_title_cases(spark, sf_dir):
    """The last two titles before a chunk, empty ones left out; none, no list."""
    d = _rows(spark, "id INT, titles ARRAY<STRING>, page_content STRING", [(1, ["", "b"], "x"), (2, ["a", "b"], "x"), (3, [], "x"), (4, None, "x"), (5, ["a", "b", "c"], "x")])
    return S.split_by_character(d, "\n", S.SplitConfig(10, 0), titles="titles").select("id", "ord", "page_content")


# Re-assembly.

_SEP = TITLE_SEPARATOR
SEGMENTS = [("n", i, i, str(i)) for i in range(20)] + [("t", i, i, f"{h}{_SEP}{c}") for i, (h, c) in enumerate([("A", "a1"), ("A", "1a2"), ("B", "b1"), ("A", "2a3")])] + [("t", 4, 4, "tail")]
HITS = [
    (0, "t", 1, f"A{_SEP}1a2", 0.9), (1, "n", 6, "6", 0.8), (2, "n", 3, "3", 0.7), (3, "x", 1, "gone", 0.6), (4, "n", 1, "1", 0.5), (5, "t", 3, f"A{_SEP}2a3", 0.4),
    (6, "t", 2, f"B{_SEP}b1", 0.3), (7, "n", 99, "unknown", 0.2), (8, "n", 10, "10", 0.1), (9, "x", 2, f"C{_SEP}gone", None), (10, "t", 9, "no title", 0.0),
]


def _hits(spark):
    return _rows(spark, "hit_ord INT, document_id STRING, doc_id INT, page_content STRING, score DOUBLE", HITS)


def _segments(spark):
    return _rows(spark, "document_id STRING, doc_id INT, position INT, page_content STRING", SEGMENTS)


@expect("first_ord INT, hit_ord INT, document_id STRING, doc_id INT, score DOUBLE, strategy STRING, page_content STRING", [
    (0, 0, "t", 1, 0.9, "title", "a1a2a3tail"), (0, 6, "t", 2, 0.3, "title", "b1"), (0, 10, "t", 9, 0.0, "title", "no title"),
    (1, 1, "n", 6, 0.8, "position", "6"), (1, 2, "n", 3, 0.7, "position", "123"), (1, 7, "n", 99, 0.2, "position", "unknown"), (1, 8, "n", 10, 0.1, "position", "10"),
    (3, 3, "x", 1, 0.6, "none", "gone"), (3, 9, "x", 2, None, "none", f"C{_SEP}gone"),
])
def reorganize_cases(spark, sf_dir):
    """All hits of a query: a document with titles, one without, one that has no segments, hits whose segment is unknown."""
    got = R.reorganize(_hits(spark), _segments(spark))
    return got.withColumn("hit_ord", F.col("hit_ord").cast("int"))


@expect("document_id STRING, hit_ord INT, page_content STRING", [("n", 1, "6"), ("n", 2, "3"), ("n", 4, "1"), ("n", 7, "unknown"), ("n", 8, "10"), ("x", 3, "gone"), ("x", 9, f"C{_SEP}gone")])
def position_budget_cases(spark, sf_dir):
    """Growth by position stops before the budget; what has no segment passes through."""
    hits = _hits(spark).filter("document_id <> 't'")
    return R.positional_growth(hits, _segments(spark), budget=2).withColumn("hit_ord", F.col("hit_ord").cast("int"))


@expect("hit_ord INT, page_content STRING", [(0, "cdabxefg"), (1, "abx"), (2, "none"), (3, "xe")])
def title_budget_cases(spark, sf_dir):
    """Growth by title, behind and before in turns, spliced over overlaps, while under the budget; equal texts once."""
    seg = _rows(spark, "document_id STRING, ord INT, title STRING, content STRING", [("d", 0, "T", "cda"), ("d", 1, "T", "abx"), ("d", 2, "T", "xe"), ("d", 3, "T", "efg")])
    hits = _rows(spark, "document_id STRING, hit_ord INT, title STRING, content STRING", [("d", 0, "T", "abx"), ("d", 2, "U", "none"), ("d", 5, "T", "abx")])
    small = _rows(spark, "document_id STRING, hit_ord INT, title STRING, content STRING", [("d", 1, "T", "abx"), ("d", 3, "T", "xe")])
    return R.title_growth(hits, seg, 7).unionByName(R.title_growth(small, seg, 1)).select("hit_ord", "page_content")


@expect("content STRING, doc_id INT, document_id STRING, score DOUBLE", [("gone", 1, "x", 0.6), (f"C{_SEP}gone", 2, "x", None)])
def format_segment_cases(spark, sf_dir):
    return R.format_segments(_hits(spark).filter("document_id = 'x'"))


@expect("a STRING, b STRING, joined STRING", [("aba", "aba", "ababa"), ("aa", "aab", "aaab"), ("1", "123", "123"), ("ab", "cd", "abcd"), ("x", "", "x"), ("", "y", "y"), ("x", None, None), ("😀b", "b😀", "😀b😀")])
def splice_cases(spark, sf_dir):
    some = [("aba", "aba"), ("aa", "aab"), ("1", "123"), ("ab", "cd"), ("x", ""), ("", "y"), ("x", None), ("😀b", "b😀")]
    return _rows(spark, "a STRING, b STRING", some).withColumn("joined", X.splice(F.col("a"), F.col("b")))


# Rows that SQL computes from the same fixture.


@query("WITH " + FX.values("n", FX.NODES) + f""" SELECT id, (SELECT sum(CASE WHEN regexp_matches(coalesce(v, ''), '(?i){X.POSITIVE}') THEN 25 ELSE 0 END - CASE WHEN regexp_matches(coalesce(v, ''), '(?i){X.NEGATIVE}') THEN 25 ELSE 0 END) FROM (VALUES (class), (node_id)) t(v))::INT AS weight,
  CASE WHEN lower(tag) IN ('div', 'article') THEN 5 WHEN lower(tag) IN ('pre', 'td', 'blockquote') THEN 3 WHEN lower(tag) IN ('ul', 'ol', 'form') THEN -3 WHEN lower(tag) IN ('h1') THEN -5 ELSE 0 END AS prior,
  round(length(link_text) / greatest(length(text), 1), 6) AS density FROM n""")
def node_scores(spark, sf_dir):
    n = FX.frame(spark, FX.NODES)
    return n.select("id", X.class_weight(F.col("class"), F.col("node_id")).alias("weight"), X.tag_prior(F.col("tag")).alias("prior"), F.round(X.link_density(F.col("link_text"), F.col("text")), 6).alias("density"))


_METRICS = "WITH " + FX.values("b", FX.BLOCKS) + ", m AS (SELECT doc_id, page_idx, arg_min(block_idx, (y0, block_idx)) AS header_idx, arg_min(y1 - y0, (y0, block_idx)) AS header_height, arg_max(block_idx, (y1, -block_idx)) AS footer_idx, arg_max(y1 - y0, (y1, -block_idx)) AS footer_height FROM b GROUP BY ALL)"
_VOTE = _METRICS + ", h AS (SELECT doc_id, max(c) >= 0.9 * sum(c) AS has_header FROM (SELECT doc_id, header_height, count(*) AS c FROM m GROUP BY ALL) GROUP BY 1), f AS (SELECT doc_id, max(c) >= 0.9 * sum(c) AS has_footer FROM (SELECT doc_id, footer_height, count(*) AS c FROM m GROUP BY ALL) GROUP BY 1)"
_LINES = _VOTE + ", k AS (SELECT b.*, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_idx) - 1 AS page FROM b JOIN m USING (doc_id, page_idx) JOIN h USING (doc_id) JOIN f USING (doc_id) WHERE NOT ((has_header AND block_idx = header_idx) OR (has_footer AND block_idx = footer_idx))), l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, block_idx) - 1 AS line_idx, page, replace(text, chr(10), '') AS text FROM k)"
_TOC = _LINES + ", " + FX.values("t", FX.TOC) + ", x AS (SELECT doc_id, toc_ord, level, title, min(line_idx) AS line_idx FROM t JOIN l USING (doc_id) WHERE l.page = t.page - 1 AND level <= 3 AND (contains(text, title) OR contains(text, replace(title, ' ', ''))) GROUP BY ALL)"


@query(_METRICS + " SELECT * FROM m")
def pdf_page_metrics(spark, sf_dir):
    return P.page_metrics(FX.frame(spark, FX.BLOCKS))


@query(_VOTE + " SELECT doc_id, has_header, has_footer FROM h JOIN f USING (doc_id)")
def pdf_header_vote(spark, sf_dir):
    return P.header_vote(P.page_metrics(FX.frame(spark, FX.BLOCKS)))


@query(_LINES + " SELECT * FROM l")
def pdf_filtered_lines(spark, sf_dir):
    return P.lines(P.filtered_blocks(FX.frame(spark, FX.BLOCKS)))


@query(_TOC + " SELECT * FROM x")
def pdf_toc_match(spark, sf_dir):
    return P.toc_lines(FX.frame(spark, FX.TOC), pdf_filtered_lines(spark, sf_dir))


@query("WITH " + FX.values("r", FX.REPAIR) + """ SELECT id, replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(
  translate(translate(raw, chr(160) || chr(8194), ''), chr(12288) || chr(8195) || '袁遥院渊冤尧揖铱耀曰鄄覬', '  ，。：（）、【】~；-∅'), '(\\d\\s)益', '\\1℃', 'g'), '(\\d)依', '\\1±', 'g'), '滋g', 'μg'),
  '伊(\\d+)', 'x\\1', 'g'), '叶(.*?)曳', '《\\1》', 'gs'), '逸(\\d+)', '≥\\1', 'g'), '臆(\\d+)', '≤\\1', 'g'), chr(61548), '●'), chr(10), '') AS fixed FROM r""")
def pdf_text_repair(spark, sf_dir):
    return FX.frame(spark, FX.REPAIR).select("id", X.repair_pdf_text(F.col("raw")).alias("fixed"))


@query("WITH " + FX.values("r", FX.RECORDS) + """ SELECT id, CASE WHEN id = 1 THEN '男' END AS sex, CASE WHEN id = 1 THEN '40' END AS age,
  coalesce(nullif(revised, ''), nullif(initial, '') || '，' || nullif(supplementary, ''), nullif(initial, ''), '') AS diagnosis, coalesce(nullif(plan, ''), nullif(operation, ''), '') AS treatment FROM r""")
def emr_fields(spark, sf_dir):
    r = FX.frame(spark, FX.RECORDS).withColumn("kv", X.bracketed_pairs(F.col("content")))
    at = lambda k: F.try_element_at("kv", F.lit(k))
    return r.select("id", at("性别").alias("sex"), at("年龄").alias("age"), X.diagnosis(F.col("revised"), F.col("initial"), F.col("supplementary")).alias("diagnosis"), X.treatment(F.col("plan"), F.col("operation")).alias("treatment"))

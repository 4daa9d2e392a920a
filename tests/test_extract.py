import io
import zipfile

import pytest

from quarry.functions.dom import parse
from quarry.functions.readable import summary
from quarry.operators import html as H
from quarry.operators import markdown as M
from quarry.operators import pdf as P
from quarry.operators import records as E
from quarry.operators import retrieval as R
from quarry.operators import split as S
from quarry.sources import files
from quarry.streaming.run import transform_stream

WHOLE = H.HtmlConfig(use_summary=False)


def page(html, **kw):
    return H.extract_page(html, None, H.HtmlConfig(**({"use_summary": False} | kw)))


def test_sections_and_titles():
    got = page("<h1>A <b>x</b></h1>lost<p>Hello <b>W</b>, see<sup>[1-3]</sup> m<sup>2</sup> (ok).<br>x</p><h3>C</h3>c<p>d<h2>B</h2><p>b")
    assert [([t for _, t in s["titles"]], s["text"]) for s in got["sections"]] == [(["A x"], "Hello W, see m^2 (ok).\nx"), (["A x", "C"], "d"), (["A x", "B"], "b")]
    assert page("<h1>A</h1>kept<p>p", keep_heading_tails=True)["sections"][0]["text"] == "kept\n\np"


def test_spans_captions_and_headers():
    html = "<title>T</title><h2>B</h2><p>表1</p><table><tr><th colspan=2>k<th>v<tr><td rowspan=2>1<td>2<td>3<tr><td>4<td>5</table><p>end"
    (t,) = page(html)["tables"]
    assert t["cells"] == [["k", "k", "v"], ["1", "2", "3"], ["1", "4", "5"]]
    assert t["titles"] == [("title", "T"), ("h2", "B"), ("p", "表1")]
    assert t["md"].split("\n")[:2] == ["| k | v |", "| --- | --- |"]


def test_choices_and_links():
    got = page('<p><input type=checkbox checked><span>yes</span><input type=radio><span>no</span> <a href=x>li\nnk</a>')
    assert got["sections"][0]["text"] == "yes li nk"


def test_odd_pages():
    for html in (None, "", "<", "<b>" * 5000 + "x", "text only", "<table></table>", "<script>x", "\0"):
        page(html)
        H.extract_page(html, "a/b.c.html", H.HtmlConfig())
    assert H.page_title(parse("<p>x"), "a/b.c.html") == "b"


def test_main_content():
    html = f"<body><div class=sidebar>{'<p>Noise, noise, noise and more noise.</p>' * 9}</div><div id=content>{'<p>Words, that matter, and more of them.</p>' * 9}</div>"
    text = summary(html).text()
    assert "matter" in text and "oise" not in text


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "<title>T</title><h1>A</h1><p>x</p><table><tr><td>k<td>v<tr><td>1<td>2<tr><td>3</table>"), (2, None)], "id int, html string")
    got = [(r.id, r.ord, r.titles, r.row, r.page_content) for r in H.extract_html(pages, H.HtmlConfig(use_summary=False, title_convert_to_markdown=True, contain_closest_title_levels=1)).orderBy("id", "ord").collect()]
    assert got[-2:] == [(1, 2, ["T", "A"], 0, "k为1的v是2"), (1, 3, ["T", "A"], 1, "k为3的v是")]
    assert got[1] == (1, 1, ["T", "# A"], None, "# A\nx")


def test_markdown_sections():
    text = "intro\n# A\na\n```\n# not\n```\n## B\n\n##  \nb\n# C\n"
    assert M.sections(text) == [([], "intro\n"), (["# A"], "a\n\n```\n# not\n```\n\n"), (["# A", "## B"], "\n"), (["# A"], "b\n"), (["# C"], "\n")]
    rest, tables = M.take_tables("x\n| a | b |\n| - | - |\n| 1 | 2 |\ny\n")
    assert tables == ["\n| a | b |\n| - | - |\n| 1 | 2 |\n"] and rest == "xy\n"


def test_outline():
    assert P.outline_levels([0, 2, 3, 3, 2, 10]) == [1, 1, 2, 2, 1, 3]
    assert P.outline_levels([]) == []


def test_growth_by_position():
    parts = [(i, len(str(i)), i if i in (1, 3, 6, 10) else None) for i in range(12)]
    assert R.grow_island(parts, 2, 2000) == [(1, 1, 3), (6, 6, 6), (10, 10, 10)]
    assert R.grow_island(parts, 2, 2) == [(1, 1, 1), (3, 3, 3), (6, 6, 6), (10, 10, 10)]
    assert R.grow_island([], 2, 2) == []
    # places without a segment, and hits that come out of order and meet what others took
    gaps = [(2, 3, 1), (4, 3, 0), (5, 9, None), (7, 1, 2)]
    assert R.grow_island(gaps, 2, 6) == [(0, 2, 4), (2, 7, 7)]
    assert R.grow_island(gaps, 2, 5) == [(0, 4, 4), (1, 2, 2), (2, 7, 7)]
    assert R.grow_island(gaps, 3, 100) == [(0, 2, 7)]


def test_growth_frames(spark):
    seg = spark.createDataFrame([("d", i, i, str(i)) for i in range(100)], "document_id string, doc_id int, position int, page_content string")
    hits = seg.filter("doc_id in (1, 3, 6, 10)").selectExpr("document_id", "doc_id", "doc_id as hit_ord")
    assert [r.page_content for r in R.positional_growth(hits, seg).orderBy("hit_ord").collect()] == ["123", "6", "10"]


def test_growth_by_title():
    assert R.grow_title("b", ["c"], ["a"], 100) == ("abc", 1)
    assert R.grow_title("b", ["c"], ["a"], 1) == ("b", 0)
    assert R.grow_title("x", [], [], 9) == ("x", 0)


def test_records(spark):
    row = spark.createDataFrame([("谈话记录 | x | [说的话] |\n性别：[男]",)], "c string").select(E.record_fields(spark_col("c"), E.TALK).alias("f")).first()
    assert row.f == {"性别": "男", "谈话记录": "说的话"}
    kinds = spark.createDataFrame([('<header>[谈 话记录]</header><table data-name="基本信息"><table data-id="谈话记录">',), ("<p>",)], "h string")
    assert [r.k for r in kinds.select(E.record_kind(spark_col("h")).alias("k")).collect()] == ["谈话记录", None]


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


XLSX = archive({"xl/sharedStrings.xml": "<sst><si><t>k</t></si><si><t>v</t></si></sst>", "xl/worksheets/sheet1.xml": '<w><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row/><row><c r="A3"><v>7</v></c></row></w>'})
DOCX = archive({"word/document.xml": '<w:d xmlns:w="u"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>a &amp; b</w:t></w:r></w:p></w:body></w:d>'})
EPUB = archive({"c.opf": '<p xmlns:dc="u"><dc:title># Book</dc:title></p>', "1.xhtml": '<html xmlns="u"><body xmlns="v"><h1>One</h1><p>text</p></body></html>'})


def test_readers():
    assert files.xlsx_html(XLSX) == "<table><tr><td>k</td><td></td><td>v</td></tr><tr><td>7</td><td></td><td></td></tr></table>"
    assert files.docx_html(DOCX) == "<h1>Head</h1><p>a &amp; b</p>"
    assert files.epub_html(EPUB, "x.epub") == "<html><head><title>Book</title></head><body><div><h1>One</h1><p>text</p></div></body></html>"
    assert files.csv_html("a,b\n1\n1,2,3\n") == "<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td></td></tr></table>"
    assert files.find_codec("中文".encode("gbk")) == "gb2312" and files.find_codec(b"") == "utf-8" and files.find_codec(b"\xff\xff\xff") == "cp037"


def test_folder(spark, tmp_path):
    for name, content in {"a.xlsx": XLSX, "b.docx": DOCX, "c.epub": EPUB, "d.md": b"# H\nx\n", "e.bin": b"x", "sub/f.csv": b"k,v\n1,2\n", "g.xlsx": b"broken"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = files.read_files(spark, str(tmp_path))
    assert {r.path[-6:]: r.error for r in files.texts(found).filter("error is not null").collect()}.keys() == {"/e.bin", "g.xlsx"}
    got = {r.path.rsplit("/", 1)[1]: (r.titles, r.page_content) for r in files.extract_files(found).collect() if r.page_content != "Book"}
    assert got["b.docx"] == (["b", "Head"], "a & b")
    assert got["c.epub"] == (["Book", "One"], "text")
    assert got["d.md"] == (["# H"], "x")
    assert got["f.csv"] == ([], "k为1的v是2")


def test_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text as page_content").repartition(3)
    docs.write.parquet(source)
    plan = lambda d: S.split_by_character(d, "\n", S.SplitConfig(500, 0))
    transform_stream(spark, source, target, str(tmp_path / "state"), plan).awaitTermination()
    key = ["doc_id", "ord", "page_content"]
    assert sorted(spark.read.parquet(target).select(*key).collect()) == sorted(plan(docs).select(*key).collect())


def test_longest_chain_is_brute_force():
    import itertools
    import random

    r = random.Random(2)
    for _ in range(400):
        m = [(r.randint(0, 5), r.randint(0, 6)) for _ in range(r.randint(0, 8))]
        grows = lambda c: all(a < c2 and b < d for (a, b), (c2, d) in itertools.pairwise(c))
        own = sorted(set(m))
        chains = [c for n in range(len(own) + 1) for c in itertools.combinations(own, n) if grows(c)]
        most = max(map(len, chains))
        got = P.longest_chain(m)
        assert grows(got) and len(got) == most and set(got) <= set(m)
        assert not got or got[-1][1] == min(c[-1][1] for c in chains if len(c) == most)


def test_contents_without_pages(spark):
    lines = [("d", k, 0, t) for k, t in enumerate(["Contents One Two Three", "One", "text of Three and more", "T w o", "Two", "Three", "One"])] + [("e", 0, 0, "One"), ("f", 0, 0, None)]
    line = spark.createDataFrame(lines, "doc_id string, line_idx int, page int, text string")
    toc = spark.createDataFrame([("d", 0, 1, "O ne", 9), ("d", 1, 2, "Two", 9), ("d", 2, 1, "Three", None), ("d", 3, 4, "text", 1), ("d", 4, 1, "absent", 1), ("d", 5, 1, "", 1), ("f", 0, 1, "x", 1), ("g", 0, 1, "x", 1)], "doc_id string, toc_ord int, level int, title string, page int")
    every = sorted((r.doc_id, r.toc_ord, r.line_idx) for r in P.title_matches(toc, line).collect())
    want = sorted((d, o, i) for d, o, lv, t, _ in toc.collect() for e, i, _, x in lines if d == e and lv < 4 and t and x and (t in x or t.replace(" ", "") in x))
    assert every == want
    got = sorted((r.toc_ord, r.line_idx, r.level, r.title) for r in P.toc_chain(toc, line).collect())
    assert got == [(0, 0, 1, "O ne"), (1, 4, 2, "Two"), (2, 5, 1, "Three")]
    assert P.toc_chain(toc.limit(0), line).count() == 0


@pytest.mark.parametrize("n", [3_600, 70_000])
def test_old_workbook_of_many_rows(n):
    """Strings over many records, an allocation table of many sectors, and rows beyond a sheet's."""
    from quarry.sources import office, xls

    cells = [(0, 0, "key"), *((i, c, v) for i in range(1, n + 1) for c, v in enumerate((i, f"名{i}𝄞")))]
    sheets = xls.sheets(office.xls(cells, header=1), files.number_text)
    assert [r for s in sheets for r in s[1:]] == [{0: str(i), 1: f"名{i}𝄞"} for i in range(1, n + 1)]
    assert all(s[0] == {0: "key"} and len(s) <= office.SHEET_ROWS for s in sheets)


def test_old_workbook_of_many_sectors():
    """The allocation table's own places go on behind the file's header."""
    from quarry.sources import office, xls

    cells = [(i, 0, f"{i} " + "x" * 4_000) for i in range(2_000)]
    assert xls.sheets(office.xls(cells), files.number_text) == [[{0: v} for _, _, v in cells]]


def test_names_without_semicolon_stay():
    """A reference that was cut, or that isn't known, is text; known ones with a semicolon, and numbers, are read."""
    html = '<title>a &amp; b &amp&amp</title><h1>c &lt; &copy &notit; &#233; &am</h1><p><a href="?x=1&copy=2&amp;y">&quot;z&quot;</a>'
    root = parse(html)
    assert [next(iter(root.all(t))).text() for t in ("title", "h1", "a")] == ["a & b &amp&amp", "c < &copy &notit; é &am", '"z"']
    assert root.all("a")[0].attrs["href"] == "?x=1&copy=2&y"
    assert page(html)["title"] == "a & b &amp&amp" and page(html, use_first_header_as_title=True)["title"] == "c < &copy &notit; é &am"


def _sheets(*tables):
    """A workbook of inline strings."""
    from html import escape

    from quarry.sources import office

    sheet = lambda rows: "<w>" + "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>' for v in r) + "</row>" for r in rows) + "</w>"
    return office.archive({f"xl/worksheets/sheet{k}.xml": sheet(rows) for k, rows in enumerate(tables, 1)})


def test_spreadsheets_in_parts_give_the_rows_of_whole_ones(spark, monkeypatch):
    """Tables of any number of rows, with headers of one row and of two, rows that begin like the header, captions and sheets behind each other."""
    body = lambda n: [[("k" if i % 3 else "") + str(i % 4), f"<{i}>", "&amp;"] for i in range(n)]
    some = [[["k1", "v", "w"], *body(n)] for n in range(12)] + [[["k", "v", "w"], ["k", "x", "w"], *body(n)] for n in range(9)] + [[["k2", "v"], ["a"], ["k2", "b"], ["k2", "c"], ["k2", "d"], ["a", "e"]]]
    made = {f"/{k}.xlsx": _sheets(t) for k, t in enumerate(some)}
    made |= {"/m.xlsx": _sheets(some[9], some[20], [["表一"]], some[11], [["x"]], some[3]), "/c.csv": "\n".join(",".join(r) for r in some[11]).encode(), "/bad.xlsx": b"x", "/n.md": b"# a\nb"}
    rows = spark.createDataFrame([(p, bytearray(c)) for p, c in made.items()], "path string, content binary")
    show = lambda d: sorted(repr(tuple(r)) for r in d.select("path", "ord", "titles", "content_type", "row", "page_content").collect())
    whole = H.extract_html(files.texts(rows).filter("error IS NULL AND kind <> 'md'").select("path", "text"), H.HtmlConfig(use_summary=False), "text")
    want = show(whole)
    for part in (2, 3, 5, 100):
        pages = [p for path, c in made.items() for p in _in_parts(monkeypatch, part, path, c)]
        assert part == 100 or max(p[0].count("<tr>") for p in pages) <= part + 3
        assert [r for r in show(_extracted(spark, pages, rows)) if "/n.md" not in r] == want


def _in_parts(monkeypatch, part, path, content):
    monkeypatch.setattr(files, "PART", part)
    return [(*p, path) for p in files.file_pages(path, content) if not path.endswith(".md")]


def _extracted(spark, pages, rows):
    d = spark.createDataFrame([(path, *p) for *p, path in pages], "path string, text string, _skip int, _ord int, _row int")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(files, "_pages", lambda *_: d.withColumn("kind", files._kind()))
        return files.extract_files(rows)


def test_spreadsheets_are_read_and_written_by_rows(spark):
    """A workbook of many rows gives pages of few, and neither its markup nor its tree is ever whole."""
    import tracemalloc

    from quarry.sources import office

    n = 40_000
    rows = lambda: (f'<row><c><v>{i}</v></c><c t="inlineStr"><is><t>Customer#{i:09d}</t></is></c></row>' for i in range(n))
    tracemalloc.start()
    content = office.archive({"xl/worksheets/sheet1.xml": (x for x in ("<w>", *rows(), "</w>"))})
    tracemalloc.reset_peak()
    sizes = [p[0].count("<tr>") for p in files.file_pages("/a.xlsx", content)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == n + 2 * (len(sizes) - 1) and max(sizes) <= files.PART + 2
    assert len(content) < 1 << 20 and peak < 400 * n
    found = files.extract_files(spark.createDataFrame([("/a.xlsx", bytearray(content))], "path string, content binary"))
    got = [(r.ord, r.row, r.page_content) for r in found.orderBy("ord").collect()]
    assert got == [(i - 1, i - 1, f"0为{i}的Customer#{0:09d}是Customer#{i:09d}") for i in range(1, n)]

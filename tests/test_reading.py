"""Plain markup is read without the standard parser, as that would read it; a page is read once where a second try would be the first again."""

import random
import time

from pyspark.sql import functions as F

from quarry.functions import dom, readable
from quarry.functions import text as X
from quarry.operators import html as H

PARTS = """<p>|<P class=k>|</p>|</p >|<div id='comment'>|<div class="side bar">|</div>|<b>|</b>|<br>|<br/>|<br />|<img src=x/>|<img src="x"/>|<a href=x>|<a href='y' title="t t">|<a href=x />|</a>|words, more|&amp;|&lt|&#65;|&nbsp;|&
<!-- c -->|<!---->|<!-->|<!--a-b-->|<!doctype html>|<script>|x<y|</script>|<title>|</title>|<td>|<tr>|<table>|<li>|<input checked>|<input type=checkbox checked/>|<x y='>'>|<p a=b c>|<p  a=b>|<p a='b'c=d>|<p a=>|<p =b>|</p x>|</p/>|<p/ a>|<1>|<|>|<p
<html lang=x>|<body class=foot>|</body>|<iframe src=q>|</iframe>|<scripty>|<p a=b/c>|<p a=b/>|<p A-b=C>|<p a a=1 a=2>|<p a`=1>|<p a='&lt;'>|</>|<?x?>|<![CDATA[x]]>|<İ>|<pİ>|é""".replace("\n", "|").split("|")


def _dump(x):
    return x if isinstance(x, str) else (x.tag, list(x.attrs.items()), [_dump(k) for k in x.kids])


def test_plain_markup_is_read_as_by_the_standard_parser(monkeypatch):
    pick = random.Random(5)
    pages = ["".join(pick.choices(PARTS, k=pick.randrange(30))) for _ in range(3_000)]
    found = [_dump(dom.parse(p, d)) for p in pages for d in (dom.UNSEEN, dom.SCRIPTS)]
    monkeypatch.setattr(dom, "_read_plain", lambda builder, html: 0)
    assert found == [_dump(dom.parse(p, d)) for p in pages for d in (dom.UNSEEN, dom.SCRIPTS)]


def test_plain_markup_needs_no_standard_parser(monkeypatch):
    monkeypatch.setattr(dom._Builder, "parse_starttag", None)
    monkeypatch.setattr(dom._Builder, "parse_endtag", None)
    page = "<body class=\"a b\"><!-- c --><h1 id='t'>A &amp; B</h1><p data-name='基本信息' hidden>x<br/>y<a href=z>l</a><ul><li>m<li>n</ul></body>"
    assert dom.parse(page).html() == '<html><body class="a b"><h1 id="t">A &amp; B</h1><p data-name="基本信息" hidden="">x<br>y<a href="z">l</a></p><ul><li>m</li><li>n</li></ul></body></html>'


def test_a_page_without_unlikely_names_is_read_once(monkeypatch):
    reads, own = [], readable.parse
    monkeypatch.setattr(readable, "parse", lambda *a: reads.append(a) or own(*a))
    for page, n in (("<body><p>short</body>", 1), ("<body><p>Words, that matter, and more of them here.</body>", 1), ("<div class=sidebar>x</div><p>short", 2)):
        reads.clear()
        assert readable.summary(page).text() and len(reads) == n
    reads.clear()
    assert H.extract_page("<body><p>主诉：x</p></body>", "p.html", H.HtmlConfig(sniff_records=True))["sections"] == [{"titles": [("title", "p")], "text": "主诉：x"}] and len(reads) == 1


def test_densities_of_links_count_where_links_are():
    how = readable.Readability()
    page = "<div><p>Words, that matter, and more of them here.</p></div><div><p>Words, that matter, and <a>more of them</a> here.</p></div>"
    scores = readable._scores(readable.read(page, how), readable._Weigher(how))
    plain, linked = (s for n, s in scores.items() if n.tag == "p")
    assert plain > linked == plain * (1 - len("more of them") / len("Words, that matter, and more of them here."))


def test_a_tree_is_read_again_as_its_markup_would_be():
    pick = random.Random(6)
    pages = ["".join(pick.choices([*PARTS, "<head>", "<h2>", "</h2>", "<header>", "</header>", "<textarea>", "</textarea>", "&amp;lt;"], k=pick.randrange(30))) for _ in range(3_000)]
    for page in pages:
        root = dom.parse(page, dom.SCRIPTS)
        if pick.random() < 0.5:
            H.prepare(root, "t", H.HtmlConfig())
        before, markup = _dump(root), root.html()
        for drop in (dom.UNSEEN, dom.SCRIPTS):
            assert _dump(dom.parse(root, drop)) == _dump(dom.parse(markup, drop)), markup
        assert _dump(readable.summary(root)) == _dump(readable.summary(markup)), markup
        assert _dump(root) == before


def test_a_page_is_read_again_without_its_markup(monkeypatch):
    page = "<body><header>谈话记录]</header><p>A &amp; B<a href='x?a&b'>l</a><table data-name='基本信息'><tr><td>a</table></body>"
    want = H.extract_page(page, "p.html", H.HtmlConfig())
    assert want["tables"] and want["sections"]
    monkeypatch.setattr(dom.Node, "html", None)
    assert H.extract_page(page, "p.html", H.HtmlConfig()) == want


def test_a_page_is_walked_for_tags_that_it_has(monkeypatch):
    root = dom.parse("<div>a<i>b</i></div>")
    assert [n.tag for n in root.all("div", "p")] == ["div"] and root.all("i") and not root.all("p")
    readable._paragraphs_from_divs(root)
    assert [n.tag for n in root.all("p")] == ["p"]
    monkeypatch.setattr(dom.Node, "all", None)
    assert root.all("a", "table") == []


PAIRS = r"(?U)(\w+)\s*[:：]\s*\[\s*([^\]]+?)\s*\]"


def test_pairs_are_those_of_the_plain_pattern(spark):
    pick = random.Random(7)
    parts = ["a", "性", "b1", "_", ":", "：", ":[", "：[", "[", "]", "] ", " ", "  ", "\n", "\u3000", "x", "\U00020000", "😀", "\u0301", "-", "|", "a: [", " ]", "\u0085", "a:[x]"]
    rows = spark.createDataFrame([("".join(pick.choices(parts, k=pick.randrange(25))),) for _ in range(20_000)], "t string")
    both = [(F.regexp_extract_all("t", F.lit(PAIRS), F.lit(k)), F.regexp_extract_all("t", F.lit(X.PAIR), F.lit(k))) for k in (1, 2)]
    assert rows.filter((both[0][0] != both[0][1]) | (both[1][0] != both[1][1])).count() == 0 < rows.filter(F.size(both[0][0]) > 0).count()


def test_pairs_take_time_with_the_texts_length(spark):
    # the pattern before tried each run of letters from each of its characters: minutes for one of these texts
    long = ["x" * 400_000 + " a:[b]", "𠀀" * 400_000 + " a:[b]", "a:[b" + " " * 400_000 + "] x"]
    began = time.perf_counter()
    found = spark.createDataFrame([(t,) for t in long], "t string").select(X.bracketed_pairs(F.col("t"))["a"].alias("a")).collect()
    assert [r.a for r in found] == ["b"] * 3 and time.perf_counter() - began < 30

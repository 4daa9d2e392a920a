"""The node table's sums against the tree's own walks."""

import pytest
from quarry.functions import readable as R
from quarry.functions.dom import SCRIPTS, parse
from quarry.operators import nodes as N

SF = "/root/testdata/sf0.001"
PAGES = [
    None,
    "",
    "plain text only",
    "<div>foo<b>bar</b> baz<a href='#'>li</a>nk <a>two <i>words</i></a>, and some more text to be long enough.</div>",
    "<body><div id=content class='post'><p>" + "A sentence, with pauses; and more: yes! " * 9 + "<a>x</a></p><div class=comment><p>gone gone gone gone gone gone gone</p></div> tail text <p>short</p></div><table><tr><td>cell text that is long enough to be counted here<td> b</table></body>",
    "<h1>A</h1>one<h2>B <i>b</i></h2>two<h4>C</h4>three<h2>D</h2>four<h1></h1>five<p>six<h3>E</h3></p>seven",
    "<div>" * 300 + "deep text that is long enough to be counted" + "</div>" * 10,
    "<p>a b　c" + "\x1c d" * 20 + "</p><pre>  x   y\n\n" + "z " * 40 + "</pre>",
]


def tree_scores(html, how):
    root = parse(html, SCRIPTS)
    R._prune_unlikely(root)
    R._paragraphs_from_divs(root)
    order = [root, *root.all()]
    number = {id(n): k for k, n in enumerate(order)}
    return {(number[id(n)], n.tag): s for n, s in R._scores(root, R._Weigher(how)).items()}


@pytest.fixture(scope="module")
def pages(spark):
    own = [(k, t, "x") for k, t in enumerate(PAGES)]
    given = [(1000 + r.page_id, r.html, "y") for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    return own + given + [(None, PAGES[4], "z")]


@pytest.mark.parametrize("how", [R.Readability(), R.Readability(positive="post", negative="tag-td", min_text=5)])
def test_scores(spark, pages, how):
    df = spark.createDataFrame(pages, "page_id long, html string, tag string").repartition(4)
    got = {}
    for r in N.scored(N.node_table(df, prepared=True), how).collect():
        got.setdefault(r.k, {})[r.pre, r.tag] = r.score
    for k, html, _ in pages:
        want = tree_scores(html, how)
        assert set(got.get(k, {})) == set(want), k
        assert all(abs(got[k][x] - s) < 1e-9 for x, s in want.items()), k


def test_sizes(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, html string, tag string").repartition(4)
    got = {(r.k, r.pre): (r.size, r.links, r.pauses) for r in N.sized(N.node_table(df)).collect()}
    n = 0
    for k, html, _ in pages:
        root = parse(html)
        for pre, x in enumerate([root, *root.all()]):
            t = x.text()
            assert got[k, pre] == (R._size(t), sum(R._size(a.text()) for a in x.all("a")), len(R.PAUSES.findall(t)))
            n += 1
    assert n == len(got)


def test_title_paths(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, html string, tag string").repartition(4)
    got = {}
    for r in sorted(N.title_paths(N.node_table(df)).collect(), key=lambda r: r.ord):
        got.setdefault(r.k, []).append((r.text, list(r.titles)))
    for k, html, _ in pages:
        stack, want, inside = [], [], 0
        for kind, x, node in parse(html).events():
            if kind == "start" and node.tag in N.HEADINGS:
                while stack and stack[-1][0] >= node.tag:
                    stack.pop()
                stack.append((node.tag, " ".join(node.text().split())))
                inside += 1
            elif kind == "end" and node.tag in N.HEADINGS:
                inside -= 1
            elif kind in ("text", "tail") and x and not inside:
                want.append((x, [t for _, t in stack]))
        assert got.get(k, []) == want, k
    assert N.node_table(df.limit(0)).count() == 0 and N.scored(N.node_table(df.limit(0))).count() == 0


def test_pages_are_parsed_once(spark):
    """Scores are joined from written elements; the pages' own plan isn't repeated in them."""
    from quarry.operators import nodes as N

    pages = spark.createDataFrame([(1, "<div id=content><p>" + "word, " * 20 + "<a href=x>link</a></p></div>")], "page_id long, html string")
    rows = N.scored(N.node_table(pages, prepared=True))
    assert "MapInArrow" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.filter("tag = 'div'").count() == 1

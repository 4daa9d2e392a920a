"""Extra columns of clashing names, nulls, empty tables, very long and repeated texts, and what must fail."""

import random
import re

import pytest
from pyspark.sql import functions as F
from quarry.functions import md_html
from quarry.functions import text as X
from quarry.operators import html as H
from quarry.operators import markdown as M
from quarry.operators import pdf as P
from quarry.operators import retrieval as R
from quarry.operators import split as S
from quarry.sources import files, rest, xls

CLASH = ["ord", "start_index", "titles", "content_type", "row", "headers", "record", "_c", "_p", "_d", "_m", "_s", "_t", "Ord"]


def docs(spark, rows, name="page_content"):
    d = spark.createDataFrame(rows, f"id int, {name} string")
    for c in CLASH:
        if c.lower() not in {x.lower() for x in d.columns}:
            d = d.withColumn(c, F.lit("mine"))
    return d


PLANS = {
    "character": lambda d: S.split_by_character(d, " ", S.SplitConfig(5, 0, add_start_index=True)),
    "recursive": lambda d: S.split_recursively(d, cfg=S.SplitConfig(5, 0, keep_separator=True)),
    "characters": lambda d: S.split_characters(d, 5, 1),
    "tokens": lambda d: S.split_by_tokens(d, lambda t: list(map(ord, t)), lambda x: "".join(map(chr, x)), 5, 1),
    "headers": lambda d: S.split_markdown_headers(d, [("#", "1")]),
    "markdown": lambda d: M.extract_markdown(d),
    "html": lambda d: H.extract_html(d, H.HtmlConfig(use_summary=False, sniff_records=True), html="page_content"),
}


@pytest.mark.parametrize("name", sorted(PLANS))
def test_clashing_columns(spark, name):
    rows = [(1, "a b c d e f"), (2, None), (3, ""), (1, "a b c d e f"), (4, "w " * 20_000)]
    d = docs(spark, rows)
    bare = PLANS[name](d.select("id", "page_content"))
    got = PLANS[name](d)
    made = [c for c in bare.columns if c != "id"]
    # what the operator makes is its own, and every other column is as it was
    key = ["id", *made]
    assert sorted(map(repr, got.select(key).collect())) == sorted(map(repr, bare.select(key).collect()))
    others = [c for c in d.columns if c not in ("id", "page_content", *made)]
    assert {tuple(r) for r in got.select(others).distinct().collect()} <= {("mine",) * len(others)}
    assert PLANS[name](d.limit(0)).count() == 0


def test_reassembly_of_nothing(spark):
    hits = spark.createDataFrame([], "hit_ord int, document_id string, doc_id int, page_content string")
    seg = spark.createDataFrame([], "document_id string, doc_id int, position int, page_content string")
    assert R.reorganize(hits, seg).count() == 0
    one = spark.createDataFrame([(0, "a", 1, "x"), (1, None, 1, "y")], hits.schema)
    assert [(r.first_ord, r.page_content) for r in R.reorganize(one, seg).orderBy("hit_ord").collect()] == [(0, "x"), (1, "y")]
    assert [r.page_content for r in R.positional_islands(one, seg).orderBy("seed_ord").collect()] == ["x", "y"]


def test_hits_without_segments_pass_through(spark):
    seg = spark.createDataFrame([("a", i, i, str(i)) for i in range(9)], "document_id string, doc_id int, position int, page_content string")
    hits = spark.createDataFrame([(0, "a", 1, "1"), (1, "a", 77, "lost"), (2, "b", 1, "other"), (3, "a", 3, "3")], "hit_ord int, document_id string, doc_id int, page_content string")
    assert {(r.seed_ord, r.page_content) for r in R.positional_islands(hits, seg).collect()} == {(0, "123"), (1, "lost"), (2, "other")}
    assert {(r.hit_ord, r.page_content) for r in R.positional_growth(hits, seg).collect()} == {(0, "123"), (1, "lost"), (2, "other")}
    titled = hits.withColumn("title", F.lit("T")).withColumnRenamed("page_content", "content")
    none = seg.select("document_id", F.col("position").alias("ord"), F.lit("U").alias("title"), F.col("page_content").alias("content"))
    assert {(r.hit_ord, r.page_content) for r in R.title_expansion(titled, none).collect()} == {(0, "1"), (1, "lost"), (2, "other"), (3, "3")}


def test_overlap_is_brute_force():
    r = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert X.overlap(a, b) == next((k for k in range(1, min(len(a), len(b)) + 1) if a[-k:] == b[:k]), 0)
    long = "ab" * 200_000
    assert X.overlap(long, "ac" + long) == 0 and X.overlap(long, long) == 2


def test_growth_by_title_is_the_nearest_in_turns():
    for n in range(1, 7):
        contents = [f"<{i}>" for i in range(n)]
        for at in range(n):
            for budget in (0, 4, 7, 10, 100):
                want, left, right = contents[at], at - 1, at + 1
                while len(want) < budget and (left >= 0 or right < n):
                    if right < n:
                        want, right = X.splice_texts(want, contents[right]), right + 1
                    if left >= 0:
                        want, left = X.splice_texts(contents[left], want), left - 1
                assert R.grow_title(contents[at], contents[at + 1 :], contents[:at][::-1], budget)[0] == want


def test_empty_pdf_tables(spark):
    blocks = spark.createDataFrame([], "doc_id int, page_idx int, block_idx int, y0 double, y1 double, text string")
    toc = spark.createDataFrame([], "doc_id int, toc_ord int, level int, title string, page int")
    assert P.extract_pdf(blocks).count() == 0 and P.extract_pdf(blocks, toc).count() == 0


def test_one_page_document_of_nulls(spark):
    blocks = spark.createDataFrame([(1, 0, i, float(i), float(i + 1), t) for i, t in enumerate(["top", None, "kept", "", "bottom"])], "doc_id int, page_idx int, block_idx int, y0 double, y1 double, text string")
    assert [(r.first, r.titles, r.page_content) for r in P.extract_pdf(blocks).collect()] == [(-1, [], "kept")]


def test_segmenter_is_asked_once_for_a_context():
    asked = []

    def segment(s):
        asked.append(s)
        return list(s)

    repair = X.protected_punctuation(segment)
    assert repair("袁袁") == "，，" and repair("袁袁") == "，，" and len(asked) == len(set(asked))


def test_send(spark):
    d = spark.createDataFrame([("a",), ("b",)], "name string")
    q = d.select(rest.create_by_text(F.lit("s"), F.col("name"), F.lit("t")).alias("request"))
    rest.send(q, lambda method, path, body, file: 200)
    with pytest.raises(Exception, match="404"):
        rest.send(q, lambda method, path, body, file: 404)
    for bad in (lambda: rest.create_dataset(F.lit("n"), permission="all"), lambda: rest.list_datasets(0, 1), lambda: rest.process_rule(mode="x")):
        with pytest.raises(ValueError):
            bad()


def test_markdown_marks():
    some = {
        "a *b* **c** _d_ `e*f*` \\*g\\*": "<p>a <em>b</em> <strong>c</strong> <em>d</em> <code>e*f*</code> *g*</p>",
        "![i](p \"t\") <http://x> <b>y</b> 1 < 2 & 3 &amp;": '<p><img src="p" alt="i" title="t"> <a href="http://x">http://x</a> <b>y</b> 1 &lt; 2 &amp; 3 &amp;</p>',
        "T\n=\nx\n---\n***\n": "<h1>T</h1>\n\n<h2>x</h2>\n\n<hr>",
        "> a\n> b\n\n    code\n": "<blockquote>\n<p>a\nb</p>\n</blockquote>\n\n<pre><code>code\n</code></pre>",
        "<div>\n*x*\n</div>\n\ny": "<div>\n*x*\n</div>\n\n<p>y</p>",
        "": "",
    }
    assert {k: md_html.convert(k) for k in some} == some


def test_broken_workbooks():
    for raw in (b"", xls.MAGIC, xls.MAGIC + b"\0" * 600, b"x" * 2000):
        assert files.file_text("/a.xls", raw)[1]
        assert files.file_text("/a.xlsx", raw)[1]


def test_long_pages():
    page = "<ul>" + "<li>x<b>" * 3000 + "</ul>" + "<p>" + "word " * 50_000
    got = H.extract_page(page, None, H.HtmlConfig(use_summary=False))
    assert len(got["sections"]) == 1 and len(re.findall("word", got["sections"][0]["text"])) == 50_000


@pytest.mark.parametrize("budget", [1, 6, 40, 500])
@pytest.mark.parametrize("letters", ["ab", "abcdefghij"])
def test_title_growth_reaches_what_the_budget_can(spark, budget, letters):
    """Short, empty and overlapping segments, so that stretches have to grow; hits without a segment; extra columns."""
    r = random.Random(budget)
    seg = [("d", k, r.choice("TU"), "".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 5, 9])))) for k in range(150)] + [("e", k, "T", "a") for k in range(60)]
    hits = [(d, n, t, c) for n, (d, _, t, c) in enumerate(r.sample(seg, 40))] + [("d", 100, "none", "own"), ("d", 101, "T", "not there at all"), ("e", 102, "T", None), (None, 103, "T", "x")]
    want = {}
    for d, n, t, c in hits:
        c = c or ""
        own = [x for e, _, u, x in sorted(seg, key=lambda s: (s[1], s[3])) if (e, u) == (d, t)]
        if c in own:
            at = own.index(c)
            left, right = at - 1, at + 1
            while len(c) < budget and (left >= 0 or right < len(own)):
                if right < len(own):
                    c, right = X.splice_texts(c, own[right]), right + 1
                if left >= 0:
                    c, left = X.splice_texts(own[left], c), left - 1
        want[d, c] = min(n, want.get((d, c), n))
    s = spark.createDataFrame(seg, "document_id string, ord int, title string, content string").withColumn("at", F.lit("x")).withColumn("i", F.lit(1)).repartition(5)
    h = spark.createDataFrame(hits, "document_id string, hit_ord int, title string, content string").withColumn("n", F.lit(1)).repartition(3)
    assert {(x.document_id, x.page_content): x.hit_ord for x in R.title_growth(h, s, budget).collect()} == want


def test_extra_columns_in_another_case_are_replaced(spark):
    d = spark.createDataFrame([(1, "a\nb", "x", "<p>c", "# T\nd")], "ID int, page_content string, ORD string, html string, md string")
    assert S.split_by_character(d, "\n", S.SplitConfig(1, 0)).select("ord").collect()[0].ord == 0
    assert M.extract_markdown(d.select("ID", F.col("md").alias("page_content"), "ORD")).select("ord").first().ord == 0
    assert H.extract_html(d.select("ID", "html", "ORD", F.lit(1).alias("Row")), H.HtmlConfig(use_summary=False)).select("ord").first().ord == 0


def test_addresses_are_no_headings(spark):
    """Numbers of three digits in a run of numbers are an address."""
    from quarry.operators import pdf as P

    texts = {"28.68.191.238 Den schusch o geosch.": None, "66.18.58.246 Erbeie": None, "1.2.3. x": 9, "1.2.3.4 x": 8, "1.2.3.4.5 x": 7, "1.2.x": 9, "12.x": 10, "1.2.13 x": 9, "1.2.100 x": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.heading_pattern(F.col("t")).alias("p")).collect()
    assert {r.t: r.p for r in rows} == texts


def test_pdf_steps_read_their_blocks_once(spark):
    from quarry.plans import derived

    for q, n in ((derived.pdf_metrics_of_documents, 1), (derived.pdf_vote_of_documents, 1), (derived.pdf_lines_of_documents, 1), (derived.pdf_toc_of_documents, 2), (derived.pdf_title_matches_of_documents, 2)):
        plan = q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parquet") == n, q.__name__

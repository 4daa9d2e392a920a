"""Registered queries on small tables with what is found only in whole texts, against brute force."""

import re

import duckdb
from quarry.plans import catalog


def tables(spark, tmp_path, **rows):
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def documents(spark, tmp_path, texts):
    return tables(spark, tmp_path, documents=("doc_id long, text string, source string, lang string", [(i, t, f"s{i}", "en") for i, t in enumerate(texts)]))


def test_whitespace(spark, tmp_path):
    texts = ["a \t b\n" * 500, " " * 300 + "x" * 300 + " \n y ", "", " \n" * 200, "word " * 39 + "\t\n end"]
    got = {r.doc_id: (r.non_blank, r.collapsed) for r in catalog.queries()["whitespace"](spark, documents(spark, tmp_path, texts)).collect()}
    assert got == {i: (bool(t.strip()), re.sub(r"\s+", " ", t).strip()) for i, t in enumerate(texts)}


def test_links_and_images(spark, tmp_path):
    texts = ["x" * 150 + " [far](http://u) and ![[img]] z", "y\n" * 80 + "[a](b) [c](d)\n![[e]]\nend", "", "no links " * 50]
    got = {r.doc_id: r.plain for r in catalog.queries()["md_strip_links_images"](spark, documents(spark, tmp_path, texts)).collect()}
    marked = [f"[s{i}](http://en) ![[s{i}]] {t}" for i, t in enumerate(texts)]
    assert got == {i: re.sub(r"\[(.*?)\]\((.*?)\)", r"\1", re.sub(r"!\[\[(.*)\]\]", "", t)) for i, t in enumerate(marked)}
    assert got[1] == "s1  " + "y\n" * 80 + "a c\n\nend"


def conversations(spark, tmp_path, turns):
    return tables(spark, tmp_path, conversations=("conv_id long, turn int, role string, text string", turns))


def test_splice(spark, tmp_path):
    texts = ["a" + "b" * 400 + "overlap", "overlap" + "c" * 500 + "xyz", "xyz" * 150, "q" * 310, "no", ""]
    got = {r.turn: r.joined for r in catalog.queries()["splice_pairs"](spark, conversations(spark, tmp_path, [(1, i, "user", t) for i, t in enumerate(texts)])).collect()}
    fits = lambda a, b: next((k for k in range(1, min(len(a), len(b)) + 1) if a.endswith(b[:k])), 0)
    assert got == {i: a + b[fits(a, b) :] for i, (a, b) in enumerate(zip(texts, texts[1:]))}
    assert got[0] == texts[0] + texts[1][7:] and got[1] == texts[1] + texts[2][3:]


TURNS = [(c, t, ("user", "assistant")[t % 2], f"{c}.{t} " + "w" * (90 * ((c + t) % 5))) for c in range(12) for t in range(30)]
HITS = {(c, t) for c, t, _, _ in TURNS if (c * 31 + t * t * 17 + t * 3) % 7 < 3}


def test_hits_vary():
    gaps = {b[1] - a[1] for a, b in zip(sorted(HITS), sorted(HITS)[1:]) if a[0] == b[0]}
    assert {1, 2, 3, 4} <= gaps


def islands():
    """Runs of hits at most 2 apart: (conversation, turns of the hits)."""
    runs = []
    for c, t in sorted(HITS):
        if runs and runs[-1][0] == c and t - runs[-1][1][-1] <= 2:
            runs[-1][1].append(t)
        else:
            runs.append((c, [t]))
    return runs


def test_islands(spark, tmp_path):
    text = {(c, t): x + "\n" for c, t, _, x in TURNS}
    want = sorted((c, h[0], h[-1], "".join(text[c, t] for t in range(h[0], h[-1] + 1))) for c, h in islands())
    got = catalog.queries()["normal_islands"](spark, conversations(spark, tmp_path, TURNS)).collect()
    assert sorted((r.document_id, r.first, r.last, r.page_content) for r in got) == want
    assert any(len(h) > 1 and h[-1] - h[0] >= len(h) for _, h in islands())


def test_position_growth_merges_fills_and_stops(spark, tmp_path):
    text = {(c, t): x + "\n" for c, t, _, x in TURNS}
    got = catalog.queries()["normal_growth"](spark, conversations(spark, tmp_path, TURNS)).collect()
    own = {(r.document_id, r.hit_ord): r.page_content for r in got}
    whole = {(c, h[0]): "".join(text[c, t] for t in range(h[0], h[-1] + 1)) for c, h in islands()}
    # an island within the budget is one text from its first hit; a longer one falls into several of at most 2,000
    assert all(own[k] == x for k, x in whole.items() if len(x) <= 2000)
    assert all(len(x) <= 2000 for x in own.values())
    assert any(len(x) > 2000 for x in whole.values()) and len(own) > len(whole)
    assert any(len(h) > 1 and len(whole[c, h[0]]) <= 2000 for c, h in islands())


def test_title_growth_and_expansion(spark, tmp_path):
    d = conversations(spark, tmp_path, TURNS)
    body = {}
    for c, t, role, x in TURNS:
        body.setdefault((c, role), []).append((t, x))
    role = {(c, t): r for c, t, r, _ in TURNS}
    want = sorted({(c, "".join(x for _, x in body[c, role[c, t]])): min(u for b, u in HITS if b == c and role[b, u] == role[c, t]) for c, t in HITS}.items())
    assert sorted(((r.document_id, r.page_content), r.hit_ord) for r in catalog.queries()["title_expand"](spark, d).collect()) == want
    got = catalog.queries()["title_growth"](spark, d).collect()
    assert {(r.document_id, r.hit_ord) for r in got} <= HITS and len({r.hit_ord % 4 for r in got if r.document_id == 0}) > 1


def test_growth_against_sql(spark, tmp_path):
    d = conversations(spark, tmp_path, TURNS)
    for name in ("normal_growth", "title_growth"):
        got = sorted((r.document_id, r.hit_ord, r.page_content) for r in catalog.queries()[name](spark, d).collect())
        con = duckdb.connect()
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet/*.parquet'")
        assert got == sorted(map(tuple, con.sql(f"SELECT document_id, hit_ord, page_content FROM ({catalog.oracle_sql()[name]})").fetchall()))

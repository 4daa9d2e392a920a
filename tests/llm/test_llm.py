"""Each operator against brute force or an exact round trip, on tables with every edge case."""

import hashlib
import itertools
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from quarry.llm import decontaminate, language_id, line_dedup, nbest, ngram_join, quality_rules, queries, suffix_dedup, token_output, tool_calls, warc
from quarry.llm.components import connected_components

from tests import oracle

SF = "/root/testdata/sf0.001"
EDGE = [(9001, None, "a"), (9002, "", "b"), (9003, " \t\n ", None), (9004, "one two", "a"), (9004, "one two", "a"), (None, "one two three four five six " * 20, "b"), (9005, "long " * 9000, "a"), (9006, "a" * 20000, "b"), (9007, "Tie tie TIE tie " * 30, "a"), (9008, "Tie tie TIE tie " * 30, "b")]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "lang")
    e = spark.createDataFrame(EDGE, "doc_id long, text string, source string").withColumn("lang", F.lit(None).cast("string"))
    return d.unionByName(e).withColumn("n", F.lit(1)).withColumn("kind", F.lit("x")).withColumn("part", F.lit(2)).withColumn("payload", F.lit(b"z"))


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    oracle.check(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, name, tmp_path):
    for t in ("documents", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 300)] + [(7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 400)}


def test_ngram_join(docs, rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = set()
    for a, b in itertools.combinations(sorted(up), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            up[y] = x
            links.add((a, b))
    got = ngram_join.ngram_join(docs).components().collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id) if r.doc_id is not None else None) for r in got)
    every = ngram_join.ngram_join(docs, all_links=True)
    rep = {r.doc_id: r.rep for r in every.documents.collect()}
    found = {(r.a, r.b) for r in every.links.collect()}
    assert found <= links and all(rep[a] == rep[b] or tuple(sorted((rep[a], rep[b]))) in found for a, b in links)


def test_hot_near_copies(spark, monkeypatch):
    """A hub whose copies are like it but not like each other, in blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base)]
    for k in range(60):
        w = list(base)
        for j in range(7):
            w[(k * 13 + j * 57) % 400] = f"x{k}y{j}"
        texts.append(" ".join(w))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    assert {r.component_id for r in ngram_join.ngram_join(d).components().collect()} == {0}


@pytest.mark.parametrize("block", [500_000, 30])
def test_decontaminate(spark, docs, rows, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    b = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "The of"), (901, ""), (902, None), (903, "ONE two"), (903, "ONE two")], "item_id long, text string"))

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))

    windows = {}
    for i, t in b.collect():
        w = words(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(i)
    want = []
    for i, t in rows:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (x := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    items |= windows[x]
        want.append((i, len(w), len(hit), sorted(items)))
    got = [(r.doc_id, r.n_words, sum(x["last"] - x["first"] + 1 for x in r.runs), list(r["items"])) for r in decontaminate.contaminated_words(docs, b).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("batch", [400_000, 20_000])
def test_suffix_dedup(docs, rows, batch, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    first = {}
    for i, t in rows:
        t = t.encode()
        for j in range(len(t) - 49 if i is not None else 0):
            s = t[j : j + 50]
            first[s] = min(first.get(s, 1 << 60), i)
    want = []
    for i, t in rows:
        t = t.encode()
        gone = bytearray(len(t))
        for j in range(len(t) - 49 if i is not None else 0):
            if first[t[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        want.append((i, len(t), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest(), len(re.findall(b"\1+", bytes(gone)))))
    got = [(r.doc_id, r.n_bytes, hashlib.sha256(bytes(r.kept)).hexdigest(), len(r.spans)) for r in suffix_dedup.repeated_bytes(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens(spark, docs, name):
    from tokenizers import Tokenizer

    path = queries.tokenizer(name)
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(9100, "  A<|endoftext|>b\tc,d e\x1cf É I'm don't's 12,3 \x01 ß. <|ENDOFTEXT|> İx\n")], "doc_id long, text string"))
    tok, want, at = Tokenizer.from_file(path), [], 0
    for r in sorted(docs.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or "")):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
        at += len(ids)
    manifest = token_output.write_tokens(docs, path, seq_len=64)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in token_output.read_tokens(manifest, True).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    one = token_output.TokenFile(manifest.orderBy("part").first().path)
    assert one.sequence(0)[0].tolist() == list(itertools.chain.from_iterable(w[4] for w in want))[:64]


def test_language_id(docs):
    model = queries.tokenizer("piece_bpe_32k.model")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    got = language_id.identify(docs.withColumn("held", held), model, language_id.learn(docs, model, ~held)).collect()
    own = [r for r in got if r.held and r.lang]
    assert sum(r.lang == r.lang_pred for r in own) >= 0.97 * len(own)
    assert all(0 <= r.score <= 1 and (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in got)


def test_n_best_is_brute_force():
    model = queries.tokenizer("piece_bpe_32k.model")
    s = nbest.Segmenter(model, 5)
    own = {s.v.pieces[i]: i for i in s.v.own}

    def all_ways(t):
        if not t:
            return [(0.0, [])]
        out = [] if t[0] in own else [(x + s.v.unknown, s.v.spell(t[0]) + p) for x, p in all_ways(t[1:])]
        return out + [(x + s.v.score[own[t[:n]]], [own[t[:n]], *p]) for n in range(1, min(16, len(t)) + 1) if t[:n] in own for x, p in all_ways(t[n:])]

    for t in ["the cat", "  a", "é你😀", "on,the;", "xxxx x", "a\nb", "erron", "they.re"]:
        _, scores, changes = next(s.encode([t]))
        ways = sorted(all_ways("▁" + t.replace(" ", "▁")), key=lambda x: -x[0])
        assert scores == [x for x, _ in ways[:5]]
        ids = [s.apply(t, c) for c in changes]
        assert len(set(map(tuple, ids))) == len(ids) and all(s.decode(x) == t for x in ids)


def test_n_best_documents(docs):
    got = nbest.encode(docs, queries.tokenizer("piece_bpe_32k.model"), all_ids=True).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.decoded == text[r.doc_id] and (r.ids is None or list(r.n_best[0] if r.n_best else []) == list(r.ids)) for r in got)


@pytest.mark.parametrize("block", [16 << 20, 3000])
def test_warc(spark, block, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", block)
    evil = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9
    extra = [(900, "u", evil), (901, "u", None), (902, "u", "short"), (903, "u", "short"), (904, "u\r\nx", evil), (904, "u", evil), (None, "z", evil), (899, "q", "é" * 60), (898, None, "é" * 60)]
    pages = spark.read.parquet(f"{SF}/pages.parquet").unionByName(spark.createDataFrame(extra, "page_id long, url string, html string")).withColumn("digest", F.lit(1))
    body = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, h in body:
        if len(h) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    want = [(i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if first.get(h, i) != i else "response", first[h] if first.get(h, i) != i else None) for i, h in body]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(spark, warc.write_warc(pages.repartition(2))).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_quality_order_changes_nothing(docs):
    rules = quality_rules.default_rules()
    a, b = (sorted((repr(r.doc_id), r.kept) for r in quality_rules.cascade(docs, x).collect()) for x in (rules, rules[::-1]))
    assert a == b and len(a) == docs.count()


def test_line_dedup(spark):
    rows = [(i, f"cookie notice\nown line {i}\n", f"s{i % 12}") for i in range(24)] + [(50, None, "s1"), (51, "cookie notice", None), (None, "cookie notice\nx", "s2")] + [(60 + i, "copied text", f"s{i}") for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("h", F.lit(0))
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(d).collect()}
    assert got[0] == ("cookie notice\nown line 0\n", 0) and got[5] == ("own line 5\n", 1)
    assert got[50] == (None, 0) and got[51] == ("", 1) and got[None] == ("x", 1) and got[63] == ("copied text", 0)


def test_tool_calls(spark):
    calls = [(1, 0, "a", "f", '{"x": 1.0, "b": "é"}'), (1, 2, "b", "f", '{"x": {"$ref": "a"}}'), (1, 4, "c", "f", '{"x": {"$ref": "b"}}'), (1, 4, "c", "f", '{"x": {"$ref": "b"}}'), (1, 5, "d", "g", "{}"), (1, 6, "e", "f", "[1"), (1, 7, None, "f", "{}"), (2, 0, "p", "f", '{"x":{"$ref":"q"}}'), (2, 1, "q", "f", '{"x":{"$ref":"p"}}'), (2, 2, "r", "f", '{"x":{"$ref":"nope"}}')]
    results = [(1, 1, "a", "ok"), (1, 3, "z", None), (1, 9, "a", "late")]
    tools = [("f", '{"type":"object","required":["x"],"properties":{"x":{"type":"integer"}}}')]
    got = tool_calls.link_tool_calls(spark.createDataFrame(calls, "conv_id long, turn int, call_id string, name string, arguments string"), spark.createDataFrame(results, "conv_id long, turn int, call_id string, content string"), spark.createDataFrame(tools, "name string, schema string")).collect()
    by = {r.call_id: r for r in got}
    assert len(got) == 10 and [by[k].level for k in "abcdpqr"] == [0, 1, 2, 0, None, None, 0]
    assert [by[k].status for k in "abzp"] == ["linked", "no_result", "no_call", "cycle"] and by[None].status == "no_id"
    assert by["a"].json == '{"arguments":{"b":"é","x":1},"call_id":"a","name":"f","result":"ok"}' and list(by["a"].errors) == []
    assert by["d"].errors and by["e"].errors and list(by["r"].errors) == ["$ref: no call nope"]


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.filter("NOT round_trip").isEmpty()

"""Operators on hot groups, clashing names, repeated ids and very long texts, with small bounds so that every way is taken."""

import heapq
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry.llm import _store, components, decontaminate, nbest, ngram_join, quality_rules, queries, tool_calls

SHAPE = "doc_id long, text string"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(rows):
    """Smallest id of each id's component, by comparing all pairs of rows."""
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        n = len(x & y)
        if n and 100 * n >= 80 * (len(x) + len(y) - n):
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {i: find(i) for i in up}


def crowd(seed=1):
    """A large group of near copies, groups like it but apart from it, copies, and texts that share its rarest words."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(60)] = f"x{k}"
        rows.append(" ".join(w))
    for k in range(40):
        w = list(base)
        cut = r.randint(12, 40)
        w[cut:] = [f"y{k % 5}z{i}" for i in range(60 - cut)]
        rows.append(" ".join(w))
    rows += [" ".join(base)] * 60 + ["same few words"] * 40 + [None, "", " "]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("bounds", [{}, {"LOCAL": 2, "BLOCK": 8, "SMALL": 3}, {"LOCAL": 4, "BLOCK": 16, "SMALL_IDS": 0, "GROUP_BYTES": 900.0, "SALTS": 3}])
def test_hot_groups(spark, monkeypatch, bounds):
    for k, v in bounds.items():
        monkeypatch.setattr(ngram_join, k, v)
    monkeypatch.setattr(components, "HUB", 20 if bounds else 200_000)
    rows = crowd()
    d = spark.createDataFrame(rows, SHAPE).repartition(6)
    want = classes(rows)
    got = ngram_join.ngram_join(d).components().collect()
    assert sorted((r.doc_id, r.component_id, r.n_shingles) for r in got) == sorted((i, want[i], len(shingles(t))) for i, t in rows)


def test_each_pair_is_verified_once(spark, monkeypatch):
    seen = []
    verify = ngram_join._verify

    def spy(docs, pairs, *a):
        seen.append({(r.a, r.b) for r in pairs.select("a", "b").collect()})
        return verify(docs, pairs, *a)

    monkeypatch.setattr(ngram_join, "_verify", spy)
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    monkeypatch.setattr(ngram_join, "LOCAL", 3)
    # texts that are like a hub but mostly not like each other: stars and chains leave some apart
    base = [f"w{i}" for i in range(120)]
    rows = [" ".join(base)]
    for k in range(60):
        w = list(base)
        for j in range(2 + k % 3):
            w[(k * 13 + j * 37) % 120] = f"x{k}y{j}"
        rows.append(" ".join(w))
    rows = list(enumerate(rows))
    got = ngram_join.ngram_join(spark.createDataFrame(rows, SHAPE).repartition(6)).components().collect()
    want = classes(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(seen) == 2 and all(seen) and not seen[0] & seen[1]


def test_repeated_and_missing_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b), (3, b), (None, a), (None, b), (4, "alone here")]
    d = spark.createDataFrame(rows, SHAPE).withColumn("kind", F.lit(1)).withColumn("label", F.lit("x"))
    got = ngram_join.ngram_join(d).components().collect()
    assert sorted(((r.doc_id or 0), r.component_id or 0, r.n_shingles) for r in got) == sorted(((i or 0), {1: 1, 2: 1, 3: 1, 4: 4, None: 0}[i], len(shingles(t))) for i, t in rows)


@pytest.mark.parametrize("block", [500_000, 1, 7])
def test_blocks_of_windows_change_nothing(spark, block, monkeypatch):
    """Unequal texts of equal length under one id, and under none."""
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    w = [f"w{i}" for i in range(40)]
    items = [(10, " ".join(w[:10])), (11, " ".join(w[10:20])), (12, " ".join(w[5:25])), (None, " ".join(w[30:]))]
    own = [" ".join(w[:10] + ["x"] * 10), " ".join(["x"] * 10 + w[10:20]), " ".join(w[:20])]
    rows = [(i, t) for i in (1, None) for t in own] + [(1, own[0]), (2, None), (2, ""), (3, " ".join(w * 500)), (4, "w1")]
    d = spark.createDataFrame(rows, SHAPE).withColumn("runs", F.lit(0)).withColumn("n", F.lit(0)).withColumn("h0", F.lit(0))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))

    def hits(t):
        t, hit, found = (t or "").split(), set(), set()
        for i, x in items:
            x = x.split()
            for j in range(len(x) - 9):
                for p in range(len(t) - 9):
                    if t[p : p + 10] == x[j : j + 10]:
                        hit |= set(range(p, p + 10))
                        found.add(i)
        return len(t), sorted(hit), sorted(found - {None})

    got = [(r.doc_id, r.n_words, [p for x in r.runs for p in range(x["first"], x["last"] + 1)], list(r["items"])) for r in decontaminate.contaminated_words(d, b).collect()]
    assert sorted(got, key=repr) == sorted(((i, *hits(t)) for i, t in rows), key=repr)


@pytest.fixture(scope="module")
def model():
    return queries.tokenizer("piece_bpe_32k.model")


def n_best(v, text, n):
    """The n best segmentations of a whole text, by keeping n at every place: (score, ids)."""
    own = {v.pieces[i]: i for i in v.own}
    t = "▁" + text.replace(" ", "▁")
    at = [[(0.0, ())]] + [[] for _ in t]
    for e in range(1, len(t) + 1):
        new = []
        for s in range(max(0, e - v.longest), e):
            p = own.get(t[s:e])
            if p is not None:
                new += [(x + v.score[p], (*ids, p)) for x, ids in at[s]]
            elif e - s == 1:
                new += [(x + v.unknown, (*ids, *v.spell(t[s]))) for x, ids in at[s]]
        at[e] = heapq.nlargest(n, new, key=lambda x: x[0])
    return at[-1]


def test_n_best_of_whole_documents(spark, model):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text and len(r.text) < 1500][:25]
    r = random.Random(5)
    texts += ["".join(r.choice("aeinrst") for _ in range(300)), "x" * 200, "a  b\n\n c, d; e!", "日本語のテキスト é😀 "]
    s = nbest.Segmenter(model, 4)
    own = set(s.v.own.tolist()) | set(s.v.byte_of)
    for t, (ids, scores, changes) in zip(texts, s.encode(texts), strict=True):
        want = n_best(s.v, t, 4)
        assert np.allclose(scores, [x for x, _ in want]), t
        found = [s.apply(t, c) for c in changes]
        assert found[0] == ids.tolist() and len(set(map(tuple, found))) == len(found) and set(ids.tolist()) <= own
        assert all(s.decode(x) == t for x in found)


def test_an_unbroken_text_takes_little_memory(model):
    import tracemalloc

    s = nbest.Segmenter(model, 4)
    r = random.Random(6)
    list(s.encode(["warm"]))
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    tracemalloc.start()
    ids, scores, changes = next(s.encode([text]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6 and len(scores) == 4 and s.decode(ids.tolist()) == text and len({tuple(s.apply(text, c)) for c in changes}) == 4


def test_search_order_of_ties(model):
    """Of equal scores the one with the smaller last pieces comes first, with any number kept."""
    s = nbest.Segmenter(model, 50)
    v = s.v
    some = ["▁" + "a" * 12, "▁abababab", "▁xyxyxy"]
    every = nbest.searches(v, some, 5000)
    for n in (1, 2, 7, 50):
        for got, all_ in zip(nbest.searches(v, some, n), every, strict=True):
            assert got == all_[:n]
    for all_ in every:
        assert all_ == sorted(all_, key=lambda x: (-x[0], x[1][::-1]))


def test_nbest_edges(spark, model):
    rows = [(1, None), (2, ""), (2, ""), (3, " " * 50), (None, "a b")]
    d = spark.createDataFrame(rows, SHAPE).withColumn("ids", F.lit(1)).withColumn("_text", F.lit("x"))
    got = nbest.encode(d, model, all_ids=True).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(i) for i, _ in rows)
    by = {r.doc_id: r for r in got}
    assert by[1].ids is None and by[1].scores is None and by[2].ids == [] and by[2].scores == [0.0] and by[3].decoded == " " * 50 and by[None].decoded == "a b"
    with pytest.raises(ValueError):
        nbest.encode(d, model, key="ids")


def test_the_query_has_every_segmentation(spark, model, tmp_path):
    """The digests of op5 are those of all four segmentations, found by brute force, not only of the best."""
    texts = ["Banana bread, twice.\nThen none", "interoperability", "w.\n\n,x;y", "Ünïté 2024$$$ and é😀!", "", None, "a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op5_sentencepiece_nbest(spark, str(tmp_path)).collect()}
    v = nbest.Segmenter(model, 4).v
    assert len(got) == len(texts) and got[5].n_best_pieces is None and got[5].n_best_xxhash64 is None
    for i, t in enumerate(texts[:4]):
        ways = [(float(x), list(map(int, ids))) for x, ids in n_best(v, t, 64)]
        r = got[i]
        losses = [ways[0][0] - x for x, _ in ways]
        assert [float(x) for x in r.losses.split(",")] == losses[:4]
        found = list(zip(r.n_best_pieces.split(","), r.n_best_xxhash64.split(","), strict=True))
        digests = spark.createDataFrame([(n, ids) for n, (_, ids) in enumerate(ways)], "n int, ids array<int>").select("n", F.size("ids").cast("string"), F.xxhash64("ids").cast("string")).collect()
        loss = {(size, h): losses[n] for n, size, h in digests}
        # equal scores leave the order open
        assert [loss[x] for x in found] == losses[:4] and len(set(found)) == len(found)
    empty = spark.range(1).select(F.xxhash64(F.array().cast("array<int>")).cast("string")).first()[0]
    assert (got[4].n_best_pieces, got[4].n_best_xxhash64, got[4].losses) == ("0", empty, "0")
    assert got[6].n_best_pieces == ",".join(str(len(ids)) for _, ids in n_best(v, "a", 4))


def test_cuts_change_no_segmentation(model):
    """Texts cut at punctuation and line ends against the same texts as a whole."""
    r = random.Random(8)
    texts = ["".join(r.choice("the.\n ,²é1$▁'-_") for _ in range(r.randrange(1, 40))) for _ in range(150)]
    s = nbest.Segmenter(model, 4)
    for t, (scores, every) in zip(texts, s.n_best(texts), strict=True):
        whole = nbest.searches(s.v, ["▁" + t.replace(" ", "▁")], 4)[0]
        assert scores == [x for x, _ in whole] and every[0].tolist() == whole[0][1]
        assert len({tuple(x.tolist()) for x in every}) == len(every) and all(s.decode(x.tolist()) == t.replace("▁", " ") for x in every)


def test_folders_go(spark):
    import os

    t = _store.saved(spark.range(3), "x")
    path = _store._FOLDERS[t].removeprefix("file:")
    assert os.path.isdir(path)
    _store.discard(t)
    assert not os.path.exists(path)
    with _store.scratch(spark):
        t = _store.saved(spark.range(3), "x")
        path = _store._FOLDERS[t].removeprefix("file:")
        assert os.path.isdir(path)
    assert not os.path.exists(path)


@pytest.mark.parametrize("bound", [_store.SMALL_IDS, 0])
def test_rows_without_a_key_stay(spark, monkeypatch, bound):
    monkeypatch.setattr(_store, "SMALL_IDS", bound)
    d = spark.createDataFrame([("a", 1), ("b", None), ("c", 2), ("b", None), ("d", 2), ("e", 3)], "text string, id long")
    ids = spark.createDataFrame([(2,), (2,), (None,), (9,)], "id long")
    out = _store.without(d, ids, "id")
    assert sorted(r.text for r in out.collect()) == ["a", "b", "b", "e"]
    assert not _store.without(d.limit(0), ids, "id").collect() and _store.without(d, ids.limit(0), "id").count() == 6


CALLS = "conv_id long, turn int, call_id string, name string, arguments string"


def link(spark, calls, results=(), tools=(("f", "{}"),)):
    c = spark.createDataFrame(list(calls), CALLS).withColumn("id", F.lit("x")).withColumn("level", F.lit("x")).withColumn("schema", F.lit("x"))
    r = spark.createDataFrame(list(results), "conv_id long, turn int, call_id string, content string").withColumn("called", F.lit(1))
    t = spark.createDataFrame(list(tools), "name string, schema string").withColumn("turn", F.lit(1))
    return tool_calls.link_tool_calls(c, r, t).collect()


@pytest.mark.parametrize("bound", [500_000, 3])
def test_levels_of_chains_branches_and_cycles(spark, monkeypatch, bound):
    monkeypatch.setattr(tool_calls, "FOLD", bound)
    r = random.Random(7)
    deps = {(1, str(i)): {str(i - 1)} if i else set() for i in range(40)}
    deps |= {(2, str(i)): {str(r.randrange(i)) for _ in range(r.randint(0, 3))} if i else set() for i in range(30)}
    deps |= {(3, k): d for k, d in {"a": {"b"}, "b": {"c"}, "c": {"a"}, "d": {"a"}, "e": {"d", "f"}, "f": set(), "g": {"f"}, "h": {"h"}, "i": {"g", "f"}, "j": {"i"}, "k": {"j"}}.items()}
    deps |= {(4, "x"): {"y"}, (4, "y"): set()}
    calls = [(c, n, k, "f", '{"x":[' + ",".join(f'{{"$ref":"{d}"}}' for d in sorted(ds)) + "]}") for n, ((c, k), ds) in enumerate(deps.items())]

    def level(c, k, above=()):
        if k in above:
            raise RecursionError
        return max((level(c, d, (*above, k)) + 1 for d in deps[c, k]), default=0)

    for row in link(spark, calls + calls[:5]):
        try:
            want = level(row.conv_id, row.call_id)
        except RecursionError:
            want = None
        assert (row.level, row.status) == (want, "cycle" if want is None else "no_result"), row


BAD = {"p": '{"properties":{"x":{"pattern":"["}}}', "m": '{"properties":{"x":{"minLength":"3"}}}', "r": '{"required":null}', "t": '{"type":5}', "l": "[1]", "e": '{"anyOf":[]}', "n": "{", "o": '{"properties":[]}', "a": '{"anyOf":[{"type":"text"}]}'}


def test_malformed_schemas_are_errors_of_their_calls(spark):
    rows = link(spark, [(1, i, k, k, '{"x":"y"}') for i, k in enumerate(BAD)] + [(1, 99, "ok", "ok", '{"x":"y"}'), (1, 100, "un", "unknown", "{}")], tools=[*BAD.items(), ("ok", '{"properties":{"x":{"type":"string"}}}'), ("ok", "~"), (None, "{}")])
    by = {r.call_id: list(r.errors) for r in rows}
    assert by.pop("ok") == [] and by.pop("un") == by.pop("n") == ["$: unknown tool"]
    assert all(len(e) == 1 and e[0].startswith("$: the tool's schema") for e in by.values()) and len(by) == 8


def test_large_schemas_and_long_arguments(spark, monkeypatch):
    monkeypatch.setattr(tool_calls, "SMALL_SCHEMAS", 0)
    long = "w " * 200_000
    rows = link(spark, [(1, 0, "a", "f", '{"x":"' + long + '"}'), (1, 1, "b", "f", None), (1, 2, None, None, None), (None, 3, "c", "f", "{}")], [(1, 5, "a", None), (1, 4, "a", long)], [("f", '{"properties":{"x":{"maxLength":5}}}')])
    by = {r.turn: r for r in rows}
    assert by[0].errors == ["$.x: over maxLength"] and by[0].result_turn == 4 and len(by[0].json) > 800_000
    assert by[1].errors == ["$: not a JSON object"] and by[1].status == "no_result" and by[2].status == by[3].status == "no_id"


def test_canonical_numbers():
    some = {0.00001: "0.00001", 1e-7: "1e-7", 1.5e-7: "1.5e-7", 0.000001: "0.000001", 1e21: "1e+21", 1e20: "100000000000000000000", 123.456: "123.456", -0.0: "0", 5e-324: "5e-324", 1.7976931348623157e308: "1.7976931348623157e+308", 333333333.33333329: "333333333.3333333", 4.50: "4.5", 2e-3: "0.002", -1.0: "-1"}
    assert {x: tool_calls.canonical(x) for x in some} == some
    assert tool_calls.canonical({"": 1, "😀": 2, "a": [True, None, 10**30, "\x07\n\""]}) == '{"a":[true,null,1000000000000000000000000000000,"\\u0007\\n\\""],"😀":2,"":1}'


def judged(t):
    """The features and verdicts of one text in plain Python."""
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = len({p for at in grams.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)})
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dups = len(lines) - len(set(lines))
    chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t))
    base = len(w) < 50 or 100 * repeated > 50 * len(w)
    import regex

    others = len(regex.sub(r"[\p{L}\p{M}]+", "", t)) - (len(t) - chars)
    gone = 10 * symbols > len(w) or not 3 * len(w) <= chars <= 15 * len(w) or 100 * dups > 40 * len(lines) or 100 * len(re.findall("[A-Z]", t)) > 30 * chars or 2 * others > chars
    return len(w), chars, symbols, len(lines), dups, repeated, base, not base and not gone


def texts_of_quality():
    r = random.Random(9)
    word = lambda n=6: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(2, n)))
    plain = lambda n: " ".join(word() for _ in range(n))
    return [
        None, "", " \n\t\x0b ", plain(49), plain(50), plain(80), "one two three " * 40, plain(60).upper(), plain(60) + " # $ % & | < > * #", "é" + plain(55) + "日本語 😀\x85\xa0x",
        "\n".join([plain(6)] * 4 + [plain(6) for _ in range(8)]), "\n".join([plain(12)] * 5 + [plain(9)] * 2), " ".join("a" for _ in range(60)), " ".join("x" * 16 + str(i) for i in range(60)), " ".join(f"{i}.{i}" for i in range(1000, 1070)),
        plain(70) + "\r\n" + plain(5), plain(20_000), "a b c a b c " + plain(50), "\n\n".join(plain(30) for _ in range(3)) + "\n",
    ]


@pytest.mark.parametrize("wanted", [quality_rules.WANTED, ("n_words",), ()])
def test_quality_rules_are_brute_force(spark, wanted):
    rows = list(enumerate(texts_of_quality())) + [(None, "x " * 60), (5, texts_of_quality()[5])]
    d = spark.createDataFrame(rows, SHAPE).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit("x")).withColumn("_w", F.lit("x"))
    got = quality_rules.cascade(d, wanted=wanted).collect()
    want = [(i, dict(zip(quality_rules.WANTED, judged(t), strict=False)), *judged(t)[-2:]) for i, t in rows]
    assert sorted(repr((r.doc_id, [r[c] for c in wanted], r.base_failed, r.kept)) for r in got) == sorted(repr((i, [x[c] for c in wanted], b, k)) for i, x, b, k in want)


def test_rules_are_ordered_by_rejections_per_counted_work(spark):
    rules = {r.name: r for r in quality_rules.default_rules()}
    names = ["letters", "capitals", "symbols", "word_length", "repeated_lines"]
    # 100 rows of 10 characters: letters rejects 60 rows and capitals 50 of these, but both read the text; symbols rejects 5 for nothing
    rows = [(10, i < 60, i < 50, 90 <= i < 95, False, False) for i in range(100)]
    order = lambda have: [r.name for r in quality_rules.ordered([rules[n] for n in names], rows, have)]
    free = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"}
    assert order(free) == ["symbols", "capitals", "letters", "word_length", "repeated_lines"]
    # where all features are there the one that rejects most is first
    assert order(free | {"n_capitals", "n_other_signs"})[:2] == ["letters", "symbols"]
    # and with none it is the best for its work: 50 of 4 + 1 times the characters before 60 of 6 + 1
    assert order(set())[0] == "capitals"
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    orders = {tuple(r.name for r in quality_rules.order_rules(docs, list(rules.values()))) for _ in range(3)}
    assert len(orders) == 1


def test_features_that_nobody_wants_are_computed_by_the_rule(spark):
    d = spark.createDataFrame([(1, "x")], SHAPE)
    plan = quality_rules.cascade(d, rules=[quality_rules.default_rules()[3]], wanted=())._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan and "[A-Z]+" in plan and "n_symbols" not in plan and "n_dup_lines" not in plan


BIG = '{"x": 1e999}'


def test_numbers_without_end_are_faults_of_their_row(spark):
    rule = '{"type": "object", "properties": {"x": {"type": "number"}}}'
    calls = spark.createDataFrame([(1, 0, "a", "f", BIG), (1, 1, "b", "f", '{"x": -1e999}'), (1, 2, "c", "f", '{"x": 1e300}'), (1, 3, "d", "g", '{"x": "long"}')], "conv_id long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    tools = spark.createDataFrame([("f", rule), ("g", '{"properties": {"x": {"minLength": 1e999}}}')], "name string, schema string")
    got = {r.call_id: len(r.errors) for r in tool_calls.link_tool_calls(calls, results, tools).collect()}
    assert got["a"] and got["b"] and got["d"] and not got["c"]
    assert tool_calls.parse(BIG) == (None, False) and tool_calls.parse("[1e308, -0.0]") == ([1e308, -0.0], True)


def test_ids_that_are_no_numbers_are_refused(spark, tmp_path):
    from quarry.llm import suffix_dedup, token_output, warc

    d = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    good = spark.createDataFrame([(1, "some text")], SHAPE)
    for call in (lambda: token_output.write_tokens(d, queries.tokenizer("word_bpe_49k.json")), lambda: ngram_join.ngram_join(d), lambda: suffix_dedup.repeated_bytes(d), lambda: decontaminate.contaminated_words(d, good.withColumnRenamed("doc_id", "item_id")), lambda: decontaminate.contaminated_words(good, d.withColumnRenamed("doc_id", "item_id")), lambda: warc.write_warc(d, key="doc_id", payload="text", url="text")):
        with pytest.raises(TypeError, match="whole numbers"):
            call()


@pytest.mark.parametrize("key", ["_text", "t", "k"])
def test_n_best_of_any_key(spark, key):
    d = spark.createDataFrame([("x", "one two")], f"{key} string, text string")
    (r,) = nbest.encode(d, queries.tokenizer("piece_bpe_32k.model"), n=2, key=key).collect()
    assert r[key] == "x" and r.decoded == "one two"
    with pytest.raises(ValueError):
        nbest.encode(d.withColumnRenamed(key, "IDS"), queries.tokenizer("piece_bpe_32k.model"), key="IDS")

"""Language models, line dedup and the pipeline against plain Python on tables with every edge case."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry.llm import language_id, line_dedup, nbest, queries

from tests.llm.test_edges import classes, n_best

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def model():
    return queries.tokenizer("piece_bpe_32k.model")


def log_sum(v, own, unit, p):
    """Logarithm of the sum over all segmentations of a unit."""
    at = [0.0] + [-math.inf] * len(unit)
    for e in range(1, len(unit) + 1):
        terms = [at[s] + math.log(p[own[unit[s:e]]]) for s in range(max(0, e - v.longest), e) if unit[s:e] in own]
        if unit[e - 1] not in own:
            terms.append(at[e - 1] + math.log(p[-1]))
        top = max(terms, default=-math.inf)
        at[e] = top + math.log(sum(math.exp(x - top) for x in terms)) if terms else top
    return at[-1]


def predicted(v, text, langs, prob):
    if text is None or not re.search(r"[^\W\d_]", text) or not langs:
        return "und", 0.0
    own = {v.pieces[i]: i for i in v.own}
    scores = [sum(log_sum(v, own, "▁" + w, prob[:, i]) for w in text.split()) for i in range(len(langs))]
    best = scores.index(max(scores))
    return langs[best], 1 / sum(math.exp(x - scores[best]) for x in scores)


def words(seed, n, letters):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


A, B = "aeilnorst", "bdkmuvwyz"


def test_language_id_is_brute_force(spark, model):
    rows = [(i, words(i, 30, A if i % 2 else B), "xy"[i % 2]) for i in range(40)]
    rows += [(100, None, "x"), (101, "", "x"), (102, "123 .", None), (None, words(7, 20, A), "y"), (None, words(8, 20, B), "x"), (3, words(3, 30, A), "y"), (103, "ༀ" * 46 + " " + "q" * 500, None), (104, words(9, 3000, A), None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("mine")).withColumn("Lang_Pred", F.lit(1)).withColumn("h", F.lit(2))
    fitted = language_id.learn(d, model)
    langs, prob = fitted
    assert langs == ["x", "y"] and np.allclose(prob[:-1].sum(0), 1)
    got = language_id.identify(d, model, fitted)
    assert got.columns == ["doc_id", "text", "lang", "h", "lang_pred", "score"]
    v = language_id.vocab(model)
    want = {(i, t): predicted(v, t, langs, prob) for i, t, _ in rows}
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        lang, score = want[r.doc_id, r.text]
        assert r.lang_pred == lang and abs(r.score - score) < 1e-9, r
    # what is learned doesn't change with repeated rows, order or partitions
    again = language_id.learn(d.unionByName(d).repartition(7), model)
    assert again[0] == langs and np.allclose(again[1], prob)


def test_unknown_characters_do_not_underflow(model):
    texts = {"x": [words(1, 50, A)], "y": [words(2, 50, B)]}
    langs, prob = language_id.fit(texts, model)
    v = language_id.vocab(model)
    own = {v.pieces[i]: i for i in v.own}
    for text in ("ༀ" * 46, "ༀ" * 47, "q" * 47, "ༀ" * 20 + "aei"):
        got = language_id.Scorer(model, prob).texts([text])[0]
        assert np.allclose(got, [log_sum(v, own, "▁" + text, prob[:, i]) for i in range(2)], rtol=1e-9)


def test_nothing_to_learn(spark, model):
    d = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    fitted = language_id.learn(d, model)
    assert fitted[0] == [] and [(r.lang_pred, r.score) for r in language_id.identify(d, model, fitted).collect()] == [("und", 0.0)]


def kept_lines(rows, least=10):
    """(text, removed) of (id, text, source) rows: lines on many sites stay in the smallest id only."""
    sites, first = {}, {}
    trim = lambda x: x.strip(" \t\n\x0b\f\r")
    texts = {}
    for i, t, s in rows:
        if t is not None:
            texts.setdefault(t, []).append((i is None, i or 0, s))
    for t, own in texts.items():
        nameless, i, site = min(own, key=lambda x: (x[0], x[1], x[2] or ""))
        for line in {trim(x) for x in t.split("\n")} - {""}:
            if site is not None:
                sites.setdefault(line, set()).add(site)
            if not nameless:
                first[line] = min(first.get(line, i), i)
    many = {x for x, s in sites.items() if len(s) >= least}
    out = []
    for i, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        stay = [x for x in lines if trim(x) not in many or (i is not None and first.get(trim(x)) == i)]
        out.append((None if t is None else "\n".join(stay), len(lines) - len(stay)))
    return out


@pytest.mark.parametrize("bounds", [{}, {"SMALL": 1}, {"SMALL": 1, "HOT": 2}])
def test_line_dedup_is_brute_force(spark, monkeypatch, bounds):
    for k, v in bounds.items():
        monkeypatch.setattr(line_dedup, k, v)
    rows = [(i, f"cookie notice \nown {i}\n\n\t\nnine sites {i}" + ("\nnine" if i < 9 else "") + ("\nten" if i < 10 else ""), f"s{i}") for i in range(14)]
    rows += [(50, None, "s1"), (51, "", None), (52, " \n\t", "s2"), (53, "cookie notice", None), (3, "cookie notice\nsame id", "s3"), (54, "long\n" * 30_000 + "ten", "s4"), (55, "ten\nten\n ten", "s5"), (55, "ten\nten\n ten", "s5")]
    rows += [(60 + i, "copied to all", f"s{i}") for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("_th", "_flags", "_kept", "n_removed", "N_lines", "h"):
        d = d.withColumn(c, F.lit("mine"))
    got = line_dedup.dedup_lines(d)
    assert got.columns == ["doc_id", "text", "source", "_th", "_flags", "_kept", "h", "n_lines", "n_removed"]
    out = got.collect()
    assert {(r._th, r._flags, r._kept, r.h) for r in out} == {("mine",) * 4}
    want = [(i, *k) for (i, _, _), k in zip(rows, kept_lines(rows), strict=True)]
    assert sorted(repr((r.doc_id, r.text, r.n_removed)) for r in out) == sorted(map(repr, want))


def fixture(spark, tmp_path, rows, items=()):
    spark.createDataFrame(list(rows), COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_is_plain_python(spark, tmp_path, model):
    import corpus_pipeline as C

    item = words(99, 12, A)
    rows = []

    def add(i, text, lang, source=None):
        rows.append((i, text, lang, source or f"s{len(rows) % 13}", len(text or "")))

    for i in range(40):
        add(i, words(i, 40, A if i % 2 else B) + "\nterms of use\n" + words(1000 + i, 20, A if i % 2 else B), "xy"[i % 2])
    add(100, words(1, 40, A) + "\nterms of use\n" + words(1001, 20, A) + " near", "y")
    add(101, words(1, 40, A) + "\nterms of use\n" + words(1001, 20, A), "y")
    add(102, words(5, 30, A) + " " + item + " " + words(6, 30, A), "y")
    add(103, "terms of use", "y")
    for i, t in ((104, None), (105, ""), (106, "12 34 !"), (107, " \n ")):
        add(i, t, None)
    add(None, words(70, 40, A), "y")
    add(None, words(70, 40, A), "y")
    add(None, words(71, 40, B) + " " + item, None)
    add(9, words(72, 40, A), "y")
    add(9, words(72, 40, A), "y")
    sf = fixture(spark, tmp_path, rows, [(1, item), (2, None)])

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    langs, prob = language_id.learn(docs, model, allowed=~F.coalesce(held, F.lit(False)))
    v = language_id.vocab(model)
    one = [(i, t, *predicted(v, t, langs, prob), s) for i, t, _, s, _ in rows]
    one = [(i, t, lang, s) for i, t, lang, score, s in one if lang != "und" and score >= C.LEAST_SCORE]
    two = [(i, k, lang, s) for (i, _, lang, s), (k, gone) in zip(one, kept_lines([(i, t, s) for i, t, _, s in one]), strict=True) if not gone or k.strip(" \t\n\x0b\f\r")]
    # one of each group stays: rows are told apart by id and text
    named = sorted({(i, t) for i, t, _, _ in two if i is not None})
    low = classes(list(enumerate(t for _, t in named)))
    first = {x: named[low[n]] for n, x in enumerate(named)}
    three, seen = [], set()
    for i, t, lang, s in two:
        if i is None:
            three.append((i, t, lang))
        elif first[i, t][0] == i and first[first[i, t]] == first[i, t] and (i, t) not in seen:
            group = [x for x in named if first[x] == first[i, t] and x[0] == i]
            if len(group) == 1 or len({x for x in group if x in seen}) == 0:
                seen |= set(group)
                three.append((i, t, lang))
    four = [x for x in three if item not in x[1]]
    out = C.run(spark, sf).collect()
    assert sorted(repr((r.doc_id, r.lang)) for r in out) == sorted(repr((i, lang)) for i, _, lang in four)
    s = nbest.Segmenter(model, 4)
    texts = {(r.doc_id, tuple(r.ids)): r for r in out}
    for i, t, _ in four:
        ids, scores, _ = next(s.encode([t]))
        r = texts[i, tuple(ids.tolist())]
        assert r.round_trip and r.n_pieces == len(ids) and list(r.scores) == scores
        assert np.allclose(scores, [x for x, _ in n_best(s.v, t, 4)])
        assert len(r.n_best) == len(scores) and list(r.n_best[0]) == list(r.ids) and len({tuple(x) for x in r.n_best}) == len(scores)
        assert all(s.decode(x) == t for x in r.n_best)
    assert len(four) < len(three) < len(two) <= len(one) < len(rows)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as C

    assert C.run(spark, fixture(spark, tmp_path, [])).count() == 0


def test_pipeline_leaves_no_folders_behind(spark, tmp_path):
    import corpus_pipeline as C
    from quarry.llm import _store

    before = set(_store._MADE)
    C.run(spark, fixture(spark, tmp_path, [(i, words(i, 30, A), "y", "s", 1) for i in range(12)])).count()
    assert all("/stage-" in p for p in set(_store._MADE) - before)

"""Language models against enumerated segmentations, long units among the training texts, and the pipeline against plain Python."""

import math
import random

import numpy as np
import pytest
from quarry.llm import language_id, queries


@pytest.fixture(scope="module")
def model():
    return queries.tokenizer("piece_bpe_32k.model")


def ways(v, own, t):
    """All segmentations of a unit into pieces; the vocabulary's size stands for bytes."""
    if not t:
        return [[]]
    out = [] if t[0] in own else [[v.size, *w] for w in ways(v, own, t[1:])]
    return out + [[own[t[:n]], *w] for n in range(1, min(v.longest, len(t)) + 1) if t[:n] in own for w in ways(v, own, t[n:])]


def test_expected_counts_and_forward_are_brute_force(model):
    v = language_id.vocab(model)
    own = {v.pieces[i]: i for i in v.own}
    rng = np.random.default_rng(1)
    p = rng.uniform(0.1, 2, v.size + 1) / len(v.own)
    units, weight = ["▁hello", "▁é你😀ab", "▁there's", "▁"], np.array([1.0, 2.0, 3.0, 4.0])
    want, logs = np.zeros(v.size + 1), []
    for u, n in zip(units, weight, strict=True):
        found = [(math.prod(p[i] for i in w), w) for w in ways(v, own, u)]
        total = sum(x for x, _ in found)
        logs.append(math.log(total))
        for x, w in found:
            np.add.at(want, w, n * x / total)
    for f in (language_id._expected, language_id._expected_long):
        assert np.allclose(f(v, units, weight, p), want, atol=1e-12)
    prob = p[:, None]
    assert np.allclose(language_id._forward(v, units, prob)[:, 0], logs)
    assert np.allclose([language_id._forward_long(v, u, prob)[0] for u in units], logs)


def test_fit_learns_from_long_units(model, monkeypatch):
    monkeypatch.setattr(language_id, "LONG_CHARS", 500)
    rng = random.Random(3)
    run = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(60, 400)))
    a, b = "的一是不了人我在有他", "これはのをにとがでし"
    langs, prob = language_id.fit({"a": [run(a) for _ in range(20)], "b": [run(b) + " " + run(b) for _ in range(20)]}, model)
    assert langs == ["a", "b"] and not np.allclose(prob[:-1, 0], prob[:-1, 1])
    scores = language_id.Scorer(model, prob).texts([run(a), run(b), a, b])
    assert scores.argmax(1).tolist() == [0, 1, 0, 1]


def test_length_does_not_change_the_fit(model, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 12))) for _ in range(50)) for _ in range(5)]
    _, want = language_id.fit({"x": texts}, model)
    monkeypatch.setattr(language_id, "LONG", 4)
    _, got = language_id.fit({"x": texts}, model)
    assert np.allclose(got, want, rtol=1e-6, atol=1e-15)


def test_rows_that_share_an_id_go_one_by_one(spark, tmp_path):
    import corpus_pipeline as C

    word = lambda seed, n=40: " ".join(random.Random(seed).choice("abcdefghij") + str(random.Random(seed * 1000 + i).randint(0, 999)) for i in range(n))
    a, b, c, item = word(1), word(2), word(3), word(4, 12)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b), (3, c), (3, c), (4, word(5)), (4, word(6) + " " + item), (None, word(7)), (None, a), (None, word(8) + " " + item)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    show = lambda df: sorted(((r.doc_id or 0, r.text) for r in df.collect()))
    joined = C.ngram_jaccard_join(spark, docs, str(tmp_path))
    assert joined.columns == list(C.COLUMNS)
    # left out: 2 is near 1's first text, 3's first is 1's second, 3's last is a copy
    want = [(i or 0, t) for k, (i, t) in enumerate(rows) if k not in (2, 3, 5)]
    assert show(joined) == sorted(want)
    assert show(C.benchmark_decontamination(spark, joined, str(tmp_path))) == sorted(x for x in want if item not in x[1])


def test_equal_ids_of_near_texts_leave_one_row(spark, tmp_path):
    import corpus_pipeline as C

    a = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(5, a), (5, a + " x"), (4, a + " y"), (9, "other words stand here alone now")]], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in C.ngram_jaccard_join(spark, docs, str(tmp_path)).collect()) == [4, 9]

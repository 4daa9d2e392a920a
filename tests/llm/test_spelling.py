"""Spelling variants against plain Python over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from quarry.llm import spelling_variants as S

LOW = {c: c + 32 for c in range(65, 91)}


def plain_counts(rows, every=199):
    total = Counter()
    for k, t in rows:
        for r in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOW)
            h = zlib.crc32(f"{'' if k is None else k}:{r}".encode())
            if h % every == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            if len(r) >= 6:
                total[r] += 1
    return {w: n for w, n in total.items() if n >= 5}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(words, times=5):
    near = {a: [b for b in words if b != a and abs(len(a) - len(b)) < 2 and one_edit(a, b)] for a in words}
    form = {}
    for a, own in near.items():
        b = min(own, key=lambda x: (-words[x], x), default=None)
        form[a] = b if b is not None and words[b] >= times * words[a] else None

    def root(a):
        while form[a] is not None:
            a = form[a]
        return a

    return sorted((a, form[a] or "", root(a), words[a], len(near[a]), words[form[a]] if form[a] else 0) for a in words)


def got(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def crowd(seed, size=250):
    """Words that share short and long ends, many to a block, of few letters and some beyond ASCII."""
    r = random.Random(seed)
    words = {"".join(r.choice("abé") for _ in range(r.randint(6, 8))) for _ in range(size)}
    words |= {"common" + "".join(r.choice("xyz") for _ in range(r.randint(0, 4))) for _ in range(size)}
    words |= {"".join(r.choice("xyz") for _ in range(r.randint(0, 4))) + "ending" for _ in range(size)}
    words |= {"abc" + c + "def" for c in "abcdefghijklmnopqrstuvwxyzàéÿ"} | {"q" * 3000, "q" * 2999, "q" * 2999 + "r"}
    return {w: r.choice([1, 2, 5, 6, 30, 31, 200, 1000]) for w in words}


@pytest.mark.parametrize("bounds", [{}, {"BLOCK": 4, "ROOM": 5000}, {"BLOCK": 1, "SMALL_IDS": 0}])
def test_groups(spark, monkeypatch, bounds):
    for k, v in bounds.items():
        monkeypatch.setattr(S, k, v)
    words = crowd(1)
    df = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("near", F.lit(1)).withColumn("l", F.lit(2)).repartition(5)
    assert got(S.variant_groups(df)) == plain_groups(words)


@pytest.mark.parametrize("bounds", [{}, {"BLOCK": 3}])
def test_each_pair_comes_once(spark, monkeypatch, bounds):
    for k, v in bounds.items():
        monkeypatch.setattr(S, k, v)
    words = crowd(2, 80)
    rows = [(r.word, r.near) for r in S.near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()]
    assert sorted(rows) == sorted((a, b) for a in words for b in words if a != b and abs(len(a) - len(b)) < 2 and one_edit(a, b))


def test_chains_of_forms(spark):
    words = {"abcdef": 5, "abcdeg": 25, "abcdhg": 125, "abcihg": 625, "abjihg": 3125, "zzzzzz": 9, "zzzzzy": 44, "zzzzyy": 45}
    assert got(S.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long"))) == plain_groups(words)


@pytest.mark.parametrize("bounds", [{}, {"HOLD": 3, "AT_ONCE": 10}])
@pytest.mark.parametrize("every", [199, 3])
def test_counts(spark, monkeypatch, bounds, every):
    for k, v in bounds.items():
        monkeypatch.setattr(S, k, v)
    r = random.Random(4)
    some = ["spelling", "Spelling", "ÉCOLIERS", "école×÷s", "variantes", "a1b2", "tok_en", "naïveté", "short", "ABCDEFG"]
    rows = [(k % 30 or None, " ".join(r.choice(some) for _ in range(40))) for k in range(60)] + [(1, None), (2, ""), (3, "x" * 5000), (3, "x" * 5000), (4, "one-word\n" * 9)]
    d = spark.createDataFrame(rows, "id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("k", F.lit(1)).repartition(4)
    assert {x.word: x.n for x in S.word_counts(d, key="id", drop_every=every).collect()} == plain_counts(rows, every)
    assert S.variant_groups(S.word_counts(d.limit(0), key="id")).count() == 0

"""Dictionaries and the words of a context against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from quarry.functions import dictionary as D
from quarry.functions import text as X


def plain_words(context, words):
    n = len(context)
    found = [(i, k) for i in range(n) for k in range(2, n - i + 1) if context[i : i + k] in words]
    covered = {j for i, k in found for j in range(i, i + k)}
    return [context[i : i + k] for i, k in sorted(found + [(i, 1) for i in range(n) if i not in covered])]


@pytest.mark.parametrize("size", [0, 1, 40, 3000])
def test_trie(size):
    r = random.Random(size)
    words = {"".join(r.choice("ab袁遥尧🦜c") for _ in range(r.randint(1, 6))) for _ in range(size)}
    d = D.Dictionary(words)
    contexts = ["".join(r.choice("ab袁遥尧🦜cxyz") for _ in range(r.randint(0, 8))) for _ in range(500)] + ["", "a"]
    own = [sorted((i, n) for i in range(len(c)) for n in range(1, len(c) - i + 1) if c[i : i + n] in words) for c in contexts]
    context, first, length = d.find(contexts)
    got = [[] for _ in contexts]
    for k, i, n in zip(context.tolist(), first.tolist(), length.tolist(), strict=True):
        got[k].append((i, n))
    assert got == own
    assert [d(c) for c in contexts] == [plain_words(c, words) for c in contexts]
    assert d.protects(contexts, ["袁"] * len(contexts)).tolist() == [any(n > 1 and "袁" in c[i : i + n] for i, n in x) for c, x in zip(contexts, own, strict=True)]


def test_repair_asks_once_for_a_context(spark, monkeypatch):
    d = D.Dictionary(["渊博", "尧舜", "ab尧"])
    texts = ["他学问渊博袁人称尧舜遥", "x袁x", "ab尧c", "尧ab", None, "", "渊渊渊博", "遥" * 3000]
    repair = X.protected_punctuation(d)
    want = [None if t is None else repair(t) for t in texts]
    assert X._repaired(texts, d) == want
    assert want[0] == "他学问渊博，人称尧舜。"
    asked = []
    monkeypatch.setattr(D.Dictionary, "protects", lambda self, a, c, f=D.Dictionary.protects: asked.extend(zip(a, c, strict=True)) or f(self, a, c))
    X._repaired(texts * 3, d)
    assert len(asked) == len(set(asked))
    df = spark.createDataFrame([(t, 1) for t in texts], "t string, word int").select(X.repair_punctuation(F.col("t"), d).alias("r"))
    assert [r.r for r in df.collect()] == want


@pytest.mark.parametrize("grams", [False, True])
def test_learned_words(spark, grams):
    r = random.Random(7)
    some = ["天地", "玄黄", "宇宙洪荒", "日月", "盈昃"]
    texts = ["".join(r.choice(some) for _ in range(12)) + " one two threefold " + r.choice("xy") for _ in range(60)] + [None, "", " "]
    d = spark.createDataFrame([(t, 1) for t in texts], "text string, n int").repartition(3)
    got = {x.word: x.n for x in D.learn_words(d, least=10, longest=4, grams=grams, cohesion=2.0).collect()}
    runs = [w for t in texts if t for w in re.findall(r"[^\W\d_]+", t)]
    if not grams:
        assert got == {w: n for w, n in Counter(w for w in runs if 2 <= len(w) <= 4).items() if n >= 10}
        return
    n = Counter(w[i : i + k] for w in runs for k in range(1, 5) for i in range(len(w) - k + 1))
    n = {w: k for w, k in n.items() if k >= 10}
    total = sum(map(len, runs))
    want = {w: k for w, k in n.items() if len(w) > 1 and all(k * total >= 2.0 * n[w[:i]] * n[w[i:]] for i in range(1, len(w)))}
    assert got == want and {"天地", "玄黄", "日月"} <= set(got)
    assert D.learn_words(d.limit(0), grams=True).count() == 0


def test_bounded(spark, monkeypatch):
    monkeypatch.setattr(D, "MOST", 2)
    words = spark.createDataFrame([("ab",), ("cd",), ("ab",), (None,)], "word string")
    with pytest.raises(ValueError):
        D.Dictionary.of(words.unionByName(spark.createDataFrame([("ef",)], "word string")))
    assert D.Dictionary.of(words.filter("word IS NOT NULL"))("xabcdy") == ["x", "ab", "cd", "y"]

"""Character sets found by pairs of bytes, against plain Python counts."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from quarry.functions import charsets as C
from quarry.sources import files

SETS = ("utf-8", "gb18030", "big5hkscs", "cp1252", "utf-16-le")
LINES = ["天地玄黄宇宙洪荒日月盈昃辰宿列张", "寒来暑往秋收冬藏闰余成岁律吕调阳", "une élève zélée à l'école près du château", "Größe, Übermut und ähnliche Wörter", "plain words of no set at all", None, ""]


def plain_model():
    n = {s: Counter() for s in SETS}
    for t in LINES * 3:
        for s in SETS:
            try:
                b = (t or "").encode(s)
            except UnicodeEncodeError:
                continue
            n[s].update(zip(b, b[1:], strict=False))
    most = max(sum(x.values()) for x in n.values()) + 65536
    return n, lambda s, p: round(-1024 * math.log2((n[s][p] + 1) / most))


@pytest.fixture(scope="module")
def counts(spark):
    return C.pair_counts(spark.createDataFrame([(t, 1) for t in LINES * 3], "text string, n int").repartition(4), sets=SETS)


def test_counts_and_weights(counts):
    n, weight = plain_model()
    assert {(r.codec, divmod(r.pair, 256)): r.n for r in counts.collect()} == {(s, p): k for s, x in n.items() for p, k in x.items()}
    model = C.Charsets.of(counts, SETS)
    b = "寒来暑往".encode("gb18030")
    assert model.weigh(b).tolist() == [sum(weight(s, p) for p in zip(b, b[1:], strict=False)) for s in SETS]


@pytest.mark.parametrize("codec", ["utf-8", "gb18030", "cp1252", "utf-16-le"])
@pytest.mark.parametrize("text", ["日月盈昃天地玄黄辰宿列张", "l'élève zélée près de l'école du château"])
def test_found(counts, codec, text, monkeypatch):
    model = C.Charsets.of(counts, SETS)
    try:
        b = text.encode(codec)
    except UnicodeEncodeError:
        return
    assert b.decode(model.find(b)) == text
    monkeypatch.setattr(C, "AT_ONCE", 7)
    assert b.decode(model.find(b)) == text


def test_columns(spark, counts):
    model = C.Charsets.of(counts, SETS)
    rows = [(None,), (b"",), (b"short",), (b"only ascii words here",), ("une élève zélée à l'école".encode("cp1252"),), ("﻿élève zélée".encode(),), ("élève zélée".encode("utf-16"),), (b"\xff\xfe\xfa" * 9 + b"\x81",)]
    d = spark.createDataFrame(rows, "content binary").withColumn("guess", C.guessed(F.col("content"), model))
    got = [(r.guess, r.t) for r in d.select("guess", C.decoded(F.col("content"), F.col("guess")).alias("t")).collect()]
    assert [g for g, _ in got[:-1]] == [None, "utf-8", "utf-8", "utf-8", "cp1252", "utf-8-sig", "utf-16"]
    assert [t for _, t in got[3:7]] == ["only ascii words here", "une élève zélée à l'école", "élève zélée", "élève zélée"]
    assert C.pair_counts(spark.createDataFrame([], "text string"), sets=SETS).count() == 0
    with pytest.raises(LookupError):
        C.pair_counts(d, "guess", ("no-such-set",))


def test_files_that_state_none(spark, counts):
    model = C.Charsets.of(counts, SETS)
    page = "<html><head><title>x</title></head><body><p>日月盈昃天地玄黄辰宿列张寒来暑往</p></body></html>"
    stated = page.replace("<head>", '<head><meta charset="gbk">')
    rows = [("/a.html", page.encode("gb18030")), ("/b.html", stated.encode("gbk")), ("/c.csv", "clé,élève\nprès,château\n".encode("cp1252")), ("/d.md", "# élève\n\nprès du château".encode("cp1252"))]
    got = {r.path: r.text for r in files.texts(spark.createDataFrame(rows, "path string, content binary"), charsets=model).collect()}
    assert got["/a.html"] == page and got["/b.html"] == stated
    assert "élève" in got["/c.csv"] and "château" in got["/d.md"]
    d = spark.createDataFrame(rows[:2], "path string, content binary")
    assert [r.c for r in d.select(files.page_charset(F.col("content"), model).alias("c")).collect()] == ["gb18030", "gbk"]

"""Functions of whole batches hold a piece of their rows' results at a time."""

import inspect

import pandas as pd
from pyspark.sql import functions as F

from quarry.functions import charsets as C
from quarry.functions import text as X
from quarry.functions.dictionary import Dictionary
from quarry.functions.pieces import ROWS, SIZE, pieces
from quarry.operators import html as H
from quarry.operators import markdown as M


def test_pieces_are_bounded_and_keep_rows():
    text = pd.Series(["a"] * 1_200 + ["b" * SIZE, None, "c" * (SIZE - 1), "dd"])
    got = list(pieces([(text, pd.Series(range(len(text)))), (text[:0], text[:0])]))
    assert [v for t, _ in got for v in t] == text.tolist() and [v for _, k in got for v in k] == list(range(len(text)))
    assert all(len(t) <= ROWS and (len(t) == 1 or sum(map(len, t.dropna())) <= SIZE) for t, _ in got)
    assert [len(x) for (x,) in pieces([text[:700]])] == [500, 200]


def test_large_batches_are_read_in_pieces(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    rows = spark.range(1_300).coalesce(1).select("id", F.concat(F.lit("# h\n<p>尧 é"), "id").alias("t"))
    most = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), "int")
    assert rows.select(most("t").alias("n")).agg(F.max("n")).first()[0] == 1_300
    pages = H.extract_html(rows, H.HtmlConfig(use_summary=False), "t").select("id", F.col("page_content").substr(-4, 4).alias("end"))
    assert sorted((r.id, r.end) for r in pages.collect()) == [(i, f"尧 é{i}"[-4:]) for i in range(1_300)]
    marked = M.extract_markdown(rows, text="t")
    assert sorted((r.id, r.page_content) for r in marked.collect()) == [(i, f"<p>尧 é{i}") for i in range(1_300)]
    found = rows.select("id", C.decoded(C.encoded(F.col("t"), "cp1252"), F.lit("cp1252")).alias("lost"), X.repair_punctuation(F.col("t"), Dictionary(["x"])).alias("r"))
    assert sorted((r.id, r.lost, r.r) for r in found.collect()) == [(i, None, f"# h\n<p>、 é{i}") for i in range(1_300)]
    for udf in (C.encoded, C.guessed, C.decoded, X.repair_punctuation, H.page_udf, M.sections_udf):
        assert "pieces(batches)" in inspect.getsource(udf)

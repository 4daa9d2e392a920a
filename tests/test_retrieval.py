from pyspark.sql import functions as F
from quarry.functions.text import splice
from quarry.operators import retrieval as R


def test_islands(spark):
    seg = spark.range(100).select(F.lit("t").alias("document_id"), F.col("id").cast("int").alias("doc_id"), F.col("id").cast("int").alias("position"), F.col("id").cast("string").alias("page_content"))
    hits = spark.createDataFrame([("t", 1, 0), ("t", 3, 1), ("t", 6, 2), ("t", 10, 3)], "document_id string, doc_id int, hit_ord int")
    got = [r.page_content for r in R.positional_islands(hits, seg).orderBy("seed_ord").collect()]
    assert got == ["123", "6", "10"]


def test_splice(spark):
    cases = [("aba", "aba", "ababa"), ("aa", "aab", "aaab"), ("1", "123", "123"), ("ab", "cd", "abcd"), ("x", "", "x")]
    df = spark.createDataFrame(cases, "a string, b string, want string").select(splice(F.col("a"), F.col("b")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())

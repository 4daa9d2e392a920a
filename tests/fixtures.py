"""Small tables for operators whose inputs the reference tables lack, as DataFrames and as SQL from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BLOCKS = ("doc_id INT, page_idx INT, block_idx INT, y0 DOUBLE, y1 DOUBLE, text STRING", [
    (d, p, b, float(y0), float(y1), t)
    for d, pages in ((1, 4), (2, 3), (3, 1))
    for p in range(pages)
    for b, (y0, y1, t) in enumerate([
        (0, 10 if d != 2 else 10 + p, f"head {d}"),
        (20, 40, f"{p + 1} Part {p}" if d == 1 else f"text {p}"),
        (40, 60, f"body\nof {d}.{p}"),
        (60, 80, f"more {p}"),
        (90, 100, f"page {p}"),
    ])
    if not (d == 1 and p == 2 and 1 <= b <= 3)
])
TOC = ("doc_id INT, toc_ord INT, level INT, title STRING, page INT", [(1, 0, 1, "1 Part 0", 1), (1, 1, 2, "2 Part 1", 2), (1, 2, 4, "deep", 2), (1, 3, 2, "4Part3", 3), (2, 0, 1, "text 1", 2), (2, 1, 1, "absent", 3)])
REPAIR = ("id INT, raw STRING", [(1, "37 益袁5依1 滋g"), (2, "伊10遥叶书曳"), (3, "逸5 臆6"), (4, "a\xa0b c　d\ne"), (5, "揖x铱耀y")])
RECORDS = ("id INT, content STRING, revised STRING, initial STRING, supplementary STRING, plan STRING, operation STRING", [(1, "性别：[ 女 ] 年龄: [ 40 ] 性别：[男]", "r", "i", "s", "p", "o"), (2, "科室：[内科]", None, "i", "s", "", "o"), (3, "none", "", "i", None, None, None), (4, None, None, None, "s", None, "")])
NODES = ("id INT, tag STRING, class STRING, node_id STRING, link_text STRING, text STRING", [(1, "div", "article body", "main", "ab", "abcd"), (2, "UL", "sidebar", None, "", ""), (3, "td", "footer text", "comment", "a", "ab"), (4, "h1", None, "", "", "x"), (5, "p", "plain", "x", "x", "xxx")])


def frame(spark: SparkSession, fixture) -> DataFrame:
    schema, rows = fixture
    return spark.createDataFrame(rows, schema)


def values(name: str, fixture) -> str:
    """A common table expression with the rows."""
    schema, rows = fixture
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [c.split()[1].replace("STRING", "VARCHAR") for c in schema.split(", ")]
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
    return f"{name} AS (SELECT " + ", ".join(f"{n}::{k} AS {n}" for n, k in zip(names, kinds, strict=True)) + f" FROM (VALUES {body}) v({', '.join(names)}))"

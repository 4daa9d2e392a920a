"""Pages as tables of nodes, so that Spark's windows and joins answer what a tree is walked for.

``node_table`` makes a page's tree into events in document order: an element's start and end, and
each string.  Between an element's start and end stand its descendants, so a sum over a
subtree is a difference of running sums; one shuffle by page serves all windows.
What ``sized`` and ``scored`` read more than once, elements without their texts, is written to ``spark.checkpoint.dir``.
``sized`` adds text and link lengths, ``scored`` the main-content scores of all
elements above a paragraph, ``title_paths`` the headings that are in force at each string.

A null or empty page has its ``html`` element alone; keys may be null but must tell pages
apart; columns other than key and html are ignored; no rows give no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.dom import SCRIPTS, UNSEEN, parse
from quarry.functions.readable import PAUSES, PRIORS, Readability, _paragraphs_from_divs, _prune_unlikely
from quarry.functions.text import SPACE, class_weight
from quarry.sources.shared import shared_folder

START, STRING, END = 0, 1, 2
PARAGRAPHS = ("p", "pre", "td")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Bytes of page text in an Arrow batch of events.
BATCH = 4 << 20
_SCHEMA = "ord int, kind int, pre int, tag string, class string, id string, text string, glued int, up array<int>"


def _events(html: str | None, prepared: bool):
    """(kind, pre, tag, class, id, text, glued, up) of a page's events.

    up: an element's ancestors' numbers, itself first, for paragraphs alone.  glued: of a string, that it goes on a
    word of the string before it; of an end, that the element's first string does.  An element's text is that of headings.
    """
    root = parse(html, SCRIPTS if prepared else UNSEEN)
    if prepared:
        _prune_unlikely(root)
        _paragraphs_from_divs(root)
    number, firsts, open_word = 0, [], False
    stack: list[int] = []
    for kind, x, node in root.events():
        if kind == "start":
            stack.append(number)
            firsts.append(None)
            up = stack[::-1] if node.tag in PARAGRAPHS else None
            yield START, number, node.tag, node.attrs.get("class"), node.attrs.get("id"), " ".join(node.text().split()) if node.tag in HEADINGS else None, 0, up
            number += 1
        elif kind == "end":
            yield END, stack.pop(), node.tag, None, None, None, int(firsts[-1] or 0), None
            first = firsts.pop()
            if firsts and firsts[-1] is None:
                firsts[-1] = first
        elif x:
            glued = int(open_word and not x[0].isspace())
            if firsts[-1] is None:
                firsts[-1] = glued
            open_word = not x[-1].isspace()
            yield STRING, stack[-1], None, None, None, x, glued, None


def node_table(pages: DataFrame, html: str = "html", key: str = "page_id", prepared: bool = False) -> DataFrame:
    """key, ord and a page's events; ``prepared`` as main-content selection has the tree: without unlikely elements, bare divs as paragraphs."""
    kind = dict(pages.dtypes)[key]

    def run(it):
        names = ["ord", "kind", "pre", "tag", "class", "id", "text", "glued", "up"]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32())]
        for batch in it:
            keys, rows, have = [], [], 0

            def made(keys=keys, rows=rows, own=batch.column(0)):
                columns = list(zip(*rows, strict=True))
                return pa.RecordBatch.from_arrays([own.take(pa.array(keys, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["k", *names])

            for i, t in enumerate(batch.column(1).to_pylist()):
                for n, e in enumerate(_events(t, prepared)):
                    rows.append((n, *e))
                    keys.append(i)
                have += len(t or "")
                if have > BATCH:
                    yield made()
                    keys.clear(), rows.clear()
                    have = 0
            if rows:
                yield made()

    return pages.select(F.col(f"`{key}`").alias("k"), F.col(f"`{html}`").alias("h")).mapInArrow(run, f"k {kind}, {_SCHEMA}")


def sized(nodes: DataFrame) -> DataFrame:
    """k, pre, tag, class, id, up, size (of the text with single spaces), links (the same of all links below), pauses."""
    w = W.partitionBy("k").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = F.when(F.col("kind") == STRING, F.col("text")).otherwise("")
    signs = F.length(F.regexp_replace(t, SPACE, ""))
    words = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, SPACE, " "), r"[^ ]+", "x"), " ", ""))
    pauses = F.length(t) - F.length(F.regexp_replace(t, PAUSES.pattern, ""))
    own = {"signs": signs, "words": words - F.when(F.col("kind") == STRING, F.col("glued")).otherwise(0), "pauses": pauses}
    n = nodes.select("*", *[F.sum(c).over(w).alias(f"_{name}") for name, c in own.items()]).filter(F.col("kind") != STRING)
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    between = lambda c: at(END, f"_{c}") - at(START, f"_{c}")
    # an element's first string begins a word in the element, whatever stands before
    el = n.groupBy("k", "pre").agg(F.first("tag").alias("tag"), at(START, "class").alias("class"), at(START, "id").alias("id"), F.first("up", ignorenulls=True).alias("up"), at(START, "ord").alias("_from"), at(END, "ord").alias("_to"), between("signs").alias("_s"), (between("words") + at(END, "glued")).alias("_w"), between("pauses").alias("pauses"))
    el = el.withColumn("size", F.when(F.col("_w") > 0, F.col("_s") + F.col("_w") - 1).otherwise(0))
    el = _written(el)
    link = F.when(F.col("tag") == "a", F.col("size")).otherwise(0)
    ends = el.select("k", "pre", F.explode(F.array(F.struct(F.col("_from").alias("ord"), link.alias("n"), F.lit(START).alias("kind")), F.struct(F.col("_to").alias("ord"), F.lit(0).cast(dict(el.dtypes)["size"]).alias("n"), F.lit(END).alias("kind")))).alias("e")).select("k", "pre", "e.*")
    links = ends.withColumn("_n", F.sum("n").over(w)).groupBy("k", "pre").agg((at(END, "_n") - at(START, "_n")).alias("links"))
    return _with(el, links).select("k", "pre", "tag", "class", "id", "up", "size", "links", "pauses")


def _written(rows: DataFrame) -> DataFrame:
    """Rows that several steps read, written once, so that pages aren't parsed again for each of them."""
    at = shared_folder(rows.sparkSession, "nodes")
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def _with(el: DataFrame, more: DataFrame) -> DataFrame:
    """Elements with what was computed of them; a null key is a page's too."""
    more = more.withColumnsRenamed({"k": "_k", "pre": "_pre"})
    return el.join(more, el["k"].eqNullSafe(more["_k"]) & (el["pre"] == more["_pre"])).drop("_k", "_pre")


def scored(nodes: DataFrame, how: Readability | None = None) -> DataFrame:
    """k, pre, tag, score of every element above a paragraph with enough text, and of these: what it weighs by itself, and each paragraph's points by distance, less its share of links."""
    how = how or Readability()
    el = _written(sized(nodes))
    points = F.col("pauses") + 1 + F.least(F.col("size") / 100, F.lit(3))
    given = el.filter(F.col("tag").isin(*PARAGRAPHS) & (F.col("size") >= how.min_text)).select("k", points.alias("points"), F.posexplode("up").alias("far", "pre"))
    given = given.groupBy("k", "pre").agg(F.sum(F.col("points") / (F.col("far") + 1)).alias("given"))
    prior = F.lit(0)
    for tag, n in PRIORS.items():
        prior = F.when(F.col("tag") == tag, n).otherwise(prior)
    own = class_weight(F.col("class"), F.col("id"), F.col("tag"), how.positive, how.negative) + prior
    return _with(el, given).select("k", "pre", "tag", ((own + F.col("given")) * (1 - F.col("links") / F.greatest("size", F.lit(1)))).alias("score"))


def title_paths(nodes: DataFrame) -> DataFrame:
    """k, ord, text, titles of every string outside headings: the headings in force, the highest first."""
    w = W.partitionBy("k").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    begins = F.col("kind") == START
    n = nodes.select("*", *[F.last(F.when(begins & (F.col("tag") == h), F.struct("ord", "text")), ignorenulls=True).over(w).alias(h) for h in HEADINGS], F.sum(F.when(F.col("tag").isin(*HEADINGS), F.when(begins, 1).when(F.col("kind") == END, -1)).otherwise(0)).over(w).alias("_inside"))
    higher, titles = F.lit(-1), []
    for h in HEADINGS:
        at = F.coalesce(F.col(h)["ord"], F.lit(-1))
        titles.append(F.when(at > higher, F.col(h)["text"]))
        higher = F.greatest(higher, at)
    return n.filter((F.col("kind") == STRING) & (F.col("_inside") == 0)).select("k", "ord", "text", F.array_compact(F.array(*titles)).alias("titles"))

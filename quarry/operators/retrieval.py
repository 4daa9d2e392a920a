"""Re-assembly of retrieved chunks: by neighbouring position or by shared title.

Hits of a document without segments, and hits whose segment isn't among them, pass
through with their own text.  Windows run over one document's hits, which retrieval
bounds; segments are joined by document and position, so a long document's are spread.
"""

from __future__ import annotations

from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import splice_texts
from quarry.schema import TITLE_SEPARATOR
from quarry.sources.shared import shared_folder

KEY = ["document_id", "doc_id"]


def _content(hits: DataFrame) -> Column:
    return F.col("page_content") if "page_content" in hits.columns else F.lit(None).cast("string")


def _placed(hits: DataFrame, segments: DataFrame) -> DataFrame:
    """document_id, doc_id, hit_ord, own (the hit's text), position; null where no segment has the hit's doc_id."""
    place = segments.groupBy(*KEY).agg(F.max("position").alias("position"))
    return hits.select(*KEY, "hit_ord", _content(hits).alias("own")).join(place, KEY, "left")


def _islands(placed: DataFrame, max_window: int) -> DataFrame:
    w = W.partitionBy("document_id").orderBy("position", "hit_ord")
    gap = F.col("position") - F.lag("position").over(w)
    return placed.withColumn("_new", F.when(gap <= max_window, 0).otherwise(1)).withColumn("island", F.sum("_new").over(w))


def _filled(isles: DataFrame, segments: DataFrame) -> DataFrame:
    """The segments between an island's first and last position, by an equi-join: an island is as long as its hits and gaps."""
    places = isles.withColumn("position", F.explode(F.sequence("first", "last")))
    last = segments.groupBy("document_id", "position").agg(F.max("page_content").alias("page_content"))
    return places.join(last, ["document_id", "position"])


def positional_islands(hits: DataFrame, segments: DataFrame, max_window: int = 2) -> DataFrame:
    """Hits of a document whose positions are at most ``max_window`` apart become one text, gaps filled with the segments between.

    hits: document_id, doc_id, hit_ord and, for those without a segment, page_content;
    segments: document_id, doc_id, position, page_content.  Returns document_id,
    seed_ord (the first hit's), seed_doc_id, first, last, page_content; first and last
    are null for a hit that passes through.
    """
    placed = _placed(hits, segments)
    isles = _islands(placed.filter("position IS NOT NULL"), max_window).groupBy("document_id", "island").agg(F.min("position").alias("first"), F.max("position").alias("last"), F.min(F.struct("hit_ord", "doc_id")).alias("seed"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "page_content"))), lambda x: x["page_content"]), "")
    out = _filled(isles, segments).groupBy("document_id", "island", "first", "last", "seed").agg(text.alias("page_content"))
    out = out.select("document_id", F.col("seed.hit_ord").alias("seed_ord"), F.col("seed.doc_id").alias("seed_doc_id"), "first", "last", "page_content")
    null = F.lit(None).cast(dict(out.dtypes)["first"])
    return out.unionByName(placed.filter("position IS NULL").select("document_id", F.col("hit_ord").alias("seed_ord"), F.col("doc_id").alias("seed_doc_id"), null.alias("first"), null.alias("last"), F.col("own").alias("page_content")))


def title_expansion(hits: DataFrame, segments: DataFrame) -> DataFrame:
    """Each hit becomes all contents under its title, in order; equal texts of a document stay once, at the first hit.

    hits: document_id, hit_ord, title and, for those under no known title, content;
    segments: document_id, ord, title, content.
    """
    body = segments.groupBy("document_id", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), "").alias("page_content"))
    own = F.col("content") if "content" in hits.columns else F.lit(None).cast("string")
    found = hits.withColumn("_own", own).join(body, ["document_id", "title"], "left")
    return found.groupBy("document_id", F.coalesce("page_content", "_own").alias("page_content")).agg(F.min("hit_ord").alias("hit_ord"))


def dispatch(hits: DataFrame) -> DataFrame:
    """How each document's hits are re-assembled: by title if the first has one."""
    first = F.min_by(F.contains("page_content", F.lit(TITLE_SEPARATOR)), "hit_ord")
    return hits.groupBy("document_id").agg(F.when(first, "title").otherwise("position").alias("strategy"), F.min("hit_ord").alias("first_ord"))


def distinct_contents(docs: DataFrame, key: str, content: str) -> DataFrame:
    """The first row of each content."""
    return docs.groupBy(content).agg(F.min(key).alias(key))


def format_segments(docs: DataFrame) -> DataFrame:
    """content, doc_id, document_id, score; what a table lacks is null."""
    some = {"content": "page_content", "doc_id": "doc_id", "document_id": "document_id", "score": "score"}
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).alias(name) for name, c in some.items()])


# Re-assembly within a budget of characters. By position, growth is decided over lengths
# alone; by title, over the segments that the budget can reach. Texts are joined only inside it.


def grow_island(parts: list[tuple[int, int, int | None]], window: int, budget: int) -> list[tuple[int, int, int]]:
    """(hit_ord, first, last position) per seed. parts: position, length, hit_ord or null, by position.

    Hits in order of retrieval take in the unused hits right and left of them, at most
    ``window`` positions on, with what lies between, until the text would exceed ``budget``.
    """
    before = {}
    total = 0
    for p, n, _ in parts:
        before[p] = total
        total += n
    first_of = parts[0][0] if parts else 0
    sums = [before.get(p) for p in range(first_of, parts[-1][0] + 1)] + [total] if parts else [0]
    for i in range(len(sums) - 2, -1, -1):  # a place without a segment adds nothing
        sums[i] = sums[i + 1] if sums[i] is None else sums[i]
    size = lambda lo, hi: sums[hi + 1 - first_of] - sums[lo - first_of]
    order = {p: o for p, _, o in parts if o is not None}
    used: set[int] = set()
    out = []
    for seed in sorted(order, key=order.get):
        if seed in used:
            continue
        used.add(seed)
        lo = hi = seed
        reach, full = {1: 0, -1: 0}, False
        while not full and min(reach.values()) <= window:
            for way in (1, -1):
                if reach[way] > window:
                    continue
                reach[way] += 1
                at = hi + reach[way] if way == 1 else lo - reach[way]
                if reach[way] > window or at not in order or at in used:
                    continue
                if size(min(lo, at), max(hi, at)) > budget:
                    full = True
                    break
                used.add(at)
                lo, hi, reach[way] = min(lo, at), max(hi, at), 0
        out.append((order[seed], lo, hi))
    return out


def positional_growth(hits: DataFrame, segments: DataFrame, max_window: int = 2, budget: int = 2000) -> DataFrame:
    """document_id, hit_ord (the seed's), page_content; texts longer than ``budget`` only where a single segment is.

    Islands are cut by windows over hits alone; what is gathered of one is a length and a
    number for each place. Texts meet seed by seed, inside the budget.
    """

    @F.pandas_udf("array<struct<hit_ord:long,first:long,last:long>>")
    def grow(parts: pd.Series) -> pd.Series:
        return parts.map(lambda a: grow_island([(x["position"], x["n"], x["hit_ord"]) for x in a], max_window, budget))

    placed = _placed(hits, segments)
    h = placed.filter("position IS NOT NULL").groupBy("document_id", "position").agg(F.min("hit_ord").cast("long").alias("hit_ord"))
    h = _islands(h, max_window)
    isles = h.groupBy("document_id", "island").agg(F.min("position").alias("first"), F.max("position").alias("last"))
    texts = segments.groupBy("document_id", "position").agg(F.coalesce(F.max("page_content"), F.lit("")).alias("page_content"))
    places = isles.withColumn("position", F.explode(F.sequence("first", "last"))).select("document_id", "island", "position")
    sizes = places.join(texts.select("document_id", "position", F.length("page_content").alias("n")), ["document_id", "position"]).join(h.select("document_id", "position", "hit_ord"), ["document_id", "position"], "left")
    part = F.struct(F.col("position").cast("long").alias("position"), F.col("n"), F.col("hit_ord"))
    grown = sizes.groupBy("document_id", "island").agg(F.array_sort(F.collect_list(part)).alias("_g")).select("document_id", F.explode(grow("_g")).alias("_g")).select("document_id", "_g.*")
    own = grown.withColumn("position", F.explode(F.sequence("first", "last"))).join(texts, ["document_id", "position"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "page_content"))), lambda x: x["page_content"]), "")
    own = own.groupBy("document_id", "hit_ord").agg(text.alias("page_content"))
    return own.unionByName(placed.filter("position IS NULL").select("document_id", F.col("hit_ord").cast("long"), F.col("own").alias("page_content")))


def grow_title(content: str, behind: list[str], before: list[str], budget: int) -> tuple[str, int]:
    """A hit's text with its title's contents, the nearest behind and before it in turns, while it is shorter than ``budget``; and the turns taken."""
    turns = 0
    for a, b in zip_longest(behind, before):
        if len(content) >= budget:
            break
        content = splice_texts(content, a or "")
        content = splice_texts(b or "", content)
        turns += 1
    return content, turns


#: Times by which the reach of hits grows that the first one wasn't enough for, as segments overlapped.
WIDER = 4


def title_growth(hits: DataFrame, segments: DataFrame, budget: int = 2000) -> DataFrame:
    """document_id, hit_ord, page_content; hits and segments as in ``title_expansion``, hits with their ``content``. A hit under no known title stays as it is; equal texts of a document stay once, at the first hit.

    Segments stand on the running sum of their title's lengths, cut into stretches of the budget. A hit meets those of
    its own stretch and the next ones, which is all that the budget can reach, not its title. Where overlaps
    left a text short of the budget and of its title's ends, the stretches grow and the hit comes again.
    """
    # a running sum over a title is a window that spills; nothing of a title is gathered
    place = W.partitionBy("document_id", "title").orderBy("ord", "content")
    seg = segments.select("document_id", "title", "ord", F.coalesce("content", F.lit("")).alias("content"))
    seg = seg.withColumn("i", F.row_number().over(place)).withColumn("at", F.sum(F.length("content")).over(place.rowsBetween(W.unboundedPreceding, W.currentRow)))
    ends = seg.groupBy("document_id", "title").agg(F.max("i").alias("n"))
    hits = hits.select("document_id", F.col("hit_ord"), "title", F.coalesce("content", F.lit("")).alias("content"))
    first = seg.groupBy("document_id", "title", "content").agg(F.min(F.struct("i", "at")).alias("p"))
    found = hits.join(first, ["document_id", "title", "content"], "left").join(ends, ["document_id", "title"], "left")
    done = found.filter("p IS NULL").select("document_id", "hit_ord", "content")
    todo = found.filter("p IS NOT NULL").select("document_id", "hit_ord", "title", "content", "p.i", "p.at", "n")

    @F.pandas_udf("struct<text:string,enough:boolean>")
    def grow(content: pd.Series, parts: pd.Series, i: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        for c, own, at, last in zip(content, parts, i, n, strict=True):
            text = {x["i"]: x["content"] for x in own}
            # neighbours without a gap on either side
            hi = next(k for k in range(at + 1, last + 2) if k > last or k not in text)
            lo = next(k for k in range(at - 1, -1, -1) if k < 1 or k not in text)
            # a side that ends where its stretch does, not its title, allows as many turns only
            turns = min(hi - at - 1 if hi <= last else last, at - lo - 1 if lo >= 1 else last)
            whole, taken = grow_title(c, [text[k] for k in range(at + 1, hi)][:turns], [text[k] for k in range(at - 1, lo, -1)][:turns], budget)
            rows.append((whole, len(whole) >= budget or (hi > last and lo < 1)))
        return pd.DataFrame(rows, columns=["text", "enough"])

    reach = max(budget, 1)
    while True:
        cut = lambda d: F.floor(F.col("at") / reach)  # noqa: E731, B023
        # a segment that begins in an earlier stretch than it ends in is met from both
        starts = F.floor((F.col("at") - F.length("content")) / reach)
        own = seg.withColumn("b", F.explode(F.array_distinct(F.array(cut(seg), starts))))
        near = todo.withColumn("b", F.explode(F.sequence(cut(todo) - 2, cut(todo) + 2)))
        parts = near.join(own.select("document_id", "title", "b", F.col("i").alias("_i"), F.col("content").alias("_c")), ["document_id", "title", "b"])
        parts = parts.groupBy("document_id", "hit_ord", "title", "content", "i", "at", "n").agg(F.collect_set(F.struct(F.col("_i").alias("i"), F.col("_c").alias("content"))).alias("_p"))
        path = shared_folder(parts.sparkSession, "grown")
        parts.withColumn("g", grow("content", "_p", "i", "n")).drop("_p").write.parquet(path)
        grown = parts.sparkSession.read.parquet(path)
        done = done.unionByName(grown.filter("g.enough").select("document_id", "hit_ord", F.col("g.text").alias("content")))
        todo = grown.filter("NOT g.enough").drop("g")
        if todo.isEmpty():
            break
        reach *= WIDER
    return done.groupBy("document_id", F.col("content").alias("page_content")).agg(F.min("hit_ord").alias("hit_ord")).select("document_id", "hit_ord", "page_content")


def _titled(rows: DataFrame, ord_: str | None) -> DataFrame:
    """title and content of a text: before and behind the first separator. A segment without one goes under the title before it, a hit without one under its whole text."""
    at = F.instr("page_content", TITLE_SEPARATOR)
    there = at > 0
    title = F.when(there, F.substring(F.col("page_content"), F.lit(1), at - 1))
    if ord_:
        title = F.last(title, ignorenulls=True).over(W.partitionBy("document_id").orderBy(ord_))
    else:
        title = F.coalesce(title, "page_content")
    return rows.withColumn("title", title).withColumn("content", F.when(there, F.substring(F.col("page_content"), at + len(TITLE_SEPARATOR), F.length("page_content"))).otherwise(F.col("page_content")))


def reorganize(hits: DataFrame, segments: DataFrame, budget: int = 2000, max_window: int = 2) -> DataFrame:
    """All hits of a query re-assembled, document by document, by title where a document's first hit has one and by position elsewhere.

    hits: hit_ord, document_id, doc_id, page_content, and score if there is one;
    segments: document_id, doc_id, position, page_content.  Returns first_ord (that
    of the document's first hit), hit_ord, document_id, doc_id, score, strategy
    (title, position, or none where the document has no segments) and page_content:
    in order of first_ord and hit_ord the documents stand as they were first seen.
    No hits give no rows.
    """
    score = F.col("score") if "score" in hits.columns else F.lit(None).cast("double")
    hits = hits.select(F.col("hit_ord").cast("long").alias("hit_ord"), *KEY, score.alias("score"), "page_content")
    # a key that a missing document has too
    key = F.coalesce(F.concat(F.lit("="), F.col("document_id").cast("string")), F.lit("-")).alias("_k")
    known = segments.select(key).distinct().withColumn("_known", F.lit(True))
    how = dispatch(hits.select(key.alias("document_id"), "hit_ord", "page_content")).withColumnRenamed("document_id", "_k").join(known, "_k", "left")
    hits = hits.withColumn("_k", key).join(how.select("_k", "first_ord", F.when(F.col("_known") & (F.col("_k") != "-"), F.col("strategy")).otherwise("none").alias("strategy")), "_k")
    of = lambda name: hits.filter(F.col("strategy") == name)
    own = lambda name: segments.join(of(name).select("document_id").distinct(), "document_id", "left_semi")
    grown = positional_growth(of("position"), own("position"), max_window, budget).select("document_id", "hit_ord", "page_content")
    titled = title_growth(_titled(of("title"), None), _titled(own("title"), "position").withColumn("ord", F.col("position")), budget)
    grown = grown.unionByName(titled.select("document_id", "hit_ord", "page_content"))
    columns = ["first_ord", "hit_ord", *KEY, "score", "strategy", "page_content"]
    return hits.drop("page_content").join(grown, ["document_id", "hit_ord"]).select(columns).unionByName(of("none").select(columns))

"""N-gram Jaccard join: which documents share at least so many hundredths of their word shingles.

Method: rare-first prefix filtering with length, positional and suffix filters.

1. A pass over all documents counts every shingle in a count sketch of fixed
   size (``WIDTH`` counters, summed slice by slice).  It only orders shingles
   from rare to frequent; any order gives the same result.
2. A second pass emits each document's prefix, the ``n - ceil(0.8 n) + 1``
   rarest of its ``n`` shingles: two similar documents share one of them.
   Documents of a task with equal shingle sets emit one prefix.
3. Prefixes meet by shingle.  Where a task has more than ``LOCAL`` rows of one,
   they are linked there and only their head travels, so no task meets more rows
   of a shingle than ``LOCAL`` for each portion of the input.  Small buckets give
   all their pairs, larger ones a star around the document where the shingle
   stands first and a chain of neighbours, so a bucket of m documents gives O(m)
   pairs.  The length filter and the positional filter drop pairs that can't
   reach the threshold.
4. Pairs are dealt by the component of candidates they belong to, so a document's
   set travels once; the pairs of a large component are dealt by the leaf of
   their star, and those of a document with very many by the other one.  The
   suffix filter compares histograms of hash ranges (a lower bound of the
   symmetric difference); what is left is verified on the sets, once per pair:
   pairs of a later round that an earlier one had are left out.
5. Verified links give components.  Buckets whose documents are still in
   different components are compared across components only (with ``all_links``
   across all rows): the rows outside a bucket's largest component against all
   its rows, block against block, so what is copied grows with their product.
   Nothing is capped.

Shingles are told apart by 64-bit hashes.

Edge cases: a null or blank text has an empty set and links with nothing; a
text of fewer words than a shingle is one shingle; equal rows are copies and
share a component; a null id gives a row with a null component; rows that share
an id are in one component, each with its own set (they are joined by a hash of
id and text); an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._store import SMALL_IDS, lean, n_parts, saved, whole_ids
from .components import connected_components

WIDTH = 1 << 21
SLICES = 64
SMALL = 8
LOCAL = 32
BLOCK = 512
BINS = 16
#: Bytes of sets of one component, and of one document's pairs, that go to one partition.
GROUP_BYTES = 250e3
#: Parts of a shingle's rows where the table of shingles is too large for a broadcast.
SALTS = 32
#: Marks the head of rows that were linked before they travelled.
HEAD = K.U(1 << 63)


def shingle_sets(data, offs, k):
    """For each row the sorted distinct shingle hashes."""
    s, e, wo = K.words(data, offs, K.NOT_SPACE)
    h = K.word_hashes(data, s, e)
    g = K.gram_hashes(h, k)
    for a, b in zip(wo[:-1], wo[1:], strict=True):
        n = b - a
        yield np.unique(g[a : b - k + 1]) if n >= k else K.one_gram(h[a:b]) if n else g[:0]


def _ceil_div(a, b):
    return -(-a // b)


def _sketch(docs: DataFrame, text: str, k: int) -> tuple[np.ndarray, int]:
    schema = "slice int, total long, counts binary"

    def count(it):
        c, total = np.zeros(WIDTH, np.uint32), 0
        for batch in it:
            for _, _, data, offs in K.text_chunks(batch.column(0)):
                for x in shingle_sets(data, offs, k):
                    total += len(x)
                    _bump(c, x)
        part = c.reshape(SLICES, -1)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "total": pa.array([total] + [0] * (SLICES - 1), pa.int64()), "counts": pa.array([x.astype(np.uint8 if x.max() < 256 else np.uint16 if x.max() < 65536 else np.uint32).tobytes() for x in part], pa.binary())})

    size = WIDTH // SLICES

    def plus(it):
        """Sums of slices, as batches come."""
        sums: dict[int, list] = {}
        for batch in it:
            for i, total, raw in zip(*(batch.column(k).to_pylist() for k in ("slice", "total", "counts")), strict=True):
                x = np.frombuffer(raw, {size: np.uint8, 2 * size: np.uint16, 4 * size: np.uint32, 8 * size: np.uint64}[len(raw)])
                have = sums.setdefault(i, [0, np.zeros(size, np.uint64)])
                have[0] += total
                have[1] += x
        for i, (total, x) in sums.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "total": pa.array([total], pa.int64()), "counts": pa.array([x.tobytes()], pa.binary())})

    def level(x):
        return np.minimum(255, np.round(8 * np.log2(1 + x.astype(np.float64)))).astype(np.uint8)

    # two rounds of sums: among some tasks first, so that no task reads the slices of all
    some = docs.select(text).mapInArrow(lean(count), schema).withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(32)))
    some = some.repartition(n_parts(docs.sparkSession, 0), "slice", "lane").select("slice", "total", "counts").mapInArrow(lean(plus), schema)
    merged = [(r[0], r[1], level(np.frombuffer(r[2], np.uint64))) for r in some.repartition(SLICES, "slice").mapInArrow(lean(plus), schema).collect()]
    out = np.zeros(WIDTH, np.uint8).reshape(SLICES, -1)
    for s, _, x in merged:
        out[s] = x
    return out.reshape(-1), sum(t for _, t, _ in merged)


def _bump(c, x):
    i, n = np.unique((x >> K.U(43)).astype(np.int64), return_counts=True)  # x is sorted, and so are the counters
    c[i] += n.astype(np.uint32)


def _need(na, nb, num, den):
    """Least intersection of sets of na and nb elements with intersection/union >= num/den."""
    return _ceil_div(num * (na + nb), num + den)


def _passes(na, pa_, nb, pb, num, den):
    """Length filter, and the positional filter for a first common token at these places."""
    lo, hi = np.minimum(na, nb), np.maximum(na, nb)
    return (den * lo >= num * hi) & (1 + np.minimum(na - pa_, nb - pb) - 1 >= _need(na, nb, num, den))


def _pairs_of(hub, leaf, n):
    """Distinct pairs as (smaller id, larger id, 1 where the smaller is the leaf, n)."""
    lo, hi = np.minimum(hub, leaf), np.maximum(hub, leaf)
    keep = np.flatnonzero(lo != hi)
    o = keep[np.lexsort((hi[keep], lo[keep]))]
    lo, hi, leaf, n = lo[o], hi[o], leaf[o], n[o]
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return lo[new], hi[new], (leaf == lo)[new].astype(np.int64), n[new]


def _bucket_pairs(tok, doc, n, pos, num, den, small):
    """Pairs of rows sorted by token and then position: stars, chains, and all pairs of small buckets."""
    first = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
    m = np.diff(np.r_[first, len(tok)])
    many = np.repeat(m, m)
    hub, leaf = [np.repeat(first, m)], [np.arange(len(tok))]
    for d in range(1, small):
        i = np.flatnonzero((tok[d:] == tok[:-d]) & ((many[d:] <= small) | (d == 1)))
        hub.append(i), leaf.append(i + d)
    i, j = np.concatenate(hub), np.concatenate(leaf)
    ok = _passes(n[i], pos[i], n[j], pos[j], num, den)
    i, j = i[ok], j[ok]
    return _pairs_of(doc[i], doc[j], n[j]), first, many


def _sorted_rows(tok, doc, npos):
    """Rows by token, position, size and document; n and pos apart, and whether a row is a head."""
    head = (npos & HEAD) != 0
    n, pos = ((npos & ~HEAD) >> K.U(32)).astype(np.int64), (npos & K.U(0xFFFFFFFF)).astype(np.int64)
    o = np.lexsort((doc, n, pos, tok))
    return tok[o], doc[o], n[o], pos[o], head[o]


@dataclass
class NgramJoin:
    #: doc_id, rep (a document of the task with the same set), n: one row per row of the input.
    documents: DataFrame
    #: a < b: verified links between documents with different ids; with all_links every one between representatives.
    links: DataFrame
    #: Where rows of an id differ, doc_id above is a key of id and text: key, id and the smallest key of the id.
    keys: DataFrame | None = None

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every input row."""
        links, d = self.links.select("a", "b"), self.documents
        if self.keys is not None:
            links = links.unionByName(self.keys.select(F.col("key").alias("a"), F.col("first").alias("b")))
        labels = connected_components(links)
        nameless = d.filter("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
        d = d.filter("doc_id IS NOT NULL").join(labels, F.col("rep") == F.col("node"), "left").select("doc_id", "n", F.coalesce("component", "rep").alias("c"))
        if self.keys is not None:
            d = d.join(self.keys.select(F.col("key").alias("doc_id"), "id"), "doc_id").select(F.col("id").alias("doc_id"), "n", "c")
        # a component's smallest id is its label but where no task chose it to stand for its set; written, so that a hot one can be split
        low = saved(d.groupBy("c").agg(F.min("doc_id").alias("low")).filter("low <> c"), "low")
        d = d.join(F.broadcast(low) if low.count() <= SMALL_IDS else low, "c", "left")
        return d.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "c").alias("component_id")).unionByName(nameless)


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 4, den: int = 5, all_links: bool = False) -> NgramJoin:
    """Link documents whose shingle sets have den * intersection >= num * union."""
    docs = docs.select(whole_ids(docs, key).alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    keys = None
    if _unlike(docs):
        docs = docs.withColumn("id", F.col("doc_id")).withColumn("doc_id", F.when(F.col("id").isNotNull(), F.xxhash64("id", "text")))
        keys = saved(docs.filter("id IS NOT NULL").select(F.col("doc_id").alias("key"), "id").distinct(), "keys")
        keys = saved(keys.join(keys.groupBy("id").agg(F.min("key").alias("first")), "id"), "keys")
        docs = docs.select("doc_id", "text")
    level, total = _sketch(docs, "text", k)
    shared = spark.sparkContext.broadcast(level)
    parts = n_parts(spark, 24 * 0.21 * total)

    def prefixes(it):
        seen: dict[bytes, int] = {}
        rows, held, size = [[], [], [], []], [], 0
        freq = shared.value

        def flush():
            n = len(rows[0])
            if n:
                yield 0, np.concatenate([np.array(x, np.int64) for x in rows]).tobytes(), (rows[0][0] or 0) % parts
                for x in rows:
                    x.clear()
            if held:
                tok, doc, npos = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                o = np.argsort(tok, kind="stable")
                t = tok[o]
                first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                m = np.diff(np.r_[first, len(t)])
                many = np.repeat(m > LOCAL, m)
                if many.any():
                    i = o[many]
                    ht, hd, hn, hp, _ = _sorted_rows(tok[i], doc[i], npos[i])
                    found, heads, _ = _bucket_pairs(ht, hd, hn, hp, num, den, 2)
                    both = (hn.astype(K.U) << K.U(32)) | hp.astype(K.U)
                    yield 3, np.concatenate(found).tobytes(), int(hd[0]) % parts
                    yield 2, ht.tobytes() + hd.tobytes() + both.tobytes(), int(hd[-1]) % parts
                    i = o[~many]
                    tok, doc, npos = np.r_[tok[i], ht[heads]], np.r_[doc[i], hd[heads]], np.r_[npos[i], both[heads] | HEAD]
                p = ((tok & K.U(0xFFFFFFFF)) % K.U(parts)).astype(np.int64)
                o = np.argsort(p, kind="stable")
                cut = np.flatnonzero(np.r_[True, p[o][1:] != p[o][:-1]])
                for i in np.split(o, cut[1:]):
                    yield 1, tok[i].tobytes() + doc[i].tobytes() + npos[i].tobytes(), int(p[i[0]])

        def out(x):
            x = list(x)
            return pa.RecordBatch.from_pydict({"kind": pa.array([r[0] for r in x], pa.int32()), "part": pa.array([r[2] for r in x], pa.int32()), "payload": pa.array([r[1] for r in x], pa.binary())})

        for batch in it:
            ids = batch.column(0).to_pylist()
            for lo, _, data, offs in K.text_chunks(batch.column(1)):
                for j, x in enumerate(shingle_sets(data, offs, k)):
                    d, n = ids[lo + j], len(x)
                    rep = d
                    if n and d is not None:
                        fp = _print(x)
                        rep = seen.setdefault(fp, d)
                        if rep == d:
                            p = n - _ceil_div(num * n, den) + 1
                            o = np.argsort(freq[(x >> K.U(43)).astype(np.int64)], kind="stable")[:p]
                            held.append((x[o], np.full(p, d, np.int64), (np.uint64(n) << K.U(32)) | np.arange(p, dtype=np.uint64)))
                            size += 24 * p
                    rows[0].append(d or 0), rows[1].append(d is not None), rows[2].append(rep or 0), rows[3].append(n)
                if size > 24e6:
                    yield out(flush())
                    size = 0
        yield out(flush())

    dealt = docs.mapInArrow(lean(prefixes), "kind int, part int, payload binary").repartition(parts, "part")

    def meet(it):
        cols = [[], [], []]
        for batch in it:
            for kind, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                raw = raw.as_buffer()
                if kind == 0:
                    x = np.frombuffer(raw, np.int64).reshape(4, -1)
                    yield _rows(0, pa.array(x[0], mask=x[1] == 0), x[2], x[3])
                    continue
                if kind == 3:
                    a, b, leaf, n = np.frombuffer(raw, np.int64).reshape(4, -1)
                    yield _rows(1, a, b, leaf, n)
                    continue
                m = raw.size // 24
                x = [np.frombuffer(raw, t, m, 8 * m * i) for i, t in enumerate((np.uint64, np.int64, np.uint64))]
                if kind == 2:
                    yield _rows(2, x[0].view(np.int64), x[1], (x[2] >> K.U(32)).astype(np.int64), (x[2] & K.U(0xFFFFFFFF)).astype(np.int64))
                    continue
                for c, y in zip(cols, x, strict=True):
                    c.append(y)
        if not cols[0]:
            return
        tok, doc, npos = (np.concatenate(c) for c in cols)
        o = np.argsort(tok)
        t = tok[o]
        same = np.r_[False, t[1:] == t[:-1], False]
        o = o[same[1:] | same[:-1]]
        if not len(o):
            return
        tok, doc, n, pos, head = _sorted_rows(tok[o], doc[o], npos[o])
        (a, b, leaf, size), first, many = _bucket_pairs(tok, doc, n, pos, num, den, SMALL)
        yield _rows(1, a, b, leaf, size)
        # what was linked before it travelled is among the rest already
        rest = (np.maximum(many, np.repeat(np.add.reduceat(head, first), np.diff(np.r_[first, len(tok)])) * (SMALL + 1)) > SMALL) & ~head
        yield _rows(2, tok[rest].view(np.int64), doc[rest], n[rest], pos[rest])

    met = saved(dealt.mapInArrow(lean(meet), "kind int, a long, b long, n long, pos long"), "met")
    documents = met.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("rep"), "n")
    pairs = saved(met.filter("kind = 1").groupBy("a", "b").agg(F.min("n").alias("leaf"), F.max("pos").alias("size")), "pairs")
    links = saved(_verify(docs, pairs, k, num, den), "links")
    rest = met.filter("kind = 2").select(F.col("a").alias("token"), F.col("b").alias("doc"), "n", "pos")
    if all_links:
        rest = rest.withColumn("label", F.col("doc"))
    else:
        labels = connected_components(links)
        rest = rest.join(labels, F.col("doc") == F.col("node"), "left").select("token", "doc", "n", "pos", F.coalesce("component", "doc").alias("label"))
    rest = saved(rest, "rest")
    # combined before the shuffle: rows of a shingle and label, then labels of a shingle
    spread = rest.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
    spread = saved(spread.select("token", "m", (F.col("m") - F.col("top.c")).alias("q"), F.col("top.label").alias("top")), "spread")
    if not (n := spread.count()):
        return NgramJoin(documents, links, keys)
    if n <= SMALL_IDS // 2:
        rest = rest.join(F.broadcast(spread), "token")
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        rest = rest.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(spread.withColumn("salt", salt), ["token", "salt"])
    more = saved(_across(rest, parts, num, den).groupBy("a", "b").agg(F.min("leaf").alias("leaf"), F.max("size").alias("size")).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    if more.isEmpty():
        return NgramJoin(documents, links, keys)
    return NgramJoin(documents, saved(links.unionByName(_verify(docs, more, k, num, den)), "links"), keys)


def _unlike(docs: DataFrame) -> bool:
    """Whether an id stands in rows of different texts; texts are read only where ids repeat."""
    twice = saved(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "twice")
    if not (n := twice.count()):
        return False
    h = docs.join(F.broadcast(twice) if n <= SMALL_IDS else twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
    return not h.filter("low <> high").isEmpty()


def _print(x: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(x.data)


def _rows(kind, a, b, n, pos=None):
    z = len(b)
    return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(z, kind, np.int32)), "a": a if isinstance(a, pa.Array) else pa.array(a), "b": pa.array(b), "n": pa.array(n), "pos": pa.array(np.zeros(z, np.int64) if pos is None else pos)})


def _across(rest: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """Pairs of a shingle's rows with different labels: those out of its top label, in blocks, with all, in blocks."""
    # few rows out of the top label meet all others in small blocks, as many copies of either side being made at most as of the other
    block = F.greatest(F.least(F.col("q"), F.lit(BLOCK)), F.lit(BLOCK // 16))
    some = rest.withColumn("minor", F.col("label") != F.col("top")).withColumn("nb", F.ceil(F.col("q") / F.lit(BLOCK)).cast("long")).withColumn("nr", F.ceil(F.col("m") / block).cast("long")).withColumn("h", F.xxhash64("doc"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    cols = ["token", "b", "r", "side", "minor", "doc", "n", "pos", "label"]
    left = some.filter("minor").withColumn("b", F.pmod("h", "nb")).withColumn("r", every(F.col("nr"))).withColumn("side", F.lit(0))
    right = some.withColumn("r", F.pmod("h", "nr")).withColumn("b", every(F.col("nb"))).withColumn("side", F.lit(1))
    both = left.select(cols).unionByName(right.select(cols)).repartition(parts, "token", "b", "r").sortWithinPartitions("token", "b", "r")

    def compare(x):
        left, right = np.flatnonzero(x["side"] == 0), np.flatnonzero(x["side"] == 1)
        for lo in range(0, len(left), 512):
            i = left[lo : lo + 512, None]
            ok = (x["label"][i] != x["label"][right]) & (~x["minor"][right] | (x["doc"][i] < x["doc"][right])) & _passes(x["n"][i], x["pos"][i], x["n"][right], x["pos"][right], num, den)
            p, q = np.nonzero(ok)
            yield x["doc"][i[p, 0]], x["doc"][right[q]], x["n"][right[q]]

    def pairs(it):
        held, found, n_found = [], [], 0

        def out():
            a, b, leaf, size = _pairs_of(*(np.concatenate(c) for c in zip(*found, strict=True)))
            found.clear()
            for lo in range(0, len(a), 10_000):
                yield pa.RecordBatch.from_pydict({k: pa.array(c[lo : lo + 10_000]) for k, c in (("a", a), ("b", b), ("leaf", leaf), ("size", size))})

        # groups come one after the other; the last of a batch may go on in the next
        for batch in chain(it, [None]):
            if batch is not None:
                held.append({k: c.to_numpy(zero_copy_only=False) for k, c in zip(batch.schema.names, batch.columns, strict=True)})
            x = {k: np.concatenate([h[k] for h in held]) for k in cols} if held else {}
            held.clear()
            if not x or not len(x["token"]):
                continue
            new = np.flatnonzero(np.r_[True, (x["token"][1:] != x["token"][:-1]) | (x["b"][1:] != x["b"][:-1]) | (x["r"][1:] != x["r"][:-1])])
            edge = np.r_[new, len(x["token"])]
            whole = len(edge) - 1 - (batch is not None)
            for s, e in zip(edge[:whole], edge[1 : whole + 1], strict=True):
                for pair in compare({k: v[s:e] for k, v in x.items()}):
                    found.append(pair)
                    n_found += len(pair[0])
                if n_found > 500_000:
                    yield from out()
                    n_found = 0
            if batch is not None:
                held.append({k: v[edge[whole] :] for k, v in x.items()})
        if found:
            yield from out()

    return both.mapInArrow(lean(pairs), "a long, b long, leaf long, size long")


def _near(x, y, num, den) -> bool:
    """Whether two sets, each with its histogram, reach the threshold: suffix filter, then the sets."""
    (p, hp), (q, hq) = x, y
    n = len(p) + len(q)
    if int(np.abs(hp - hq).sum()) * (num + den) > n * (den - num):
        return False
    if len(p) > len(q):
        p, q = q, p
    if not len(p):
        return False
    i = np.searchsorted(q, p)
    i[i == len(q)] = 0
    inter = int((q[i] == p).sum())
    return den * inter >= num * (n - inter)


_EDGES = np.arange(1, BINS, dtype=K.U) << K.U(60)


def _dealt(pairs: DataFrame) -> DataFrame:
    """The pairs with ``group``: small components whole, large ones by leaf, and the pairs of a heavy leaf by hub."""
    labels = connected_components(pairs)
    of = lambda one, other: F.when(F.col("leaf") == 1, F.col(one)).otherwise(F.col(other))
    p = pairs.select("a", "b", of("a", "b").alias("node"), of("b", "a").alias("hub"), "size").join(labels, "node").withColumnRenamed("node", "leaf")
    p = saved(p, "pairs")

    def large(name):
        some = saved(p.groupBy(name).agg(F.ceil(8 * F.sum("size") / GROUP_BYTES).cast("long").alias(f"{name}_parts")).filter(f"{name}_parts > 1"), "large")
        n = some.count()
        return (F.broadcast(some) if n <= SMALL_IDS else some) if n else None

    if (some := large("component")) is None:
        return p.withColumn("group", F.xxhash64("component"))
    p = p.join(some, "component", "left").withColumn("by_leaf", F.when(F.col("component_parts").isNotNull(), F.pmod(F.xxhash64("leaf"), F.col("component_parts"))))
    by_hub = F.lit(None).cast("long")
    if (some := large("leaf")) is not None:
        p, by_hub = p.join(some, "leaf", "left"), F.when(F.col("leaf_parts").isNotNull(), F.pmod(F.xxhash64("hub"), F.col("leaf_parts")))
    return p.withColumn("group", F.xxhash64("component", "by_leaf", by_hub))


def _verify(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of a written table that reach the threshold."""
    spark = pairs.sparkSession
    if pairs.isEmpty():
        return pairs.select("a", "b")
    p = saved(_dealt(pairs).select("a", "b", "group", "size"), "dealt")
    ends = p.select("group", "size", F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id", "group").agg(F.max("size").alias("size"))
    asked = saved(ends.groupBy("doc_id").agg(F.collect_list("group").alias("groups"), F.sum("size").alias("size")), "asked")
    n, size = asked.agg(F.count("*"), F.sum("size")).first()
    parts = n_parts(spark, 10 * size)
    # 16 MB of ids and groups at most are broadcast
    ids = asked.select("doc_id", "groups")
    wanted = docs.join(F.broadcast(ids) if n <= 500_000 and p.count() <= 1_000_000 else ids, "doc_id")

    def sets(it):
        seen: set[int] = set()
        for batch in it:
            for lo, hi, data, offs in K.text_chunks(batch.column(1)):
                ids, groups, rows = batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(2).slice(lo, hi - lo).to_pylist(), []
                for i, g, y in zip(ids, groups, shingle_sets(data, offs, k), strict=True):
                    if i not in seen:
                        seen.add(i)
                        raw = y.tobytes()
                        rows += [(x, i, raw) for x in g]
                if not rows:
                    continue
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["group", "a", "set"])

    null = lambda t: F.lit(None).cast(t)
    x = wanted.select("doc_id", "text", "groups").mapInArrow(lean(sets), "group long, a long, set binary")
    x = x.select(F.lit(0).alias("kind"), "group", "a", null("long").alias("b"), "set")
    x = x.unionByName(p.select(F.lit(1).alias("kind"), "group", "a", "b", null("binary").alias("set")))
    dealt = x.repartition(parts, "group").sortWithinPartitions("kind").select("kind", "a", "b", "set")

    def check(it):
        have: dict[int, tuple] = {}
        for batch in it:
            kind, a, b, sets = (batch.column(i) for i in range(4))
            kind = kind.to_numpy()
            for i in np.flatnonzero(kind == 0).tolist():
                if (key := a[i].as_py()) not in have:
                    y = np.frombuffer(sets[i].as_py(), K.U)
                    have[key] = y, np.diff(np.r_[0, np.searchsorted(y, _EDGES), len(y)])
            i = pa.array(np.flatnonzero(kind == 1))
            a, b = a.take(i), b.take(i)
            ok = [_near(have[p], have[q], num, den) for p, q in zip(a.to_pylist(), b.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return dealt.mapInArrow(lean(check), "a long, b long")

"""Benchmark decontamination: which words of a document lie in a window of a benchmark item.

Method: prefix-filtered set join of windows with documents.

1. Each window (``width`` consecutive item words, or a whole shorter item) is a
   set of shingles of up to five words.  A window counts only when it is wholly
   contained, so a prefix of one shingle per window is enough.
2. Shingles are ordered by rarity, counted over all documents; each window's
   prefix is its rarest shingle.
3. Documents' shingles join the prefix tokens.  The length bound (the document
   is long enough) and the positional bound (the window, laid where the token
   stands, is inside the document) leave candidates.
4. Every candidate is verified word by word over its item-sized window.

Items are taken in blocks of ``BLOCK_WINDOWS`` windows, the only thing that is
broadcast, so its size is bounded; each further block is one more scan.  With
several blocks a row is known by its id and a 128-bit hash of its text, so what
is found doesn't depend on the blocks; rows equal in both are combined before
the shuffle.

Words are told apart by 64-bit hashes.

Edge cases: a null text has no words and no hit; an item without words has no
window; repeated items and ids count each once per id; null item ids are left
out of n_items; rows that share an id, null too, are judged each by its own
text; other columns are ignored, whatever their names; empty tables give no rows
(documents) or no hits (items).
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._store import lean, whole_ids, without

SHINGLE = 5
BLOCK_WINDOWS = 500_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Windows:
    """A block's windows: word hashes, items, and the prefix token that each is found by."""

    def __init__(self, items: list[tuple], width: int):
        self.ids = [i for i, _ in items]
        texts = pa.array([t for _, t in items], pa.string())
        hashes, owner, length = [np.zeros((0, width), K.U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi, data, offs in K.text_chunks(texts):
            s, e, wo = K.words(data, offs, K.ALNUM)
            h = K.word_hashes(data, s, e)
            words = np.diff(wo)
            n = np.minimum(words, width)
            many = np.where(n > 0, words - n + 1, 0)
            row = np.repeat(np.arange(hi - lo), many)
            first = wo[row] + _ramp(many)
            x = np.zeros((len(row), width), K.U)
            for q in range(width):
                i = np.flatnonzero(n[row] > q)
                x[i, q] = h[first[i] + q]
            hashes.append(x), owner.append(lo + row), length.append(n[row])
        self.hash, self.owner, self.length = np.concatenate(hashes), np.concatenate(owner), np.concatenate(length)
        self.width = width
        #: (window, offset) of each shingle; its size is five words or the whole of a shorter window
        self.size = np.minimum(SHINGLE, self.length)
        self.sizes = sorted(set(self.size.tolist()))
        t, w, o = [np.zeros(0, K.U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in self.sizes:
            of = np.flatnonzero(self.size == k)
            for off in range(width - k + 1):
                i = of[self.length[of] >= off + k]
                x = sum((self.hash[i, off + q] * K.GRAM[q] for q in range(k)), np.zeros(len(i), K.U)) + K.U(k)
                t.append(K.mix(x)), w.append(i), o.append(np.full(len(i), off))
        self.token, self.window, self.offset = np.concatenate(t), np.concatenate(w), np.concatenate(o)
        self.tokens = np.unique(self.token)

    def choose(self, count: np.ndarray) -> None:
        """Keep the rarest shingle of each window; count is by place in tokens."""
        rare = count[np.searchsorted(self.tokens, self.token)]
        o = np.lexsort((self.offset, self.token, rare, self.window))
        o = o[np.r_[True, self.window[o][1:] != self.window[o][:-1]]] if len(o) else o
        o = o[np.argsort(self.token[o], kind="stable")]
        self.token, self.window, self.offset = self.token[o], self.window[o], self.offset[o]
        self.tokens, self.first = np.unique(self.token, return_index=True)
        self.first = np.r_[self.first, len(self.token)]


class _Probe:
    """Membership of 64-bit tokens in a sorted set: a bitmap turns most away."""

    def __init__(self, tokens):
        self.tokens = tokens
        self.bits = max(16, min(26, int(len(tokens)).bit_length() + 6))
        self.map = np.zeros(1 << self.bits, bool)
        self.map[(tokens >> K.U(64 - self.bits)).astype(np.int64)] = True

    def find(self, g):
        """(places in g, places in tokens) of members."""
        at = np.flatnonzero(self.map[(g >> K.U(64 - self.bits)).astype(np.int64)])
        i = np.searchsorted(self.tokens, g[at])
        i[i == len(self.tokens)] = 0
        ok = self.tokens[i] == g[at] if len(self.tokens) else np.zeros(0, bool)
        return at[ok], i[ok]


def _grams(h, wo, k):
    """Shingles of k words inside rows: hashes and first words."""
    g = K.gram_hashes(h, k)
    inside = np.ones(len(g), bool)
    for b in wo[1:-1]:
        inside[max(0, b - k + 1) : b] = False
    return g, inside


def rarity(docs: DataFrame, text: str, w: Windows) -> np.ndarray:
    """How often each shingle of the block's windows stands in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast((w.tokens, w.sizes))

    def count(it):
        tokens, sizes = shared.value
        probe, c = _Probe(tokens), np.zeros(len(tokens), np.int64)
        for batch in it:
            for _, _, data, offs in K.text_chunks(batch.column(0)):
                s, e, wo = K.words(data, offs, K.ALNUM)
                h = K.word_hashes(data, s, e)
                for k in sizes:
                    g, inside = _grams(h, wo, k)
                    at, i = probe.find(g)
                    c += np.bincount(i[inside[at]], minlength=len(c))
        i = np.flatnonzero(c)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int64()), "c": pa.array(c[i], pa.int64())})

    def pack(it):
        for batch in it:
            yield pa.RecordBatch.from_pydict({k: pa.array([batch.column(j).to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for j, k in enumerate("ic")})

    out = np.zeros(len(w.tokens), np.int64)
    sums = docs.select(text).mapInArrow(lean(count), "i long, c long").groupBy("i").agg(F.sum("c").alias("c"))
    # eight bytes and eight more for each token of a block: a bounded number
    for i, c in sums.mapInArrow(pack, "i binary, c binary").toLocalIterator():
        out[np.frombuffer(i, np.int64)] = np.frombuffer(c, np.int64)
    return out


def _scan(docs: DataFrame, w: Windows) -> DataFrame:
    """The documents' numbers, n_words, first and last word of each hit run, items: one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def find(it):
        w = shared.value
        probe = _Probe(w.tokens)
        for batch in it:
            at_text, same = batch.schema.get_field_index("text"), [k for k in batch.schema.names if k != "text"]
            for lo, hi, data, offs in K.text_chunks(batch.column(at_text)):
                s, e, wo = K.words(data, offs, K.ALNUM)
                h = K.word_hashes(data, s, e)
                starts, wins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for k in w.sizes:
                    g, inside = _grams(h, wo, k)
                    at, tok = probe.find(g)
                    keep = inside[at]
                    at, tok = at[keep], tok[keep]
                    reps = w.first[tok + 1] - w.first[tok]
                    entry = np.repeat(w.first[tok], reps) + _ramp(reps)
                    at = np.repeat(at, reps)
                    win, start = w.window[entry], at - w.offset[entry]
                    row = np.searchsorted(wo, at, "right") - 1
                    # the positional bound, then the length bound
                    ok = (w.size[win] == k) & (start >= wo[row]) & (start + w.length[win] <= wo[row + 1])
                    win, start = win[ok], start[ok]
                    equal = np.ones(len(win), bool)
                    for q in range(w.width):
                        i = np.flatnonzero(equal & (w.length[win] > q))
                        equal[i] = h[start[i] + q] == w.hash[win[i], q]
                    starts.append(start[equal]), wins.append(win[equal])
                start, win = np.concatenate(starts), np.concatenate(wins)
                hit = np.zeros(len(h) + 1, np.int64)
                np.add.at(hit, start, 1)
                np.add.at(hit, start + w.length[win], -1)
                hit = np.cumsum(hit)[:-1] > 0
                row = np.searchsorted(wo, start, "right") - 1
                runs: list[list] = [[] for _ in range(hi - lo)]
                items: list[list] = [[] for _ in range(hi - lo)]
                for r in np.unique(row):
                    x = np.r_[False, hit[wo[r] : wo[r + 1]], False]
                    edge = np.flatnonzero(x[1:] != x[:-1]).reshape(-1, 2)
                    runs[r] = [{"first": int(a), "last": int(b) - 1} for a, b in edge]
                    items[r] = sorted({w.ids[o] for o in w.owner[win[row == r]].tolist() if w.ids[o] is not None})
                yield pa.RecordBatch.from_pydict({k: batch.column(k).slice(lo, hi - lo) for k in same} | {"n_words": pa.array(np.diff(wo)), "runs": pa.array(runs, _RUNS), "items": pa.array(items, pa.list_(pa.int64()))})

    keys = ", ".join(f"{k} long" for k in docs.columns if k != "text")
    return docs.mapInArrow(lean(find), f"{keys}, n_words long, runs array<struct<first:long,last:long>>, items array<long>")


_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _ramp(reps):
    end = np.cumsum(reps)
    return np.arange(end[-1] if len(end) else 0) - np.repeat(end - reps, reps)


def _blocks(items: DataFrame, key: str, text: str, width: int):
    """Blocks of items with at most about BLOCK_WINDOWS windows, read one after the other."""
    held, n = [], 0
    for r in items.select(whole_ids(items, key), text).toLocalIterator():
        words = len(_WORD.findall(r[1].encode().lower())) if r[1] else 0
        if not words:
            continue
        held.append((r[0], r[1]))
        n += max(1, words - width + 1)
        if n >= BLOCK_WINDOWS:
            yield held
            held, n = [], 0
    if held:
        yield held


def contaminated_words(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """Per document row: doc_id, n_words, runs (disjoint, ascending first and last hit words), items (sorted ids)."""
    docs = docs.select(whole_ids(docs, key).alias("doc_id"), F.col(text).alias("text"))
    blocks = _blocks(items, item_key, item_text, width)
    block, after = next(blocks, []), next(blocks, None)
    if after is None:
        return _found(docs, block, width)
    # the text's hashes stand for the row from scan to scan
    docs = docs.select("doc_id", F.xxhash64("text").alias("h0"), F.xxhash64(F.lit("again"), "text").alias("h1"), "text")
    found = None
    for i, block in enumerate(chain([block, after], blocks)):
        one = _found(docs, block, width).withColumn("n", F.lit(0 if i else 1))
        found = one if found is None else found.unionByName(one)
    # equal rows of a block have equal runs, so sets of them stay as small as the number of blocks
    found = found.groupBy("doc_id", "h0", "h1", "n_words").agg(F.sum("n").alias("n"), F.collect_set("runs").alias("runs"), F.collect_set("items").alias("items"))
    runs = F.array_sort(F.array_distinct(F.flatten("runs")))
    start = F.struct(F.lit(-2).cast("long").alias("first"), F.lit(-2).cast("long").alias("last"))
    joined = F.aggregate(runs, F.array(start), lambda s, x: F.when(x["first"] <= F.element_at(s, -1)["last"] + 1, F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.struct(F.element_at(s, -1)["first"].alias("first"), F.greatest(F.element_at(s, -1)["last"], x["last"]).alias("last"))))).otherwise(F.concat(s, F.array(x))))
    found = found.select("doc_id", "n_words", F.filter(joined, lambda x: x["first"] >= 0).alias("runs"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"), "n")
    return found.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")


def _found(docs: DataFrame, block: list[tuple], width: int) -> DataFrame:
    w = Windows(block, width)
    w.choose(rarity(docs, "text", w) if block else np.zeros(0, np.int64))
    return _scan(docs, w)


def drop_contaminated(docs: DataFrame, items: DataFrame, least_words: int = 10, key: str = "doc_id", **names) -> DataFrame:
    """The documents with fewer than ``least_words`` hit words; a null id keeps its row."""
    hits = contaminated_words(docs, items, key=key, **names)
    n = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"] + 1)
    bad = hits.filter(n >= least_words).select(F.col("doc_id").alias(key)).distinct()
    return without(docs, bad, key)

"""Words that differ by one edit, and the frequent form that a rare spelling belongs to.

Tasks count their words before they are shuffled.  Of two words that differ by one
insertion, deletion or replacement, the shorter with l code points, either the first l // 2 code points are
the same or the last l // 2.  So each word stands in a forward dictionary (by its first half)
and a reversed one (by its last half), once for its own length and once for one
less; a block has the words of length l and l + 1 that share a half.  Blocks are counted with a
partial aggregation; the words of those over ``BLOCK`` don't meet but are dealt anew by half of
what isn't shared yet (the same argument holds for it), until blocks are small or one code point is left.
The dictionaries are then range-partitioned and sorted, so that a block is a
range of rows, scanned and verified with numpy.  A pair is taken in the one block that comes first by the
length of its common prefix, so no pair comes twice.

A word's form is its near word of largest n, if that is ``times`` its own n; forms' n grow by
that factor, so that following them by pointer doubling ends after few joins.

Edge cases: a null text has no words; a null key is an empty one in the hash that picks runs to
edit; rows may repeat (each counts); runs of any length are whole words; other columns are ignored, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._lattice import points
from ._store import SMALL_IDS, saved
from .nbest import _spans

#: Distinct words a task holds before it emits them; runs of a text that are counted at once.
HOLD, AT_ONCE = 1_000_000, 1 << 20
#: Words of a block that are compared with each other.
BLOCK = 128
#: Code points and pairs' code points that are compared at once.
ROOM = 1 << 22
_LOWER = {c: c + 32 for c in range(65, 91)}
ANY = 1 << 30


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: str = r"A-Za-zÀ-ÿ", least_length: int = 6, least_count: int = 5, drop_every: int = 199) -> DataFrame:
    """word, n: maximal runs of letters with A-Z in lower case.

    Where the crc32 h of ``<key>:<run>`` is a multiple of ``drop_every`` (0: nowhere), the run goes without its code point h % length.
    """
    docs = docs.filter(F.col(f"`{text}`").isNotNull()).select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("k"), F.col(f"`{text}`").alias("t"))
    # shorter runs give no word
    runs = re.compile(f"[{letters}]{{{least_length},}}")

    def count(it):
        total: dict[str, int] = {}

        def emit():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

        for batch in it:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(t) <= AT_ONCE:
                    found = Counter(runs.findall(t))
                else:
                    found, all_runs = Counter(), (m[0] for m in runs.finditer(t))
                    while some := list(islice(all_runs, AT_ONCE)):
                        found.update(some)
                own: dict[str, int] = {}
                for w, n in found.items():
                    w = w.lower() if w.isascii() else w.translate(_LOWER)
                    own[w] = own.get(w, 0) + n
                begun = zlib.crc32(f"{k}:".encode())
                for w, n in own.items():
                    if drop_every:
                        h = zlib.crc32(w.encode(), begun)
                        if h % drop_every == 0:
                            i = h % len(w)
                            w = w[:i] + w[i + 1 :]
                            if len(w) < least_length:
                                continue
                    total[w] = total.get(w, 0) + n
            if len(total) > HOLD:
                yield emit()
                total.clear()
        yield emit()

    words = docs.mapInArrow(count, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _dealt(rows: DataFrame) -> DataFrame:
    """Adds what names a row's block: what is shared at both ends, and a hash of all."""
    rows = rows.withColumn("pre", F.expr("left(word, p)")).withColumn("suf", F.expr("reverse(right(word, s))"))
    return rows.withColumn("block", F.xxhash64("l", "p", "s", "below", "pre", "suf"))


def _first(words: DataFrame) -> DataFrame:
    """Each word in both dictionaries, for its length and one less."""
    rows = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("l")).filter("l > 0")
    half = F.floor(F.col("l") / 2).cast("int")
    ends = F.explode(F.array(F.struct(half.alias("p"), F.lit(0).alias("s"), F.lit(ANY).alias("below")), F.struct(F.lit(0).alias("p"), half.alias("s"), half.alias("below"))))
    return _dealt(rows.select("word", "n", "l", ends.alias("e")).select("word", "n", "l", "e.*"))


def _subdivided(rows: DataFrame) -> DataFrame:
    """Rows of large blocks, in the two blocks that share half of the rest at one end more."""
    more = F.floor((F.col("l") - F.col("p") - F.col("s")) / 2).cast("int")
    left = F.struct((F.col("p") + more).alias("p"), F.col("s"), F.col("below"))
    right = F.struct(F.col("p"), (F.col("s") + more).alias("s"), F.least("below", F.col("p") + more).alias("below"))
    return _dealt(rows.select("word", "n", "l", F.explode(F.array(left, right)).alias("e")).select("word", "n", "l", "e.*"))


def _blocks(words: DataFrame) -> list[DataFrame]:
    """Tables of rows whose blocks are small, or have one code point that isn't shared."""
    rows, out = _first(words), []
    while True:
        rows = saved(rows, "blocks")
        large = saved(rows.groupBy("block").count().filter(F.col("count") > BLOCK).select("block"), "large")
        n = large.count()
        if not n:
            return [*out, rows]
        large = F.broadcast(large) if n <= SMALL_IDS else large
        rest = F.col("l") - F.col("p") - F.col("s") < 2
        out += [rows.join(large, "block", "left_anti"), rows.filter(rest).join(large, "block", "left_semi")]
        rows = _subdivided(rows.filter(~rest).join(large, "block", "left_semi"))
        if rows.isEmpty():
            return out


def _near(flat: np.ndarray, start: np.ndarray, size: np.ndarray, l: int, i: np.ndarray, j: np.ndarray, below: np.ndarray) -> np.ndarray:  # noqa: E741
    """Whether words i and j, of l and l or l + 1 code points, are one edit apart and share less than ``below`` at the front."""
    out = np.zeros(len(i), bool)
    step = max(1, ROOM // (l + 1))
    for lo in range(0, len(i), step):
        a, b = i[lo : lo + step], j[lo : lo + step]
        a, b = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
        at = np.arange(l)
        x, y = flat[start[a][:, None] + at], flat[start[b][:, None] + at]
        same = x == y
        prefix = np.where(same.all(1), l, same.argmin(1))
        longer = size[b] > l
        near = ~longer & (size[a] == l) & (same.sum(1) == l - 1)
        k = np.flatnonzero(longer & (size[a] == l))
        if len(k):
            # with one code point of the longer word left out after the common prefix
            shifted = x[k] == flat[start[b[k]][:, None] + at + 1]
            near[k] = (shifted | (at < prefix[k][:, None])).all(1)
        out[lo : lo + step] = near & (prefix < below[lo : lo + step])
    return out


def _compare(words: list[str], l: np.ndarray, below: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """Near pairs of whole blocks, which are runs of rows."""
    flat, size = points(words)
    start = np.cumsum(size) - size
    cut = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
    end = np.repeat(cut[1:], np.diff(cut))
    row = np.arange(len(words))
    left, right = [], []
    partners = end - row - 1
    done = 0
    pairs = np.cumsum(partners)
    while done < len(words):
        upto = max(done + 1, int(np.searchsorted(pairs, (pairs[done - 1] if done else 0) + ROOM // 4, "right")))
        n = partners[done:upto]
        i = np.repeat(row[done:upto], n)
        j = _spans(row[done:upto] + 1, n)
        for k in np.unique(l[i]).tolist():
            some = np.flatnonzero(l[i] == k)
            found = some[_near(flat, start, size, k, i[some], j[some], below[i[some]])]
            left.append(i[found]), right.append(j[found])
        done = upto
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n of all words that are one edit apart, both ways, from distinct (word, n)."""
    tables = _blocks(words)
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    order = ("l", "p", "s", "below", "pre", "suf")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("word", "n", "l", "below", "block")

    def scan(it):
        held = None
        for batch in it:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            block = table["block"].to_numpy()
            # the last block may go on in the next batch
            whole = int(np.flatnonzero(block != block[-1])[-1]) + 1 if (block != block[-1]).any() else 0
            held = table.slice(whole)
            if whole:
                yield found(table.slice(0, whole))
        if held is not None and held.num_rows:
            yield found(held)

    def found(t):
        i, j = _compare(t["word"].to_pylist(), t["l"].to_numpy(), t["below"].to_numpy(), t["block"].to_numpy())
        a, b = pa.array(np.r_[i, j]), pa.array(np.r_[j, i])
        word, n = t["word"].combine_chunks(), t["n"].combine_chunks()
        return pa.RecordBatch.from_arrays([word.take(a), n.take(a), word.take(b), n.take(b)], ["word", "n", "near", "near_n"])

    return rows.mapInArrow(scan, "word string, n long, near string, near_n long")


def variant_groups(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n from distinct (word, n)."""
    words = saved(words.select("word", "n"), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("b"))
    found = words.join(best, "word", "left")
    form = F.when(-F.col("b.m") >= times * F.col("n"), F.col("b.w"))
    found = saved(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("b.m")).alias("form_n")), "forms")
    root = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        root = saved(root, "roots")
        nxt = root.alias("a").join(root.alias("b"), F.col("a.root") == F.col("b.word"), "left")
        if nxt.filter("b.word IS NOT NULL").isEmpty():
            break
        root = nxt.select("a.word", F.coalesce("b.root", "a.root").alias("root"))
    return found.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

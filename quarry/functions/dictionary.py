"""A dictionary learned from a table, and all of its words in a context by a double-array trie.

``learn_words`` counts words in one aggregation: runs of letters, or with ``grams`` all substrings of
runs (for scripts without spaces), which must then hold together: more frequent than their parts would make
them by chance, at every cut.  ``Dictionary`` keeps the words as two arrays, ``base`` and
``check``: from state s a character with code c leads to base[s] + c if check has s there.  All places of
all distinct contexts walk the arrays at once, so each context is segmented once a batch.

A dictionary travels with the tasks, so it is bounded: over ``MOST`` words ``Dictionary.of`` raises;
raise ``least`` then.  Null and empty texts have no words; an empty dictionary protects nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a dictionary at most.
MOST = 500_000
#: Places that are searched at once for a node's children.
WINDOW = 2048


def learn_words(texts: DataFrame, text: str = "text", least: int = 20, longest: int = 7, grams: bool = False, cohesion: float = 10.0) -> DataFrame:
    """word, n: words of 2 to ``longest`` characters that occur ``least`` times."""
    runs = texts.select(F.explode(F.expr(rf"regexp_extract_all(`{text}`, '\\p{{L}}+', 0)")).alias("word"))
    if not grams:
        return runs.filter(F.length("word").between(2, longest)).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    size = F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("size")
    at = F.explode(F.sequence(F.lit(1), F.length("word") - F.col("size") + 1)).alias("at")
    some = runs.groupBy("word").agg(F.count("*").alias("n")).select("word", "n", size).filter("size <= length(word)").select("word", "n", "size", at)
    counts = some.select(F.expr("substring(word, at, size)").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    total = runs.agg(F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("total"))
    cut = F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("cut")
    cuts = counts.filter("length(word) > 1").select("word", "n", cut).select("word", "n", F.expr("left(word, cut)").alias("a"), F.expr("substring(word, cut + 1)").alias("b"))
    a, b = counts.select(F.col("word").alias("a"), F.col("n").alias("n_a")), counts.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    # a part of a frequent word is as frequent, so both joins find their row; the total is one row
    held = cuts.join(a, "a").join(b, "b").join(F.broadcast(total)).withColumn("held", F.col("n").cast("double") * F.col("total") >= cohesion * F.col("n_a") * F.col("n_b"))
    return held.groupBy("word", "n").agg(F.bool_and("held").alias("held")).filter("held").select("word", "n")


class Dictionary:
    """Words as a double-array trie."""

    def __init__(self, words: Iterable[str]):
        words = sorted({w for w in words if w})
        self.longest = max(map(len, words), default=0)
        points = sorted({ord(c) for w in words for c in w})
        self.points = np.array(points, np.uint32)
        code = {p: k + 1 for k, p in enumerate(points)}
        children: list[dict[int, int]] = [{}]
        ends = []
        for w in words:
            at = 0
            for c in w:
                k = code[ord(c)]
                if k not in children[at]:
                    children[at][k] = len(children)
                    children.append({})
                at = children[at][k]
            ends.append(at)
        self._place(children, ends, len(points))

    def _place(self, children, ends, n_codes) -> None:
        """Give each node's children a base where all their places are free: a single child takes the first free place, others search windows from where the last search ended, and leave holes to single ones."""
        size = 2 * len(children) + n_codes + 2 * WINDOW
        base, check, used = np.zeros(size, np.int32), np.full(size, -1, np.int32), bytearray(size)
        state, free, top = [0] * len(children), n_codes + 1, n_codes + 1
        todo = [0]
        for node in todo:
            own = sorted(children[node].items())
            if not own:
                continue
            if len(own) == 1:
                free = used.index(0, free)
                b = free - own[0][0]
            else:
                codes = np.array([k for k, _ in own])
                while True:
                    taken = np.frombuffer(used, np.uint8)
                    firsts = np.flatnonzero(taken[top : top + WINDOW] == 0) + top - codes[0]
                    fits = (taken[firsts[:, None] + codes] == 0).all(1) if len(firsts) else np.zeros(0, bool)
                    del taken
                    if fits.any():
                        b = int(firsts[fits.argmax()])
                        break
                    top += WINDOW // 2
                    if top + 2 * WINDOW + n_codes > len(used):
                        break
            if max(top + 2 * WINDOW, free + 1, b + own[-1][0] if len(own) == 1 or fits.any() else 0) + n_codes >= len(used):
                more = len(used)
                base, check = np.r_[base, np.zeros(more, np.int32)], np.r_[check, np.full(more, -1, np.int32)]
                used.extend(bytes(more))
                if len(own) > 1 and not fits.any():
                    b = more - codes[0]
            base[state[node]] = b
            for k, child in own:
                state[child] = b + k
                check[b + k], used[b + k] = state[node], 1
                todo.append(child)
        self.base, self.check = base, check
        self.word = np.zeros(len(base), bool)
        self.word[[state[e] for e in ends]] = True

    @classmethod
    def of(cls, words: DataFrame, word: str = "word") -> Dictionary:
        """From a column of words, ``MOST`` of them at most."""
        rows = words.select(word).distinct().limit(MOST + 1).collect()
        if len(rows) > MOST:
            raise ValueError(f"over {MOST} words: learn with a larger least")
        return cls(r[0] for r in rows if r[0])

    def codes(self, points: np.ndarray) -> np.ndarray:
        """The code of each code point, 0 for those that no word has."""
        if not len(self.points):
            return np.zeros(len(points), np.int64)
        k = np.searchsorted(self.points, points)
        k[k == len(self.points)] = 0
        return np.where(self.points[k] == points, k + 1, 0)

    def find(self, contexts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every word in every context: context, first place, length, in this order."""
        flat = np.frombuffer("".join(contexts).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, contexts), np.int64, len(contexts))
        code, end = self.codes(flat), np.repeat(np.cumsum(size), size)
        at, state = np.arange(len(flat)), np.zeros(len(flat), np.int64)
        firsts, lengths = [], []
        for k in range(self.longest):
            keep = at + k < end[at]
            at, state = at[keep], state[keep]
            nxt = self.base[state] + code[at + k]
            ok = (code[at + k] > 0) & (nxt < len(self.check)) & (self.check[np.minimum(nxt, len(self.check) - 1)] == state)
            at, state = at[ok], nxt[ok]
            firsts.append(at[self.word[state]])
            lengths.append(np.full(len(firsts[-1]), k + 1))
        none = np.zeros(0, np.int64)
        first, length = np.concatenate([none, *firsts]), np.concatenate([none, *lengths])
        o = np.lexsort((length, first))
        first, length = first[o], length[o]
        context = np.repeat(np.arange(len(contexts)), size)[first]
        return context, first - (np.cumsum(size) - size)[context], length

    def __call__(self, context: str) -> list[str]:
        """All words in a context, and its characters that are in none of two or more."""
        _, first, length = self.find([context])
        found = [(i, n) for i, n in zip(first.tolist(), length.tolist(), strict=True) if n > 1]
        covered = {j for i, n in found for j in range(i, i + n)}
        return [context[i : i + n] for i, n in sorted(found + [(i, 1) for i in range(len(context)) if i not in covered])]

    def protects(self, contexts: list[str], chars: list[str]) -> np.ndarray:
        """Whether a word of two or more in the context has the character."""
        context, first, length = self.find(contexts)
        some = np.flatnonzero(length > 1)
        out = np.zeros(len(contexts), bool)
        for k, i, n in zip(context[some].tolist(), first[some].tolist(), length[some].tolist(), strict=True):
            if not out[k] and chars[k] in contexts[k][i : i + n]:
                out[k] = True
        return out

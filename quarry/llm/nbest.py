"""SentencePiece encoding and decoding, with the n best segmentations.

A text becomes a mark and its characters with marks for spaces, as the model's
own encoder does.  No piece spans a mark after another character, punctuation
after a letter or a line's end, as far as the vocabulary shows it, so the lattice
falls apart into units, each solved once per worker (at most ``REMEMBER``).

A forward Viterbi pass gives the best score of a path to each place.  It is the
exact heuristic of a backward A* search from a unit's end: hypotheses leave the
queue in order of their whole path's score, so the first n to reach the start
are the n best.  As the heuristic is exact, each of them ends as a path of its
own with the score it has, so no more than n need wait; each points back to the
one it came from, and a unit of any length takes memory in proportion to it.
The pass is vectorised over all new units, and so is the first step of the
search, the loss of each detour from a best path.  A document's n
best segmentations differ in the units with the n - 1 smallest losses, for which
the search runs on; their combinations are taken in order from a queue.

Scores are the model's; a character without a piece is spelled in bytes and
scores under every piece.  Ties fall to the smaller ids of the last pieces.

Edge cases: a null text gives nulls; an empty one no pieces and one empty
segmentation; decoding turns the mark's own character into a space, so a text
that has it doesn't round-trip; repeated rows are alike; other columns than the
key and the text are ignored, and a key named like an output column is refused;
an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._lattice import MARK, PUNCTUATION, groups, vocab
from ._store import remembered

REMEMBER = 200_000
#: Characters of units that are remembered, and that are solved at once.
REMEMBER_CHARS, PORTION = 8_000_000, 100_000
#: Units whose n best are remembered.
REMEMBER_BEST = 100_000
#: Stands before a unit that begins inside a word; texts that hold it are not cut there.
_CUT = "\0"
_UNIT = re.compile(f"{MARK}+[^{MARK}{_CUT}]*|{_CUT}[^{MARK}{_CUT}]+")


def searches(v, units: list[str], n: int) -> list[list[tuple[float, list[int]]]]:
    """For each unit its n best segmentations, (score, ids), by backward A* with forward Viterbi scores."""
    first, last, piece, base, lens, cuts = v.edges(units)
    score = np.where(piece < 0, v.unknown, v.score[piece])
    ahead = np.zeros(int(lens.sum()) + len(lens))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        g = groups(last[a:b])
        ahead[last[a:b][g]] = np.maximum.reduceat(ahead[first[a:b]] + score[a:b], g)
    # a place's edges, the smaller pieces first
    o = np.lexsort((piece, last))
    to = np.searchsorted(last[o], np.arange(len(ahead) + 1)).tolist()
    edges = list(zip(first[o].tolist(), piece[o].tolist(), score[o].tolist(), strict=True))
    ahead = ahead.tolist()
    return [_search(v, u, n, b, b + m, ahead, to, edges) for u, b, m in zip(units, base.tolist(), lens.tolist(), strict=True)]


def _search(v, unit, n, begin, end, ahead, to, edges):
    """The queue holds (score of the whole path, place, score behind it, edges behind it), in order of the pieces behind, the last piece of the unit first."""
    out: list[tuple[float, list[int]]] = []
    queue = [(ahead[end], end, 0.0, None)]
    while queue and len(out) < n:
        # of equal scores the first in order
        at = max(range(len(queue)), key=lambda i: queue[i][0])
        f, place, behind, path = queue.pop(at)
        if place == begin:
            ids = []
            while path:
                path, start, p = path
                ids += [p] if p >= 0 else v.spell(unit[start - begin])
            out.append((f, ids))
            continue
        queue[at:at] = [(ahead[start] + (behind + s), start, behind + s, (path, start, p)) for start, p, s in edges[to[place] : to[place + 1]]]
        if len(queue) > n - len(out):
            best = sorted(range(len(queue)), key=lambda i: -queue[i][0])[: n - len(out)]
            queue = [queue[i] for i in sorted(best)]
    return out


_WORD = re.compile(f"{MARK}+[^{MARK}]*")


def _portions(items: list, lengths):
    """Runs of at most ``PORTION`` characters; what is longer is one of its own."""
    ends = np.cumsum(np.fromiter(lengths, np.int64, len(items)))
    lo = 0
    while lo < len(items):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PORTION, "right")))
        yield items[lo:hi]
        lo = hi


def _plain(unit: str) -> str:
    return unit[1:] if unit[0] == _CUT else unit


class Segmenter:
    def __init__(self, path: str, n: int):
        self.v, self.n = vocab(path), n
        self.stop = re.compile(rf"[{PUNCTUATION}](?<=[^\W\d_{self.v.bound}].)")
        self.clear()

    def clear(self):
        self.at = K.Numbers()
        self.found: dict[int, list] = {}
        self.best, self.loss, self.start, self.count = (np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.ids = np.zeros(0, np.int32)
        self.units: list[str] = []
        self.chars = 0

    def _forget(self):
        keep = self.at.forget_rare()
        self.ids = self.ids[_spans(self.start[keep], self.count[keep])]
        self.best, self.loss, self.count = self.best[keep], self.loss[keep], self.count[keep]
        self.start = np.cumsum(self.count) - self.count
        self.units = [self.units[i] for i in keep.tolist()]
        self.found = {j: self.found[i] for j, i in enumerate(keep.tolist()) if i in self.found}
        self.chars = sum(map(len, self.units))
        if self.chars > REMEMBER_CHARS:
            self.clear()

    def learn(self, units: list[str]) -> None:
        for some in _portions(units, map(len, units)):
            self._learn(some)

    def _learn(self, names: list[str]) -> None:
        """Best segmentation and the loss of the second best, for all units at once."""
        v = self.v
        units = [_plain(u) for u in names]
        first, last, piece, base, lens, cuts = v.edges(units)
        score = np.where(piece < 0, v.unknown, v.score[piece])
        n = int(lens.sum()) + len(lens)
        ahead, by = np.zeros(n), np.full(n, -1)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            x = ahead[first[a:b]] + score[a:b]
            l, p = last[a:b], piece[a:b]
            g = groups(l)
            top = np.maximum.reduceat(x, g)
            ahead[l[g]] = top
            # of equal scores the smaller piece
            of = np.repeat(np.arange(len(g)), np.diff(np.r_[g, len(l)]))
            best = np.flatnonzero(x == top[of])
            best = best[np.lexsort((p[best], of[best]))]
            best = best[groups(of[best])]
            by[l[best]] = a + best
        # places on best paths, from the ends backward
        on = np.zeros(n, bool)
        at = base + lens
        steps = []
        live = np.arange(len(units))
        while len(live):
            on[at] = True
            go = by[at] >= 0
            live, e = live[go], by[at[go]]
            steps.append((live, e))
            at = first[e]
        unit = np.concatenate([s[0] for s in steps]) if steps else live
        edge = np.concatenate([s[1] for s in steps]) if steps else live
        o = np.lexsort((first[edge], unit))
        unit, edge = unit[o], edge[o]
        # the A* search's first step: what a detour into a best path's place loses
        other = on[last] & (np.arange(len(last)) != by[last])
        lose = ahead[last[other]] - ahead[first[other]] - score[other]
        loss = np.full(len(units), np.inf)
        np.minimum.at(loss, np.searchsorted(base, first[other], "right") - 1, lose)
        p = piece[edge]
        size = np.ones(len(p), np.int64)
        spelled = np.flatnonzero(p < 0)
        bytes_of = [v.spell(units[unit[i]][first[edge[i]] - base[unit[i]]]) for i in spelled]
        size[spelled] = [len(x) for x in bytes_of]
        ids = np.repeat(p, size)
        end = np.cumsum(size)
        for i, x in zip(spelled, bytes_of, strict=True):
            ids[end[i] - size[i] : end[i]] = x
        count = np.bincount(unit, size, len(units)).astype(np.int64)
        self.units += names
        self.chars += sum(map(len, names))
        self.start = np.r_[self.start, len(self.ids) + np.cumsum(count) - count]
        self.count, self.best, self.loss = np.r_[self.count, count], np.r_[self.best, ahead[base + lens]], np.r_[self.loss, loss]
        self.ids = np.r_[self.ids, ids.astype(np.int32)]

    def prepare(self, ks: set[int]) -> None:
        """Search all units of these numbers that haven't been."""
        new = sorted(ks - self.found.keys())
        for some in _portions(new, (len(self.units[k]) for k in new)):
            self.found.update(zip(some, searches(self.v, [_plain(self.units[k]) for k in some], self.n), strict=True))

    def split(self, text: str) -> list[str]:
        t = MARK + text.replace(" ", MARK)
        if not self.v.by_word:
            return [t]
        if _CUT in t:
            return _WORD.findall(t)
        if self.v.by_line:
            t = t.replace("\n", f"{_CUT}\n{_CUT}")
        return _UNIT.findall(self.stop.sub(rf"{_CUT}\g<0>", t))

    def encode(self, texts: list[str]):
        """For each text (ids of the best, scores of the n best, units changed in each: list of {place of unit: ids})."""
        for ids, _, scores, changes in self._solve(texts):
            yield ids, scores, changes

    def n_best(self, texts: list[str]):
        """For each text (scores of the n best, all ids of each)."""
        for ids, starts, scores, changes in self._solve(texts):
            yield scores, [_changed(ids, starts, x) for x in changes]

    def _solve(self, texts: list[str]):
        """As ``encode``, with the place in the ids where each unit starts and one more for the end."""
        if len(self.at) > REMEMBER or self.chars > REMEMBER_CHARS:
            self._forget()
        if len(self.found) > REMEMBER_BEST:
            self.found.clear()
        lists = [self.split(t) if t else [] for t in texts]
        flat = self.at.of(list(chain.from_iterable(lists)))
        self.learn(list(self.at.fresh))
        self.at.fresh.clear()
        texts_of = np.split(flat, np.cumsum([len(x) for x in lists])[:-1])
        near = [self._near(k) for k in texts_of]
        self.prepare({int(k[i]) for k, x in zip(texts_of, near, strict=True) for i in x})
        n = self.count[flat]
        total = np.r_[0, np.cumsum(n)]
        ids = self.ids[_spans(self.start[flat], n)]
        at = 0
        for k, x in zip(texts_of, near, strict=True):
            starts = total[at : at + len(k) + 1] - total[at]
            yield ids[total[at] : total[at + len(k)]], starts, *self._n_best(k, x)
            at += len(k)

    def _near(self, k) -> list[int]:
        """The places of units with the n - 1 smallest losses; of equal ones the first."""
        m = min(self.n - 1, len(k))
        if not m:
            return []
        loss = self.loss[k]
        near = np.argpartition(loss, m - 1)[:m] if m < len(k) else np.arange(len(k))
        if m < len(k):
            worst = loss[near].max()
            less = np.flatnonzero(loss < worst)
            near = np.concatenate([less, np.flatnonzero(loss == worst)[: m - len(less)]])
        return [i for i in near.tolist() if loss[i] < np.inf]

    def _n_best(self, k, near):
        total = float(self.best[k].sum())
        scores, changes = [total], [{}]
        alts = [self.found[int(k[i])] for i in near]
        queue, seen = [(0.0, (0,) * len(near))], {(0,) * len(near)}
        while queue and len(scores) < self.n:
            lost, pick = heapq.heappop(queue)
            if any(pick):
                scores.append(total - lost), changes.append({near[j]: alts[j][c][1] for j, c in enumerate(pick) if c})
            for j in range(len(near)):
                nxt = (*pick[:j], pick[j] + 1, *pick[j + 1 :])
                if nxt[j] < len(alts[j]) and nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(queue, (lost + alts[j][pick[j]][0] - alts[j][nxt[j]][0], nxt))
        return scores, changes

    def apply(self, text: str, change: dict[int, list[int]]) -> list[int]:
        """All ids of a segmentation."""
        out: list[int] = []
        for i, u in enumerate(self.split(text)):
            k = self.at[u]
            out += change[i] if i in change else self.ids[self.start[k] : self.start[k] + self.count[k]].tolist()
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.v.raw.__getitem__, ids))[1:]

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "surrogatepass")


def _changed(ids: np.ndarray, starts: np.ndarray, change: dict[int, list[int]]) -> np.ndarray:
    """The ids with those of some units replaced."""
    if not change:
        return ids
    parts, done = [], 0
    for i in sorted(change):
        parts += [ids[done : starts[i]], np.array(change[i], np.int32)]
        done = starts[i + 1]
    return np.concatenate([*parts, ids[done:]])


def _lists(arrays: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Offsets and values of a list array of these."""
    return pa.array(np.r_[0, np.cumsum([len(x) for x in arrays])].astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]))


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start to start + n of each, one after the other."""
    end = np.cumsum(n)
    return np.arange(end[-1] if len(end) else 0) - np.repeat(end - n - start, n)


def segmenter(path: str, n: int) -> Segmenter:
    return remembered(("segmenter", path, n), lambda: Segmenter(path, n))


def encode(docs: DataFrame, model: str, n: int = 4, text: str = "text", key: str = "doc_id", all_ids: bool = False) -> DataFrame:
    """key, ids (best segmentation), scores (of the n best, best first), decoded, and with all_ids n_best: ids of each."""
    made = ("ids", "scores", "decoded", *(("n_best",) if all_ids else ()))
    if key.lower() in made:
        raise ValueError(f"the key {key} is named like an output column")
    kind = dict(docs.dtypes)[key]
    docs = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))

    def run(it):
        s = segmenter(model, n)
        for batch in it:
            for lo in range(0, batch.num_rows, 200):
                some = batch.slice(lo, 200)
                texts = some.column(1).to_pylist()
                null = np.array([t is None for t in texts], bool)
                mask = pa.array(null)
                found = list(s.n_best(texts)) if all_ids else [(x, [ids]) for ids, x, _ in s.encode(texts)]
                best = [every[0] for _, every in found]
                out = {"k": some.column(0), "ids": pa.ListArray.from_arrays(*_lists(best), mask=mask)}
                out["scores"] = pa.array([None if t is None else x for t, (x, _) in zip(texts, found, strict=True)], pa.list_(pa.float64()))
                out["decoded"] = pa.array([None if t is None else s.decode_bytes(ids.tolist()) for t, ids in zip(texts, best, strict=True)], pa.string())
                if all_ids:
                    each = pa.ListArray.from_arrays(*_lists([ids for _, every in found for ids in every]))
                    ends = np.r_[0, np.cumsum([len(every) for _, every in found])].astype(np.int32)
                    out["n_best"] = pa.ListArray.from_arrays(pa.array(ends), each, mask=mask)
                yield pa.RecordBatch.from_pydict(out)

    return docs.mapInArrow(run, f"k {kind}, ids array<int>, scores array<double>, decoded string" + (", n_best array<array<int>>" if all_ids else "")).withColumnRenamed("k", key)

"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

A text falls into words by the tokenizer's pattern; each word new to the task
becomes rows (word, position, token), one per byte.  ``MERGE`` joins neighbours with the
merge table (left, right, rank), contracts each word's leftmost pair of the smallest rank
and recurses until no word has a pair left.  A word that is a token itself is that token,
as the tiktoken library has it.  ``DECODE`` joins ids with the vocabulary and aggregates their bytes in order.

A word over ``SHORT`` bytes is cut into pieces first.  A boundary between two tokens of
the whole word never was inside a merged pair, so both sides merge as if alone; hence the pieces' tokens
are the word's if the last token of each and the first of the next stay apart
when encoded together.  Where they don't, the tokens around the cut are encoded anew, in windows that
double, and where these meet, whole pieces as one (``MERGE_ALL``: all pairs of the smallest rank at once where the
result is sure to be the same, else the leftmost).

Edge cases: a null or empty text has no ids and decodes to nothing; ids of rows may be null or repeat, as rows
don't meet; a very long text is encoded and decoded in portions; an empty table gives
no rows; other columns than key and text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._store import remembered
from .nbest import _spans

#: Distinct words that a worker remembers at most, about.
REMEMBER = 400_000
#: Bytes of a word up to which its pairs are contracted one by one.
SHORT = 64
#: Bytes of words in a query, words of a text and characters of texts in a portion, ids in a query.
QUERY_BYTES, PORTION_WORDS, PORTION_CHARS, QUERY_IDS = 1 << 20, 1 << 18, 1 << 22, 1 << 20
#: Tokens on each side of a failed cut that are encoded anew first.
WINDOW = 4

MERGE = """
WITH RECURSIVE t(w, i, tok, nxt, step) AS (
  SELECT w, i, tok, lead(tok) OVER (PARTITION BY w ORDER BY i), 0 FROM start
  UNION ALL
  SELECT w, i, CASE WHEN i = place THEN rank ELSE tok END, CASE WHEN i = place THEN after WHEN i = place - 1 THEN rank ELSE nxt END, step
  FROM (
    SELECT t.w, t.i - (t.i > best.place)::INT AS i, t.tok, t.nxt, t.step + 1 AS step, best.place, best.rank, best.after, t.i = best.place + 1 AS gone
    FROM t JOIN (
      SELECT f.w, (f.k & 4294967295)::INT AS place, (f.k >> 32)::INT AS rank, u.nxt AS after
      FROM (SELECT t.w, min((m.rank::BIGINT << 32) | t.i) AS k FROM t JOIN merges m ON ((t.tok::BIGINT << 32) | t.nxt) = m.pair GROUP BY t.w) f
      JOIN t u ON u.w = f.w AND u.i = (f.k & 4294967295) + 1) best ON t.w = best.w)
  WHERE NOT gone)
SELECT t.w, t.tok FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step) ORDER BY t.w, t.i
"""

#: Steps after which the recursion begins anew from the words that aren't done, so that its table of all steps stays small.
STEPS = 16
MERGE_ALL = f"""
WITH RECURSIVE t(w, i, tok, step) AS (
  SELECT w, i, tok, 0 FROM start
  UNION ALL
  SELECT w, i, coalesce(new, tok), step + 1 FROM (
    SELECT *, lag(new) OVER (PARTITION BY w ORDER BY i) AS gone FROM (
      SELECT *, CASE WHEN rank = best AND (calm OR i = first) AND row_number() OVER (PARTITION BY w, run, rank = best ORDER BY i) % 2 = 1 THEN rank END AS new FROM (
        SELECT *, min(i) FILTER (rank = best) OVER (PARTITION BY w) AS first, o - row_number() OVER (PARTITION BY w, rank = best ORDER BY i) AS run FROM (
          SELECT x.*, m.rank, m.calm, min(m.rank) OVER (PARTITION BY w) AS best FROM (
            SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY i) AS nxt, row_number() OVER (PARTITION BY w ORDER BY i) AS o FROM t WHERE step < {STEPS}) x
          LEFT JOIN merges m ON ((x.tok::BIGINT << 32) | x.nxt) = m.pair))))
  WHERE best IS NOT NULL AND gone IS NULL)
SELECT t.w, t.i, t.tok, t.step FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) USING (w, step) ORDER BY t.w, t.i
"""

DECODE = "SELECT d, unhex(string_agg(hex, '' ORDER BY i)) AS raw FROM ids JOIN vocabulary USING (id) GROUP BY d ORDER BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of lines with a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merger:
    """Words to ids and ids to bytes, by the queries above; words are remembered."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.split = regex.compile(pattern)
        self.rank = read_ranks(path)
        pairs, calm = [], np.ones(max(self.rank.values()) + 1, bool)
        for whole, r in self.rank.items():
            for k in range(1, len(whole)):
                a, b = self.rank.get(whole[:k]), self.rank.get(whole[k:])
                if a is not None and b is not None:
                    pairs.append((a, b, r))
                    # a pair with a merged token in it may go before the next pair of that token's rank
                    for x in (a, b):
                        calm[x] &= r > x
        a, b, r = np.array(pairs, np.int64).reshape(-1, 3).T
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        self.raw = {i: b for b, i in self.rank.items()}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        self._table("merges", pair=(a << 32) | b, rank=r.astype(np.int32), calm=calm[r])
        self._table("vocabulary", id=np.array(list(self.rank.values()), np.int32), hex=[b.hex() for b in self.rank])
        #: Whether two tokens, one after the other, stay apart.
        self.apart: dict[tuple[int, int], bool] = {}
        self._forget()

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS FROM given")
        self.db.unregister("given")

    def _forget(self) -> None:
        self.at = K.Numbers()
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _start(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, words), np.int64, len(words))
        w = np.repeat(np.arange(len(words)), n)
        return w.astype(np.int32), _spans(np.zeros(len(words), np.int64), n).astype(np.int32), self.byte[np.frombuffer(b"".join(words), np.uint8)]

    def _merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words that aren't empty, of up to ``SHORT`` bytes or so."""
        out: list[np.ndarray] = []
        size = np.cumsum([len(x) for x in words])
        lo = 0
        while lo < len(words):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + QUERY_BYTES, "right")))
            w, i, tok = self._start(words[lo:hi])
            self._table("start", w=w, i=i, tok=tok)
            got = self.db.sql(MERGE).to_arrow_table()
            w = got["w"].to_numpy()
            out += np.split(got["tok"].to_numpy().astype(np.int32), np.flatnonzero(w[1:] != w[:-1]) + 1)
            lo = hi
        return out

    def _merge_all(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of any length."""
        out: dict[int, np.ndarray] = {}
        w, i, tok = self._start(words)
        while len(w):
            self._table("start", w=w, i=i, tok=tok)
            got = self.db.sql(MERGE_ALL).to_arrow_table()
            w, i, tok, step = (got[c].to_numpy() for c in ("w", "i", "tok", "step"))
            done = step < STEPS
            for k in np.unique(w[done]).tolist():
                a, b = np.searchsorted(w, [k, k + 1])
                out[k] = tok[a:b].astype(np.int32)
            w, i, tok = w[~done], i[~done], tok[~done]
        return [out[k] for k in range(len(words))]

    def _stay(self, pairs: set[tuple[int, int]]) -> None:
        new = [p for p in pairs if p not in self.apart]
        if new:
            if len(self.apart) > REMEMBER:
                kept = {p: self.apart[p] for p in pairs if p in self.apart}
                self.apart = kept
            for p, ids in zip(new, self._merge([self.raw[a] + self.raw[b] for a, b in new]), strict=True):
                self.apart[p] = ids.tolist() == list(p)

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def _long(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of any length from those of pieces that are proved to stand."""
        pieces = [[x[k : k + SHORT] for k in range(0, len(x), SHORT)] for x in words]
        flat = iter(self._merge([p for x in pieces for p in x]))
        state = [[next(flat).tolist() for _ in x] for x in pieces]
        width = [[WINDOW] * (len(x) - 1) for x in state]
        held = [[1] * len(x) for x in state]
        while True:
            self._stay({(x[k][-1], x[k + 1][0]) for x in state for k in range(len(x) - 1)})
            windows, joins = [], []
            for n, x in enumerate(state):
                broken = [k for k in range(len(x) - 1) if not self.apart[x[k][-1], x[k + 1][0]]]
                for k in broken:
                    m = width[n][k]
                    if 2 * m < min(len(x[k]), len(x[k + 1])):
                        windows.append((n, k, m))
                if broken and not any(w[0] == n for w in windows):
                    end = 0
                    for k in broken:
                        if k >= end:
                            # with as many pieces as it holds, so that a word that falls into step nowhere takes few rounds
                            end = min(k + 1 + held[n][k], len(x))
                            joins.append((n, k, end))
            if not windows and not joins:
                return [np.array(list(chain.from_iterable(x)), np.int32) for x in state]
            made = self._merge([self._bytes(state[n][k][-m:] + state[n][k + 1][:m]) for n, k, m in windows])
            fits = {}
            for (n, k, m), ids in zip(windows, made, strict=True):
                ids, x = ids.tolist(), state[n]
                fits[n, k, m] = ids, (x[k][-m - 1], ids[0]), (ids[-1], x[k + 1][m])
            self._stay({p for _, *both in fits.values() for p in both})
            for (n, k, m), (ids, a, b) in fits.items():
                width[n][k] = 2 * m
                if self.apart[a] and self.apart[b]:
                    # the cut moves to a boundary of the window, which stands
                    state[n][k] = state[n][k][:-m] + ids
                    state[n][k + 1] = state[n][k + 1][m:]
            made = self._merge_all([self._bytes(list(chain.from_iterable(state[n][k:end]))) for n, k, end in joins])
            for (n, k, end), ids in sorted(zip(joins, made, strict=True), key=lambda j: j[0], reverse=True):
                state[n][k:end], held[n][k:end] = [ids.tolist()], [sum(held[n][k:end])]
                width[n][k : end - 1] = []

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        own: list = [self.rank.get(b) for b in raw]
        found: list = [None if i is None else np.array([i], np.int32) for i in own]
        for how, some in ((self._merge, lambda n: n <= SHORT), (self._long, lambda n: n > SHORT)):
            part = [j for j, b in enumerate(raw) if own[j] is None and some(len(b))]
            if part:
                for j, ids in zip(part, how([raw[j] for j in part]), strict=True):
                    found[j] = ids
        count = np.array([len(x) for x in found], np.int64)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, *found])

    def _known(self, words: list[str]) -> np.ndarray:
        k = self.at.of(words)
        if self.at.fresh:
            self._learn(list(self.at.fresh))
            self.at.fresh.clear()
        return k

    def _shrink(self) -> None:
        keep = self.at.forget_rare()
        start, self.count = self.start[keep], self.count[keep]
        self.ids = self.ids[_spans(start, self.count)]
        self.start = np.cumsum(self.count) - self.count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and each text's number of ids."""
        parts, sizes = [], np.zeros(len(texts), np.int64)
        lo = 0
        while lo < len(texts):
            hi, chars = lo + 1, len(texts[lo])
            while hi < len(texts) and chars + len(texts[hi]) <= PORTION_CHARS:
                chars += len(texts[hi])
                hi += 1
            if len(self.at) > REMEMBER:
                self._shrink()
            if hi == lo + 1:
                it = (m[0] for m in self.split.finditer(texts[lo]))
                while words := list(islice(it, PORTION_WORDS)):
                    k = self._known(words)
                    parts.append(self.ids[_spans(self.start[k], self.count[k])])
                    sizes[lo] += len(parts[-1])
                    if len(self.at) > REMEMBER:
                        self._shrink()
            else:
                lists = [self.split.findall(t) for t in texts[lo:hi]]
                k = self._known(list(chain.from_iterable(lists)))
                n = self.count[k]
                parts.append(self.ids[_spans(self.start[k], n)])
                total = np.r_[0, np.cumsum(n)]
                sizes[lo:hi] = np.diff(total[np.r_[0, np.cumsum([len(x) for x in lists])]])
            lo = hi
        return np.concatenate([np.zeros(0, np.int32), *parts]), sizes

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        out = [b""] * len(sizes)
        of = np.repeat(np.arange(len(sizes)), sizes)
        for lo in range(0, len(ids), QUERY_IDS):
            some = of[lo : lo + QUERY_IDS]
            self.db.register("ids", pa.table({"d": some, "i": np.arange(len(some), dtype=np.int32), "id": ids[lo : lo + QUERY_IDS]}))
            got = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("ids")
            for d, raw in zip(got["d"].to_pylist(), got["raw"].to_pylist(), strict=True):
                out[d] += raw
        return out


def merger(path: str, pattern: str) -> Merger:
    return remembered(("merger", path, pattern), lambda: Merger(path, pattern))


def bpe_encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = True) -> DataFrame:
    """key, ids (binary: unsigned 32-bit little-endian, one after the other) and, if asked for, decoded (the bytes that the ids stand for)."""
    if key.lower() in ("ids", "decoded"):
        raise ValueError(f"the key {key} is named like an output column")
    kind = dict(docs.dtypes)[key]
    docs = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))

    def run(it):
        m = merger(ranks, pattern)
        for batch in it:
            size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PORTION_CHARS, "right")))
                some = batch.slice(lo, hi - lo)
                ids, n = m.encode([t or "" for t in some.column(1).to_pylist()])
                ends = pa.array(np.r_[0, 4 * np.cumsum(n)], pa.int64())
                packed = pa.Array.from_buffers(pa.large_binary(), len(n), [None, ends.buffers()[1], pa.py_buffer(ids.astype("<u4"))])
                out = {"k": some.column(0), "ids": packed.cast(pa.binary())}
                if decoded:
                    out["decoded"] = pa.array(m.decode(ids, n), pa.binary())
                yield pa.RecordBatch.from_pydict(out)
                lo = hi

    return docs.mapInArrow(run, f"k {kind}, ids binary" + (", decoded binary" if decoded else "")).withColumnRenamed("k", key)

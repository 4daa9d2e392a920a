"""Vectorised kernels over Arrow text: words, n-grams and hashes of whole batches at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_R = 0x9E6D62D06F6A9A9B
_RINV = pow(_R, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random odd 64-bit value for each byte; A-Z share those of a-z in LOWER.
BYTES = _rng.integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]
GRAM = _rng.integers(0, 1 << 63, 16, dtype=U) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words that white space ends, and of words of ASCII letters, digits and all other characters than ASCII.
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
_pw = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (SplitMix64's finaliser)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pw[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, r in enumerate((_R, _RINV)):
            a = np.full(size, r, U)
            a[0] = 1
            _pw[k] = np.cumprod(a, dtype=U)
    return _pw[0][:n], _pw[1][:n]


def byte_sums(data: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """Prefix sums from which ``span_hash`` hashes any span of ``data``."""
    c = np.zeros(len(data) + 1, U)
    v = table[data]
    v *= _powers(len(data))[0] if len(data) else 1
    np.cumsum(v, out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    x = c[end] - c[start]
    x *= _powers(len(c))[1][start]
    return mix(x)


def text_chunks(arr: pa.Array, limit: int = 1 << 20):
    """Yields (first row, last row + 1, bytes, offsets) of runs of rows with about ``limit`` bytes; a null is empty."""
    if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type):
        arr = arr.cast(pa.large_binary())
    else:
        arr = arr.cast(pa.binary())
    if arr.null_count:
        arr = pc.fill_null(arr, b"")
    n = len(arr)
    if not n:
        return
    _, off, buf = arr.buffers()
    off = np.frombuffer(off, np.int64 if pa.types.is_large_binary(arr.type) else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``data``, and for each row the number of words before it (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    w = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~w[:-1]
    before |= edge[:n]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~w[1:]
    after |= edge[1:]
    s, e = np.flatnonzero(w & before), np.flatnonzero(w & after) + 1
    return s, e, np.searchsorted(s, offs)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
    return span_hash(byte_sums(data, table), s, e)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, those that cross rows included; they stand at their first word."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U)
    x = h[:m] * GRAM[0]
    for j in range(1, k):
        x += h[j : j + m] * GRAM[j]
    x += U(k)
    return mix(x)


def one_gram(h: np.ndarray) -> np.ndarray:
    """A hash of the whole short sequence ``h``, told apart by its length."""
    return gram_hashes(h, len(h))


class Numbers(dict):
    """Numbers words in the order in which they are first seen; ``fresh`` has those not yet dealt with."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.hits = np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def of(self, words: list[str]) -> np.ndarray:
        i = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        seen = np.bincount(i, minlength=len(self))
        seen[: len(self.hits)] += self.hits
        self.hits = seen
        return i

    def forget_rare(self) -> np.ndarray:
        """Forget words seen only once, or all if few were; returns the old numbers of those kept, in their new order."""
        keep = np.flatnonzero(self.hits > 1)
        if 2 * len(keep) > len(self):
            keep = keep[:0]
        names = list(self)
        self.clear()
        self.update(zip([names[i] for i in keep.tolist()], range(len(keep)), strict=True))
        self.hits = np.zeros(len(keep), np.int64)
        return keep

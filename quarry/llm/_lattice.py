"""Piece lattices of many short strings at once, over a fixed SentencePiece vocabulary."""

from __future__ import annotations

import re
import string

import numpy as np

from . import _kernel as K

MARK = "▁"
PUNCTUATION = re.escape(string.punctuation)
_BOUND = re.compile(rf"([^\W\d_])(?=[{PUNCTUATION}])")
_VOCABS: dict = {}


class Vocab:
    """Pieces, their scores, and a table from hashes of code points to pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.score = np.array([sp.get_score(i) for i in range(n)])
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        own = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) and self.pieces[i]]
        self.own = np.array(own)
        #: What each piece stands for in a text, in UTF-8.
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode("utf-8", "surrogatepass") for i, p in enumerate(self.pieces)]
        self.size = n
        #: A character without a piece of its own is spelled in bytes; its score is under every piece's.
        self.unknown = float(self.score[own].min()) - 10.0
        #: Texts fall apart before each mark if no piece has a mark after another character.
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in own)
        #: Letters before a punctuation mark in a piece; after all others texts fall apart before punctuation.
        self.bound = "".join(sorted({c for i in own for c in _BOUND.findall(self.pieces[i])}))
        #: Around line ends too if no piece has one beside another character.
        self.by_line = not any("\n" in self.pieces[i] and len(self.pieces[i]) > 1 for i in own)
        self.longest = max(len(self.pieces[i]) for i in own)
        flat, lens = points([self.pieces[i] for i in own])
        c = _sums(flat)
        end = np.cumsum(lens)
        h = K.span_hash(c, end - lens, end)
        o = np.argsort(h)
        self.hash, self.piece = h[o], self.own[o]
        assert (self.hash[1:] != self.hash[:-1]).all()
        #: The first hash of each 20 leading bits, and the most that share them.
        top, first, many = np.unique((self.hash >> K.U(44)).astype(np.int64), return_index=True, return_counts=True)
        self.slot = np.full(1 << 20, -1, np.int32)
        self.slot[top], self.shared = first, int(many.max())
        self.lengths = sorted({len(self.pieces[i]) for i in own})

    def edges(self, units: list[str]):
        """Edges (first place, end place, piece or -1 for a character in bytes) by position of the end in its unit.

        Places count over all units with one more for each unit's end, so unit u
        has places base[u] to base[u] + length.  Returns also base, lengths and
        the cuts between end positions.
        """
        flat, lens = points(units)
        n = len(flat)
        begin = np.cumsum(lens) - lens
        base = begin + np.arange(len(lens))
        unit = np.repeat(np.arange(len(lens)), lens)
        inside = np.arange(n) - begin[unit]
        left = lens[unit] - inside
        c = _sums(flat)
        at_all, len_all, piece_all = [], [], []
        single = np.zeros(n, bool)
        begins = np.arange(n)
        for size in self.lengths:
            begins = begins[left[begins] >= size]
            h = K.span_hash(c, begins, begins + size)
            j = self.slot[(h >> K.U(44)).astype(np.int64)]
            k = np.flatnonzero(j >= 0)
            h, j = h[k], j[k]
            for _ in range(self.shared - 1):
                j += (self.hash[j] < h) & (j < len(self.hash) - 1)
            ok = self.hash[j] == h
            i, piece = begins[k[ok]], self.piece[j[ok]]
            if size == 1:
                single[i] = True
            at_all.append(i), len_all.append(np.full(len(i), size)), piece_all.append(piece)
        i = np.flatnonzero(~single)
        at_all.append(i), len_all.append(np.ones(len(i), np.int64)), piece_all.append(np.full(len(i), -1))
        at, size, piece = np.concatenate(at_all), np.concatenate(len_all), np.concatenate(piece_all)
        end_in = inside[at] + size
        first = at + unit[at]
        last = first + size
        o = np.lexsort((last, end_in))
        first, last, piece, end_in = first[o], last[o], piece[o], end_in[o]
        cuts = np.flatnonzero(np.r_[True, end_in[1:] != end_in[:-1], True]) if len(o) else np.zeros(1, np.int64)
        return first, last, piece, base, lens, cuts

    def spell(self, ch: str) -> list[int]:
        return [self.byte_id[b] for b in ch.encode("utf-8", "surrogatepass")] if self.byte_id else [0]


def points(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings and the length of each."""
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, strings), np.int64, len(strings))


def _sums(flat: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flat) + 1, K.U)
    v = K.mix(flat.astype(K.U) + K.U(0x51ED270B))
    if len(flat):
        v *= K._powers(len(flat))[0]
    np.cumsum(v, out=c[1:])
    return c


def vocab(path: str) -> Vocab:
    if path not in _VOCABS:
        _VOCABS[path] = Vocab(path)
    return _VOCABS[path]


def groups(last: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, last[1:] != last[:-1]])

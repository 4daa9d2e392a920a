"""Language identification by unigrams whose segmentation is summed out.

Each language has a probability for every piece of a fixed public vocabulary.
A text's probability is the sum over all its segmentations into pieces of the
product of their probabilities; the forward algorithm computes it.  No piece
spans a word's beginning, so a text's logarithm is the sum over its words, and a
word is scored once per worker and remembered (at most ``REMEMBER`` words).

Piece probabilities are fitted by expectation-maximisation (forward-backward
over the same lattices) on at most ``PER_LANGUAGE`` documents of each language,
chosen by hash from all different ones that may be learned from.  Each language is
fitted in a task of its own; the driver has the probabilities only.  Characters without a piece
are spelled in bytes, whose probability is shared by all languages.

The score is the posterior probability of the predicted language, with equal
priors; ties fall to the language that is first in order.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; rows
without a language are never learned from; rows equal in id and text are learned
from once; with no language to learn all is ``und``; repeated rows are predicted
alike; a text of any length counts whole; columns of the input stay, but one named
like an output column is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from . import _kernel as K
from ._lattice import MARK, groups, vocab
from ._store import release, remembered

PER_LANGUAGE = 1000
REMEMBER = 300_000
ROUNDS = 3
#: Units over this length, or that could underflow, are fitted and scored in the logarithm domain.
LONG = 48
#: Characters of short and of long units that are fitted at once.
SHORT_CHARS, LONG_CHARS = 80_000, 50_000
_LETTER = re.compile(r"[^\W\d_]")
_BYTE = 1e-7


def units_of(text: str) -> list[str]:
    return [MARK + w for w in text.split()]


def _fits(prob) -> int:
    """The longest unit whose probability can't underflow: no piece is shorter than a character."""
    least = float(prob.min()) if prob.size else 1.0
    return LONG if least >= 1 else max(1, min(LONG, int(280 / -np.log10(least))))


def _forward(v, units, prob):
    """Logarithm of the sum over segmentations, for each unit and language; prob: pieces x languages, its last row for bytes."""
    first, last, piece, base, lens, cuts = v.edges(units)
    alpha = np.zeros((int(lens.sum()) + len(lens), prob.shape[1]))
    alpha[base] = 1.0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        g = groups(last[a:b])
        alpha[last[a:b][g]] = np.add.reduceat(alpha[first[a:b]] * prob[piece[a:b]], g)
    return np.log(alpha[base + lens])


def _forward_long(v, unit, prob):
    """The same for one long unit, with logarithms throughout."""
    first, last, piece, *_ = v.edges([unit])
    logp = np.log(prob)
    out = np.full((len(unit) + 1, prob.shape[1]), -np.inf)
    out[0] = 0.0
    g = groups(last)
    for a, b in zip(g, np.r_[g[1:], len(last)], strict=True):
        x = out[first[a:b]] + logp[piece[a:b]]
        m = x.max(0)
        out[last[a]] = m + np.log(np.exp(x - m).sum(0))
    return out[-1]


def _expected(v, units, weight, p):
    """Expected numbers of uses of each piece (last: bytes) over all segmentations."""
    first, last, piece, base, lens, cuts = v.edges(units)
    n = int(lens.sum()) + len(lens)
    alpha, beta = np.zeros(n), np.zeros(n)
    alpha[base], beta[base + lens] = 1.0, 1.0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        g = groups(last[a:b])
        alpha[last[a:b][g]] = np.add.reduceat(alpha[first[a:b]] * p[piece[a:b]], g)
    for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
        np.add.at(beta, first[a:b], beta[last[a:b]] * p[piece[a:b]])
    unit = np.searchsorted(base, first, "right") - 1
    post = alpha[first] * p[piece] * beta[last] / alpha[base + lens][unit] * weight[unit]
    return np.bincount(np.where(piece < 0, v.size, piece), post, v.size + 1)


def _expected_long(v, units, weight, p):
    """The same for long units, with logarithms throughout."""
    first, last, piece, base, lens, cuts = v.edges(units)
    n = int(lens.sum()) + len(lens)
    logp = np.log(p)[piece]
    alpha, beta = np.full(n, -np.inf), np.full(n, -np.inf)
    alpha[base], beta[base + lens] = 0.0, 0.0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        g = groups(last[a:b])
        alpha[last[a:b][g]] = np.logaddexp.reduceat(alpha[first[a:b]] + logp[a:b], g)
    for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
        np.logaddexp.at(beta, first[a:b], beta[last[a:b]] + logp[a:b])
    unit = np.searchsorted(base, first, "right") - 1
    post = np.exp(alpha[first] + logp + beta[last] - alpha[base + lens][unit]) * weight[unit]
    return np.bincount(np.where(piece < 0, v.size, piece), post, v.size + 1)


def _batches(units: list[str], size: int):
    """Runs of units of about ``size`` characters: first and last + 1."""
    ends = np.cumsum([len(u) for u in units])
    lo = 0
    while lo < len(units):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield lo, hi
        lo = hi


def fit_one(texts: list[str], model: str, rounds: int = ROUNDS) -> np.ndarray:
    """Probabilities of pieces, the last that of a byte, from a language's texts."""
    v = vocab(model)
    words = Counter()
    for t in texts:
        words.update(units_of(t))
    units = sorted(words, key=lambda w: (len(w), w))
    lengths = np.array([len(u) for u in units])
    weight = np.array([words[w] for w in units], float)
    p = np.full(v.size + 1, 1.0 / len(v.own))
    p[-1] = _BYTE
    for _ in range(rounds if words else 0):
        c = np.zeros(v.size + 1)
        short = int(np.searchsorted(lengths, _fits(p), "right"))
        for lo, hi in _batches(units[:short], SHORT_CHARS):
            c += _expected(v, units[lo:hi], weight[lo:hi], p)
        for lo, hi in _batches(units[short:], LONG_CHARS):
            c += _expected_long(v, units[short + lo : short + hi], weight[short + lo : short + hi], p)
        c = c[:-1] + 0.01
        p = np.append(c / c.sum(), _BYTE)
    return p


def fit(texts: dict[str, list[str]], model: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and pieces x languages probabilities."""
    langs = sorted(texts)
    return langs, np.array([fit_one(texts[k], model, rounds) for k in langs]).reshape(len(langs), vocab(model).size + 1).T


class Scorer:
    def __init__(self, model: str, prob: np.ndarray):
        self.v, self.prob, self.fits = vocab(model), prob, _fits(prob)
        self.clear()

    def clear(self):
        self.at = K.Numbers()
        self.rows = np.zeros((0, self.prob.shape[1]))

    def texts(self, texts: list[str]) -> np.ndarray:
        """Logarithms of the texts' probabilities, texts x languages."""
        if len(self.at) > REMEMBER:
            self.rows = self.rows[self.at.forget_rare()]
        lists = [t.split() for t in texts]
        i = self.at.of(list(chain.from_iterable(lists)))
        if new := self.at.fresh:
            got = np.empty((len(new), self.prob.shape[1]))
            short = [j for j, w in enumerate(new) if len(w) < self.fits]
            units = [MARK + new[j] for j in short]
            for lo, hi in _batches(units, SHORT_CHARS):
                got[short[lo:hi]] = _forward(self.v, units[lo:hi], self.prob)
            for j, w in enumerate(new):
                if len(w) >= self.fits:
                    got[j] = _forward_long(self.v, MARK + w, self.prob)
            new.clear()
            self.rows = np.concatenate([self.rows, got])
        c = np.zeros((len(i) + 1, self.prob.shape[1]))
        np.cumsum(self.rows[i], axis=0, out=c[1:])
        n = np.cumsum([0, *map(len, lists)])
        return c[n[1:]] - c[n[:-1]]


def learn(docs: DataFrame, model: str, allowed: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Fit on at most ``per_language`` documents of each language, those with the smallest hashes of id and text as far as can be told by share."""
    if allowed is not None:
        docs = docs.filter(allowed)
    space = 1 << 30
    h = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit("language")), F.lit(space))
    docs = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(key).cast("string").alias("k"), F.col(text).alias("t"), h.alias("h"))
    # different rows, within a few hundredths
    count = {r[0]: r[1] for r in docs.groupBy("l").agg(F.approx_count_distinct(F.xxhash64("k", "t"), 0.02)).collect()}
    if not count:
        return [], np.zeros((vocab(model).size + 1, 0))
    # a quarter more than wanted on average, of which the first by hash are taken
    share = F.create_map(*[x for k, n in count.items() for x in (F.lit(k), F.lit(int(min(1.0, (1.25 * per_language + 20) / n) * space)))])
    some = docs.filter(F.col("h") < F.try_element_at(share, F.col("l"))).groupBy("l", "h", "k").agg(F.min("t").alias("t"))

    def one(table: pa.Table) -> pa.Table:
        release()
        rows = sorted(zip(table.column("h").to_pylist(), table.column("k").to_pylist(), table.column("t").to_pylist(), strict=True), key=lambda r: (r[0], r[1] or "", r[2]))
        p = fit_one([t for _, _, t in rows[:per_language]], model)
        name = table.column("l")[0].as_py()
        release()
        return pa.table({"l": [name], "p": pa.array([p.tobytes()], pa.binary())})

    # a language's bounded sample in one task each; eight bytes a piece come back
    found = {r[0]: np.frombuffer(r[1]) for r in some.groupBy("l").applyInArrow(one, "l string, p binary").collect()}
    langs = sorted(found)
    return langs, np.array([found[k] for k in langs]).T


def identify(docs: DataFrame, model: str, fitted: tuple[list[str], np.ndarray], text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The documents with the predicted language and its posterior probability, in place of columns of these names."""
    langs, prob = fitted
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((langs, prob))
    # the text may be named like an output column, too
    at = docs.columns.index(text)
    stay = [i for i, c in enumerate(docs.columns) if c.lower() not in (pred.lower(), score.lower())]
    schema = StructType([*(docs.schema.fields[i] for i in stay), *StructType().add(pred, StringType()).add(score, DoubleType()).fields])

    def predict(it):
        langs, prob = shared.value
        s = remembered(("language", shared._path), lambda: Scorer(model, prob))
        for batch in it:
            out_l, out_s = [], []
            for lo in range(0, batch.num_rows, 500):
                texts = batch.column(at).slice(lo, 500).to_pylist()
                known = [bool(langs) and t is not None and _LETTER.search(t) is not None for t in texts]
                x = s.texts([t if k else "" for t, k in zip(texts, known, strict=True)])
                if langs:
                    best = x.argmax(1)
                    p = 1.0 / np.exp(x - x.max(1, keepdims=True)).sum(1)
                for j, k in enumerate(known):
                    out_l.append(langs[best[j]] if k else "und")
                    out_s.append(float(p[j]) if k else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in stay), pa.array(out_l, pa.string()), pa.array(out_s, pa.float64())], names=[*(batch.schema.names[i] for i in stay), pred, score])

    return docs.mapInArrow(predict, schema)

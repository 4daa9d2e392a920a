"""The character set of bytes that don't say which: what a set's decoder accepts, weighed by pairs of bytes.

``pair_counts`` encodes a table's texts in each set and counts pairs of neighbouring bytes, in
tasks first; no more than 65,536 rows a set, whatever the table's size.  A pair weighs
-1024 log2 of its smoothed share, as an integer, so that sums don't depend on order.  ``Charsets``
takes the set of least weight among those whose decoder (a state machine over
bytes) accepts the content; of equal ones the first.  Markup between angle brackets doesn't count.

A byte order mark decides alone.  A null stays null.  What is ASCII, empty, under ``LEAST`` bytes or accepted by none is UTF-8.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.pieces import pieces

#: Sets that texts of Western European languages come in.
SETS = ("utf-8", "utf-16-le", "cp1252", "cp850", "mac_roman", "cp037")
#: Bytes under which nothing is guessed. Fixed value.
LEAST = 10
#: Bytes that are weighed at once, and pairs that a task counts at once.
AT_ONCE = 1 << 20
#: Marks at the front that name a set.
MARKS = {codecs.BOM_UTF8: "utf-8-sig", codecs.BOM_UTF32_LE: "utf-32", codecs.BOM_UTF32_BE: "utf-32", codecs.BOM_UTF16_LE: "utf-16", codecs.BOM_UTF16_BE: "utf-16"}
MARKUP = re.compile(rb"(\s*</?[^>]*>)+\s*")


def _checked(sets: Sequence[str]) -> tuple[str, ...]:
    for s in sets:
        codecs.lookup(s)
    return tuple(sets)


def pairs(content: bytes) -> np.ndarray:
    b = np.frombuffer(content, np.uint8).astype(np.int32)
    return b[:-1] * 256 + b[1:]


def encoded(text: Column, name: str) -> Column:
    """The text's bytes in a set; null where the set lacks one of its characters."""

    @F.pandas_udf(T.BinaryType())
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t):
            try:
                return None if t is None else t.encode(name)
            except UnicodeEncodeError:
                return None

        for (texts,) in pieces(batches):
            yield texts.map(one)

    return encode(text)


def pair_counts(texts: DataFrame, text: str = "text", sets: Sequence[str] = SETS) -> DataFrame:
    """codec, pair (first byte * 256 + second), n over all texts that a set can encode."""
    sets = _checked(sets)

    def count(it):
        n = np.zeros((len(sets), 1 << 16), np.int64)
        held, have = [[] for _ in sets], 0

        def add():
            for k, some in enumerate(held):
                if some:
                    n[k] += np.bincount(np.concatenate(some), minlength=1 << 16)
                    some.clear()

        for batch in it:
            for t in batch.column(0).to_pylist():
                for k, name in enumerate(sets):
                    try:
                        held[k].append(pairs(t.encode(name)))
                    except UnicodeEncodeError:
                        continue
                if (have := have + len(t)) > AT_ONCE:
                    add()
                    have = 0
        add()
        k, pair = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"codec": pa.array([sets[i] for i in k.tolist()], pa.string()), "pair": pa.array(pair.astype(np.int32)), "n": pa.array(n[k, pair])})

    rows = texts.select(F.col(f"`{text}`").alias("t")).filter("t IS NOT NULL").mapInArrow(count, "codec string, pair int, n long")
    return rows.groupBy("codec", "pair").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Charsets:
    """Sets in order of preference, and the weight of each pair of bytes in each."""

    sets: tuple[str, ...]
    weights: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame, sets: Sequence[str] = SETS) -> Charsets:
        sets = _checked(sets)
        n = np.zeros((len(sets), 1 << 16), np.int64)
        for r in counts.collect():  # 65,536 rows a set at most
            if r.codec in sets:
                n[sets.index(r.codec), r.pair] = r.n
        # one whole for all sets: what they share, as ASCII, then speaks for none
        share = (n + 1) / (n.sum(1).max() + (1 << 16))
        return cls(sets, np.round(-1024 * np.log2(share)).astype(np.int32))

    def weigh(self, content: bytes) -> np.ndarray:
        total = np.zeros(len(self.sets), np.int64)
        for lo in range(0, max(0, len(content) - 1), AT_ONCE):
            p = pairs(content[lo : lo + AT_ONCE + 1])
            total += self.weights[:, p].sum(1, dtype=np.int64)
        return total

    def find(self, content: bytes, markup: bool = False) -> str:
        """The likeliest set; with ``markup`` by the text outside tags."""
        for mark, name in MARKS.items():
            if content.startswith(mark):
                return name
        shown = MARKUP.sub(b" ", content).strip() if markup else content
        if len(shown) < LEAST or (shown.isascii() and b"\0" not in shown):
            return "utf-8"
        for k in np.argsort(self.weigh(shown), kind="stable").tolist():
            try:
                content.decode(self.sets[k])
            except UnicodeDecodeError:
                continue
            return self.sets[k]
        return "utf-8"


def guessed(content: Column, model: Charsets, markup: bool = False) -> Column:
    """The name of the likeliest set of binary content."""

    @F.pandas_udf(T.StringType())
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for (contents,) in pieces(batches):
            yield contents.map(lambda b: None if b is None else model.find(bytes(b), markup))

    return find(content)


def decoded(content: Column, codec: Column) -> Column:
    """Content as text by the set of each row; bytes that the set refuses become replacement characters."""

    @F.pandas_udf(T.StringType())
    def decode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for some in pieces(batches):
            yield pd.Series([None if b is None or n is None else bytes(b).decode(n, "replace") for b, n in zip(*some, strict=True)], dtype=object)

    return decode(content, codec)

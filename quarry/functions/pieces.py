"""Arrow batches in pieces, so that what a task holds of its rows' results has a bound."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

#: Rows, and characters or bytes of all columns' texts, of a piece.
ROWS, SIZE = 500, 4 << 20


def pieces(batches: Iterator) -> Iterator[tuple[pd.Series, ...]]:
    """The same rows in order in runs of at most ``ROWS`` and about ``SIZE``; a larger row is a piece by itself. For functions of an iterator of series, or of tuples of series."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        texts = [c for c in columns if c.dtype == object or pd.api.types.is_string_dtype(c.dtype)]
        lo = have = 0
        for i in range(len(columns[0])):
            n = sum(len(v) for v in (c.iat[i] for c in texts) if isinstance(v, (str, bytes, bytearray)))
            if i > lo and (i - lo >= ROWS or have + n > SIZE):
                yield tuple(c.iloc[lo:i] for c in columns)
                lo, have = i, 0
            have += n
        if len(columns[0]) > lo:
            yield tuple(c.iloc[lo:] for c in columns)

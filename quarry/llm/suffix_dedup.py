"""Suffix-array dedup: remove every byte covered by a string of ``least`` bytes that an earlier document has too.

Method: threshold-bounded interval expansion on Burrows-Wheeler transforms.

1. Each window of ``least`` bytes falls to the smallest hash of its ``GRAM``-byte
   pieces, which depends on the window's content alone, so equal windows meet.
   A run of windows with the same smallest hash is one piece of text.
2. A first exchange carries these hashes alone (five bytes each) and finds those
   of two or more documents.  Only pieces with such a hash go on, each distinct
   one once per bucket of documents, with its smallest document.
3. Where pieces meet, a BWT of their concatenation is built and intervals are
   expanded breadth first: level l+1 extends the intervals of level l backward
   by a character, so boundaries with common prefix 0, 1, 2, ... appear by
   increasing value, and the expansion stops at ``least``.  An interval then
   holds all places of one string; its smallest document is the string's first.
4. Documents receive, for the pieces they hold, the first document of each
   window, and remove the windows that an earlier document has.

Text never meets by document group, so a hot group of copies is spread over all
buckets; copies of a piece are combined before each exchange.  Hashes of pieces
have 64 bits; the strings themselves are compared by the BWT.

Edge cases: null texts are empty; texts under ``least`` bytes lose nothing; equal
ids are no earlier documents; a null id neither loses bytes nor is earlier than
any; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._store import lean, n_parts, whole_ids

GRAM = 25
LONGEST = 64
#: Bytes of pieces in one transform: its arrays fit a core's cache.
BATCH = 400_000
#: Bytes of text in one partition, and in one packed block.
PER_PART = 12e6
PACK = 12_000_000
CHUNK = 1 << 20


def pieces(data: np.ndarray, offs: np.ndarray, least: int):
    """Runs of windows with the same smallest hash: (row, first window, number of windows, hash), and the prefix sums."""
    c = K.byte_sums(data)
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none, np.zeros(0, K.U), c
    at = np.arange(n - GRAM + 1)
    x = c[GRAM:] - c[:-GRAM]
    x *= K._powers(n + 1)[1][: len(at)]
    x = K.mix(x)
    want, have = least - GRAM + 1, 1
    while have < want:
        step = min(have, want - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    ok = np.ones(n + 1, bool)
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        ok[max(a, b - least + 1) : b] = False
    ok = ok[: len(x)]
    new = np.r_[True, x[1:] != x[:-1]]
    new[1:] |= ~ok[:-1]
    start = np.flatnonzero(new & ok)
    # a run ends where the next begins or where windows end
    stop = np.flatnonzero(ok & np.r_[(new[1:] | ~ok[1:]), True]) + 1
    count = stop - start
    if len(count) and count.max() > LONGEST:
        reps = -(-count // LONGEST)
        j = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        start, stop = np.repeat(start, reps) + j * LONGEST, np.repeat(stop, reps)
        count = np.minimum(stop - start, LONGEST)
    return np.searchsorted(offs, start, "right") - 1, start, count, x[start], c


def _part(h, parts):
    return ((h & K.U(0xFFFFFF)) % K.U(parts)).astype(np.int64)


def _five(h):
    return np.ascontiguousarray((h >> K.U(24)).view(np.uint8).reshape(-1, 8)[:, :5])


def _unfive(b):
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).reshape(-1)


def _split(p):
    """Index arrays of equal values of p, with the value."""
    o = np.argsort(p, kind="stable")
    if not len(o):
        return
    q = p[o]
    for i in np.split(o, np.flatnonzero(q[1:] != q[:-1]) + 1):
        yield int(p[i[0]]), i


def _batch(part, payload, extra=None):
    cols = {"part": pa.array(part, pa.int32()), "payload": pa.array(map(_squeeze, payload), pa.binary())}
    if extra is not None:
        cols = {"part": cols["part"], "q": pa.array(extra, pa.int32()), "payload": cols["payload"]}
    return pa.RecordBatch.from_pydict(cols)


def _squeeze(raw: bytes) -> bytes:
    return np.int64(len(raw)).tobytes() + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def _expand(payload: pa.Scalar) -> pa.Buffer:
    raw = payload.as_buffer()
    return pa.Codec("zstd").decompress(raw.slice(8), int(np.frombuffer(raw, np.int64, 1)[0]))


def _text_block(ids: pa.Array, texts: pa.Array) -> bytes:
    """Ids (with a mark where one is null), lengths and bytes of rows."""
    data = [x for *_, x, _ in K.text_chunks(texts, 1 << 40)]
    n = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return _pack(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), n) + b"".join(x.tobytes() for x in data)


def _text_rows(raw: pa.Buffer) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    (ids, valid, n), at = _unpack(raw, np.int64, np.bool_, np.int64)
    offs = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=offs[1:])
    return ids, valid, pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offs), raw.slice(at)])


def _pack(*arrays):
    return np.int64(len(arrays[0])).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(raw, *types):
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out, at


def first_places(strings: list[np.ndarray] | np.ndarray, lens: np.ndarray, docs: np.ndarray, least: int) -> np.ndarray:
    """For each place of the concatenated strings the smallest document among the places of the string of ``least`` bytes there; the largest integer where none starts."""
    none = np.iinfo(np.int64).max
    data = np.asarray(strings)
    m = len(lens)
    # symbols: 0 ends a string, others are the byte and one
    n = len(data) + m
    sym = np.zeros(n + 64, np.uint16)
    end = np.cumsum(lens)
    begin = end - lens
    shift = np.repeat(np.arange(m), lens)
    place = np.arange(len(data)) + shift
    sym[place] = data.astype(np.uint16) + 1
    # suffixes in order of their first 63 symbols: seven, then three ranks of seven, then three of 21
    key = np.zeros(n, K.U)
    for j in range(7):
        key = (key << K.U(9)) | sym[j : j + n].astype(K.U)
    depth, bits = 7, K.U(max(1, int(n).bit_length()))
    while True:
        sa = np.argsort(key)
        x = key[sa]
        rank = np.empty(n, K.U)
        rank[sa] = np.cumsum(np.r_[1, x[1:] != x[:-1]]).astype(K.U)
        if depth >= least:
            break
        key = rank.copy()
        for j in (depth, 2 * depth) if 3 * bits <= 64 else (depth,):
            key <<= bits
            key[: max(0, n - j)] |= rank[j:]
        depth *= 3 if 3 * bits <= 64 else 2
    sa = sa.astype(np.int32)
    isa = np.empty(n, np.int32)
    isa[sa] = np.arange(n, dtype=np.int32)
    nxt = sa + 1
    nxt[nxt == n] = 0
    #: Row of the suffix that is one character shorter: the inverse of the transform's last-to-first mapping.
    back = isa[nxt]
    head = sym[sa]
    new_head = head[1:] != head[:-1]
    interval = np.zeros(n, np.int32)
    bound = np.ones(n, bool)
    for _ in range(least):
        # extend every interval backward by each character: rows stay together that have the same
        # character before rows of the same interval
        x = interval[back]
        np.not_equal(x[1:], x[:-1], out=bound[1:])
        bound[1:] |= new_head
        np.cumsum(bound, out=interval)
    first = np.full(n, none, np.int64)
    own = np.repeat(docs, lens)
    whole = np.arange(len(data)) + least <= np.repeat(end, lens)
    first[isa[place[whole]]] = own[whole]
    low = np.minimum.reduceat(first, np.flatnonzero(bound))
    out = np.full(len(data), none, np.int64)
    out[whole] = low[interval[isa[place[whole]]] - 1]
    return out


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 50) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (maximal removed runs, first byte and the one after the last), kept (the other bytes)."""
    if not GRAM <= least <= 56:
        raise ValueError(f"least must lie between {GRAM} and 56 bytes")
    docs = docs.select(whole_ids(docs, key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = n_parts(docs.sparkSession, n_bytes, PER_PART)
    named = docs.filter("doc_id is not null")

    def offer(it):
        """The hashes of each document's pieces, by bucket of hashes."""
        held, size = [], 0

        def flush():
            ids, h = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            p, raw = [], []
            for part, i in _split(_part(h, parts)):
                d, n = _runs(ids[i])
                p.append(part), raw.append(_pack(d, n) + _five(h[i]).tobytes())
            return _batch(p, raw)

        for batch in it:
            ids = batch.column(0).to_numpy()
            for lo, hi, data, offs in K.text_chunks(batch.column(1), CHUNK):
                row, _, _, h, _ = pieces(data, offs, least)
                held.append((ids[lo:hi][row], h))
                size += len(h)
                if size > 2_000_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def shared(it):
        """Hashes of two or more documents, by bucket of documents."""
        dd, hh = [], []
        for batch in it:
            for raw in batch.column(1):
                raw = _expand(raw)
                (d, n), at = _unpack(raw, np.int64, np.int32)
                dd.append(np.repeat(d, n)), hh.append(_unfive(memoryview(raw)[at:]))
        if not dd:
            return
        d, h = np.concatenate(dd), np.concatenate(hh)
        dd.clear(), hh.clear()
        o = np.argsort(h)
        d, h = d[o], h[o]
        cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        many = np.minimum.reduceat(d, cut) != np.maximum.reduceat(d, cut)
        keep = np.repeat(many, np.diff(np.r_[cut, len(h)]))
        d, h = d[keep], h[keep]
        p, raw = [], []
        for part, i in _split(_bucket(d, parts)):
            i = i[np.argsort(d[i], kind="stable")]
            ids, n = _runs(d[i])
            p.append(part), raw.append(_pack(ids, n) + np.ascontiguousarray(h[i].view(np.uint8).reshape(-1, 8)[:, :5]).tobytes())
        yield _batch(p, raw)

    def bucketed(it):
        """Whole texts, packed by bucket of documents."""
        held, size = [], 0

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids = rows.column(0).combine_chunks()
            p, raw = [], []
            for part, i in _split(_bucket(ids.fill_null(0).to_numpy(zero_copy_only=False), parts)):
                some = rows.take(pa.array(i))
                p.append(part), raw.append(_text_block(some.column(0).combine_chunks(), some.column(1).combine_chunks()))
            return _batch(p, raw)

        for batch in it:
            for lo in range(0, batch.num_rows, 500):
                held.append(batch.slice(lo, 500))
                size += pa.compute.sum(pa.compute.binary_length(held[-1].column(1))).as_py() or 0
                if size > PACK:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    bucket = docs.mapInArrow(lean(bucketed), "part int, payload binary").withColumn("kind", F.lit(0))
    known = named.mapInArrow(lean(offer), "part int, payload binary").repartition(parts, "part").mapInArrow(lean(shared), "part int, payload binary")

    def send(it):
        """Each bucket's distinct pieces with a shared hash, by bucket of hashes."""
        texts, notes = [], []
        for batch in it:
            for part, payload, kind in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if kind:
                    raw = _expand(payload)
                    (d, n), at = _unpack(raw, np.int64, np.int32)
                    notes.append((np.repeat(d, n), _unfive(memoryview(raw)[at:])))
                else:
                    texts.append((part, payload))
        if not notes or not texts:
            return
        d, h = (np.concatenate(x) for x in zip(*notes, strict=True))
        notes.clear()
        ids = np.unique(d)
        wanted = np.unique((np.searchsorted(ids, d).astype(K.U) << K.U(40)) | h)
        seen: dict[int, list] = {}
        for bucket_id, payload in texts:
            own, valid, rows = _text_rows(_expand(payload))
            for lo, hi, data, offs in K.text_chunks(rows, CHUNK):
                row, start, count, h, c = pieces(data, offs, least)
                doc = own[lo:hi][row]
                at = np.searchsorted(ids, doc)
                at[at == len(ids)] = 0
                k = (at.astype(K.U) << K.U(40)) | (h >> K.U(24))
                i = np.searchsorted(wanted, k)
                i[i == len(wanted)] = 0
                keep = (wanted[i] == k) & (ids[at] == doc) & valid[lo:hi][row]
                row, start, count, h, doc = row[keep], start[keep], count[keep], h[keep], doc[keep]
                if not len(h):
                    continue
                size = count + least - 1
                key = K.span_hash(c, start, start + size)
                # copies of a piece in this chunk and bucket go once, with the smallest and largest document
                o = np.argsort(key, kind="stable")
                cut = np.flatnonzero(np.r_[True, key[o][1:] != key[o][:-1]])
                lowest, highest, one = np.minimum.reduceat(doc[o], cut), np.maximum.reduceat(doc[o], cut), o[cut]
                seen.setdefault(bucket_id, []).append((key[one], h[one], size[one], lowest, highest, _gather(data, start[one], size[one])))
        for q, found in seen.items():
            key, h, size, low, high = (np.concatenate([x[j] for x in found]) for j in range(5))
            text = np.concatenate([x[5] for x in found])
            begin = np.cumsum(size) - size
            o = np.argsort(key, kind="stable")
            cut = np.flatnonzero(np.r_[True, key[o][1:] != key[o][:-1]])
            low, high, one = np.minimum.reduceat(low[o], cut), np.maximum.reduceat(high[o], cut), o[cut]
            key, h, size, begin = key[one], h[one], size[one], begin[one]
            p, raw = [], []
            for part, i in _split(_part(h, parts)):
                p.append(part)
                raw.append(_pack(key[i], (h[i] >> K.U(56)).astype(np.uint8), size[i].astype(np.uint16), low[i], high[i]) + _gather(text, begin[i], size[i]).tobytes())
            yield _batch(p, raw, [q] * len(p))

    def settle(it):
        """The first document of each window of each piece, for the buckets of documents that hold the piece."""
        cols = [[], [], [], [], [], [], []]
        for batch in it:
            for q, raw in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = _expand(raw)
                got, at = _unpack(raw, np.uint64, np.uint8, np.uint16, np.int64, np.int64)
                for c, x in zip(cols, (*got, np.full(len(got[0]), q, np.int32), np.frombuffer(raw, np.uint8, offset=at)), strict=True):
                    c.append(x)
        if not cols[0]:
            return
        key, sub, size, low, high, q, text = (np.concatenate(c) for c in cols)
        cols.clear()
        size = size.astype(np.int64)
        begin = np.cumsum(size) - size
        order = np.lexsort((key, sub))
        # sub-batches of whole classes of smallest hashes: equal windows are never apart
        total = np.cumsum(np.bincount(sub, size, 256))
        group = (total // BATCH)[sub[order]]
        for rows in np.split(order, np.flatnonzero(group[1:] != group[:-1]) + 1):
            k = key[rows]
            cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            one, which = rows[cut], np.cumsum(np.r_[0, k[1:] != k[:-1]])
            first = first_places(_gather(text, begin[one], size[one]), size[one], np.minimum.reduceat(low[rows], cut), least)
            # runs of windows with the same first document
            windows = size[one] - least + 1
            at = np.cumsum(size[one]) - size[one]
            piece = np.repeat(np.arange(len(one)), windows)
            off = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
            f = first[at[piece] + off]
            new = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (piece[1:] != piece[:-1])])
            run = np.diff(np.r_[new, len(f)])
            piece, off, f = piece[new], off[new], f[new]
            runs_of = np.searchsorted(piece, np.arange(len(one) + 1))
            reps = runs_of[which + 1] - runs_of[which]
            entry = np.repeat(runs_of[which], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            owner = np.repeat(rows, reps)
            useful = f[entry] < high[owner]
            entry, owner = entry[useful], owner[useful]
            p, raw = [], []
            for part, i in _split(q[owner]):
                p.append(part)
                raw.append(_pack(key[owner[i]], off[entry[i]].astype(np.uint8), run[entry[i]].astype(np.uint8), f[entry[i]]))
            yield _batch(p, raw)

    def remove(it):
        texts, notes = [], []
        for batch in it:
            for payload, kind in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                if kind:
                    notes.append(_unpack(_expand(payload), np.uint64, np.uint8, np.uint8, np.int64)[0])
                else:
                    texts.append(payload)
        if notes:
            key, off, run, first = (np.concatenate(x) for x in zip(*notes, strict=True))
            o = np.argsort(key, kind="stable")
            key, off, run, first = key[o], off[o].astype(np.int64), run[o].astype(np.int64), first[o]
        else:
            key = np.zeros(0, K.U)
        for payload in texts:
            own, known_id, rows = _text_rows(_expand(payload))
            for lo, hi, data, offs in K.text_chunks(rows, CHUNK):
                gone = np.zeros(len(data) + 1, np.int32)
                if len(key):
                    row, start, count, h, c = pieces(data, offs, least)
                    k = K.span_hash(c, start, start + count + least - 1)
                    a, b = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
                    reps = b - a
                    entry = np.repeat(a, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                    at, doc = np.repeat(start, reps) + off[entry], np.repeat(row, reps)
                    ok = (first[entry] < own[lo:hi][doc]) & known_id[lo:hi][doc]
                    at, n = at[ok], run[entry][ok]
                    gone += np.bincount(at, minlength=len(gone)).astype(np.int32)
                    gone -= np.bincount(at + n + least - 1, minlength=len(gone)).astype(np.int32)
                gone = np.cumsum(gone)[:-1] > 0
                edge = np.zeros(len(data) + 1, bool)
                edge[1:-1] = gone[1:] != gone[:-1]
                edge[offs] = True
                cuts = np.flatnonzero(edge)
                spans, kept, total = [], [], []
                left = data[~gone].tobytes()
                pos = np.r_[0, np.cumsum(~gone)]
                ia = np.searchsorted(cuts, offs)
                for j in range(hi - lo):
                    s, e = offs[j], offs[j + 1]
                    total.append(e - s)
                    kept.append(left[pos[s] : pos[e]])
                    x = cuts[ia[j] : ia[j + 1] + 1]
                    spans.append([{"first": int(u - s), "end": int(v - s)} for u, v in zip(x[:-1], x[1:], strict=True) if gone[u]] if pos[e] - pos[s] != e - s else [])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(own[lo:hi], mask=~known_id[lo:hi]), "n_bytes": pa.array(total, pa.int64()), "spans": pa.array(spans, _SPANS), "kept": pa.array(kept, pa.binary())})

    def beside(notes: DataFrame) -> DataFrame:
        """Documents and notes in the same partition by bucket of documents."""
        return bucket.unionByName(notes.withColumn("kind", F.lit(1))).repartition(parts, "part")

    offered = beside(known).mapInArrow(lean(send), "part int, q int, payload binary")
    found = offered.repartition(parts, "part").mapInArrow(lean(settle), "part int, payload binary")
    return beside(found).mapInArrow(lean(remove), "doc_id long, n_bytes long, spans array<struct<first:long,end:long>>, kept binary")


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _bucket(d, parts):
    return (K.mix(d.astype(np.int64).view(K.U)) % K.U(parts)).astype(np.int64)


def _runs(d):
    """Run-length code of neighbouring equal ids."""
    cut = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, np.int64)
    return d[cut], np.diff(np.r_[cut, len(d)]).astype(np.int32)


def _gather(data, start, size):
    """The spans of data, one after the other."""
    i = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)
    return data[i]

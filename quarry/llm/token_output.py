"""Token-id output: Arrow IPC files of fixed-size lists, for zero-copy random access to equal-length sequences.

Documents are range-partitioned by id, tokenised once, and packed one after the
other into sequences of ``seq_len`` ids.  A part's ``.arrow`` file has uncompressed
batches of fixed-size lists, ``ids`` (16-bit where the vocabulary allows, else
32-bit) and ``mask`` (false where the last sequence is padded): sequence i is a
slice of a mapped buffer.  Its ``.docs`` file has each document's id, start in
the part and number of ids.  Files are written under another name and renamed,
so a lost or repeated task leaves whole files only.

A text's words (between spaces and line ends, which no token spans) are encoded
by the tokenizer once each per worker and remembered by 64-bit hashes, about
``REMEMBER`` at most; those met once are forgotten first.  That holds for a tokenizer whose
file lower-cases texts, drops white space between words and marks words' ends; any other one gets
whole texts.

Edge cases: a null text is empty and gives the end id alone; ids may repeat (the
rows stay apart, in order of text) or be null (first); an empty table gives no
files and no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernel as K
from ._store import n_parts, open_fs, publish, remembered, saved, shared_dir, whole_ids

REMEMBER = 500_000
#: Stands between words that are encoded together; words that have it are encoded apart.
MARK = "\x01"
ROWS = 256


class WordCoder:
    """Ids of texts by remembered units: words, with commas and the like after an ASCII letter apart.

    A tokenizer ``by_word`` never joins what a space, a line end or such a cut separates,
    and it ignores case, so each unit is encoded once, whatever its case.  Others encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        self.by_word = _by_word(json.loads(self.tok.to_str()))
        mark = self.tok.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.ends = np.zeros(self.size + 1, bool)
        for piece, i in self.tok.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        none = np.zeros(0, np.int64)
        #: Hashes in order; where each unit's ids start, how many there are, and how often it was met.
        self.hash, self.start, self.count, self.hits = np.zeros(0, K.U), none, none, none
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, units: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(units, add_special_tokens=False)]

    def _together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units that are letters only: each is one word to the tokenizer, whose last piece is marked as an end."""
        flat = np.concatenate(self._encode([" ".join(units[k : k + 500]) for k in range(0, len(units), 500)]))
        last = np.flatnonzero(self.ends[flat])
        if len(last) == len(units) and last[-1] == len(flat) - 1:
            return flat, np.diff(last, prepend=-1)
        return self._apart(units)

    def _apart(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any units, a mark between them."""
        if self.mark is None or MARK in "\n".join(units):
            each = self._encode(units)
            return np.concatenate(each), np.array([len(x) for x in each])
        flat = np.concatenate(self._encode([f" {MARK} ".join(["", *units[k : k + 500], ""]) for k in range(0, len(units), 500)]))
        at = np.flatnonzero(flat == self.mark)
        last = np.cumsum([min(500, len(units) - k) + 1 for k in range(0, len(units), 500)]) - 1
        return flat[flat != self.mark], np.delete(np.diff(at, append=0) - 1, last)

    def _add(self, hashes: np.ndarray, units: list[str]) -> None:
        plain = np.array([u.isalpha() for u in units])
        for part, how in ((np.flatnonzero(plain), self._together), (np.flatnonzero(~plain), self._apart)):
            if not len(part):
                continue
            ids, count = how([units[i] for i in part.tolist()])
            h = hashes[part]
            at = np.searchsorted(self.hash, h)
            self.start = np.insert(self.start, at, len(self.ids) + np.cumsum(count) - count)
            self.count = np.insert(self.count, at, count)
            self.hits = np.insert(self.hits, at, 0)
            self.hash = np.insert(self.hash, at, h)
            self.ids = np.concatenate([self.ids, ids])

    def _forget(self) -> None:
        """Forget units met once, or all if few were."""
        keep = np.flatnonzero(self.hits > 1)
        if 2 * len(keep) > len(self.hash):
            keep = keep[:0]
        self.hash, start, self.count = self.hash[keep], self.start[keep], self.count[keep]
        self.ids = self.ids[_spans(start, self.count)]
        self.start = np.cumsum(self.count) - self.count
        self.hits = np.zeros(len(keep), np.int64)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in ``data``, and the number of ids of each."""
        if not self.by_word:
            lists = self._encode([bytes(data[a:b]).decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)])
            return np.concatenate([np.zeros(0, np.uint32), *lists]), np.fromiter(map(len, lists), np.int64, len(lists))
        if len(self.hash) > REMEMBER:
            self._forget()
        s, e, _ = K.words(data, offs, _IN_WORD)
        raw = data.tobytes()
        cut = np.flatnonzero(_STOP[data[1:]] & _LETTER[data[:-1]]) + 1
        cut = cut[np.searchsorted(s, cut, "right") - 1 == np.searchsorted(s, cut - 1, "right") - 1]
        # a cut that is inside a word ends one unit and begins the next
        s, e = np.sort(np.r_[s, cut]), np.sort(np.r_[e, cut])
        # special tokens are told apart by case
        h = K.word_hashes(data, s, e, K.BYTES if b"<|" in raw else K.LOWER)
        one, first, which, seen = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.hash, one)
        at[at == len(self.hash)] = 0
        new = self.hash[at] != one if len(self.hash) else np.ones(len(one), bool)
        if new.any():
            i = first[new]
            self._add(one[new], [raw[a:b].decode() for a, b in zip(s[i].tolist(), e[i].tolist(), strict=True)])
            at = np.searchsorted(self.hash, one)
        if not len(one):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        self.hits[at] += seen
        start, n = self.start[at][which], self.count[at][which]
        total = np.r_[0, np.cumsum(n)]
        edge = total[np.searchsorted(s, offs)]
        return self.ids[_spans(start, n)], np.diff(edge)


def _by_word(spec: dict) -> bool:
    """Whether a tokenizer's file says that it lower-cases, makes words of runs of letters and of signs that a pattern finds and drops the rest, and marks words' ends."""
    parts = lambda x, name: x[name] if x and x.get("type") == "Sequence" else [x] if x else []
    steps = [x["type"] for x in parts(spec.get("normalizer"), "normalizers")]
    pre = parts(spec.get("pre_tokenizer"), "pretokenizers")
    removed = any(x["type"] == "Split" and x.get("behavior") == "Removed" and x.get("invert") and "[^\\s\\p{L}\\p{N}]+" in x["pattern"].get("Regex", "") and r"[\p{L}]+" in x["pattern"]["Regex"] for x in pre)
    plain = not any(x.get("add_prefix_space") for x in pre)
    return "Lowercase" in steps and set(steps) <= {"NFC", "Replace", "Lowercase"} and removed and plain and spec["model"].get("end_of_word_suffix") == "</w>"


_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, 0x0A]] = False
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b",.!?;:")] = True


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start to start + n of each, one after the other."""
    end = np.cumsum(n)
    return np.arange(end[-1] if len(end) else 0) - np.repeat(end - n - start, n)


def coder(path: str) -> WordCoder:
    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return WordCoder(path)

    return remembered(("tokens", path), make)


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, key: str = "doc_id", text: str = "text", seq_len: int = 2048, end_id: int = 1) -> DataFrame:
    """Write the files; returns path, part, n_docs, n_tokens of each part, in ascending order of ids by part."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "tokens")
    docs = docs.select(whole_ids(docs, key).alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = docs.repartitionByRange(n_parts(spark, size, 32e6), F.col("doc_id").asc_nulls_first(), F.left("text", F.lit(64))).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(it):
        part = TaskContext.get().partitionId()
        c = coder(tokenizer)
        kind = np.uint16 if c.size <= 1 << 16 else np.uint32
        schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        index: list[tuple] = []
        n_tokens = 0

        def body(out):
            nonlocal n_tokens
            held, have = [], 0

            def put(flat, n):
                full = np.zeros(-(-len(flat) // seq_len) * seq_len, kind)
                full[: len(flat)] = flat
                w.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(full), seq_len), pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(full)) < n), seq_len)], schema=schema))

            with pa.ipc.new_file(out, schema) as w:
                for batch in it:
                    for lo, hi, data, offs in K.text_chunks(batch.column(1)):
                        some = batch.slice(lo, hi - lo)
                        ids, n = c.encode(data, offs)
                        end = np.cumsum(n) + np.arange(1, len(n) + 1)
                        flat = np.full(len(ids) + len(n), end_id, kind)
                        plain = np.ones(len(flat), bool)
                        plain[end - 1] = False
                        flat[plain] = ids
                        index.append((some.column(0), n_tokens + np.r_[0, end[:-1]], n + 1))
                        n_tokens += len(flat)
                        held.append(flat)
                        have += len(flat)
                        if have >= ROWS * seq_len:
                            flat = np.concatenate(held)
                            whole = len(flat) // (ROWS * seq_len) * ROWS * seq_len
                            for a in range(0, whole, ROWS * seq_len):
                                put(flat[a : a + ROWS * seq_len], ROWS * seq_len)
                            held, have = [flat[whole:]], len(flat) - whole
                if have:
                    flat = np.concatenate(held)
                    put(flat, len(flat))

        first = next(it, None)
        if first is None:
            return
        it = _chain(first, it)
        publish(path, f"part-{part:06d}.arrow", body)
        docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])

        def table(out):
            with pa.ipc.new_file(out, docs_schema) as w:
                for ids, start, n in index:
                    w.write_batch(pa.RecordBatch.from_arrays([ids, pa.array(start, pa.int64()), pa.array(n, pa.int64())], schema=docs_schema))

        publish(path, f"part-{part:06d}.docs", table)
        yield pa.RecordBatch.from_pydict({"path": [f"{path}/part-{part:06d}"], "part": [part], "n_docs": [sum(len(x[0]) for x in index)], "n_tokens": [n_tokens]})

    return saved(docs.mapInArrow(write, "path string, part long, n_docs long, n_tokens long"), "manifest")


def _chain(first, rest):
    yield first
    yield from rest


class TokenFile:
    """One part: sequences and documents by number, as views of the mapped file where the store allows it."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        local = fs.type_name == "local"
        opened = (lambda p: pa.memory_map(p)) if local else fs.open_input_file
        self.reader = pa.ipc.open_file(opened(path + ".arrow"))
        self.docs = pa.ipc.open_file(opened(path + ".docs")).read_all()
        self.seq_len = self.reader.schema.field("ids").type.list_size
        self._at: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def batch(self, k: int) -> np.ndarray:
        if self._at[0] != k:
            self._at = k, self.reader.get_batch(k).column(0).flatten().to_numpy()
        return self._at[1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        b, j = divmod(i, ROWS)
        mask = self.reader.get_batch(b).column(1)[j].values
        return self.batch(b)[j * self.seq_len : (j + 1) * self.seq_len], mask

    def span(self, start: int, n: int):
        """The ids from ``start`` on, in as many views as there are batches."""
        each = ROWS * self.seq_len
        while n:
            k, off = divmod(start, each)
            x = self.batch(k)[off : off + n]
            yield x
            start, n = start + len(x), n - len(x)


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids before the document in all parts), n_tokens, ids_crc32 and, if asked for, ids: read from the files."""
    spark: SparkSession = manifest.sparkSession
    parts, base = [], 0
    for r in manifest.orderBy("part").collect():  # a row per file
        parts.append((r.path, base))
        base += r.n_tokens
    schema = "path string, base long"
    files = spark.createDataFrame(parts, schema).repartition(max(1, len(parts)), "path") if parts else spark.createDataFrame([], schema)

    def read(it):
        for batch in it:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = TokenFile(path)
                for some in f.docs.to_batches(max_chunksize=1000):
                    crc, ids = [], []
                    for start, n in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True):
                        c, own = 0, []
                        for x in f.span(start, n):
                            c = zlib.crc32(x.astype("<u4").data, c)
                            own.append(x)
                        crc.append(c)
                        if with_ids:
                            ids.append(np.concatenate(own).astype(np.int64))
                    cols = {"doc_id": some.column(0), "start": pa.array(np.array(some.column(1)) + base), "n_tokens": some.column(2), "ids_crc32": pa.array(crc, pa.int64())}
                    yield pa.RecordBatch.from_pydict(cols | ({"ids": pa.array(ids, pa.list_(pa.int64()))} if with_ids else {}))

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))

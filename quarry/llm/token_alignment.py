"""Alignment of two tokenizers' tokens over a corpus, and how often ids meet.

A (a file of the tokenizers library, byte-level) and B (a SentencePiece model) encode a
space and the text.  Each side's ends are a cumulated sum of token lengths in bytes;
ends that both have (``intersect1d``) cut the tokens into groups (``searchsorted``), and the tokens
of A that link with those of B, from a first to a last one, are expanded by ``repeat``: those whose ranges end
together, or with ``whole_groups`` all of a group.  All that happens
once for each unit (what stands between single spaces) that is new to a worker, for
many units at once: neither side has a token across such a space, where both are sure to end.
A tokenizer that doesn't promise this gets whole texts.

``Alignment.counts`` counts each pair of ids in every task first, then by pair and salt,
then by pair.  ``Alignment.scored`` looks up pairs with more than one in ``LOOKUP`` of all links,
hence fewer than ``LOOKUP`` pairs, in the tasks; all others meet their counts in a shuffle, in
which no pair has more rows than that.

Edge cases: a text that is null or empty, or that one side doesn't give back byte by byte, has no
tokens; keys may be null or repeat, as rows are told apart by number; a very long text
goes in portions; other columns are ignored, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import re
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _kernel as K
from ._lattice import vocab
from ._store import open_fs, remembered, saved
from .nbest import _spans

#: Units that a worker remembers at most, about.
REMEMBER = 250_000
#: Characters of texts in a portion, links of a task that are counted at once, pairs a task holds before it emits them.
PORTION, COUNT_AT_ONCE, HOLD = 1 << 20, 1 << 21, 1 << 20
#: Pairs that tasks look up themselves (16 bytes each).
LOOKUP = 2_000_000
SALTS = 16
#: Units that are encoded as one text.
TOGETHER = 200
#: A space between two characters that are none.
CUT = re.compile(r" (?<=\S )(?=\S)")


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as its character, all others as characters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """Bytes of all tokens of a tokenizer, by id."""

    def __init__(self, raw: list[bytes]):
        self.length = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.data[_spans(self.start[ids], self.length[ids])]


class Aligner:
    def __init__(self, a: str, b: str, whole_groups: bool):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.whole_groups = whole_groups
        self.tok_a = Tokenizer.from_file(a)
        self.tok_a.encode_special_tokens = True
        self.tok_b = sentencepiece.SentencePieceProcessor(model_file=b)
        v, of = vocab(b), byte_of_character()
        entries = [self.tok_a.id_to_token(i) or "" for i in range(self.tok_a.get_vocab_size())]
        self.a = Side([bytes(map(of.__getitem__, x)) if all(c in of for c in x) else x.encode() for x in entries])
        self.b = Side(v.raw)
        spec = json.loads(self.tok_a.to_str())
        pre = spec["pre_tokenizer"] or {}
        #: Whether no token of either side goes across a space between two other characters.
        self.by_space = v.by_word and spec["normalizer"] is None and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) == ("ByteLevel", False, True)
        #: Whether every token has bytes, so that no end comes twice.
        self.filled = bool(self.a.length.all() and self.b.length.all())
        self.kind = pair_type(len(self.a.length), len(self.b.length))
        most = max(len(self.a.length), len(self.b.length))
        #: Each id and what follows it: another id of the group's side, side B, the next group, the next unit.
        self.written = [f"{i}{c}" for c in ",|;\n" for i in range(most)]
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.at = K.Numbers()
        none = np.zeros(0, np.int64)
        self.n_a = self.n_b = self.n_groups = self.start = self.count = none
        self.whole = np.zeros(0, bool)
        self.links, self.groups = np.zeros(0, self.kind), []

    def _shrink(self) -> None:
        keep = self.at.forget_rare()
        self.groups = [self.groups[i] for i in keep.tolist()]
        self.n_a, self.n_b, self.n_groups, self.whole, self.count, start = (x[keep] for x in (self.n_a, self.n_b, self.n_groups, self.whole, self.count, self.start))
        self.links = self.links[_spans(start, self.count)]
        self.start = np.cumsum(self.count) - self.count

    def _ids(self, texts: list[str]) -> list[list[list[int]]]:
        """Ids of a space and each text on both sides."""
        return [x.ids for x in self.tok_a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], self.tok_b.encode(texts, num_threads=1)

    def _apart(self, units: list[str]):
        """Ids of both sides, one unit after the other, their numbers, and which units both give back."""
        raw = [b" " + u.encode() for u in units]
        whole, out = np.ones(len(units), bool), []
        for side, lists in zip((self.a, self.b), self._ids(units), strict=True):
            ids, n = np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(units))
            of = np.r_[0, np.cumsum(side.length[ids])][np.r_[0, np.cumsum(n)]]
            flat = side.bytes(ids).tobytes()
            whole &= np.fromiter((flat[x:y] == t for x, y, t in zip(of[:-1].tolist(), of[1:].tolist(), raw, strict=True)), bool, len(units))
            out += [ids, n]
        return *out, whole

    def _together(self, units: list[str]):
        """The same, of units in texts of many, with a space between them; None where a text isn't given back."""
        texts = [" ".join(units[k : k + TOGETHER]) for k in range(0, len(units), TOGETHER)]
        raw = np.frombuffer("".join([" " + t for t in texts]).encode(), np.uint8)
        ends = np.cumsum(np.fromiter((len(u) if u.isascii() else len(u.encode()) for u in units), np.int64, len(units)) + 1)
        out = []
        for side, lists in zip((self.a, self.b), self._ids(texts), strict=True):
            ids = np.array(list(chain.from_iterable(lists)), np.int64)
            if not np.array_equal(side.bytes(ids), raw):
                return None
            end = np.cumsum(side.length[ids])
            last = np.searchsorted(end, ends, "right")
            if (end[last - 1] != ends).any():
                return None
            out += [ids, np.diff(last, prepend=0)]
        return *out, np.ones(len(units), bool)

    def _learn(self, units: list[str]) -> None:
        if not self.by_space:
            return self._align(units, *self._apart(units))
        # what stands between single spaces of a text has no blank at its ends but where the text has
        odd = np.fromiter((u[:1].isspace() or u[-1:].isspace() for u in units), bool, len(units))
        if not odd.any() and (got := self._together(units)):
            return self._align(units, *got)
        parts = []
        for k in range(0, len(units), TOGETHER):
            some = units[k : k + TOGETHER]
            parts.append((None if odd[k : k + TOGETHER].any() else self._together(some)) or self._apart(some))
        self._align(units, *map(np.concatenate, zip(*parts, strict=True)))

    def _align(self, units, a, n_a, b, n_b, whole) -> None:
        # from here on only units that both sides give back
        unit_a, unit_b = (np.repeat(np.arange(len(units)), n) for n in (n_a, n_b))
        a, b, unit_a, unit_b = a[whole[unit_a]], b[whole[unit_b]], unit_a[whole[unit_a]], unit_b[whole[unit_b]]
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=self.filled)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        lo, hi = (np.searchsorted(group_b, group_a, s) if self.whole_groups else np.searchsorted(end_b, end_a, s) for s in ("left", "right"))
        n = hi - lo
        links = (np.repeat(a, n).astype(self.kind) << self.kind(8 * self.kind().itemsize // 2)) | b[_spans(lo, n)].astype(self.kind)
        count = np.bincount(np.repeat(unit_a, n), minlength=len(units))
        last = np.searchsorted(end_a, cuts)
        self.groups += self._write(a, b, unit_a, group_a, group_b, whole)
        self.n_a, self.n_b = np.r_[self.n_a, n_a], np.r_[self.n_b, n_b]
        self.n_groups = np.r_[self.n_groups, np.bincount(unit_a[last], minlength=len(units))]
        self.start, self.count = np.r_[self.start, len(self.links) + np.cumsum(count) - count], np.r_[self.count, count]
        self.whole, self.links = np.r_[self.whole, whole], np.concatenate([self.links, links])

    def _write(self, a, b, unit_a, group_a, group_b, whole) -> list[str]:
        """Each unit's groups: ids of A, a bar, ids of B; groups apart by semicolons."""
        if not len(a):
            return [""] * len(whole)
        ids, place = np.concatenate([a, b]), np.concatenate([2 * group_a, 2 * group_b + 1])
        o = np.argsort(place, kind="stable")
        ids, place = ids[o], place[o]
        unit = np.zeros(place[-1] // 2 + 2, np.int64)
        unit[group_a], unit[-1] = unit_a, -1
        nxt = np.r_[place[1:], place[-1] + 1]
        group, after = place // 2, nxt // 2
        follows = np.select([nxt == place, after == group, unit[after] == unit[group]], [0, 1, 2], 3)
        texts = iter("".join(map(self.written.__getitem__, (follows * self.most + ids).tolist())).split("\n"))
        return [next(texts) if w else "" for w in whole.tolist()]

    def _known(self, units: list[str]) -> np.ndarray:
        if len(self.at) > REMEMBER:
            self._shrink()
        k = self.at.of(units)
        if self.at.fresh:
            self._learn(list(self.at.fresh))
            self.at.fresh.clear()
        return k

    def _portions(self, text: str):
        """Lists of the text's units."""
        if not self.by_space:
            yield [text]
            return
        lo = 0
        while len(text) - lo > PORTION and (m := CUT.search(text, lo + PORTION)):
            yield CUT.split(text[lo : m.start()])
            lo = m.end()
        yield CUT.split(text[lo:] if lo else text)

    def rows(self, texts: list[str | None]) -> dict[str, list | np.ndarray]:
        """n_a, n_b, n_groups, groups and links (bytes) of each text."""
        totals = np.zeros((4, len(texts)), np.int64)
        groups, links = [[] for _ in texts], [[] for _ in texts]
        held, chars = [], 0
        for j, text in enumerate(texts):
            for units in self._portions(text) if text else ():
                held.append((j, units))
                if (chars := chars + sum(map(len, units))) > PORTION:
                    self._add(held, totals, groups, links)
                    held, chars = [], 0
        self._add(held, totals, groups, links)
        for j in np.flatnonzero(totals[3]).tolist():
            groups[j], links[j], totals[:3, j] = [], [], 0
        return dict(zip(("n_a", "n_b", "n_groups"), totals[:3], strict=True)) | {"groups": [";".join(x) for x in groups], "links": [b"".join(x) for x in links]}

    def _add(self, held: list[tuple[int, list[str]]], totals: np.ndarray, groups: list, links: list) -> None:
        """Count in what portions of texts have; the last of the totals is units that don't come back as they were."""
        if not held:
            return
        k = self._known([u for _, units in held for u in units])
        ends = np.r_[0, np.cumsum([len(units) for _, units in held])]
        of = np.array([j for j, _ in held])
        for total, each in zip(totals, (self.n_a, self.n_b, self.n_groups, ~self.whole), strict=True):
            np.add.at(total, of, np.diff(np.r_[0, np.cumsum(each[k], dtype=np.int64)][ends]))
        flat = self.links[_spans(self.start[k], self.count[k])].tobytes()
        at = np.r_[0, np.cumsum(self.count[k])][ends] * self.links.itemsize
        names = list(map(self.groups.__getitem__, k.tolist()))
        for (j, _), lo, hi, x, y in zip(held, ends[:-1].tolist(), ends[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            groups[j].append(";".join(names[lo:hi]))
            links[j].append(flat[x:y])


def pair_type(n_a: int, n_b: int) -> type:
    """The integers that hold an id of each side in a half."""
    return np.uint32 if max(n_a, n_b) <= 1 << 16 else np.uint64


def aligner(a: str, b: str, whole_groups: bool) -> Aligner:
    return remembered(("aligner", a, b, whole_groups), lambda: Aligner(a, b, whole_groups))


def _slices(batch: pa.RecordBatch, column: int, limit: int):
    """Runs of rows with about ``limit`` bytes in a column."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


class Alignment:
    """documents (key, n_a, n_b, n_groups, groups, links), counts of pairs, and documents with their links' counts."""

    def __init__(self, docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", whole_groups: bool = False):
        self.names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "links")
        if key.lower() in self.names:
            raise ValueError(f"the key {key} is named like an output column")
        self.spark, self.key, self.a, self.b, self.whole_groups = docs.sparkSession, key, a, b, whole_groups
        self._type = dict(docs.dtypes)[key]
        self._docs = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))

    @cached_property
    def _kind(self) -> type:
        from tokenizers import Tokenizer

        return pair_type(Tokenizer.from_file(self.a).get_vocab_size(), vocab(self.b).size)

    def documents(self) -> DataFrame:
        """key, n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2,b3``) and links: pairs of ids, A's in the upper half of an unsigned little-endian integer."""
        a, b, whole_groups = self.a, self.b, self.whole_groups

        def run(it):
            own = aligner(a, b, whole_groups)
            for batch in it:
                for some in _slices(batch, 1, PORTION):
                    out = own.rows(some.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(out[c]) for c in ("n_a", "n_b", "n_groups")), pa.array(out["groups"], pa.string()), pa.array(out["links"], pa.binary())], ["k", "n_a", "n_b", "n_groups", "groups", "links"])

        return self._docs.mapInArrow(run, f"k {self._type}, n_a long, n_b long, n_groups long, groups string, links binary").withColumnRenamed("k", self.key)

    @cached_property
    def rows(self) -> DataFrame:
        """The documents as written, a number each, with the groups' hash for the groups."""
        d = self.documents()
        return saved(d.withColumn("groups", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).withColumnRenamed("groups", "groups_sha256").withColumn("_row", F.monotonically_increasing_id()), "aligned")

    @cached_property
    def counts(self) -> DataFrame:
        """pair, n (links that hold it) and best (no pair with the same id of B has more)."""
        kind = self._kind

        def count(it):
            salt = TaskContext.get().partitionId() % SALTS
            pairs, n = np.zeros(0, kind), np.zeros(0, np.int64)
            held, have = [], 0

            def merge():
                nonlocal pairs, n, held, have
                new, times = np.unique(np.concatenate(held), return_counts=True)
                both, which = np.unique(np.concatenate([pairs, new]), return_inverse=True)
                n = np.bincount(which, np.concatenate([n, times]), len(both)).astype(np.int64)
                pairs, held, have = both, [], 0

            def emit():
                return pa.RecordBatch.from_pydict({"pair": pa.array(pairs.astype(np.int64)), "salt": pa.array(np.full(len(pairs), salt, np.int32)), "n": pa.array(n)})

            for batch in it:
                for x in batch.column(0).to_pylist():
                    held.append(np.frombuffer(x, kind))
                    have += len(held[-1])
                    if have > COUNT_AT_ONCE:
                        merge()
                        if len(pairs) > HOLD:
                            yield emit()
                            pairs, n = pairs[:0], n[:0]
            if held:
                merge()
            yield emit()

        parts = self.rows.filter("n_groups > 0").select("links").mapInArrow(count, "pair long, salt int, n long")
        once = parts.groupBy("pair", "salt").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))
        once = saved(once.withColumn("b", F.col("pair").bitwiseAND((1 << 4 * kind().itemsize) - 1)), "pairs")
        top = once.groupBy("b").agg(F.max("n").alias("most"))
        # no more rows than B has ids
        return saved(once.join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")

    def scored(self) -> DataFrame:
        """key, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their id of B), count_sum (over links), groups_sha256."""
        kind, counts = self._kind, self.counts
        total, n_pairs = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        hot = saved(counts.filter(F.col("n") > (total // LOOKUP if n_pairs > LOOKUP else 0)).coalesce(max(1, min(n_pairs, LOOKUP) // 500_000)), "hot") if n_pairs else counts
        files = sorted(hot.inputFiles())

        def look_up(batches, cold):
            pair, n, best = remembered(("counts", *files), lambda: _read_counts(files, kind))
            for batch in batches:
                for some in _slices(batch, 1, 1 << 23):
                    links = [np.frombuffer(x or b"", kind) for x in some.column(1).to_pylist()]
                    size = np.fromiter(map(len, links), np.int64, len(links))
                    flat = np.concatenate([np.zeros(0, kind), *links])
                    at = np.searchsorted(pair, flat)
                    at[at == len(pair)] = 0
                    known = pair[at] == flat if len(pair) else np.zeros(len(flat), bool)
                    if cold:
                        row = np.repeat(np.asarray(some.column(0)), size)[~known]
                        yield pa.RecordBatch.from_pydict({"_row": pa.array(row), "pair": pa.array(flat[~known].astype(np.int64))})
                        continue
                    add = lambda x: pa.array(np.diff(np.r_[0, np.cumsum(np.where(known, x[at], 0) if len(pair) else np.zeros(len(flat), np.int64))][np.r_[0, np.cumsum(size)]]))  # noqa: E731, B023
                    yield pa.RecordBatch.from_pydict({"_row": some.column(0), "n_links": pa.array(size), "n_best": add(best), "count_sum": add(n), **{c: some.column(c) for c in keep}})

        keep = ("k", "n_a", "n_b", "n_groups", "groups_sha256")
        rows = self.rows.withColumnRenamed(self.key, "k")
        out = rows.select("_row", "links", *keep).mapInArrow(lambda it: look_up(it, False), f"_row long, n_links long, n_best long, count_sum long, k {self._type}, n_a long, n_b long, n_groups long, groups_sha256 string")
        if n_pairs > LOOKUP:
            rest = rows.select("_row", "links").mapInArrow(lambda it: look_up(it, True), "_row long, pair long")
            rest = rest.groupBy("_row", "pair").agg(F.count("*").alias("times")).join(counts, "pair")
            more = rest.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
            out = out.join(more, "_row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
        return out.select(F.col("k").alias(self.key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _read_counts(files: list[str], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a written table in order, with their counts, and whether each is best."""
    import pyarrow.parquet as pq

    parts = []
    for uri in files:
        fs, path = open_fs(uri)
        parts.append(pq.read_table(path, filesystem=fs))
    if not parts:
        return np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = pa.concat_tables(parts)
    pair = t["pair"].to_numpy().astype(kind)
    o = np.argsort(pair)
    return pair[o], t["n"].to_numpy()[o], t["best"].to_numpy().astype(np.int64)[o]

"""Folders of files as a Spark data source: ``spark.read`` and ``readStream`` with ``format("quarry_files")``, ``write`` for files.

Columns: path (below the folder), kind (the name's ending in lower case), size, modified, content, text
(HTML, or the Markdown itself, as ``files.file_text`` makes it) and error.  The planner lists the folder's metadata
and packs files into partitions of about ``partitionBytes``, in order of path; a larger file is a
partition by itself.  What the planner holds of a listing is ``RUN`` files, as others wait in sorted temporary files, and the
partitions that Spark is given, packed; stores other than local and mounted folders are listed by pyarrow at once.  Only the columns of the schema that was given are made: without
content, text and error no file is opened.  Filters on path and kind leave out files before they are
planned (``register`` turns ``spark.sql.python.filterPushdown.enabled`` on).  A file that can't be
opened, or that no reader knows, is a row whose error says why.

The stream's offset is a place in the order of (modified, path).  A batch takes the files up to the newest one
that has been at rest for ``settleSeconds``, so that none with an equal time is still to come;
``filesPerBatch`` bounds it, for triggers that ask again until nothing is left: ``availableNow`` asks this kind of
source once a run, before its checkpoint is read, so leave the bound out there.  A file that is changed comes again.  What arrives with an
older time than a batch already took is not seen, as with any order by time.

The planner and the tasks read through pyarrow's file systems.  Stores that only Spark
reads go by way of ``files.read_files``.
"""

from __future__ import annotations

import os
import pickle
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage

NAME = "quarry_files"
SCHEMA = "path string, kind string, size long, modified timestamp, content binary, text string, error string"
#: Bytes of files in a partition, and what each file adds to them.
PARTITION_BYTES, OPEN_COST = 32 << 20, 1 << 16
#: Seconds for which a streamed file hasn't changed.
SETTLE = 2.0
#: Bytes of rows that go to Spark at once.
BATCH_BYTES = 8 << 20
#: Files of a listing that are sorted at once, and that are read back at once.
RUN, CHUNK = 100_000, 1_000


@dataclass(frozen=True, slots=True)
class Entry:
    path: str
    size: int
    #: Nanoseconds.
    modified: int

    @property
    def kind(self) -> str:
        return self.path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in self.path.rsplit("/", 1)[-1] else ""


def _dumped(some: list[Entry]) -> bytes:
    return zlib.compress(pickle.dumps([(e.path, e.size, e.modified) for e in some]), 1)


def _loaded(raw: bytes) -> list[Entry]:
    return [Entry(*x) for x in pickle.loads(zlib.decompress(raw))]


class Files(InputPartition):
    """A partition's files, packed: the planner and Spark hold all partitions at once."""

    def __init__(self, entries: list[Entry]):
        super().__init__(0)
        self.raw = _dumped(entries)

    @property
    def entries(self) -> list[Entry]:
        return _loaded(self.raw)


def _opened(uri: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "", 1))


def entries(uri: str) -> Iterator[Entry]:
    """All files below a folder, but those whose name, or a folder's, begins with _ or a dot, as they are found."""
    import pyarrow.fs as fs

    system, root = _opened(uri)
    root = root.rstrip("/")
    if isinstance(system, fs.LocalFileSystem):
        yield from _local(root, "")
        return
    for x in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        path = x.path[len(root) + 1 :]
        if x.type == fs.FileType.File and not any(p[:1] in "_." for p in path.split("/")):
            yield Entry(path, x.size or 0, x.mtime_ns or 0)


def _local(root: str, below: str) -> Iterator[Entry]:
    folders = []
    try:
        with os.scandir(f"{root}/{below}") as found:
            for x in found:
                if x.name[:1] in "_.":
                    continue
                if x.is_dir():
                    folders.append(f"{below}{x.name}/")
                elif x.is_file():
                    try:
                        at = x.stat()
                    except FileNotFoundError:  # moved or deleted since
                        continue
                    yield Entry(below + x.name, at.st_size, at.st_mtime_ns)
    except FileNotFoundError:
        return
    for folder in folders:
        yield from _local(root, folder)


def in_order(some: Iterable[Entry], key: Callable[[Entry], object]) -> Iterator[Entry]:
    """Sorted, ``RUN`` at a time: where there are more, sorted runs wait in temporary files and are merged as they are read."""
    import heapq
    import tempfile

    def waiting(f) -> Iterator[Entry]:
        with f:
            f.seek(0)
            while size := f.read(4):
                yield from _loaded(f.read(int.from_bytes(size, "big")))

    some, runs = iter(some), []
    while run := sorted(islice(some, RUN), key=key):
        if not runs and len(run) < RUN:
            return iter(run)
        f = tempfile.TemporaryFile()
        for at in range(0, len(run), CHUNK):
            raw = _dumped(run[at : at + CHUNK])
            f.write(len(raw).to_bytes(4, "big") + raw)
        runs.append(waiting(f))
    return heapq.merge(*runs, key=key)


def packed(some: Iterable[Entry], limit: int) -> list[Files]:
    """Runs of files of about so many bytes."""
    out, own, have = [], [], 0
    for e in some:
        cost = e.size + OPEN_COST
        if own and have + cost > limit:
            out.append(Files(own))
            own, have = [], 0
        own.append(e)
        have += cost
    return [*out, Files(own)] if own else out


class _Reader:
    """What batch and stream readers share: options, and a partition's rows as Arrow batches."""

    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        unknown = set(self.names) - {c.split()[0] for c in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        self.uri = options.get("path")
        if not self.uri:
            raise ValueError("a path is needed")
        flag = lambda name: options.get(name, "false").lower() == "true"
        self.last_sheet_only, self.markdown_as_html = flag("lastSheetOnly"), flag("markdownAsHtml")
        self.limit = int(options.get("partitionBytes", PARTITION_BYTES))
        self.settle, self.per_batch = float(options.get("settleSeconds", SETTLE)), int(options.get("filesPerBatch", 0))

    def _type(self, name: str) -> pa.DataType:
        return {"size": pa.int64(), "modified": pa.timestamp("us", "UTC"), "content": pa.binary()}.get(name, pa.string())

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        rows, have = [], 0
        for e in partition.entries if partition else ():  # a folder without files is one partition without entries
            row = self._row(e)
            rows.append(row)
            have += len(row["content"] or b"") + len(row["text"] or "")
            if have > BATCH_BYTES:
                yield self._batch(rows)
                rows, have = [], 0
        if rows:
            yield self._batch(rows)

    def _row(self, e: Entry) -> dict:
        row = {"path": e.path, "kind": e.kind, "size": e.size, "modified": e.modified // 1000, "content": None, "text": None, "error": None}
        if {"content", "text", "error"} & set(self.names):
            try:
                system, root = _opened(self.uri)
                with system.open_input_stream(f"{root.rstrip('/')}/{e.path}") as f:
                    row["content"] = f.read()
            except OSError as x:
                row["error"] = f"{type(x).__name__}: {x}"
                return row
            if {"text", "error"} & set(self.names):
                from quarry.sources.files import file_text

                row["text"], row["error"] = file_text(e.path, row["content"], self.last_sheet_only, self.markdown_as_html)
            if "content" not in self.names:
                row["content"] = None
        return row

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], self._type(c)) for c in self.names], self.names)


class FolderReader(_Reader, DataSourceReader):
    def __init__(self, schema, options):
        super().__init__(schema, options)
        self.tests: list = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute in (("kind",), ("path",)):
                self.tests.append(f)
            else:
                yield f

    def _passes(self, e: Entry) -> bool:
        for f in self.tests:
            x = getattr(e, f.attribute[0])
            ok = x == f.value if isinstance(f, EqualTo) else x in f.value if isinstance(f, In) else x.startswith(f.value) if isinstance(f, StringStartsWith) else x.endswith(f.value)
            if not ok:
                return False
        return True

    def partitions(self) -> list[Files]:
        return packed(in_order((e for e in entries(self.uri) if self._passes(e)), lambda e: e.path), self.limit)


class FolderStreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    @staticmethod
    def _place(offset: dict) -> tuple[int, str]:
        return int(offset["modified"]), offset["path"]

    @staticmethod
    def _at_place(e: Entry) -> tuple[int, str]:
        return e.modified, e.path

    def _between(self, start: tuple[int, str], passes: Callable[[Entry], bool]) -> Iterator[Entry]:
        return in_order((e for e in entries(self.uri) if start < self._at_place(e) and passes(e)), self._at_place)

    def latestOffset(self) -> dict:
        import time

        before = getattr(self, "_at", (-1, ""))
        waiting = getattr(self, "_waiting", iter(()))
        first = next(waiting, None)
        if first is None or self._at_place(first) <= before:
            rest = time.time_ns() - int(self.settle * 1e9)
            waiting = self._between(before, lambda e: e.modified <= rest)
            first = next(waiting, None)
        # what a batch leaves is taken by the next ones, without another listing
        self._waiting = waiting
        if first is not None:
            last = first

            def some() -> Iterator[Entry]:
                nonlocal last
                yield first
                for last in islice(waiting, self.per_batch - 1 if self.per_batch else None):
                    yield last

            files = packed(some(), self.limit)
            self._at = self._at_place(last)
            self._taken = before, self._at, files
        at = getattr(self, "_at", before)
        return {"modified": at[0], "path": at[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        lo, hi = self._place(start), self._place(end)
        # after a restart the order goes on from what the checkpoint says
        self._at = max(getattr(self, "_at", (-1, "")), hi)
        before, at, files = getattr(self, "_taken", (None, None, []))
        return files if (lo, hi) == (before, at) else packed(self._between(lo, lambda e: self._at_place(e) <= hi), self.limit)

    def commit(self, end: dict) -> None:
        self._at = max(getattr(self, "_at", (-1, "")), self._place(end))


@dataclass
class Written(WriterCommitMessage):
    files: int


class FolderWriter(DataSourceWriter):
    """Writes rows of path and content as files; each is written under another name and renamed, so a task that is tried again ends with the same files."""

    def __init__(self, schema, options):
        names = [f.name for f in schema.fields]
        if sorted(names) != ["content", "path"]:
            raise ValueError("rows of path and content are needed")
        self.uri = options["path"]

    def write(self, rows) -> Written:
        system, root = _opened(self.uri)
        root = root.rstrip("/")
        n = 0
        for r in rows:
            if r["path"] is None:
                raise ValueError("a file without a path")
            parts = r["path"].split("/")
            if ".." in parts or not parts[-1]:
                raise ValueError(f"not a file below the folder: {r['path']}")
            folder = "/".join([root, *(p for p in parts[:-1] if p)])
            system.create_dir(folder, recursive=True)
            private = f"{folder}/_{uuid.uuid4().hex}"
            with system.open_output_stream(private) as out:
                out.write(bytes(r["content"] or b""))
            system.move(private, f"{folder}/{parts[-1]}")
            n += 1
        return Written(n)

    def abort(self, messages) -> None:
        """Whole files stay: writing them again gives the same ones."""


class Folder(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(schema, self.options)

    def streamReader(self, schema) -> FolderStreamReader:
        return FolderStreamReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Folder)

"""Requests sent once each: a Spark data sink with a journal in a shared folder.

``post`` names every request by a hash (of a column of ids, or of the whole request: equal requests are one),
deals requests over tasks by that hash, so that a repeated task or a repeated job gets the
same ones, and writes them with ``format("quarry_rest")``.  A task journals in groups of ``group``:
first the names that it is about to send, then, once all have gone, what came back.  An attempt begins by
reading its part of the journal: what is noted as done isn't sent again; what was about to be sent and isn't
noted is uncertain, as is a call that ended in an error, and goes only if the transport's
``happened`` denies it.  A transport without ``happened`` must take the name as an idempotency key.

Calls that raise or return 429 or 500 and more are tried ``attempts`` times, with pauses that double; other
statuses of 400 and more, and the last failure, fail the task.  ``rate`` bounds calls a second over all
tasks.  The journal stays when a job fails, and a job with the same journal goes on from it.

Null requests are left out; an empty table sends nothing.  Two attempts of a task at the same time would both send, so
``post`` refuses a session with speculation.
"""

from __future__ import annotations

import base64
import json
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quarry.sources.folder import _opened
from quarry.sources.rest import RequestFailed

NAME = "quarry_rest"
GROUP, ATTEMPTS, PAUSE = 100, 5, 0.5
#: Statuses after which a call is tried again, beside 500 and more.
AGAIN = (408, 425, 429)


def request_name(column: str = "request", request_id: Column | None = None) -> Column:
    """A hash that stands for a request."""
    q = F.col(f"`{column}`")
    if request_id is not None:
        return F.sha2(request_id.cast("string"), 256)
    body = F.coalesce(q["body"], F.lit(""))
    file = F.coalesce(F.concat(q["file"]["name"], F.lit("\n"), F.sha2(q["file"]["content"], 256)), F.lit(""))
    # sizes keep fields apart
    return F.sha2(F.concat_ws("\n", q["method"], q["path"], F.length(body).cast("string"), body, file), 256)


class Journal:
    """One part's names: those that were about to be sent, and those done with their status."""

    def __init__(self, uri: str, part: int):
        self.system, root = _opened(uri)
        self.root = f"{root.rstrip('/')}/part-{part:06d}"
        self.system.create_dir(self.root, recursive=True)
        self.meant, self.done = set(), {}
        import pyarrow.fs as fs

        for x in self.system.get_file_info(fs.FileSelector(self.root)):
            name = x.base_name
            if name.startswith(("meant-", "done-")):
                with self.system.open_input_stream(x.path) as f:
                    rows = [json.loads(line) for line in f.read().decode().splitlines()]
                if name.startswith("meant-"):
                    self.meant |= {r["name"] for r in rows}
                else:
                    self.done |= {r["name"]: r["status"] for r in rows}

    def note(self, kind: str, rows: list[dict]) -> None:
        private = f"{self.root}/_{uuid.uuid4().hex}"
        with self.system.open_output_stream(private) as out:
            out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        self.system.move(private, f"{self.root}/{kind}-{uuid.uuid4().hex}.json")


@dataclass
class Sent(WriterCommitMessage):
    calls: int
    skipped: int


class Caller:
    """Sends a part's requests through a transport, each once."""

    def __init__(self, transport: Callable, journal: Journal, group: int = GROUP, attempts: int = ATTEMPTS, pause: float = PAUSE, gap: float = 0.0):
        self.transport, self.journal = transport, journal
        self.group, self.attempts, self.pause, self.gap = group, attempts, pause, gap
        self.calls, self.skipped, self.next = 0, 0, 0.0

    def run(self, requests) -> None:
        seen, some = set(), []
        for r in requests:
            if r["method"] is None or r["name"] in seen:
                continue
            seen.add(r["name"])
            if r["name"] in self.journal.done:
                self.skipped += 1
                continue
            some.append(r)
            if len(some) == self.group:
                self._send(some)
                some = []
        if some:
            self._send(some)

    def _send(self, some) -> None:
        self.journal.note("meant", [{"name": r["name"]} for r in some])
        done = []
        try:
            for r in some:
                done.append({"name": r["name"], "status": self._call(r, r["name"] in self.journal.meant)})
        finally:
            if done:
                self.journal.note("done", done)

    def _happened(self, args) -> bool:
        ask = getattr(self.transport, "happened", None)
        return bool(ask(*args)) if ask else False

    def _call(self, r, uncertain: bool) -> int:
        file = (r["file"]["name"], bytes(r["file"]["content"] or b"")) if r["file"] else None
        args = r["method"], r["path"], r["body"], file, r["name"]
        for k in range(self.attempts):
            if uncertain and self._happened(args):
                self.skipped += 1
                return 200
            if k:
                time.sleep(self.pause * 2 ** (k - 1) * random.uniform(0.5, 1))
            now = time.monotonic()
            if now < self.next:
                time.sleep(self.next - now)
            self.next = max(now, self.next) + self.gap
            try:
                self.calls += 1
                status = self.transport(*args)
            except Exception as e:  # a broken connection says nothing about the effect
                if k + 1 == self.attempts:
                    if self._happened(args):
                        return 200
                    raise RequestFailed(f"{r['method']} {r['path']}: {type(e).__name__}: {e}") from e
                uncertain = True
                continue
            if status < 400:
                return status
            if status < 500 and status not in AGAIN:
                raise RequestFailed(f"{r['method']} {r['path']}: {status}")
            uncertain = True
        if self._happened(args):
            return 200
        raise RequestFailed(f"{r['method']} {r['path']}: {status} after {self.attempts} attempts")


class RestWriter(DataSourceWriter):
    def __init__(self, options):
        self.options = dict(options)

    def write(self, rows) -> Sent:
        o = self.options
        transport = cloudpickle.loads(base64.b64decode(o["transport"]))
        journal = Journal(o["journal"], TaskContext.get().partitionId())
        rate, parts = float(o.get("rate", 0)), int(o.get("parts", 1))
        caller = Caller(transport, journal, int(o.get("group", GROUP)), int(o.get("attempts", ATTEMPTS)), float(o.get("pause", PAUSE)), parts / rate if rate else 0.0)
        caller.run(rows)
        return Sent(caller.calls, caller.skipped)

    def commit(self, messages) -> None:
        system, root = _opened(self.options["journal"])
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root.rstrip('/')}/committed-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps({"calls": sum(m.calls for m in messages if m), "skipped": sum(m.skipped for m in messages if m)}).encode())

    def abort(self, messages) -> None:
        """The journal stays: the next job with it goes on from what was done."""


class Rest(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> RestWriter:
        return RestWriter(self.options)


def post(requests: DataFrame, transport: Callable[[str, str, str | None, tuple[str, bytes] | None, str], int], journal: str, column: str = "request", request_id: Column | None = None, parts: int = 8, group: int = GROUP, attempts: int = ATTEMPTS, pause: float = PAUSE, rate: float = 0.0) -> None:
    """Send each request once by ``transport(method, path, body, file, name)``.

    ``journal`` is a folder that all executors share; a later call with the same folder and number of parts goes on from it.
    """
    spark: SparkSession = requests.sparkSession
    if spark.conf.get("spark.speculation", "false").lower() == "true":
        raise ValueError("with spark.speculation a request may be sent twice at once")
    spark.dataSource.register(Rest)
    q = F.col(f"`{column}`")
    rows = requests.filter(q.isNotNull()).select(request_name(column, request_id).alias("name"), *[q[c].alias(c) for c in ("method", "path", "body", "file")])
    rows = rows.repartition(parts, "name")
    packed = base64.b64encode(cloudpickle.dumps(transport)).decode()
    rows.write.format(NAME).mode("append").options(transport=packed, journal=journal, group=group, attempts=attempts, pause=pause, rate=rate, parts=parts).save()


def journaled(spark: SparkSession, journal: str) -> DataFrame:
    """name, status of all requests that are noted as done."""
    return spark.read.schema("name string, status int").json(f"{journal}/part-*/done-*.json").groupBy("name").agg(F.max("status").alias("status"))

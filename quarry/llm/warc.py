"""WARC 1.1 archives: writing with payload deduplication, reading by boundary-chain verification.

Writing: one record per row, in DataFrame functions; Spark's committer publishes
the files, so a repeated task leaves no part of a file.  Of records with equal
payloads of ``least`` bytes or more, that with the smallest id is a response and
the others are revisits that name it and carry no payload.

Reading: files are cut into blocks.  A task finds each place in its block that
looks like a record's start, reads the header there and notes the record's
successor; within the block it follows these to the first offset past the block.
Pointer jumping from each file's start over these steps keeps the entries that
the chain of records really reaches, in a number of rounds that grows with the
logarithm of the blocks of a file.  Magic inside payloads is never reached.

Edge cases: a null payload is empty; equal ids with equal payloads are both
responses; a row with a null id is a revisit where its payload has a record with
an id, and its id is read back as null; control characters in a URL are dropped;
an empty table gives no records; a broken chain raises ``ValueError``; further
columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import discard, n_parts, open_fs, saved, shared_dir, whole_ids

MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", re.I)
BLOCK = 16 << 20
HEAD = 1 << 16
#: Rows of about 80 bytes up to which the table of repeated payloads is broadcast.
SMALL = 250_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_warc(pages: DataFrame, path: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, date: str = "1970-01-01T00:00:00Z") -> str:
    """Write the archive folder and return its name."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    p = pages.select(whole_ids(pages, key).alias("id"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\x00-\x20\x7F]", "").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("body"))
    digest, size = F.sha2("body", 256), F.octet_length("body")
    first = p.filter(size >= least).select(digest.alias("digest"), "id").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    first = saved(first, "payloads")
    p = p.withColumn("digest", digest).withColumn("size", size)
    p = p.join(F.broadcast(first) if first.count() <= SMALL else first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    p = p.withColumn("revisit", revisit).withColumn("http", http)
    named = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), named(F.col("id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("url"),
        F.when(F.col("revisit"), F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), named(F.col("first")))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("size"))).cast("string"),
        F.lit("\r\n\r\n"), F.col("http"),
    )
    record = F.concat(head.cast("binary"), F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("body")))
    # the end of a record is the end of a line of the text writer, so its files are archives as they stand
    p.select(record.cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)
    return path


class _Reader:
    """Bytes of one file by offset."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()

    def at(self, offset: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - offset)), offset)

    def record(self, offset: int, held: bytes = b"") -> tuple[bytes, int, int] | None:
        """(header, start of the block, offset of the next record) of a record's start, or None."""
        n = HEAD
        raw = held[: n * 4] if held.find(b"\r\n\r\n", 0, n * 4) >= 0 else self.at(offset, n)
        if not MAGIC.match(raw):
            return None
        while (end := raw.find(b"\r\n\r\n")) < 0:
            if offset + len(raw) >= self.size:
                return None
            n *= 4
            raw = self.at(offset, n)
        head = raw[: end + 2]
        found = LENGTH.search(head)
        if not found:
            return None
        start = offset + end + 4
        return head, start, start + int(found[1]) + 4


def _scan(it):
    for batch in it:
        for path, size, lo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            r = _Reader(path)
            hi = min(lo + BLOCK, size)
            raw = r.at(lo, BLOCK + HEAD)
            nxt = {}
            for m in MAGIC.finditer(raw):
                if lo + m.start() < hi and (x := r.record(lo + m.start(), raw[m.start() : m.start() + HEAD])):
                    nxt[lo + m.start()] = x[2]
            leaves: dict[int, int] = {}
            for off in sorted(nxt, reverse=True):
                to = nxt[off]
                leaves[off] = to if to >= hi else leaves.get(to, -1)
            r.file.close()
            yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(leaves), pa.string()), "off": pa.array(leaves.keys(), pa.int64()), "leave": pa.array(leaves.values(), pa.int64())})


def record_entries(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, lo, entry) of each block of each file that a record starts in; entry is the first such record."""
    files = saved(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("path", F.col("length").alias("size")), "files")
    blocks = files.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(BLOCK).cast("long"))))
    n = blocks.count()
    if n:
        blocks = blocks.repartition(min(n, 4 * n_parts(spark, 0)), "path", "lo")
    # candidates in blocks that nothing but a false start leads to take part, and are not reached
    found = saved(blocks.mapInArrow(_scan, "path string, off long, leave long"), "candidates")
    steps = saved(found.join(files, "path").filter("leave >= 0 AND leave < size").join(found.select("path", F.col("leave").alias("off")).distinct().unionByName(files.select("path", F.lit(0).cast("long").alias("off"))), ["path", "off"], "left_semi").select("path", "off", "leave"), "steps")
    discard(found)
    reached = saved(files.select("path", F.lit(0).cast("long").alias("off")), "reached")
    have = reached.count()
    while True:
        on = steps.join(reached, ["path", "off"], "left_semi").select("path", F.col("leave").alias("off"))
        old, reached = reached, saved(reached.unionByName(on).distinct(), "reached")
        discard(old)
        before, have = have, reached.count()
        if have == before:
            break
        ahead = steps.select("path", F.col("off").alias("leave"), F.col("leave").alias("then"))
        old, steps = steps, saved(steps.join(ahead, ["path", "leave"]).select("path", "off", F.col("then").alias("leave")), "steps")
        discard(old)
    # after k rounds the first 2**k entries of each chain are reached
    return reached.join(files, "path").select("path", "size", (F.col("off") - F.col("off") % BLOCK).alias("lo"), F.col("off").alias("entry"))


def _read(it):
    for batch in it:
        for path, size, lo, entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            r, off, hi = _Reader(path), entry, min(lo + BLOCK, size)
            held = r.at(lo, BLOCK + HEAD)
            rows, n = [], 0
            while off < hi:
                got = r.record(off, held[off - lo : off - lo + HEAD])
                if not got or got[2] > size:
                    raise ValueError(f"{path}: no whole record at {off}")
                head, start, end = got
                block = held[start - lo : end - 4 - lo] if end - lo <= len(held) else r.at(start, end - 4 - start)
                fields = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if v]
                rows.append((path, off, dict(fields), block))
                n += len(block)
                off = end
                if n > 4 << 20:
                    yield _records(rows)
                    rows, n = [], 0
            r.file.close()
            yield _records(rows)


def _records(rows):
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_pydict({"path": pa.array(cols[0], pa.string()), "offset": pa.array(cols[1], pa.int64()), "fields": pa.array([list(x.items()) for x in cols[2]], pa.map_(pa.string(), pa.string())), "block": pa.array(cols[3], pa.binary())})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """path, offset, fields (names in lower case), block: every record of the archives."""
    entries = saved(record_entries(spark, path), "entries")
    n = entries.count()
    if n:
        entries = entries.repartition(min(n, 4 * n_parts(spark, 0)), "path", "lo")
    return entries.mapInArrow(_read, "path string, offset long, fields map<string,string>, block binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload (null for a revisit), payload_bytes and payload_digest of the full payload."""
    r = read_records(spark, path)
    number = lambda name: F.try_element_at(F.col("fields"), F.lit(name))
    of = lambda name: F.expr(f"try_cast(regexp_extract(fields['{name}'], '^<urn:record:(.*)>$', 1) AS bigint)")
    kind = number("warc-type")
    at = F.expr("position('\r\n\r\n' IN CAST(block AS string))")
    # the header is ASCII, so its length in characters is that in bytes
    r = r.withColumn("at", at).withColumn("http", F.substring(F.col("block").cast("string"), F.lit(1), F.col("at")))
    body = F.expr("substring(block, at + 4)")
    r = r.select(of("warc-record-id").alias("page_id"), number("warc-target-uri").alias("url"), kind.alias("record_type"), F.when(kind == "revisit", of("warc-refers-to")).alias("refers_to"), F.when(kind == "response", body).alias("payload"), F.expr("CAST(regexp_extract(http, '(?i)\\r\\ncontent-length:[ \\t]*([0-9]+)', 1) AS bigint)").alias("stated_bytes"), F.regexp_replace(number("warc-payload-digest"), "^sha256:", "").alias("stated_digest"))
    return r.withColumn("payload_bytes", F.coalesce(F.octet_length("payload").cast("long"), "stated_bytes")).withColumn("payload_digest", F.coalesce(F.sha2("payload", 256), "stated_digest"))

"""The folder data source: pruning, packing, bad files, streams."""

import os
import time

import pytest
from pyspark.sql import functions as F
from quarry.operators.html import extract_html
from quarry.sources import folder

SF = "/root/testdata/sf0.001"


@pytest.fixture
def at(spark, tmp_path):
    folder.register(spark)
    for path, content in {"a/x.html": b"<html><head><title>t</title></head><body><h1>H</h1><p>some words</p></body></html>", "a/b/y.MD": b"# y\n\ntext", "bad.xlsx": b"no zip", "plain": b"z", "none.html": b"", "_hidden/x.html": b"q", "a/.x.md": b"q"}.items():
        os.makedirs(os.path.dirname(tmp_path / path), exist_ok=True)
        (tmp_path / path).write_bytes(content)
    return str(tmp_path)


def load(spark, at, schema=None, **options):
    r = spark.read.format(folder.NAME).options(**options)
    return (r.schema(schema) if schema else r).load(at)


def test_rows(spark, at):
    got = {r.path: r for r in load(spark, at).collect()}
    assert sorted(got) == ["a/b/y.MD", "a/x.html", "bad.xlsx", "none.html", "plain"]
    assert (got["a/b/y.MD"].kind, got["a/b/y.MD"].text, got["a/b/y.MD"].error) == ("md", "# y\n\ntext", None)
    assert got["bad.xlsx"].text is None and "BadZipFile" in got["bad.xlsx"].error
    assert (got["plain"].kind, got["plain"].error) == ("", "no reader for .plain")
    assert got["none.html"].size == 0 and bytes(got["plain"].content) == b"z"
    assert abs(got["plain"].modified.timestamp() - time.time()) < 86400 * 2
    assert load(spark, at + "/nothing").count() == 0
    with pytest.raises(Exception, match="no such columns"):
        load(spark, at, "path string, other string").collect()


def test_only_what_is_asked_for(spark, at, monkeypatch):
    made = []
    monkeypatch.setattr(folder, "_opened", lambda uri, f=folder._opened: made.append(uri) or f(uri))
    reader = folder.FolderReader(spark.createDataFrame([], "path string, size long").schema, {"path": at})
    parts = reader.partitions()
    assert sum(len(p.entries) for p in parts) == 5 and len(made) == 1
    assert [b.schema.names for p in parts for b in reader.read(p)] == [["path", "size"]] and len(made) == 1


def test_filters_reach_the_planner(spark, at):
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    reader = folder.FolderReader(spark.createDataFrame([], "path string, kind string").schema, {"path": at})
    left = list(reader.pushFilters([EqualTo(("kind",), "html"), GreaterThan(("size",), 3), StringStartsWith(("path",), "a/")]))
    assert left == [GreaterThan(("size",), 3)]
    assert [e.path for p in reader.partitions() for e in p.entries] == ["a/x.html"]
    df = load(spark, at).filter("kind IN ('html', 'md') AND size > 0").select("path")
    assert sorted(r.path for r in df.collect()) == ["a/b/y.MD", "a/x.html"]


@pytest.mark.parametrize("sizes,limit", [([], 10), ([5] * 20, 3 * (5 + folder.OPEN_COST)), ([1, 10**9, 1], 10**6)])
def test_packing(sizes, limit):
    some = [folder.Entry(f"{k:03d}", n, 0) for k, n in enumerate(sizes)]
    parts = folder.packed(some, limit)
    assert [e for p in parts for e in p.entries] == some
    assert all(len(p.entries) == 1 or sum(e.size + folder.OPEN_COST for e in p.entries) <= limit for p in parts)
    assert len(parts) <= len(sizes)


def test_pages_as_files_give_the_documents_of_the_table(spark, tmp_path):
    folder.register(spark)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    at = str(tmp_path / "pages")
    files = pages.select(F.format_string("%d.html", "page_id").alias("path"), F.encode("html", "UTF-8").alias("content"))
    for _ in range(2):  # writing again ends with the same files
        files.write.format(folder.NAME).mode("append").save(at)
    read = load(spark, at, "path string, text string").select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("page_id"), F.col("text").alias("html"))
    show = lambda d: sorted(repr((r.page_id, r.ord, r.titles, r.content_type, r.page_content)) for r in extract_html(d).collect())
    assert show(read) == show(pages.select("page_id", "html"))
    with pytest.raises(Exception, match="not a file below"):
        spark.createDataFrame([("../x", b"")], "path string, content binary").write.format(folder.NAME).mode("append").save(at)


def test_stream(spark, tmp_path):
    folder.register(spark)
    at, out = tmp_path / "in", str(tmp_path / "out")
    at.mkdir()
    now = time.time() - 200

    def put(name, age, text):
        (at / name).write_text(text)
        os.utime(at / name, (now + age, now + age))

    def run(**options):
        rows = spark.readStream.format(folder.NAME).schema("path string, text string").options(settleSeconds="60", **options).load(str(at))
        q = rows.withColumn("batch", F.lit(1)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).start(out)
        q.processAllAvailable()
        n = len([p for p in q.recentProgress if p.numInputRows])
        q.stop()
        return n

    for k in range(6):
        put(f"{k}.md", k // 2, f"text {k}")
    (at / "fresh.md").write_text("too new")
    assert run(filesPerBatch="2") == 3
    put("9.md", 20, "text 9")
    put("0.md", 21, "changed")
    run()
    got = sorted((r.path, r.text) for r in spark.read.parquet(out).collect())
    assert got == sorted([(f"{k}.md", f"text {k}") for k in range(6)] + [("9.md", "text 9"), ("0.md", "changed")])


def test_stream_of_more_files_than_a_batch_takes(spark):
    """Folders of many more files than a batch takes are read whole, also after a restart."""
    from quarry.plans import derived
    from tests import oracle

    sf = "/root/testdata/sf0.001"
    oracle.check(derived.folder_stream(spark, sf, 150), derived._FILES_SQL, sf)


def test_listings_are_held_by_runs(tmp_path, monkeypatch):
    """A listing is sorted by runs, whatever the number of files, and what the planner holds of it doesn't grow with them by much."""
    import random
    import tracemalloc

    some = [folder.Entry(f"documents/{k}.md", k % 7, (k * 31) % 1_000) for k in range(30_000)]
    random.Random(1).shuffle(some)
    place = lambda e: (e.modified, e.path)
    for run, chunk in ((100_000, 1_000), (30_000, 1_000), (1_700, 90), (10_000, 3)):
        monkeypatch.setattr(folder, "RUN", run)
        monkeypatch.setattr(folder, "CHUNK", chunk)
        assert list(folder.in_order(some, place)) == sorted(some, key=place)
        assert list(folder.in_order(some[:0], place)) == []
    monkeypatch.setattr(folder, "RUN", 1_000)
    monkeypatch.setattr(folder, "CHUNK", 100)
    monkeypatch.setattr(folder, "entries", lambda uri: (folder.Entry(f"documents/{k}.md", 2_000, 10**18 + k * 7_919 % 60_000) for k in range(60_000)))
    reader = folder.FolderStreamReader.__new__(folder.FolderStreamReader)
    reader.uri, reader.settle, reader.per_batch, reader.limit = "/x", 0.0, 1_000, folder.PARTITION_BYTES
    tracemalloc.start()
    at, n = reader.initialOffset(), 0
    while (end := reader.latestOffset()) != at:
        assert reader.partitions(at, end) is reader.partitions(at, end)
        n += sum(len(p.entries) for p in reader.partitions(at, end))
        again = folder.packed(reader._between(reader._place(at), lambda e, hi=reader._place(end): place(e) <= hi), reader.limit) if n < 3_000 else None
        assert again is None or [p.entries for p in again] == [p.entries for p in reader.partitions(at, end)]
        reader.commit(end)
        at = end
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and peak < 60_000 * 60


def test_listing_of_local_folders(tmp_path):
    """What pyarrow lists: files behind links too, none that is hidden, broken or no file, nothing of a folder that isn't there."""
    import pyarrow.fs as fs

    for p in ("a/b/c.md", "a/_h/x.md", "a/.h/x.md", "_x.md", "z.md", "ö/ä ü.md"):
        os.makedirs(os.path.dirname(tmp_path / "r" / p), exist_ok=True)
        (tmp_path / "r" / p).write_text(p)
    (tmp_path / "other").mkdir()
    (tmp_path / "other/o.md").write_text("o")
    os.symlink(tmp_path / "other", tmp_path / "r/linked")
    os.symlink(tmp_path / "r/z.md", tmp_path / "r/file")
    os.symlink(tmp_path / "nothing", tmp_path / "r/broken")
    os.mkfifo(tmp_path / "r/pipe")
    root = str(tmp_path / "r")
    found = fs.LocalFileSystem().get_file_info(fs.FileSelector(root, recursive=True))
    want = [folder.Entry(x.path[len(root) + 1 :], x.size, x.mtime_ns) for x in found if x.type == fs.FileType.File]
    want = sorted((e for e in want if not any(p[:1] in "_." for p in e.path.split("/"))), key=lambda e: e.path)
    for uri in (root, root + "/", "file://" + root):
        assert sorted(folder.entries(uri), key=lambda e: e.path) == want
    assert [e.path for e in want if "/" not in e.path] == ["file", "z.md"]
    assert list(folder.entries(root + "/none")) == []

"""Where operators keep what they cut lineage with: the folder that all nodes share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
#: Folders made in this process and not yet deleted, in order.
_MADE: list[str] = []
#: The folder that a written table is read from.
_FOLDERS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _hadoop(spark: SparkSession, path: str):
    """The file system that a path belongs to, by default the cluster's, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; in local mode without that setting, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quarry-"))
    fs, p = _hadoop(spark, base)
    path = f"{fs.makeQualified(p).toString().rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)
    if path in _MADE:
        _MADE.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete what ``saved`` wrote for these tables, which nothing reads any more."""
    for t in tables:
        if path := _FOLDERS.pop(t, None):
            _delete(t.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession):
    """What is written to the shared folder inside goes at the end; a result must be written elsewhere by then."""
    before = set(_MADE)
    try:
        yield
    finally:
        for path in [p for p in _MADE if p not in before]:
            _delete(spark, path)


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what a lost executor held need not be made again."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def open_fs(uri: str):
    """The file system of a URI or path and the path in it, for the Python tasks that write or read file bytes."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(uri.replace("file:///", "/").replace("file:/", "/"))


def publish(uri: str, name: str, write) -> int:
    """``write(stream)`` into a private file, then rename it: a repeated or speculative task ends with the same file."""
    system, path = open_fs(uri)
    system.create_dir(path, recursive=True)
    private, final = f"{path}/_{uuid.uuid4().hex}.tmp", f"{path}/{name}"
    with system.open_output_stream(private) as out:
        write(out)
    size = system.get_file_info(private).size
    system.move(private, final)
    return size


def whole_ids(df: DataFrame, key: str) -> Column:
    """A key of whole numbers as longs; any other type is refused before a job runs."""
    kind = dict(df.dtypes).get(key)
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"the key {key} must be a column of whole numbers: {'there is none of that name' if kind is None else f'it is {kind}'}")
    return F.col(f"`{key}`").cast("long")


#: Rows of an id or two (8 to 16 bytes) up to which a table is broadcast: 16 MB.
SMALL_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is null or not among ``ids``; these are counted, and broadcast only where they are few."""
    ids = saved(ids, "ids")
    if ids.count() <= SMALL_IDS:
        return docs.join(F.broadcast(ids), key, "left_anti")
    # rows without a key stay; in a shuffle they would all meet in one task
    named = F.col(key).isNotNull()
    return docs.filter(named).join(ids, key, "left_anti").unionByName(docs.filter(~named))


def n_parts(spark: SparkSession, n_bytes: float, per_part: float = 32e6) -> int:
    """Shuffle partitions for so many bytes: the session's number at least, more as the data grow."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_bytes / per_part) + 1)


#: What a Python worker remembers from task to task: of one operator at a time, for others run in the same worker.
_REMEMBERED: dict = {}


def remembered(key, make):
    if key not in _REMEMBERED:
        release()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def release() -> None:
    """Forget it and give freed memory back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    _REMEMBERED.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def lean(f):
    """A task's function that holds nothing from other operators while it runs, nor afterwards."""

    def run(it):
        release()
        yield from f(it)
        release()

    return run

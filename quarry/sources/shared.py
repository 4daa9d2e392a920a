"""Folders that the driver and all executors share, for what queries write and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's name under ``spark.checkpoint.dir``; in local mode without that setting, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quarry-"))
    p = spark._jvm.org.apache.hadoop.fs.Path(base)
    base = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    return f"{base}/{tag}-{uuid.uuid4().hex}".replace("file:///", "/").replace("file:/", "/")

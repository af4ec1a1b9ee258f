"""Tables in the folder that the cluster shares: written part-way through a job, or built once and read by many queries."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple[str, str], tuple[str, str]] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set, a local one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def folder_of(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = folder_of(spark, path)
    return fs.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    fs, target = folder_of(spark, path)
    fs.delete(target, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again: what follows does not repeat it, also when executors are lost."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, path: str) -> str:
    """A digest of the files at a path, of their sizes and times: another once the table is rewritten."""
    fs, target = folder_of(spark, path)
    files, found = fs.listFiles(target, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def once(spark: SparkSession, name: str, source: str, build: Callable[[str], None]) -> str:
    """Path of what ``build`` writes to the path that it is given.

    Built on the application's first call for ``name``, and again when the files
    at ``source`` are no longer those it was built from; removed at the end.
    """
    key, state = (spark.sparkContext.applicationId, name), state_of(spark, source)
    if _made.get(key, ("", ""))[0] != state:
        if key in _made:
            delete(spark, _made[key][1])
        path = new_path(spark, "stored")
        build(path)
        _made[key] = state, path
    return _made[key][1]


def _at_exit() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may have ended already
            delete(spark, path)


atexit.register(_at_exit)

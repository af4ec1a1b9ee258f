"""Tables written part-way through an operator, in the folder the cluster shares.

A staged table cuts lineage: when an executor is lost, only the work after the
last staged table is repeated.  The folder is ``spark.checkpoint.dir``; only
where a session has none (tests, a laptop) is a local one made.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_live: list[tuple[SparkSession, str]] = []
_kept: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is configured, a local one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str, own: bool = False) -> str:
    """A fresh path in the shared folder, removed by :func:`release` unless the caller sees to it (``own``)."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (_kept if own else _live).append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for entry in [e for e in _live if path.endswith(e[1].split(":")[-1])]:
            delete(*entry)
            _live.remove(entry)


def mark() -> int:
    """A point to which :func:`release` can go back."""
    return len(_live)


def release(since: int = 0) -> None:
    """Delete staged tables made after ``since``; call it once their readers are done."""
    while len(_live) > since:
        with contextlib.suppress(Exception):  # the session may have ended already
            delete(*_live[-1])
        _live.pop()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark can reach it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _at_exit() -> None:
    release()
    for entry in _kept:
        with contextlib.suppress(Exception):
            delete(*entry)


atexit.register(_at_exit)


def join_bounded(left: DataFrame, right: DataFrame, key: str, rows: int, bound: int = 200_000, salts: int = 32, how: str = "inner") -> DataFrame:
    """Join on ``key``: by broadcast while ``right`` has at most ``bound`` rows, else salted.

    ``rows`` is the counted size of ``right``.  Past the bound the right side is
    repeated ``salts`` times, so that one key holding a third of ``left`` is
    dealt over as many tasks.  That join is a sort-merge one: the right side's
    files say nothing of its size once repeated, and may look small enough to broadcast.
    """
    if rows <= bound:
        return left.join(F.broadcast(right), key, how)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts))
    salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.withColumn("__salt", spread).join(salted.hint("merge"), [key, "__salt"], how).drop("__salt")


#: Rows, and entries of their lists, up to which what was found is broadcast.
FOUND_ROWS, FOUND_ENTRIES = 100_000, 1_000_000


def join_found(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Texts of the documents in ``found``, on ``key``: by broadcast while few were found and their lists are short in all, else by shuffle."""
    entries = sum((F.coalesce(F.size(f.name), F.lit(0)) for f in found.schema if f.dataType.typeName() == "array"), F.lit(0))
    rows, total = found.limit(FOUND_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(entries), F.lit(0))).first()
    return texts.join(F.broadcast(found) if rows <= FOUND_ROWS and total <= FOUND_ENTRIES else found, "key")


#: Rows that make a key heavy, the heaviest keys that are dealt out anew, and the tasks over which each is dealt.
LIGHT, HEAVIEST, DEALT = 1000, 1000, 256
#: Rows of a written table within which no key is sought out.
FEW = 20_000


def heavy_keys(counts: DataFrame, keys: list[str], n: str) -> list[int]:
    """Hashes of the ``HEAVIEST`` keys with more than ``LIGHT`` rows; any other has less than a ``HEAVIEST``-th of all rows, however large the table."""
    return [r[0] for r in counts.where(F.col(n) > LIGHT).select(F.xxhash64(*keys).alias("h"), F.col(n).alias("n")).orderBy(F.desc("n"), "h").limit(HEAVIEST).collect()]


def heavy_rows(table: DataFrame, keys: list[str]) -> list[int]:
    """As :func:`heavy_keys` for a written table; one of few rows has no key that would be worth dealing out."""
    if table.limit(FEW + 1).count() <= FEW:
        return []
    return heavy_keys(table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "n")


def join_skewed(left: DataFrame, right: DataFrame, keys: list[str], heavy: list[int], how: str = "inner") -> DataFrame:
    """Inner or left join on ``keys``; rows of ``left`` with a heavy key are dealt over ``DEALT`` tasks, to each of which ``right`` sends a copy."""
    if not heavy:
        return left.join(right, keys, how)
    is_heavy = F.xxhash64(*keys).isin(heavy)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns], F.lit(1)), F.lit(DEALT))
    salted = left.withColumn("__salt", F.when(is_heavy, spread).otherwise(F.lit(0).cast("long")))
    every = F.when(is_heavy, F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return salted.join(right.withColumn("__salt", F.explode(every)), [*keys, "__salt"], how).drop("__salt")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])

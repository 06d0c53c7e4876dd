"""Intermediate tables that survive the loss of an executor."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a local session gets a temporary folder of its
    own; a cluster session must name a shared one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="seamark-")
    return _own_roots[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _dropping_shuffles(spark: SparkSession):
    """Shuffle files of the enclosed execution go as soon as it has ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and return a scan of what was written.

    Cuts the lineage: a later failure rereads files instead of recomputing.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with _dropping_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if _stack():
        _stack()[-1].append(out)
    return out


def numbered(docs: DataFrame, columns: list[Column], label: str) -> DataFrame:
    """``columns`` of ``docs`` with a number for each row in ``_row``, written once.

    A plan that is evaluated twice may deal its rows differently (a shuffle
    upstream, another number of cores under a scan), so whoever matches rows
    by number has to read them all from this table.
    """
    return materialize(docs.select(F.monotonically_increasing_id().alias("_row"), *columns), label)


_local = threading.local()


def _stack() -> list[list[DataFrame]]:
    """The open blocks of this thread: queries in two threads keep to their own tables."""
    if not hasattr(_local, "open"):
        _local.open = []
    return _local.open


@contextlib.contextmanager
def passing():
    """Tables materialized inside go when the block ends, but for those given to the function it yields."""
    own: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    stack = _stack()
    stack.append(own)
    try:
        yield keep
    finally:
        stack.pop()
        for table in own:
            if not any(table is k for k in kept):
                discard(table)
        if stack:
            stack[-1].extend(kept)


def discard(table: DataFrame) -> None:
    """Delete the files of a materialized table that nothing will read again."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Cutting lineage so that a lost executor never costs an iterative job its progress."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark frees a query's shuffle files as soon as the query has ended.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The folders that were written in the block of `only_result` about us.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    The folder is one in that which the cluster names in ``spark.checkpoint.dir``. Only where that setting is missing in
    local mode, where all share one machine, a temporary folder is used; elsewhere a missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="helixframe-checkpoint-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    """The place of a folder, not made yet, that all executors share."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to reliable checkpoint files and return a DataFrame that reads them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def _freed_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


def stored(df: DataFrame, shuffled: bool = True) -> DataFrame:
    """`cut_lineage` for many rows: they stand compressed in Parquet files, and the shuffle files that they came from are freed.

    What is read back looks as small to the planner as its files, so as a side of a join it is always shuffled, unless `shuffled` is
    false and the join says how it is made.
    """
    spark = df.sparkSession
    path = new_folder(spark, "rows")
    with _freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    if (written := _written.get()) is not None:
        written.append(path)
    held = spark.read.schema(df.schema).parquet(path)
    return never_broadcast(held) if shuffled else held


@contextmanager
def only_result(spark: SparkSession) -> Iterator[None]:
    """What is `stored` in this block is deleted at its end, so its result must not read that any more: see `settled`."""
    above, own = _written.get(), []
    token = _written.set(own)
    try:
        yield
    finally:
        _written.reset(token)
        for path in own:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if above is not None:
            above[:] = [x for x in above if x not in own]


def settled(spark: SparkSession, made, shuffled: bool = True) -> DataFrame:
    """The rows of `made()`, `stored`; what was stored on the way to them is deleted. Nothing else that is made there may read it."""
    above = _written.get()
    with only_result(spark):
        own = _written.get()
        held = stored(made(), shuffled)
        kept = own.pop()
    if above is not None:
        above.append(kept)
    return held


def never_broadcast(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that is always shuffled.

    The planner estimates the size of a generator's rows by its input, so rows of a small table that were cut into their windows
    look small enough to be sent to all tasks through the driver.
    """
    return df.hint("merge")

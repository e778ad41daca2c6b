"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import checkpoint_root, handover

# Rows and bytes of an Arrow batch. Texts can be very long, so the default of
# 10,000 rows would not bound a Python worker's memory.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    # 4,096 whole texts in one column vector are arrays of many megabytes, of which the heap keeps the most that it ever took.
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}
# With this a query removes its shuffle files when it ends. Otherwise they stay until the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _ship_package(spark: SparkSession) -> None:
    """Let the Python workers import this package, wherever the driver found it."""
    context = spark.sparkContext
    if not getattr(context, "_tidewatch_shipped", False):
        package = Path(__file__).resolve().parents[1]
        base = os.path.join(tempfile.mkdtemp(prefix="tidewatch-"), "tidewatch")
        context.addPyFile(shutil.make_archive(base, "zip", package.parent, package.name))
        context._tidewatch_shipped = True


def ready(spark: SparkSession) -> SparkSession:
    """Bound the batches that Python workers get, and give the workers this package."""
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    _ship_package(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes in it leave no shuffle files on the executors' disks. Only for writes: nothing may run the same plan again."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and safe when an executor is lost."""
    with shuffles_freed(ready(df.sparkSession)):
        return handover(df, f"llm-{name}")


def lend(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """``keep`` for a large table that nothing reads any more after some step: (table, free).

    ``free()`` writes an empty table in its place, so that later steps have its disk. Call it only
    when all that was computed from the table is written.
    """
    spark, schema = ready(df.sparkSession), df.schema
    path = f"{checkpoint_root(spark)}/llm-{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    nothing = spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    return spark.read.schema(schema).parquet(path), lambda: nothing.write.mode("overwrite").parquet(path)


def no_text(column: str | Column) -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def _give_back() -> None:
    """Return free memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A ``mapInArrow`` function that leaves no free memory behind: Spark keeps a Python worker for later tasks, also of
    other stages, and it would hold the most that any task took. Called once the task's own data are gone."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


def by_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]):
    """A ``mapInArrow`` function from one that makes the function for a batch, once in a task.

    The package must reach the workers before Spark takes the function, also if the caller read the documents without ``table``.
    """
    if (spark := SparkSession.getActiveSession()) is not None:
        ready(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None and out.num_rows:
                yield out

    return tidy(run)


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, empty for null."""
    for value in batch.column(column):
        if value.is_valid:
            yield value.as_buffer().to_pybytes()
        else:
            yield b""

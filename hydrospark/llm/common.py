"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def count_words(column: str = "text") -> Column:
    """Runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def checksum(text: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes."""
    return F.crc32(text.cast("binary")).cast("long")


def row_hash(docs: DataFrame) -> Column:
    """Hash of a row's columns (but maps, which Spark does not hash): an order of rows that no task decides on."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the text 'null'."""
    return F.pmod(checksum(F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), F.lit(parts))


def about(rows: DataFrame, key: str, n: int, most: int) -> DataFrame:
    """About ``most`` of the ``n`` rows, the same ones each time: those whose key has a low hash; all if there are no more. Nothing is sorted."""
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * most / n))


BATCH_ROWS = 1000
LOT_BYTES = 2 << 20  # of text that a task works on at once, or one row


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Arrow batches have at most BATCH_ROWS rows: a row is a whole text, and tasks hold a few batches
    at once. The session's own value comes back after it, so jobs have to run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    if not 0 < int(own) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def in_lots(batch: pa.RecordBatch, sizes: pa.Array, most: int = LOT_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of up to about ``most`` bytes, by the ``sizes`` of the rows."""
    upto = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over batches, after which the worker, which waits for other tasks, gives back what Arrow's pool and the C heap keep of freed memory."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run

"""Lots: documents in groups of bounded size that tasks ask questions about and get answers back to.

An operator that has to know what other documents hold (which windows, which phrases) goes over the same lots
several times. Each time a lot sends what it wants to know, each thing once however often it has it, to buckets
by hash; a bucket joins what lots have sent and answers the lots concerned. So a thing that is everywhere is in a
bucket once a lot, and no task holds more than a lot or a bucket, whatever the data has most of.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hydrospark.llm.common import row_hash, whole_text

LOT_BYTES = 8 << 20  # of text in a lot; a longer text is a lot of its own
ROW_BYTES = 64  # that a row counts besides its text


def lots_of(docs: DataFrame, **columns) -> tuple[DataFrame, int]:
    """(lot, columns, text) of all rows, and their bytes. Rows are dealt by a hash of all their columns, so copies of a text are spread."""
    rows = docs.select(row_hash(docs).alias("row_hash"), *[c.alias(name) for name, c in columns.items()], whole_text().alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long") + ROW_BYTES).alias("n")).first()["n"] or 0
    lots = max(1, -(-n_bytes // LOT_BYTES))
    return rows.select(F.pmod("row_hash", F.lit(lots)).cast("int").alias("lot"), *columns, "text"), n_bytes


@contextlib.contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """While it lasts, the shuffle files of a finished write go at once: what it wrote is a table, nothing reads them any more."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, own)


def asked(lots: DataFrame, ask: Callable[[pa.Table], pa.Table], schema: str, answers: DataFrame | None = None) -> DataFrame:
    """What each lot sends; ``ask`` takes its rows, and the rows of ``answers`` to it if there are any."""
    if answers is None:
        return lots.groupBy("lot").applyInArrow(lambda table: trimmed(ask, table), schema)
    return lots.groupBy("lot").cogroup(answers.groupBy("lot")).applyInArrow(lambda table, own: trimmed(ask, table, own), schema)


def met(sent: DataFrame, meet: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What buckets answer; ``meet`` takes all that lots have sent to a bucket."""
    return sent.groupBy("bucket").applyInArrow(lambda table: trimmed(meet, table), schema)


def trimmed(work: Callable, *tables: pa.Table) -> pa.Table:
    """``work`` on a group, after which the worker gives back what Arrow's pool and the C heap keep of freed memory."""
    out = work(*tables)
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
    return out


def texts_of(table: pa.Table) -> list[bytes]:
    return table.column("text").cast(pa.binary()).to_pylist()


def joined_numbers(table: pa.Table, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in all rows of a binary column, and the row of each."""
    parts = [np.frombuffer(x, kind) for x in table.column(column).to_pylist()]
    sizes = np.array([len(x) for x in parts], np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, kind)), np.repeat(np.arange(len(parts)), sizes)


def joined_flags(table: pa.Table, column: str, sizes: np.ndarray) -> np.ndarray:
    """The flags in all rows of a binary column of packed bits, ``sizes`` of them in each."""
    parts = [np.unpackbits(np.frombuffer(x, np.uint8), count=int(n)) for x, n in zip(table.column(column).to_pylist(), sizes)]
    return np.concatenate(parts).astype(bool) if parts else np.empty(0, bool)


def runs_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by the keys (the first counts most), and where in it each new value starts."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        there = key[order]
        new[1:] |= there[1:] != there[:-1]
    return order, np.flatnonzero(new)

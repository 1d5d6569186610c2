"""Exact deduplication over an extendible-hash index on shared files.

The index is keyed by a 64-bit hash of the text. A directory of 2**depth entries maps the first bits of the
hash to buckets. Where a bucket would hold more than its limit the directory doubles and the bucket splits,
as long as it can; how far it can follows from the bytes of the table. Owner tasks have ranges of buckets of about equal bytes.
An owner reads its keys in order, chains texts whose hashes collide by comparing their bytes, and writes one
entry for each distinct text. Rows look up their bucket in the directory and their entry in the bucket.

A task that reads documents first folds equal ones, by their bytes too: of a text with millions of copies an
owner gets one row for each ``FOLD_BYTES`` that a reading task has met. Owners stream their keys and hold one chain at a time.

Defined cases: a null text equals an empty one; the largest id stays, any id before a null one; of rows that
repeat both id and text one is kept, the one with the least hash of its columns; an empty table gives an empty index.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from hydrospark.llm.common import in_lots, row_hash, small_batches, tidy, whole_text
from hydrospark.plans.scratch import written

BUCKET_BYTES = 4 << 20  # an overfull bucket holds more
MOST_DEPTH = 20  # the driver gets 2**20 sums at most; full buckets chain beyond that
OWNER_BYTES = 64 << 20  # of distinct texts that an owner task reads, about
FOLD_BYTES = 16 << 20  # of distinct texts that a reading task holds at once
MOST_SENT = 1 << 17  # entries of a directory that is broadcast; a larger one is joined


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, digest, text); equal texts have equal keys."""
    text = whole_text()
    return docs.select("doc_id", F.xxhash64(text).alias("h"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))


def folded(rows: DataFrame, depth: int, entries: list[int], owners: np.ndarray) -> DataFrame:
    """(owner, bucket, h, text, n, top): equal texts of a stretch of one reading task as one row with their count and largest id."""
    schema = pa.schema([("owner", pa.int32()), ("bucket", pa.int32()), ("h", pa.int64()), ("text", pa.string()), ("n", pa.int64()), ("top", pa.int64())])
    shared = rows.sparkSession.sparkContext.broadcast((np.array(entries, np.int64), owners))

    def out(held: dict[int, list[list]]) -> pa.RecordBatch:
        entries, owners = shared.value
        h = np.array([h for h, chain in held.items() for _ in chain], np.int64)
        bucket = entries[(h.view(np.uint64) >> np.uint64(64 - depth)).astype(np.int64)] if depth else np.zeros(len(h), np.int64)
        rows = [c for chain in held.values() for c in chain]
        columns = [owners[bucket], bucket, h, *([c[i] for c in rows] for i in range(3))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list]] = {}  # of a hash the distinct texts, each with its count and largest id
        size = 0
        for batch in batches:
            for lot in in_lots(batch, pc.binary_length(batch.column(2))):
                for doc_id, h, text in zip(*(lot.column(c).to_pylist() for c in range(3))):
                    chain = held.setdefault(h, [])
                    same = next((c for c in chain if c[0] == text), None)
                    if same is None:
                        chain.append([text, 1, doc_id])
                        size += len(text) + 200
                    else:
                        same[1] += 1
                        if same[2] is None or doc_id is not None and doc_id > same[2]:
                            same[2] = doc_id
                if size > FOLD_BYTES:
                    yield out(held)
                    held, size = {}, 0
        yield out(held)

    return rows.select(F.col("doc_id").cast("long"), "h", "text").mapInArrow(tidy(fold), "owner int, bucket int, h long, text string, n long, top long")


def directory(counts: dict[int, int], limit: int, most_depth: int = MOST_DEPTH) -> tuple[int, list[int]]:
    """(depth, bucket of each directory entry) from the bytes under each prefix of ``most_depth`` bits.

    Starts with one bucket; while a bucket is overfull and prefixes are left, it splits, and the directory
    doubles if the bucket was as deep as the directory. A bucket is named by its first full-length prefix.
    """
    sums = [0] * (1 << most_depth)
    for prefix, size in counts.items():
        sums[prefix] += size
    upto = [0]
    for size in sums:
        upto.append(upto[-1] + size)
    depth, todo, leaves = 0, [(0, 0)], []
    while todo:
        first, own = todo.pop()
        width = 1 << (most_depth - own)
        if upto[first + width] - upto[first] > limit and own < most_depth:
            depth = max(depth, own + 1)
            todo += [(first, own + 1), (first + width // 2, own + 1)]
        else:
            leaves.append((first, own))
    entries = [0] * (1 << depth)
    for first, own in leaves:
        at = first >> (most_depth - depth)
        entries[at : at + (1 << (depth - own))] = [first] * (1 << (depth - own))
    return depth, entries


def planned(rows: DataFrame, bucket_bytes: int) -> tuple[int, list[int], np.ndarray, int]:
    """Depth and entries of the directory, the owner of each bucket, and the number of owners."""
    # bytes of distinct texts only, since copies fold: one row for each key, then for each prefix
    sizes = rows.groupBy("h").agg(F.max(F.octet_length("text") + 64).cast("long").alias("size"))
    sums = written(sizes.groupBy(prefix(MOST_DEPTH).alias("p")).agg(F.sum("size").alias("size")), "hash-prefixes")
    total = sums.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    # three bits more than even buckets need
    bits = min(MOST_DEPTH, max(1, (total // bucket_bytes).bit_length() + 3))
    counts = {r["p"]: r["size"] for r in sums.groupBy(F.shiftright("p", MOST_DEPTH - bits).alias("p")).agg(F.sum("size").alias("size")).collect()}
    depth, entries = directory(counts, bucket_bytes, bits)
    upto = np.zeros((1 << bits) + 1)
    for p, size in counts.items():
        upto[p + 1] = size
    upto = np.cumsum(upto)
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // OWNER_BYTES))
    # a range of buckets for each owner, by the bytes before the bucket
    return depth, entries, np.minimum(upto[:-1] * n / max(1, total), n - 1).astype(np.int32), n


def prefix(bits: int) -> Column:
    return F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)


@dataclasses.dataclass
class Index:
    """Tables on shared files: ``entries`` (bucket, h, link, digest, keep_id, group_size), one for each distinct text, and ``directory`` (p, bucket) of 2**depth prefixes."""

    entries: DataFrame
    directory: DataFrame
    depth: int


def build_index(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> Index:
    """The index of a table.

    ``link`` is the entry's place in the chain of its hash.
    """
    spark = docs.sparkSession
    rows = keyed(docs)
    depth, entries, owners, n = planned(rows, bucket_bytes)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("h", pa.int64()), ("link", pa.int32()), ("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
        chain: list[list] = []  # of the current hash: bucket, h, text, n, top
        out: list[tuple] = []

        def flushed() -> None:
            out.extend((c[0], c[1], i, hashlib.sha256(c[2].encode()).digest(), c[4], c[3]) for i, c in enumerate(chain))
            chain.clear()

        for batch in batches:
            for lot in in_lots(batch, pc.binary_length(batch.column(2))):
                for bucket, h, text, n, top in zip(*(c.to_pylist() for c in lot.columns)):
                    if chain and chain[0][1] != h:
                        flushed()
                    entry = next((c for c in chain if c[2] == text), None)
                    if entry is None:
                        chain.append([bucket, h, text, n, top])
                    else:
                        entry[3] += n
                        if top is not None and (entry[4] is None or top > entry[4]):
                            entry[4] = top
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema=schema)
                out.clear()
        flushed()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    dealt = folded(rows, depth, entries, owners).repartitionById(n, "owner").sortWithinPartitions("bucket", "h").drop("owner")
    with small_batches(spark):
        index = written(dealt.mapInArrow(tidy(own), "bucket int, h long, link int, digest binary, keep_id long, group_size long"), "hash-index")
    table = pa.table({"p": pa.array(range(len(entries)), pa.int32()), "bucket": pa.array(entries, pa.int32())})
    return Index(index, written(spark.createDataFrame(table), "hash-directory"), depth)


def looked_up(rows: DataFrame, index: Index) -> DataFrame:
    """``rows`` (h, digest) with their entry: the directory tells the bucket, the bucket has the entry."""
    small = 1 << index.depth <= MOST_SENT
    placed = rows.withColumn("p", prefix(index.depth)).join(F.broadcast(index.directory) if small else index.directory, "p").drop("p")
    return placed.join(index.entries, ["bucket", "h", "digest"])


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """For each row (doc_id, keep_id, group_size, kept, text_sha256, bucket, link); one row of a group is kept."""
    index = build_index(docs)
    rows = keyed(docs).drop("text")
    # rows that repeat an id and a text: the first of them stands for the others; spread by id, so a large group is no single task
    again = Window.partitionBy("digest", "doc_id").orderBy("h")
    found = looked_up(rows.withColumn("again", F.row_number().over(again)), index)
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("again") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "bucket", "link")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    text = whole_text()
    rows = docs.select(F.struct("*").alias("row"), row_hash(docs).alias("place"), F.xxhash64(text).alias("h"), F.unhex(F.sha2(text, 256)).alias("digest"), F.col("doc_id").cast("long").alias("id"))
    found = looked_up(rows, build_index(docs)).where(F.col("id").eqNullSafe(F.col("keep_id")))
    first = Window.partitionBy("digest", "id").orderBy("place")
    return found.select("row", F.row_number().over(first).alias("again")).where("again = 1").select("row.*")

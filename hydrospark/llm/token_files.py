"""Token ids as flat binary files with 64-bit offsets, to be memory-mapped.

A set of files holds the ids of all documents in the order of doc_id. Each partition of ids is three files in
a folder that all executors share: ``N.bin`` (unsigned integers of 16 or 32 bits, little-endian, as the
vocabulary needs), ``N.off`` (int64: where each document's ids begin within the file, and their end) and
``N.ids`` (int64: the doc_ids). A table of the partitions has for each its first document and first id in the
whole set: prefix sums over one row for each partition.

A partition's files are written under a name of their own and renamed when complete, so a repeated or lost
task leaves no half file behind and overwrites with the same content.

Defined cases: a null text is an empty one, and each document ends with the end id, so none is without ids; a
null doc_id comes first and is read back as null; rows that repeat stay, in the order of a hash of their text;
the string of a special token is that token; an empty table gives an empty set.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hydrospark.llm.bpe import joined
from hydrospark.llm.common import in_lots, small_batches, tidy, whole_text
from hydrospark.plans.scratch import new_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
ROWS_PER_PART = 5000
NO_ID = -(1 << 63)
LOT = 1000  # texts or words that the tokenizer gets in one call
CACHED_BYTES = 96 << 20  # of words and their ids that a worker keeps
ENTRY_BYTES = 200  # of a kept word beside its own and its ids' bytes

# Blanks that have white space on both sides, or begin or end a text, may belong to a longer match.
_SPACE = "\\t-\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000} "
_ODD = f"^ | $|[{_SPACE}] | [{_SPACE}]"


class Encoder:
    """The tokenizers library, asked once for each distinct word, as long as there is room to keep its ids.

    A blank between two characters that are no white space begins a new match of the byte-level pattern,
    whatever stands around it. So a text is cut before such blanks, and equal chunks have equal ids. Texts with
    other blanks are encoded whole. A special token's string in a text is that token, as the library has it.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        names = self.tokenizer.get_vocab()
        self.wide = max(names.values()) >= 1 << 16
        self.opens = np.zeros(max(names.values()) + 1, bool)  # ids whose bytes begin with a blank
        self.opens[[i for name, i in names.items() if name.startswith("Ġ")]] = True
        # a cut inside the string of a special token would hide it
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if " " in t.content]
        self.known: dict[str, bytes] = {}  # ids of a word with a blank before it, as 32-bit integers
        self.kept = 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with the end id after it, and the bounds of each text's ids."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        for special in self.specials:
            odd |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        parts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.concatenate(([0], np.cumsum(parts)))
        heads = pc.take(coded.dictionary, pa.array(codes[at[:-1]])).to_pylist()
        inner = np.ones(len(codes), bool)
        inner[at[:-1]] = False
        used, where = np.unique(codes[inner], return_inverse=True)
        distinct = {w: i for i, w in enumerate(dict.fromkeys(heads))}
        found, sizes = zip(self.words(pc.take(coded.dictionary, pa.array(used)).to_pylist()), self.wholes(list(distinct)), self.wholes(texts.filter(pa.array(odd)).to_pylist()), (np.array([END_ID], np.int32), np.ones(1, np.int64)))
        codes[inner] = where
        codes[at[:-1]] = [len(used) + distinct[w] for w in heads]
        # chunks of each text in turn, and the end id as one more
        counts = np.ones(len(texts), np.int64)
        counts[~odd] = parts
        begin = np.concatenate(([0], np.cumsum(counts + 1)))
        which = np.full(begin[-1], len(used) + len(distinct) + int(odd.sum()), np.int64)
        which[np.repeat(begin[:-1][~odd] - at[:-1], parts) + np.arange(len(codes))] = codes
        which[begin[:-1][odd]] = len(used) + len(distinct) + np.arange(int(odd.sum()))
        return joined(np.concatenate(found), np.concatenate(sizes), which, begin)

    def wholes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text, end to end, and their numbers."""
        found = [np.array(e.ids, np.int32) for a in range(0, len(texts), LOT) for e in self.tokenizer.encode_batch_fast(texts[a : a + LOT], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.int32), *found]), np.array([len(x) for x in found], np.int64)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word with a blank before it, end to end, and their numbers."""
        found = [self.known.get(w) for w in words]
        fresh = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(fresh, self.fresh([words[i] for i in fresh])):
            found[i] = ids
            if self.kept < CACHED_BYTES:
                self.known[words[i]] = ids
                self.kept += ENTRY_BYTES + len(words[i]) + len(ids)
        return np.frombuffer(b"".join(found), np.int32), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def fresh(self, words: list[str]) -> Iterator[bytes]:
        """The words of a lot are one text; only the ids that begin with a blank open a word."""
        for a in range(0, len(words), LOT):
            some = words[a : a + LOT]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(f" {w}" for w in some)], add_special_tokens=False)[0].ids, np.int32)
            opens = np.flatnonzero(self.opens[ids])
            if len(opens) == len(some):
                sizes = np.diff(np.append(opens, len(ids)))
            else:
                ids, sizes = self.wholes([f" {w}" for w in some])
            whole, ends = ids.tobytes(), (np.cumsum(sizes) * 4).tolist()
            yield from (whole[start:stop] for start, stop in zip([0, *ends], ends))


@functools.cache
def encoder(vocabulary: str) -> Encoder:
    """One for the life of a worker, which serves many tasks."""
    return Encoder(vocabulary)


def write_files(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes a set of files; returns the table of its partitions:
    (part, docs, ids, width, first_doc, start), ordered by part, all of it one row for each partition."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    parts = max(1, -(-rows.count() // ROWS_PER_PART), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        own_encoder, n_docs, n_ids = encoder(vocabulary), 0, 0
        dtype = np.dtype("<u4" if own_encoder.wide else "<u2")
        temporary = {x: f"{root}/.{part}-{own}.{x}" for x in ("bin", "off", "ids")}
        out = {x: fs.open_output_stream(p) for x, p in temporary.items()}
        out["off"].write(np.zeros(1, "<i8").tobytes())
        for some in (lot for batch in batches for lot in in_lots(batch, pc.binary_length(batch.column(1)))):
            ids, bounds = own_encoder.encode(some.column(1))
            out["bin"].write(ids.astype(dtype).tobytes())
            out["off"].write((bounds[1:] + n_ids).astype("<i8").tobytes())
            out["ids"].write(pc.fill_null(some.column(0), NO_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            n_docs += some.num_rows
            n_ids += len(ids)
        for x, f in out.items():
            f.close()
            fs.move(temporary[x], f"{root}/{part}.{x}") if n_docs else fs.delete_file(temporary[x])
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part, pa.int32()), (n_docs, pa.int64()), (n_ids, pa.int64()), (dtype.itemsize, pa.int32()))], ["part", "docs", "ids", "width"])

    # the reading task comes last, so that rows of one id, and even equal rows, may be in several parts
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash"), F.col("reader")]
    dealt = rows.withColumns({"text_hash": F.xxhash64("text"), "reader": F.spark_partition_id()}).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    # one row for each partition, so its order may be that of one task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    table = dealt.mapInArrow(tidy(write), "part int, docs long, ids long, width int").select("*", sums("docs").alias("first_doc"), sums("ids").alias("start"), F.lit(folder).alias("folder"))
    path = new_path(spark, "token-parts")
    with small_batches(spark):
        table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def open_map(uri: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped if it is a local one, else read."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    if fs.get_file_info(path).size == 0:
        return np.zeros(0, dtype)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_stream(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_files(spark: SparkSession, table: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files of ``write_files``.

    ``start`` counts the ids of all documents before it; the checksum is over 32-bit ids whatever the file has.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{row['folder']}/{row['part']}"
                ids, offsets, doc_ids = open_map(f"{name}.bin", f"<u{row['width']}"), open_map(f"{name}.off", "<i8"), np.array(open_map(f"{name}.ids", "<i8"))
                checks = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                columns = [pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(offsets[:-1] + row["start"]), pa.array(np.diff(offsets)), pa.array(checks, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = table.repartition(max(1, table.count()), "part")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

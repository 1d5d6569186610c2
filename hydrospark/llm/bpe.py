"""Byte-level BPE by the ranks of a public vocabulary: encoding and decoding.

Spark's regular expressions split a text into words. A word's bytes are folded by ranked merges: the pair of
neighbours that has the lowest rank is joined, wherever it stands, until no pair has a rank.

Two forms of the fold give the same ids. ``encode_words`` is an expression of Spark's higher-order functions
over a literal rank map, for tables of distinct words. ``encode`` and ``round_trip`` serve whole documents: a task
folds the distinct words of a lot of texts together, as rows of byte arrays, and puts the documents together from
them by array indexing. (The README has the figures for which the second form is used on documents.) ``decode``
concatenates the pieces of all ids.

A word longer than ``LONG_WORD`` bytes is folded by a heap, in n log n steps for n bytes, so a run of a million
letters is no special case. A worker keeps up to ``CACHED_BYTES`` of words that it has folded, for all its tasks.

Defined cases: a null text is an empty one, which has no ids; special tokens do not exist, their strings are
ordinary text; every byte string can be encoded, since all single bytes have a rank; equal rows stay.
"""

from __future__ import annotations

import array
import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from hydrospark.llm.common import in_lots, small_batches, tidy, whole_text
from hydrospark.plans.scratch import written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
CACHED_BYTES = 96 << 20  # of words and their ids that a worker keeps
ENTRY_BYTES = 200  # of a kept word beside its own and its ids' bytes
LONG_WORD = 64  # bytes; longer words are folded one by one
CELLS = 1 << 20  # bytes of words that are folded together
NONE = np.iinfo(np.int32).max
MAP_BUCKETS = 1 << 16


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def words(text: Column, pattern: str = PATTERN) -> Column:
    """All matches of the pattern in turn; (?U) lets white space have its Unicode meaning."""
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word of n bytes, in n log n steps: a heap of ranked pairs over a linked list of pieces."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that starts at a byte: its end, the start of the one before
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not 0 < middle < n or end[middle] != stop:
            continue  # one of the two is no longer a piece
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if i and (rank := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (rank, before[i], stop))
    return [ranks[word[i:stop]] for i, stop in enumerate(end) if stop]


class Merges:
    """Folds many distinct words at once, and keeps the ids of words that it has met while there is room.

    Words of like length are the rows of a byte array. Each turn finds each row's leftmost pair of the lowest
    rank and joins it; the pairs on both sides of it are ranked anew; rows without a ranked pair are done.
    """

    def __init__(self, vocabulary: str) -> None:
        self.ranks = read_ranks(vocabulary)
        self.known: dict[bytes, bytes] = {}  # ids of a word as 32-bit integers
        self.kept = 0
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = sorted((self.ranks[token[:i]] << 32 | self.ranks[token[i:]], rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if token[:i] in self.ranks and token[i:] in self.ranks)
        self.pairs, self.joins = (np.array(x, np.int64) for x in zip(*pairs))
        self.first = self.rank(np.repeat(self.single, 256), np.tile(self.single, 256)).reshape(256, 256)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where a pair has none; a joined pair's id is its rank."""
        pair = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.joins[at], NONE).astype(np.int32)

    def rows(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, end to end, and how many each has; ``data`` (n, width) holds their bytes, padded."""
        place = np.arange(data.shape[1], dtype=np.int16)
        ids, live = self.single[data], place < sizes[:, None]
        rank = np.full(data.shape, NONE, np.int32)
        rank[:, :-1] = np.where(live[:, 1:], self.first[data[:, :-1], data[:, 1:]], NONE)
        after, before = np.tile(place + 1, (len(data), 1)), np.tile(place - 1, (len(data), 1))
        row = np.arange(len(data))
        while len(row):
            i = rank[row].argmin(1)
            low = rank[row, i]
            some = low < NONE
            row, i, low = row[some], i[some], low[some]
            gone = after[row, i]
            right, left = after[row, gone], before[row, i]
            ids[row, i], live[row, gone], after[row, i] = low, False, right
            rank[row, gone] = rank[row, i] = NONE
            some = right < sizes[row]
            r, k, j = row[some], i[some], right[some]
            before[r, j] = k
            rank[r, k] = self.rank(low[some], ids[r, j])
            some = left >= 0
            r, k = row[some], left[some]
            rank[r, k] = self.rank(ids[r, k], low[some])
        return ids[live], live.sum(1)

    def fold_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes of 32-bit integers."""
        found = [self.known.get(w) for w in words]
        fresh = [i for i, ids in enumerate(found) if ids is None]
        size = np.array([len(words[i]) for i in fresh], np.int64)
        for i in np.flatnonzero(size > LONG_WORD):
            found[fresh[i]] = array.array("i", fold(words[fresh[i]], self.ranks)).tobytes()
        width = np.maximum(-(-size // 4) * 4, 4)
        for w in np.unique(width[size <= LONG_WORD]).tolist():
            of_width = np.flatnonzero(width == w)
            for a in range(0, len(of_width), CELLS // w):
                some = of_width[a : a + CELLS // w]
                data = np.array([words[fresh[i]] for i in some], f"S{w}").view(np.uint8).reshape(-1, w)
                ids, counts = self.rows(data, size[some])
                whole, ends = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
                for i, start, stop in zip(some.tolist(), [0, *ends], ends):
                    found[fresh[i]] = whole[start:stop]
        for i in fresh:
            if self.kept >= CACHED_BYTES:
                break
            self.known[words[i]] = found[i]
            self.kept += ENTRY_BYTES + len(words[i]) + len(found[i])
        return found


@functools.cache
def merges(vocabulary: str) -> Merges:
    """One for the life of a worker, which serves many tasks."""
    return Merges(vocabulary)


def ids_of(lists: pa.ListArray, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of lists of words, end to end, and the bounds of each list's ids."""
    coded = lists.flatten().dictionary_encode()
    found = merges(vocabulary).fold_all(coded.dictionary.cast(pa.binary()).to_pylist())
    flat, size = np.frombuffer(b"".join(found), np.int32), np.fromiter(map(len, found), np.int64, len(found)) // 4
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)))
    return joined(flat, size, coded.indices.to_numpy(zero_copy_only=False), ends)


def encode(docs: DataFrame, text: str = "text", into: str = "ids", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``docs`` with the ids of each text as ``array<int>``."""
    plain = docs.drop(into)
    names = plain.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in in_lots(batch, batch.column(len(names) + 1)):
                ids, ends = ids_of(lot.column(len(names)), vocabulary)
                yield pa.RecordBatch.from_arrays([*lot.columns[:-2], listed(ids, ends)], [*names, into])

    split = plain.select("*", words(whole_text(text), pattern).alias("split into words"), F.octet_length(whole_text(text)).alias("own size"))
    return split.mapInArrow(tidy(work), plain.select("*", F.array(F.lit(0)).alias(into)).schema)


def round_trip(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``docs`` without the text, with ``ids`` and with ``decoded``, the bytes that these ids stand for: one pass over the texts."""
    plain = docs.drop("ids", "decoded")
    names = [c for c in plain.columns if c != text]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in in_lots(batch, batch.column(len(names) + 1)):
                ids, ends = ids_of(lot.column(len(names)), vocabulary)
                yield pa.RecordBatch.from_arrays([*lot.columns[:-2], listed(ids, ends), decoded(ids, ends, vocabulary)], [*names, "ids", "decoded"])

    split = plain.select(*names, words(whole_text(text), pattern).alias("split into words"), F.octet_length(whole_text(text)).alias("own size"))
    return split.mapInArrow(tidy(work), plain.select(*names, F.array(F.lit(0)).alias("ids"), F.lit(b"").alias("decoded")).schema)


def listed(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def joined(flat: np.ndarray, size: np.ndarray, which: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists that lie end to end in ``flat`` with their ``size``: those that ``which`` names, end to end, and where in that each of the ``ends`` (in lists) comes."""
    start = np.concatenate(([0], np.cumsum(size)))
    own = size[which]
    upto = np.concatenate(([0], np.cumsum(own)))
    ids = flat[np.arange(upto[-1]) + np.repeat(start[which] - upto[:-1], own)]
    return ids, upto[ends]


@functools.cache
def pieces_of(vocabulary: str) -> tuple[pa.Array, np.ndarray]:
    """The bytes of each id, and the ids, both in their order."""
    ranks = sorted(read_ranks(vocabulary).items(), key=lambda x: x[1])
    return pa.array([p for p, _ in ranks], pa.large_binary()), np.array([r for _, r in ranks])


def decoded(ids: np.ndarray, ends: np.ndarray, vocabulary: str, null: pa.Array | None = None) -> pa.Array:
    """The pieces of lists of ids, concatenated; ``ends`` bounds each list's ids."""
    pieces, places = pieces_of(vocabulary)
    _, offsets, data = pieces.take(pa.array(np.searchsorted(places, ids).astype(np.int32))).buffers()
    bounds = np.frombuffer(offsets, np.int64)[ends]
    found = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(bounds), data]).cast(pa.binary())
    return found if null is None or not null.true_count else pc.if_else(null, pa.scalar(None, pa.binary()), found)


def decode(docs: DataFrame, ids: str = "ids", into: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with the bytes that the ids stand for; null ids give null."""
    plain = docs.drop(into)
    names, at = plain.columns, plain.columns.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in in_lots(batch, pc.multiply(pc.list_value_length(batch.column(at)), 4)):
                lists = lot.column(at)
                ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([*lot.columns, decoded(lists.flatten().to_numpy(zero_copy_only=False), ends, vocabulary, lists.is_null())], [*names, into])

    return plain.mapInArrow(tidy(work), plain.select("*", F.lit(b"").alias(into)).schema)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: of its ids and of the bytes that they decode to."""
    coded = round_trip(docs.select("doc_id", "text"))
    found = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    with small_batches(docs.sparkSession):
        return written(found, "bpe-digests")


def rank_map(vocabulary: str = VOCABULARY, buckets: int = MAP_BUCKETS) -> Column:
    """A literal: array of maps from a byte string (in hex) to its rank; a string is in the map that crc32 names.

    Spark searches a map from end to end, so one map of all ranks would be slow; the maps here hold about one entry.
    """
    import json
    import zlib

    maps: list[dict[str, int]] = [{} for _ in range(buckets)]
    for token, rank in read_ranks(vocabulary).items():
        key = token.hex().upper()
        maps[zlib.crc32(key.encode()) % buckets][key] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def encode_words(table: DataFrame, word: str = "word", into: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``table`` with the ids of each word, by Spark's higher-order functions alone.

    A word is a string of hex pieces, '<61><62>'. One step of the fold looks up the ranks of all neighbours and
    replaces the best pair, '<61><62>' by '<6162>'; the number of steps is the number of bytes less one.
    """
    maps, buckets = rank_map(vocabulary), MAP_BUCKETS
    rank = lambda piece: F.try_element_at(F.get(maps, F.pmod(F.crc32(piece.cast("binary")), F.lit(buckets)).cast("int")), piece)
    pieces = lambda s: F.split(F.regexp_replace(s, "^<|>$", ""), "><", -1)

    def step(state: Column, _: Column) -> Column:
        own = pieces(state)
        pairs = F.transform(F.sequence(F.lit(1), F.size(own) - 1), lambda i: F.struct(rank(F.concat(F.element_at(own, i), F.element_at(own, i + 1))).alias("rank"), F.element_at(own, i).alias("a"), F.element_at(own, i + 1).alias("b")))
        best = F.array_min(F.filter(pairs, lambda p: p["rank"].isNotNull()))
        merged = F.replace(state, F.concat(F.lit("<"), best["a"], F.lit("><"), best["b"], F.lit(">")), F.concat(F.lit("<"), best["a"], best["b"], F.lit(">")))
        return F.when(F.size(own) < 2, state).otherwise(F.coalesce(merged, state))

    start = F.regexp_replace(F.hex(F.col(word).cast("binary")), "(..)", "<$1>")
    turns = F.octet_length(word) - 1
    folded = F.when(turns > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(turns, F.lit(1))), start, step)).otherwise(start)
    return table.withColumn(into, F.when(F.octet_length(word) == 0, F.array().cast("array<int>")).otherwise(F.transform(pieces(folded), rank)))

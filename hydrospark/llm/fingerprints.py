"""Document fingerprints from improbable features.

Each window of ``WINDOW`` bytes has an entropy. How often each entropy occurs in the whole corpus gives
its rank: the rarer, the lower. A window that holds the lowest rank of many neighbourhoods is a feature.
A document's distinct features go into a chain of Bloom filters, ``PER_FILTER`` of them into each, and
two chains are compared by the bits that their filters share, beyond what chance makes them share.

Defined cases: a null text is an empty one; an empty text has the empty chain, which is like another empty
chain (1.0) and unlike any other (0.0); a text without a feature (shorter than about ``WINDOW`` bytes) has
one feature, the whole text. Ties of rank go to the leftmost window. Rows with equal ids come in the order
of a hash of their text; a null id comes first. Texts of any length are taken in overlapping pieces.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from hydrospark.llm.common import in_lots, tidy, whole_text

WINDOW = 16  # bytes of a feature
NEAR = 32  # windows of a neighbourhood
OFTEN = 8  # neighbourhoods that a feature must win
BINS = 1000  # entropy steps
BITS, HASHES, PER_FILTER = 2048, 5, 160
PIECE = 1 << 20  # bytes that are worked on at once
ROWS_PER_BLOCK, MOST_BLOCKS = 1000, 20_000

_SCALE = 1 << 20
_C_LOG_C = np.array([0] + [round(c * math.log2(c) * _SCALE) for c in range(1, WINDOW + 1)], np.int64)
_STEP = np.diff(_C_LOG_C)
_FULL = round(WINDOW * math.log2(WINDOW) * _SCALE)
_NEVER = np.int64(1) << 31
_GAP = bytes(NEAR)


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """Entropy step (0 to BINS) of the window that starts at each byte; windows end with the data."""
    n = len(data) - WINDOW + 1
    ahead, behind = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        ahead[:-k] += same
        behind[k:] += same
    first = _C_LOG_C[np.bincount(data[:WINDOW], minlength=256)].sum()
    total = np.empty(n, np.int64)
    total[0] = first
    np.cumsum(_STEP[behind[WINDOW:]] - _STEP[ahead[: n - 1]], out=total[1:])
    total[1:] += first
    return ((_FULL - total) * BINS // _FULL).astype(np.int32)


def pieces(texts: list[bytes], context: int) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Lots of about PIECE bytes: (text, first byte, end byte, first own window, end of own windows)."""
    lot, held = [], 0
    for i, text in enumerate(texts):
        windows = len(text) - WINDOW + 1
        for at in range(0, max(windows, 0), PIECE):
            own_end = min(windows, at + PIECE)
            start, end = max(0, at - context), min(len(text), own_end + context + WINDOW)
            lot.append((i, start, end, at - start, own_end - start))
            held += end - start
            if held >= PIECE:
                yield lot
                lot, held = [], 0
    if lot:
        yield lot


def _joined(texts: list[bytes], lot: list[tuple[int, int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a lot, the base of each piece, and for each window its piece and whether it lies within one.

    Pieces are so far apart that no neighbourhood holds windows of two.
    """
    data = np.frombuffer(b"".join(texts[i][a:b] + _GAP for i, a, b, _, _ in lot), np.uint8)
    sizes = np.array([b - a for _, a, b, _, _ in lot])
    base = np.concatenate(([0], np.cumsum(sizes + NEAR)[:-1]))
    piece = np.repeat(np.arange(len(lot)), sizes + NEAR)[: len(data) - WINDOW + 1]
    inside = np.arange(len(piece)) + WINDOW <= (base + sizes)[piece]
    return data, base, piece, inside


def count_bins(texts: list[bytes]) -> np.ndarray:
    """How often each entropy step occurs in the texts' windows."""
    found = np.zeros(BINS + 1, np.int64)
    for lot in pieces(texts, 0):
        data, base, piece, inside = _joined(texts, lot)
        own = np.arange(len(piece)) < (base + np.array([x[4] for x in lot]))[piece]
        found += np.bincount(entropy_bins(data)[inside & own], minlength=BINS + 1)
    return found


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy step: 0 for the rarest. Steps that the corpus lacks, and those of windows with hardly any entropy, never win."""
    order = np.lexsort((np.arange(BINS + 1), counts))
    ranks = np.full(BINS + 1, _NEVER, np.int64)
    ranks[order] = np.arange(BINS + 1)
    ranks[counts == 0] = _NEVER
    ranks[: BINS // 10] = _NEVER
    return ranks


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_windows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at].copy().view(np.uint64)
    h = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(words.shape[1]):
        h = _mixed(h ^ words[:, k])
    return h


def features(texts: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct features of all texts, in the order of text and place."""
    owners, hashes = [], []
    for lot in pieces(texts, NEAR - 1):
        data, base, piece, inside = _joined(texts, lot)
        n = len(piece)
        key = np.full(n + NEAR - 1, _NEVER << 31, np.int64)
        rank = ranks[entropy_bins(data)]
        fit = inside & (rank < _NEVER)
        key[:n][fit] = (rank[fit] << 31) | np.flatnonzero(fit)
        best, width = key, 1
        while width < NEAR:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        best = best[inside]
        won = np.bincount(best[best < (_NEVER << 31)] & (_NEVER - 1), minlength=n)
        own = np.arange(n) - base[piece]
        own = (own >= np.array([x[3] for x in lot])[piece]) & (own < np.array([x[4] for x in lot])[piece])
        at = np.flatnonzero((won >= OFTEN) & own)
        owners.append(np.array([x[0] for x in lot], np.int64)[piece[at]])
        hashes.append(_hash_windows(data, at) if len(at) else np.zeros(0, np.uint64))
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    found = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    has = np.zeros(len(texts), bool)
    has[owner] = True
    bare = [i for i, text in enumerate(texts) if text and not has[i]]
    owner = np.concatenate((owner, np.array(bare, np.int64)))
    found = np.concatenate((found, np.array([int.from_bytes(hashlib.blake2b(texts[i], digest_size=8).digest(), "little") for i in bare], np.uint64)))
    place = np.arange(len(owner))
    order = np.lexsort((place, found, owner))
    first = np.ones(len(order), bool)
    first[1:] = (owner[order][1:] != owner[order][:-1]) | (found[order][1:] != found[order][:-1])
    kept = np.sort(order[first])
    kept = kept[np.argsort(owner[kept], kind="stable")]
    return owner[kept], found[kept]


Chain = tuple[np.ndarray, np.ndarray]  # features in each filter, its bits as 64-bit words


def chains(texts: list[bytes], ranks: np.ndarray) -> list[Chain]:
    """The chain of Bloom filters of each text."""
    owner, found = features(texts, ranks)
    per_text = np.bincount(owner, minlength=len(texts))
    filters = -(-per_text // PER_FILTER)
    base = np.concatenate(([0], np.cumsum(filters)))
    place = np.arange(len(owner)) - np.concatenate(([0], np.cumsum(per_text)))[owner]
    which = base[owner] + place // PER_FILTER
    on = np.zeros((base[-1], BITS), bool)
    for k in range(HASHES):
        on[which, (found >> np.uint64(11 * k)) & np.uint64(BITS - 1)] = True
    words = np.packbits(on, axis=1).view(np.uint64)
    inserted = np.bincount(which, minlength=base[-1])
    return [(inserted[a:b], words[a:b]) for a, b in zip(base[:-1], base[1:])]


def as_string(chain: Chain) -> str:
    return ".".join(f"{n}:{base64.b64encode(w.tobytes()).decode()}" for n, w in zip(*chain))


def from_string(fingerprint: str) -> Chain:
    parts = [x.split(":") for x in fingerprint.split(".") if x]
    words = np.frombuffer(b"".join(base64.b64decode(w) for _, w in parts), np.uint64)
    return np.array([int(n) for n, _ in parts], np.int64), words.reshape(len(parts), BITS // 64)


def _one_way(a: Chain, b: Chain) -> float:
    """Mean over a's filters of the best normalised overlap with one of b's."""
    left = 1 - 1 / BITS
    b_on = np.bitwise_count(b[1]).sum(1, dtype=np.int64)
    b_fill = 1 - left ** (HASHES * b[0])
    total = 0.0
    for n, words in zip(*a):
        shared = np.bitwise_count(b[1] & words).sum(1, dtype=np.int64)
        chance = BITS * (1 - left ** (HASHES * n)) * b_fill
        most = np.minimum(b_on, np.bitwise_count(words).sum(dtype=np.int64))
        total += float(np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return total / len(a[0])


def likeness(a: Chain, b: Chain) -> float:
    """0 to 1, the same from either side: the shorter chain's filters look for their best match in the longer."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    if len(a[0]) != len(b[0]):
        return _one_way(*sorted((a, b), key=lambda c: len(c[0])))
    return _one_way(a, b) if len(a[0]) == 1 else (_one_way(a, b) + _one_way(b, a)) / 2


def corpus_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Ranks from the entropies of all windows of all texts; the driver gets at most BINS + 1 sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BINS + 1, np.int64)
        for batch in batches:
            for lot in in_lots(batch, pc.binary_length(batch.column(0))):
                found += count_bins([x.encode() for x in lot.column(0).to_pylist()])
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["bin", "n"])

    counts = np.zeros(BINS + 1, np.int64)
    for row in docs.select(whole_text(text).alias("text")).mapInArrow(tidy(count), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[row["bin"]] = row["n"]
    return ranks_of(counts)


def fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint", ranks: np.ndarray | None = None) -> DataFrame:
    """``docs`` with the fingerprint of each text. ``ranks`` of another corpus may be given, so that fingerprints compare across runs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(corpus_ranks(docs, text) if ranks is None else ranks)
    plain = docs.drop(into)
    names, at = plain.columns, plain.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in in_lots(batch, pc.binary_length(batch.column(at))):
                texts = [(x or "").encode() for x in lot.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*lot.columns, pa.array([as_string(c) for c in chains(texts, shared.value)], pa.string())], [*names, into])

    return plain.mapInArrow(tidy(add), plain.select("*", F.lit("").alias(into)).schema)


def in_blocks(docs: DataFrame) -> DataFrame:
    """Rows (block, tail, doc_id, text), dealt out by block and sorted by id within one.

    A block is a range of ids. The row that comes first in the next block (for the last block: first of all)
    follows it once more as ``tail``, so that each row of a block finds its successor there. Bounds are ids
    that occur, at most MOST_BLOCKS of them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    blocks = max(1, min(MOST_BLOCKS, seen["n"] // ROWS_PER_BLOCK))
    bounds: list[int] = []
    if blocks > 1 and seen["low"] is not None:
        shares = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
        found = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * blocks)).alias("b")).first()["b"]
        bounds = sorted({b for b in found if b > seen["low"]})
    step = max(1, math.isqrt(len(bounds)))
    lots = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    ids = F.col("doc_id")
    literal = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]).cast("array<bigint>")
    lot = F.size(F.filter(literal([x[0] for x in lots[1:]]), lambda b: b <= ids))
    own = F.array(*[literal(x) for x in lots])
    placed = rows.withColumn("lot", lot).withColumn("own", F.element_at(own, F.col("lot") + 1))
    block = (F.col("lot") * step + F.size(F.filter("own", lambda b: b <= ids))).cast("int")
    first = ids.isNull() if seen["nulls"] else ids == F.lit(seen["low"])
    tail = lambda when, b: F.when(when, F.struct(b.cast("int").alias("block"), F.lit(1).alias("tail")))
    places = F.array(F.struct(F.col("block"), F.lit(0).alias("tail")), tail(F.array_contains("own", ids), F.col("block") - 1), tail(F.coalesce(first, F.lit(False)), F.lit(len(bounds))))
    placed = placed.withColumn("block", block).select(F.explode(F.filter(places, lambda p: p.isNotNull())).alias("p"), "doc_id", "text")
    return placed.select("p.block", "p.tail", "doc_id", "text").repartition("block").sortWithinPartitions("block", "tail", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))


def edited(text: str, after: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """For each document its fingerprint, that of its edited text, and its likeness to both that and the next document."""
    shared = docs.sparkSession.sparkContext.broadcast(corpus_ranks(docs))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Runs of rows; the last row of a run opens the next one, where it is needed as a successor."""
        held, size = [], 0
        for batch in batches:
            for some in in_lots(batch, pc.binary_length(batch.column(3))):
                for row in zip(*(some.column(i).to_pylist() for i in range(4))):
                    held.append(row)
                    size += len(row[3])
                    if size >= PIECE and len(held) > 1:
                        yield held
                        held, size = held[-1:], len(held[-1][3])
        if held:
            yield [*held, None]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in lots(batches):
            rows = [r for r in lot if r]
            # the last row of a lot is worked on in the next one, unless nothing comes after it
            pairs = [(i, i + 1 if i + 1 < len(rows) and rows[i + 1][0] == rows[i][0] else i) for i in range(len(rows) - (lot[-1] is not None)) if not rows[i][1]]
            changed = [edited(rows[i][3], rows[j][3]).encode() for i, j in pairs]
            found = chains([r[3].encode() for r in rows] + changed, shared.value)
            made = found[len(rows) :]
            columns = [
                pa.array([rows[i][2] for i, _ in pairs], pa.int64()), pa.array([len(rows[i][3]) for i, _ in pairs], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in changed], pa.string()),
                pa.array([as_string(found[i]) for i, _ in pairs], pa.string()), pa.array([as_string(c) for c in made], pa.string()),
                pa.array([likeness(found[i], c) for (i, _), c in zip(pairs, made)], pa.float64()), pa.array([likeness(found[i], found[j]) for i, j in pairs], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return in_blocks(docs).mapInArrow(tidy(compare), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

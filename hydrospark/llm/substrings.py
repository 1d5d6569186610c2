"""Substring dedup by fixed-block anchors.

A window of WINDOW words goes if it also starts in a document with a smaller id. Any such window holds a whole
block of (WINDOW + 1) / 2 words (7 of 13) that begins at a multiple of that length in the other document. So the
index has only the non-overlapping blocks of each document, every rolling window of 7 words probes it, and hits
are anchors: each window of 13 words around one is compared whole, and neighbouring windows join to maximal repeats.

Three passes over lots of documents (``lots``): blocks and probes meet in buckets by hash, each lot sends a probe
once, and learns which of its own some other lot shares; windows around anchors meet by their own keys, with the
least id that each lot has; at last each lot marks its words. No pair of documents is ever formed: a passage of m
documents is m probes and m keys. The hash of an anchor (32 bits in its bucket) only proposes; a window's key has
96 bits in its bucket, from sums of its words' hashes with a factor for each place, in two independent lanes.

Defined cases: a null or empty text has no words; a text of fewer than WINDOW words loses none; equal rows and rows of equal
ids keep what only they share; a null id is smaller than any; repeats inside one document stay; other columns of any name
do not matter; a text of any length is worked on whole, in numpy arrays of its words' hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from hydrospark.llm.lots import asked, dropping_shuffles, joined_flags, joined_numbers, lots_of, met, runs_of, texts_of
from hydrospark.plans.scratch import written

WINDOW = 13
BUCKET_PROBES = 4 << 20  # probes that a bucket gets, about
BYTES_A_WORD = 6
NO_ID = -(1 << 63)  # stands for a null id
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, (3, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)


def window_sums(hashes: np.ndarray, n: int, lane: int) -> np.ndarray:
    """A hash of each window of ``n`` words, from the words' hashes."""
    found = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n):
        # factors of places beyond 256 are made of two
        factor = _FACTORS[lane, i % 256] * (_FACTORS[lane, (i // 256) % 256] if i >= 256 else np.uint64(1))
        found += hashes[i : i + len(found)] * factor
    return found


class Lot:
    """The hashes of the words of a lot's documents, one document after the other."""

    def __init__(self, table: pa.Table, window: int) -> None:
        self.window, self.block = window, (window + 1) // 2
        self.texts, found = texts_of(table), []
        for text in self.texts:
            words = text.split()  # bytes split at ASCII white space alone
            found.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        self.sizes = np.array([len(x) for x in found], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.array([NO_ID if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
        self.hashes = np.concatenate(found) if found else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(found), dtype=np.int32), self.sizes)

    def inside(self, n: int) -> np.ndarray:
        """The places where a window of ``n`` words starts that ends in the same document."""
        m = max(0, len(self.doc) - n + 1)
        return np.flatnonzero(self.doc[:m] == self.doc[n - 1 : n - 1 + m])

    def anchors(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each rolling window of a block's length: its place, its code (bucket and 32 bits), whether it is a block of the index."""
        at = self.inside(self.block)
        sums = window_sums(self.hashes, self.block, 0)[at]
        codes = (sums >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | sums & _LOW
        return at, codes, (at - self.starts[self.doc[at]]) % self.block == 0


def probes(buckets: int, window: int) -> Callable[[pa.Table], pa.Table]:
    """A lot to (bucket, lot, codes, blocks): its distinct anchors in each bucket, and which of them are blocks."""

    def ask(table: pa.Table) -> pa.Table:
        lot = Lot(table, window)
        _, codes, block = lot.anchors(buckets)
        order, starts = runs_of(codes)
        own = codes[order][starts]
        is_block = np.logical_or.reduceat(block[order], starts) if len(starts) else block
        cuts = np.searchsorted(own, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
        rows = [(b, own[x:y], is_block[x:y]) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y]
        return pa.table({
            "bucket": pa.array([b for b, _, _ in rows], pa.int32()), "lot": pa.array([table.column("lot")[0].as_py()] * len(rows), pa.int32()),
            "codes": pa.array([(c & _LOW).astype(np.uint32).tobytes() for _, c, _ in rows], pa.binary()), "blocks": pa.array([np.packbits(f).tobytes() for _, _, f in rows], pa.binary()),
        })

    return ask


def shared_anchors(table: pa.Table) -> pa.Table:
    """A bucket's probes to (lot, bucket, codes): those that several lots have, one of them as a block."""
    codes, row = joined_numbers(table, "codes", np.uint32)
    block = joined_flags(table, "blocks", np.bincount(row, minlength=table.num_rows))
    order, starts = runs_of(codes)
    if not len(starts):
        return table.select(["lot", "bucket", "codes"]).slice(0, 0)
    sizes = np.diff(np.append(starts, len(codes)))
    live = np.repeat((sizes > 1) & np.logical_or.reduceat(block[order], starts), sizes)
    kept = np.sort(order[live])
    cuts = np.searchsorted(row[kept], np.arange(table.num_rows + 1))
    hit = np.flatnonzero(np.diff(cuts))
    return pa.table({"lot": table.column("lot").take(hit), "bucket": table.column("bucket").take(hit), "codes": pa.array([codes[kept[cuts[i] : cuts[i + 1]]].tobytes() for i in hit], pa.binary())})


def windows(buckets: int, wide: int, window: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A lot and its shared anchors to (bucket, lot, first, second, least, several): the keys of its windows around
    anchors, the least id that has each, and whether the lot has it in documents of several ids."""

    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "lot": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("first", "second", "least", "several")}})
        lot = Lot(table, window)
        at, codes, block = lot.anchors(buckets)
        shared, row = joined_numbers(answers, "codes", np.uint32)
        of = np.array(answers.column("bucket").to_pylist(), np.uint64)[row] if len(row) else np.empty(0, np.uint64)
        live = np.isin(codes, of << np.uint64(32) | shared)
        # anchors that documents of this lot share
        order, starts = runs_of(codes)
        if len(starts):
            ids = lot.doc[at][order]
            many = (np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)) & np.logical_or.reduceat(block[order], starts)
            live[order] |= np.repeat(many, np.diff(np.append(starts, len(codes))))
        upto = np.zeros(len(lot.doc) + 1, np.int64)
        upto[at[live] + 1] = 1
        upto = np.cumsum(upto)
        s = lot.inside(window)
        s = s[upto[s + window - lot.block + 1] > upto[s]]
        first, second = window_sums(lot.hashes, window, 1)[s], (window_sums(lot.hashes, window, 2)[s] >> np.uint64(32)).astype(np.uint32)
        bucket = ((first >> np.uint64(32)) % np.uint64(wide)).astype(np.int32)
        order, starts = runs_of(bucket, first, second)
        ids = lot.ids[lot.doc[s]][order]
        least = np.minimum.reduceat(ids, starts) if len(starts) else ids
        several = np.maximum.reduceat(ids, starts) != least if len(starts) else ids != ids
        one = order[starts]
        cuts = np.searchsorted(bucket[one], np.arange(wide + 1))
        held = [b for b in range(wide) if cuts[b] < cuts[b + 1]]
        cut = lambda x: [x[cuts[b] : cuts[b + 1]] for b in held]
        return pa.table({
            "bucket": pa.array(held, pa.int32()), "lot": pa.array([table.column("lot")[0].as_py()] * len(held), pa.int32()),
            **{name: pa.array([x.tobytes() for x in cut(v)], pa.binary()) for name, v in (("first", first[one]), ("second", second[one]), ("least", least))},
            "several": pa.array([np.packbits(x).tobytes() for x in cut(several)], pa.binary()),
        })

    return ask


def repeated_windows(table: pa.Table) -> pa.Table:
    """A bucket's windows to (lot, first, second, whole): those of which some document of the lot has to give its own up.
    ``whole``: all of its documents, as a smaller id elsewhere has it; else all but those of the lot's least id."""
    first, row = joined_numbers(table, "first", np.uint64)
    second, least = (joined_numbers(table, c, k)[0] for c, k in (("second", np.uint32), ("least", np.int64)))
    several = joined_flags(table, "several", np.bincount(row, minlength=table.num_rows))
    order, starts = runs_of(first, second)
    whole = np.zeros(len(first), bool)
    if len(starts):
        whole[order] = np.repeat(np.minimum.reduceat(least[order], starts), np.diff(np.append(starts, len(first)))) < least[order]
    kept = np.flatnonzero(whole | several)
    cuts = np.searchsorted(row[kept], np.arange(table.num_rows + 1))
    hit = np.flatnonzero(np.diff(cuts))
    cut = lambda x: [x[kept[cuts[i] : cuts[i + 1]]] for i in hit]
    return pa.table({
        "lot": table.column("lot").take(hit), **{name: pa.array([x.tobytes() for x in cut(v)], pa.binary()) for name, v in (("first", first), ("second", second))},
        "whole": pa.array([np.packbits(x).tobytes() for x in cut(whole)], pa.binary()),
    })


def kept_words(window: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A lot and its repeated windows to (doc_id, n_words, n_removed, kept, spans) of its documents."""

    def mark(table: pa.Table, answers: pa.Table) -> pa.Table:
        lot = Lot(table, window)
        first, row = joined_numbers(answers, "first", np.uint64)
        second, whole = joined_numbers(answers, "second", np.uint32)[0], joined_flags(answers, "whole", np.bincount(row, minlength=answers.num_rows))
        order = np.lexsort((second, first))
        first, second, whole = first[order], second[order], whole[order]
        change = np.zeros(len(lot.hashes) + 1, np.int32)
        if len(first):
            s = lot.inside(window)
            own = window_sums(lot.hashes, window, 1)[s]
            there = np.isin(own, first)
            s, own = s[there], own[there]
            other = (window_sums(lot.hashes, window, 2)[s] >> np.uint64(32)).astype(np.uint32)
            key = np.searchsorted(first, own)
            while True:  # keys that share the first lane stand next to each other
                off = (key < len(first)) & (first[np.minimum(key, len(first) - 1)] == own) & (second[np.minimum(key, len(first) - 1)] != other)
                if not off.any():
                    break
                key[off] += 1
            hit = (key < len(first)) & (first[np.minimum(key, len(first) - 1)] == own)
            s, key = s[hit], key[hit]
            ids = lot.ids[lot.doc[s]]
            least = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(least, key, ids)
            gone = s[whole[key] | (ids > least[key])]
            np.add.at(change, gone, 1)
            np.add.at(change, gone + window, -1)
        out = np.cumsum(change)[:-1] > 0
        kept, spans, removed = [], [], []
        for text, start, n in zip(lot.texts, lot.starts.tolist(), lot.sizes.tolist()):
            own, words = out[start : start + n], text.split()
            lost = int(own.sum())
            removed.append(lost)
            edges = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8))) if lost else []
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
            kept.append(b" ".join([w for w, gone in zip(words, own.tolist()) if not gone] if lost else words).decode())
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(lot.sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string()), "spans": pa.array(spans, span)})

    return mark


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans) of each row: its words that stay, joined by spaces, and the maximal
    repeats [start, end) that go, in words."""
    spark = docs.sparkSession
    lots, n_bytes = lots_of(docs, doc_id=F.col("doc_id").cast("long"))
    buckets = max(1, -(-n_bytes // (BYTES_A_WORD * BUCKET_PROBES)))
    wide = 4 * buckets  # a window's key has several times the bytes of a probe
    with dropping_shuffles(spark):
        sent = asked(lots, probes(buckets, window), "bucket int, lot int, codes binary, blocks binary")
        shared = written(met(sent, shared_anchors, "lot int, bucket int, codes binary"), "anchors")
        sent = asked(lots, windows(buckets, wide, window), "bucket int, lot int, first binary, second binary, least binary, several binary", shared)
        repeated = written(met(sent, repeated_windows, "lot int, first binary, second binary, whole binary"), "windows")
    return asked(lots, kept_words(window), "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>", repeated)


REPEATS_SQL = """
    WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    p AS (SELECT r, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS s FROM w),
    k AS (SELECT r, doc_id, s, md5(string_agg(word, ' ') OVER o) AS k FROM p WINDOW o AS (PARTITION BY r ORDER BY s ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) QUALIFY count(*) OVER o = 13),
    m AS (SELECT k, min(doc_id) AS least FROM k GROUP BY k),
    h AS (SELECT r, s FROM k JOIN m USING (k) WHERE least < doc_id),
    c AS (SELECT DISTINCT r, s + i AS s, true AS gone FROM h, generate_series(0, 12) AS g(i)),
    o AS (SELECT r, count(gone) AS n_removed, string_agg(word, ' ' ORDER BY s) FILTER (WHERE gone IS NULL) AS kept FROM p LEFT JOIN c USING (r, s) GROUP BY r)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN o USING (r)"""

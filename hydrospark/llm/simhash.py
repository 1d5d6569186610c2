"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's 64 bits are cut into BLOCKS blocks. Two fingerprints that differ in at most ``bits`` bits
agree in at least BLOCKS - bits blocks, so each fingerprint is filed under every choice of BLOCKS - bits of
them (10 choices of 2 blocks, 26 bits, for 5 blocks and 3 bits). Fingerprints that share a file are compared.

Only distinct fingerprints are filed, so copies cost nothing. A task walks its files in order, compares the
members of a file in array blocks and writes links that span each linked set within it, at most one less than
its members, never all pairs. A file with more than MOST_IN_FILE members is dealt out as tiles: pairs of
parts, one task each, so that every pair is still compared and no task holds more than two parts.

Components come from repeated rounds: each fingerprint takes the least label of its neighbours, then labels
are followed to their labels, until nothing changes. Each round is a table in the shared folder.

Defined cases: a null or empty text, or one of white space alone, has fingerprint zero, which links like any
other; fewer words than a shingle has are one shingle; equal rows share a component; a null id is smaller than
none (a component of null ids alone has a null id).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from hydrospark.llm.common import in_lots, row_hash, small_batches, tidy, whole_text
from hydrospark.plans.components import components
from hydrospark.plans.scratch import written

WORDS = 3
SEED = 42
NEAR_BITS = 3
BLOCKS = (13, 13, 13, 13, 12)  # bits of each block
MOST_IN_FILE = 20_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SLAB = 1 << 16  # shingles whose bits are counted at once


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes: the bits that over half of them have."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), _SLAB):
        counts += np.unpackbits(hashes[a : a + _SLAB].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(texts: list[str], n_words: int = WORDS) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is set if over half of the shingles' hashes have it."""
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    owners: list[tuple[int, int]] = []

    def settle() -> None:
        if not owners:
            return
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sizes = np.array([n for _, n in owners])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        set_bits = ones * 2 > sizes[:, None]
        out[[i for i, _ in owners]] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
        hashes.clear()
        owners.clear()

    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        found = text.encode().translate(_LOWER).split()
        if not found:
            continue
        whole = b" ".join(found)
        if len(found) <= n_words:
            hashes.append(digest(whole, SEED))
            owners.append((i, 1))
        else:
            ends = list(itertools.accumulate(len(w) + 1 for w in found))
            starts = [0, *ends]
            n = len(found) - n_words + 1
            if n > _SLAB:  # a very long text: its bits are counted slab by slab
                some = np.fromiter((digest(whole[s : e - 1], SEED) for s, e in zip(starts, ends[n_words - 1 :])), np.uint64, n)
                out[i] = majority(some)
                continue
            hashes += [digest(whole[s : e - 1], SEED) for s, e in zip(starts, ends[n_words - 1 :])]
            owners.append((i, n))
        if len(hashes) >= _SLAB:
            settle()
    settle()
    return out


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fp", n_words: int = WORDS) -> DataFrame:
    """``docs`` without the text, with the fingerprint as a signed long."""
    others = [c for c in docs.columns if c not in (text, into)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in in_lots(batch, pc.binary_length(batch.column(len(others)))):
                found = simhash(lot.column(len(others)).to_pylist(), n_words)
                yield pa.RecordBatch.from_arrays([*lot.columns[:-1], pa.array(found.view(np.int64))], [*others, into])

    plain = docs.select(*others, whole_text(text).alias("whole text"))
    return plain.mapInArrow(tidy(work), plain.select(*others, F.lit(0).cast("long").alias(into)).schema)


def spanning(members: np.ndarray, others: np.ndarray | None, bits: int) -> list[tuple[int, int]]:
    """Links (smaller, larger) that connect what is within ``bits`` of each other; with ``others``, only across the two.

    A walk: what has been reached takes its neighbours out of the rest, so a dense set is left after few steps.
    """
    rest = [members] if others is None else [members, others]
    found: list[tuple[int, int]] = []
    queue: list[tuple[int, np.uint64]] = []
    while queue or len(rest[0]):
        if not queue:
            queue.append((0, rest[0][0]))
            rest[0] = rest[0][1:]
        side, at = queue.pop()
        other = len(rest) - 1 - side
        near = np.bitwise_count(rest[other] ^ at) <= bits
        if near.any():
            reached, rest[other] = rest[other][near], rest[other][~near]
            found += [(min(int(at), x), max(int(at), x)) for x in reached.tolist()]
            queue += [(other, x) for x in reached]
    return found


def links(distinct: DataFrame, bits: int = NEAR_BITS, most_in_file: int = MOST_IN_FILE, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """``distinct`` (fp) to links (a, b) between fingerprints at most ``bits`` apart, enough to connect all that are; there are more ``blocks`` than bits."""
    ends = list(itertools.accumulate(blocks))
    masks = [((1 << e) - (1 << (e - w))) for e, w in zip(ends, blocks)]
    choices = [sum(c) for c in itertools.combinations(masks, len(blocks) - bits)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    files = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for i, m in enumerate(choices)])
    filed = distinct.select("fp", F.explode(files).alias("f")).select("f.choice", "f.part", "fp")
    sizes = filed.groupBy("choice", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_in_file)
    large = written(sizes, "large-files")
    tiled = large.limit(1).count() > 0
    tile = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    if tiled:
        # tile (i, j), i <= j, of a large file gets the members of parts i and j
        joined = filed.join(large, ["choice", "part"], "left")
        parts = F.ceil(F.col("n") / (most_in_file // 2)).cast("int")
        own = F.pmod(F.xxhash64("fp"), parts).cast("int")
        tiles = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: tile(F.least(k, own), F.greatest(k, own)))
        filed = joined.select("choice", "part", "fp", F.when(F.col("n").isNull(), F.lit(0)).otherwise(own).alias("own"), F.explode(F.when(F.col("n").isNull(), F.array(tile(F.lit(0), F.lit(0)))).otherwise(tiles)).alias("t"))
    else:
        filed = filed.select("choice", "part", "fp", F.lit(0).alias("own"), tile(F.lit(0), F.lit(0)).alias("t"))
    dealt = filed.select("choice", "part", "t.i", "t.j", "own", "fp").repartition("choice", "part", "i", "j").sortWithinPartitions("choice", "part", "i", "j")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(held: list[np.ndarray]) -> list[tuple[int, int]]:
            rows = np.concatenate(held, axis=1)
            fp, own, i, j = rows[5].view(np.uint64), rows[4], rows[2][0], rows[3][0]
            return spanning(fp, None, bits) if i == j else spanning(fp[own == i], fp[own == j], bits)

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        held: list[np.ndarray] = []  # rows of the file that the last batch ended in
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            found: list[tuple[int, int]] = []
            starts = np.concatenate(([0], np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(0)) + 1, [rows.shape[1]]))
            if held and (held[-1][:4, -1] != rows[:4, 0]).any():
                found += compared(held)
                held = []
            alone = np.diff(starts) == 1
            last = len(starts) - 2
            alone[0], alone[last] = False, False
            for k in np.flatnonzero(~alone):
                some = rows[:, starts[k] : starts[k + 1]]
                if k == last:
                    held.append(some)
                elif k == 0 and held:
                    found += compared([*held, some])
                    held = []
                elif some.shape[1] > 1:
                    found += compared([some])
            yield batch_of(found)
        if held:
            yield batch_of(compared(held))

    return dealt.mapInArrow(work, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, n_words: int = WORDS, bits: int = NEAR_BITS) -> DataFrame:
    """(doc_id, text_hash, fp, label, component_id, n_links) of each row.

    ``component_id`` is the least doc_id of the component, ``label`` the component's least fingerprint, and
    ``n_links`` the number of its other fingerprints.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_hash"), "text")
    with small_batches(docs.sparkSession):
        rows = written(fingerprints(rows, n_words=n_words), "simhash-rows")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    labels = components(written(links(distinct.select("fp"), bits), "simhash-links"))
    grouped = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    grouped = written(grouped, "simhash-labels")
    least = grouped.groupBy("label").agg(F.min("first_id").alias("component_id"), (F.count(F.lit(1)) - 1).alias("n_links"))
    of_fp = written(grouped.join(least, "label").select("fp", "label", "component_id", "n_links"), "simhash-components")
    return rows.join(of_fp, "fp").select("doc_id", "text_hash", "fp", "label", "component_id", "n_links")


def drop_near_duplicates(docs: DataFrame, n_words: int = WORDS, bits: int = NEAR_BITS) -> DataFrame:
    """The rows that stay, with all their columns: of each component the row with the least id.

    Of rows that repeat that id, the one with the least text hash stays.
    """
    least = near_duplicates(docs, n_words, bits).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = least.groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*").distinct()
    return first_rows(docs, kept)


def first_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each (doc_id, text_hash) of ``kept``: of several the one with the least hash of its columns."""
    rows = docs.select(F.struct("*").alias("row"), row_hash(docs).alias("place"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(whole_text()).alias("own_hash"))
    found = rows.join(kept, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")))
    first = Window.partitionBy("id", "own_hash").orderBy("place")
    return found.select("row", F.row_number().over(first).alias("again")).where("again = 1").select("row.*")

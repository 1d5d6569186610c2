"""Near copies by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

First come SimHash and pigeonhole blocks, as in ``simhash``, on fingerprints of these shingles: 64 bits in seven ``BLOCKS``, filed by
each choice of two, meet all fingerprints that differ in at most ``BLOCK_BITS`` bits. What is linked there and verified is joined to components.
That radius is as wide as pigeonholes can go here: fingerprints of similarity 0.8 differ in about ten bits, up to 22, and for so many no two blocks need
agree. So pairs beyond it, between sets that are not in one component yet, are met in a second step.

That step leaves none out: it is a prefix filter. With all shingles in one order, two sets of similarity t share one of
the first n - ceil(t * n) + 1 shingles of each, so each distinct set is filed under those. Files that hold the same sets are kept once. Any order gives the same
pairs; here shingles that are frequent in a bounded sample come last, so that files stay small.

Each set has SKETCH SimHash fingerprints of its shingles too, of 256 bits together. At a similarity of 0.8 they differ in
about 39 bits, with a deviation of 6 (of sets of five and four shingles: 48), those of sets of similarity 0.2 in 100, those of
unrelated ones in 128, with 8. So pairs that differ in more than ``NEAR_BITS`` bits (small ones: ``SMALL_BITS``), which less than one in a
million such pairs does, go before their sets are read: that is most pairs of a shared passage. So do pairs that what follows a shared shingle leaves too few others to share.

In each of a few TURNS each set is compared with a few pivots of its files that are not in its component yet, and what is
verified is joined to components; later turns have fewer sets left and more pivots. Then all pairs of a file that are still in different components are compared. So n near
copies cost a few n comparisons, and a pair is left out only if it is too unequal in size, without room, too far in bits, or
connected already. Each comparison is of whole sets.

Defined cases: words are lower-cased in ASCII and parted by ASCII white space; a text with fewer words than a
shingle is one shingle; texts without words are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from hydrospark.llm import simhash
from hydrospark.llm.common import about, small_batches, tidy, whole_text
from hydrospark.llm.simhash import _LOWER, SEED, first_rows, majority
from hydrospark.plans.components import components
from hydrospark.plans.scratch import written

WORDS = 5
SIMILARITY = Fraction(4, 5)
SAMPLE = 20_000  # texts that frequent shingles are looked for in
FREQUENT = 100_000  # frequent shingles at most
BLOCKS = (9, 9, 9, 9, 9, 9, 10)  # bits of each block of a fingerprint
BLOCK_BITS = 5  # that fingerprints of a pigeonhole differ in
TURNS = ((4, 2), (16, 8), (64, 16), (256, 32))  # pivots of a file, and how many of them a set is compared with
SKETCH = 4  # fingerprints of 64 bits
NEAR_BITS = 75
SMALL, SMALL_BITS = 8, 80  # sets of fewer shingles, and what they may differ in
EARLY = 6  # first files of a set that its partners know
MOST_SENT = 1_000_000  # keys that are broadcast at most


def shingles(text: str, n_words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    found = text.encode().translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    whole, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= n_words:
        return np.array([digest(whole, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in found))
    return np.unique(np.array([digest(whole[s : e - 1], SEED) for s, e in zip([0, *ends], ends[n_words - 1 :])], np.uint64))


def sketch(found: np.ndarray) -> np.ndarray:
    """SKETCH fingerprints of a set: of its hashes, and of them mixed anew."""
    fps = [majority(found)]
    for k in range(1, SKETCH):
        x = found + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        fps.append(majority(x ^ (x >> np.uint64(31))))
    return np.array(fps, np.uint64)


def key_of(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes())


def prefix(found: np.ndarray, frequent: np.ndarray, ranks: np.ndarray, similarity: Fraction = SIMILARITY) -> np.ndarray:
    """The shingles that a set is filed under. ``frequent`` is in order, ``ranks`` are their places among the last."""
    n = len(found)
    if not n:
        return found
    most = n + (-n * similarity.numerator // similarity.denominator) + 1
    last = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        last = np.where(frequent[at] == found, ranks[at] + 1, 0)
    return found[np.lexsort((found, last))[:most]]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def _sets(texts: DataFrame, n_words: int) -> DataFrame:
    """(key, shingles) of texts (text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, n_words) for t in batch.column(0).to_pylist()]
            keys = np.array([key_of(s) for s in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), _lists(found)], ["key", "shingles"])

    return texts.mapInArrow(tidy(work), "key long, shingles array<long>")


def _frequent(docs: DataFrame, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met in several texts of a sample, by value, with their places by rising count."""
    some = about(docs.select(whole_text().alias("text")), "text", docs.count(), SAMPLE)
    counts = _sets(some, n_words).select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    top = counts.orderBy(F.desc("n"), "s").limit(FREQUENT).toPandas()  # bounded
    values = top["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], (len(top) - 1 - np.arange(len(top)))[order]


def _verified(pairs: DataFrame, distinct: DataFrame, texts: DataFrame, n_words: int, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) that are similar enough, by their whole sets; only texts that are in a pair are read again."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    hashes = written(distinct.join(keys, "key", "left_semi").select("text_hash"), "near-texts")
    some = texts.join(F.broadcast(hashes) if hashes.limit(MOST_SENT + 1).count() <= MOST_SENT else hashes, "text_hash", "left_semi")
    with small_batches(pairs.sparkSession):
        sets = written(_sets(some.select("text"), n_words).dropDuplicates(["key"]), "near-sets")
    side = lambda c: sets.select(F.col("key").alias(c), F.col("shingles").alias(f"of_{c}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    found = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b") - both).alias("any"))
    return found.where(F.col("both") * similarity.denominator >= F.col("any") * similarity.numerator).select("a", "b")


def pigeonholed(distinct: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Pairs (a, b) of ``distinct`` (key, fp) by their first fingerprints: each set with the first one of its fingerprint, and these where fingerprints are linked."""
    of_fp = written(distinct.select("key", F.col("fp")[0].alias("own")).withColumn("first", F.min("key").over(Window.partitionBy("own"))), "near-fingerprints")
    firsts = of_fp.where("key = first").select("own", "key")
    found = simhash.links(firsts.select(F.col("own").alias("fp")), bits, blocks=BLOCKS)
    found = written(found, "near-pigeonholes").join(firsts.select(F.col("own").alias("a"), F.col("key").alias("x")), "a").join(firsts.select(F.col("own").alias("b"), F.col("key").alias("y")), "b")
    found = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return found.unionByName(of_fp.where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b")))


def links(distinct: DataFrame, texts: DataFrame, n_words: int = WORDS, similarity: Fraction = SIMILARITY, most_bits: int = NEAR_BITS, small_bits: int = SMALL_BITS) -> DataFrame:
    """(node, label) of the sets that are similar to others. ``distinct`` (key, n, fp, prefix, text_hash) are the sets, each with one of its texts, ``texts`` (text_hash, text) all."""
    filed, whole = distinct.select(F.posexplode("prefix").alias("at", "file"), "key"), Window.partitionBy("file")
    # most sets share no file, so what is compared is joined to those that do
    filed = filed.withColumn("members", F.count(F.lit(1)).over(whole)).withColumn("of", F.bit_xor(F.xxhash64("key")).over(whole)).where("members > 1")
    # files of the same sets become one, where a set has the first of its places
    filed = filed.select("key", "at", F.xxhash64("members", "of").alias("file")).repartition("key").groupBy("key", "file").agg(F.min("at").alias("at"))
    filed = filed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "file"))).alias("files")).join(distinct.select("key", "n", "fp"), "key")
    filed = filed.select("key", "n", "fp", F.slice("files.file", 1, EARLY).alias("early"), F.inline("files"))
    filed = written(filed, "near-files")
    num, den = similarity.numerator, similarity.denominator
    wide = (F.least("n", "m") * den) >= (F.greatest("n", "m") * num)
    # the first shingle that two sets share leaves them room for no more than what follows it
    room = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("be")) * (num + den) >= (F.col("n") + F.col("m")) * num
    close = sum(F.bit_count(F.col("fp")[i].bitwiseXOR(F.col("fq")[i])) for i in range(SKETCH)) <= F.when(F.least("n", "m") < SMALL, small_bits).otherwise(most_bits)
    # a pair that shares files among the first of both counts in the first of them alone
    once = F.coalesce(F.get(F.array_intersect("early", "ahead"), F.lit(0)), "file") == F.col("file")
    able = (F.col("label") != F.col("beside")) & wide & room & close & once
    beside = [F.col("key").alias("other"), F.col("n").alias("m"), F.col("at").alias("be"), F.col("fp").alias("fq"), F.col("early").alias("ahead"), F.col("label").alias("beside")]
    pair = [F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")]

    def left(labels: DataFrame) -> DataFrame:
        joined = filed.join(labels, filed["key"] == labels["node"], "left").select(*filed.columns, F.coalesce("label", "key").alias("label"))
        # files that are in one component already need no more
        mixed = joined.groupBy("file").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("file")
        return written(joined.join(mixed, "file", "left_semi"), "near-labelled")

    tried = written(pigeonholed(distinct), "near-pairs")
    found = written(_verified(tried, distinct, texts, n_words, similarity), "near-links")
    labelled = left(components(found, "near-labels"))
    for turn, (pivots_of_file, partners) in enumerate(TURNS):
        order = Window.partitionBy("file").orderBy(F.xxhash64(F.lit(turn), "key"), "key")
        pivots = labelled.withColumn("place", F.row_number().over(order)).where(F.col("place") <= pivots_of_file).select("file", *beside)
        near = labelled.join(pivots, "file").where(able).select("key", "other").distinct()
        few = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(turn), "other"), "other")
        pairs = near.withColumn("place", F.row_number().over(few)).where(F.col("place") <= partners).select(*pair).distinct()
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        more = written(_verified(pairs, distinct, texts, n_words, similarity), "near-links")
        tried, found = tried.unionByName(pairs), found.unionByName(more)
        if turn and not more.limit(1).count():
            break
        labelled = left(components(found, "near-labels"))
    rest = labelled.join(labelled.select("file", *beside), "file").where((F.col("key") < F.col("other")) & able).select(*pair).distinct()
    rest = written(rest.join(tried, ["a", "b"], "left_anti"), "near-rest")
    last = written(_verified(rest, distinct, texts, n_words, similarity), "near-more")
    return components(found.unionByName(last), "near-all")


def near_copies(docs: DataFrame, n_words: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, label) of each row: equal labels are near copies, or linked by such."""
    frequent, ranks = _frequent(docs, n_words)
    sent = docs.sparkSession.sparkContext.broadcast((frequent, ranks))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, ranks = sent.value
        for batch in batches:
            found = [shingles(t, n_words) for t in batch.column(2).to_pylist()]
            keys = np.array([key_of(s) for s in found], np.uint64).view(np.int64)
            first = _lists([prefix(s, frequent, ranks, similarity) for s in found])
            fps = _lists([sketch(s) for s in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys), pa.array([len(s) for s in found], pa.int32()), fps, first], ["doc_id", "text_hash", "key", "n", "fp", "prefix"])

    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_hash"), whole_text().alias("text"))
    with small_batches(docs.sparkSession):
        rows = written(hashed.mapInArrow(tidy(work), "doc_id long, text_hash long, key long, n int, fp array<long>, prefix array<long>"), "near-rows")
    distinct = rows.groupBy("key").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"), F.min("text_hash").alias("text_hash"))
    labels = links(distinct, hashed.select("text_hash", "text"), n_words, similarity)
    return rows.join(labels, rows["key"] == labels["node"], "left").select("doc_id", "text_hash", F.coalesce("label", "key").alias("label"))


def drop_near_copies(docs: DataFrame, n_words: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """The rows that stay, with all their columns: of each component the row with the least id, or least text hash where ids repeat; a null id is smaller than none."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    return first_rows(docs, near_copies(docs, n_words, similarity).groupBy("label").agg(least.alias("k")).select("k.doc_id", "k.text_hash"))

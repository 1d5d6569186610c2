"""Phrase collocations by stripes: each prefix keys a counter of the words that follow it.

The empty prefix counts words, a prefix of one word counts pairs, one of two words triples. Stripes are built for
lots of documents (``lots``), merged element by element in buckets, and the lots learn which of their extensions
are frequent, with their counts. An extension of a longer prefix can only be frequent if both phrases that it
overlaps are, so the next round sends stripes for these alone. A prefix's total is the count that the round
before gave it, and its longest extension is the maximum of its stripe, so one structure holds all that scores need.

A stripe of a prefix that is frequent everywhere is dealt over drawers by a hash of the next word, as many as the
prefix's count (known from the round before) asks for; the empty prefix has a drawer in every bucket. So no
counter grows beyond a bound, whatever word the data has most of.

Defined cases: a null text is empty; a null lang is ``und``, together with rows that say so; repeated rows count as
often as they are there; a table without candidates gives no rows; phrases do not cross pieces or documents; other
columns of any name do not matter; a text of any length is worked on whole, as numbers of its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from hydrospark.llm.lots import asked, dropping_shuffles, lots_of, met, texts_of
from hydrospark.plans.scratch import written

MIN_COUNT = 10
MOST_WORDS = 3
SHARE = 50  # percent of a phrase's occurrences in a longer one from which the longer one stands for it
TOP = 2000
DRAWER = 1 << 20  # occurrences of a prefix for each of its drawers
BUCKET_BYTES = 8 << 20  # of text for each bucket
PARTS = 256  # of a lang, that are sorted apart
_BREAK = b"."
# lower case for A-Z; all that ends a piece becomes a full stop
_TABLE = bytearray(range(256))
for _c in range(65, 91):
    _TABLE[_c] = _c + 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = _BREAK[0]
_TABLE = bytes(_TABLE)


class Numbers(dict):
    """Words to numbers in the order of their first sight; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({_BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words_by_lang(table: pa.Table) -> Iterator[tuple[str, Numbers, np.ndarray]]:
    """Of each lang of a lot: the numbers of its words, and its texts as numbers of words, 0 between pieces."""
    langs, texts = np.array(table.column("lang").to_pylist(), object), texts_of(table)
    order = np.argsort(langs.astype(str), kind="stable")
    for own in np.split(order, np.flatnonzero(langs[order][1:] != langs[order][:-1]) + 1) if len(order) else []:
        numbers = Numbers()
        found = [np.zeros(1, np.int64)]
        for i in own:
            tokens = texts[i].translate(_TABLE).replace(_BREAK, b" . ").split()  # bytes split at ASCII white space alone
            found += [np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens)), np.zeros(1, np.int64)]
        yield langs[own[0]], numbers, np.concatenate(found)


def packed(words: pa.Array, starts: np.ndarray) -> pa.Array:
    """Words, in runs that begin at ``starts`` (and end at the last of them), each run as one binary; no word has a line feed."""
    return pc.binary_join(pa.LargeListArray.from_arrays(starts, words), b"\n")


def bytes_of(numbers: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The same of numbers."""
    data = np.ascontiguousarray(numbers)
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer((starts * data.itemsize).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


STRIPES = "bucket int, lot int, lang string, prefix binary, nexts binary, counts binary"
ANSWERS = "lot int, lang string, prefix binary, nexts binary, counts binary"
_TYPES = {"bucket": pa.int32(), "lot": pa.int32(), "lang": pa.string(), "prefix": pa.binary(), "nexts": pa.binary(), "counts": pa.binary()}


def rows_of(parts: list[dict], names: list[str]) -> pa.Table:
    """Columns that come in parts, one under the other."""
    return pa.table({c: pa.chunked_array([pa.array(p[c], _TYPES[c]) for p in parts], _TYPES[c]) for c in names})


def stripes_of(lot: int, lang: str, buckets: int, prefixes: list[bytes], drawers: np.ndarray, starts: np.ndarray, nexts: pa.Array, counts: np.ndarray) -> dict:
    """Rows of stripes: a prefix and a drawer for each run of next words and counts."""
    at = [xxhash.xxh64_intdigest(b"%s\n%s\n%d" % (lang.encode(), p, d)) % buckets for p, d in zip(prefixes, drawers.tolist())]
    return {"bucket": at, "lot": [lot] * len(at), "lang": [lang] * len(at), "prefix": prefixes, "nexts": packed(nexts, starts), "counts": bytes_of(counts.astype(np.int32), starts)}


def words(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """A lot to the stripe of the empty prefix, a drawer for each bucket."""

    def ask(table: pa.Table) -> pa.Table:
        parts = []
        for lang, vocabulary, numbers in words_by_lang(table):
            own = list(vocabulary)[1:]
            counts = np.bincount(numbers, minlength=len(vocabulary))[1:]
            drawer = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own)) % np.uint64(buckets)
            order = np.argsort(drawer, kind="stable")
            held, starts = np.unique(drawer[order], return_index=True)
            parts.append(stripes_of(table.column("lot")[0].as_py(), lang, buckets, [b""] * len(held), held, np.append(starts, len(own)), pa.array(own, pa.binary()).take(pa.array(order)), counts[order]))
        return rows_of(parts, list(_TYPES))

    return ask


def merge(least: int) -> Callable[[pa.Table], pa.Table]:
    """A bucket's stripes, merged element by element: to each lot the extensions it has that are ``least`` or more in all, once all such
    (lot -1), and the total of each stripe, as text (lot -2)."""

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = pc.split_pattern(table.column("nexts").combine_chunks(), b"\n")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        nexts = lists.flatten()
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int32)
        row = np.repeat(np.arange(len(sizes)), sizes)
        stripe_of, known = Numbering(), list(zip(table.column("lang").to_pylist(), table.column("prefix").to_pylist()))
        stripe = np.fromiter(map(stripe_of.__getitem__, known), np.int64, len(known))
        # an element of a stripe: its number and that of the next word
        word = pc.dictionary_encode(nexts).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, first, element = np.unique(stripe[row] << 32 | word, return_index=True, return_inverse=True)
        sums = np.bincount(element, counts, len(first)).astype(np.int64)  # exact below 2^53
        stripes = list(stripe_of)

        def part(lots: list[int], of: list[int], at: np.ndarray, runs: np.ndarray, totals: np.ndarray) -> dict:
            """Rows of the elements that stand at ``at``, in runs."""
            return {"lot": lots, "lang": [stripes[i][0] for i in of], "prefix": [stripes[i][1] for i in of], "nexts": packed(nexts.take(pa.array(at)), runs), "counts": bytes_of(totals, runs)}

        def cut(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            held, starts = np.unique(group, return_index=True)
            return held, np.append(starts, len(group))

        often = np.flatnonzero(sums >= least)  # in the order of stripes
        held, runs = cut(stripe[row[first[often]]])
        parts = [part([-1] * len(held), held.tolist(), first[often], runs, sums[often])]
        total = np.bincount(stripe[row], counts, len(stripes)).astype(np.int64).tolist()
        parts.append({"lot": [-2] * len(stripes), "lang": [s[0] for s in stripes], "prefix": [s[1] for s in stripes], "nexts": [b"%d" % n for n in total], "counts": [b""] * len(stripes)})
        live = np.flatnonzero(sums[element] >= least)
        held, runs = cut(row[live])
        lots = table.column("lot").to_numpy()
        parts.append(part(lots[held].tolist(), stripe[held].tolist(), live, runs, sums[element[live]]))
        return rows_of(parts, list(_TYPES)[1:])

    return meet


class Numbering(dict):
    """Keys to numbers in the order of their first sight."""

    def __missing__(self, key: tuple) -> int:
        self[key] = n = len(self)
        return n


def answers_of(answers: pa.Table) -> dict[str, list[tuple[bytes, list[bytes], np.ndarray]]]:
    """The answers to a lot by lang: (prefix, next words, counts)."""
    found: dict[str, list] = {}
    for lang, prefix, nexts, counts in zip(*(answers.column(c).to_pylist() for c in ("lang", "prefix", "nexts", "counts"))):
        found.setdefault(lang, []).append((prefix, nexts.split(b"\n"), np.frombuffer(counts, np.int64)))
    return found


def places_of(phrases: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of a text the number of the phrase that starts there, -1 if none does; and the place in ``phrases`` (a row of
    numbers of words each) that each number stands for. Word by word, a phrase's number comes from that of its beginning and the next word."""
    rank, at = phrases[:, 0], numbers
    table, first, rank = np.unique(rank, return_index=True, return_inverse=True)
    look = np.full(int(max(numbers.max(initial=0), table.max(initial=0))) + 1, -1, np.int64)
    look[table] = np.arange(len(table))
    at = look[at]
    for j in range(1, phrases.shape[1]):
        table, first, rank = np.unique(rank << 32 | phrases[:, j], return_index=True, return_inverse=True)
        begun = np.flatnonzero(at[: len(at) - j] >= 0) if len(at) > j else np.empty(0, np.int64)
        want = at[begun] << 32 | numbers[begun + j]
        there = np.searchsorted(table, want)
        hit = table[np.minimum(there, len(table) - 1)] == want
        at = np.full(len(numbers), -1, np.int64)
        at[begun[hit]] = there[hit]
    return at, first


def longer(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A lot and its frequent phrases, all of one length, to the stripes of prefixes of that length: their extensions whose
    last words, without the first one, are a frequent phrase too."""

    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        known, parts = answers_of(answers) if table.num_rows else {}, []
        for lang, of_word, numbers in words_by_lang(table) if known else []:
            if lang not in known:
                continue
            # each frequent phrase by the numbers of its words, with its count
            rows = [[*map(of_word.__getitem__, prefix.split()), of_word[w]] for prefix, nexts, _ in known[lang] for w in nexts]
            phrases, totals = np.array(rows, np.int64), np.concatenate([c for _, _, c in known[lang]])
            n, vocabulary = phrases.shape[1], list(of_word)
            at, place = places_of(phrases, numbers)
            both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
            codes, counts = np.unique(at[both] << 32 | numbers[both + n], return_counts=True)
            prefix, word = codes >> 32, codes & 0xFFFFFFFF
            drawers = 1 + totals[place[prefix]] // DRAWER
            drawer = np.zeros(len(codes), np.int64)
            for i in np.flatnonzero(drawers > 1).tolist():
                drawer[i] = xxhash.xxh64_intdigest(vocabulary[word[i]]) % int(drawers[i])
            order = np.lexsort((drawer, prefix))
            prefix, word, counts, drawer = prefix[order], word[order], counts[order], drawer[order]
            new = np.ones(len(codes), bool)
            new[1:] = (prefix[1:] != prefix[:-1]) | (drawer[1:] != drawer[:-1])
            starts = np.flatnonzero(new)
            names = [b" ".join([vocabulary[k] for k in own]) for own in phrases[place[prefix[starts]]].tolist()]
            nexts = pa.array(vocabulary, pa.binary()).take(pa.array(word))
            parts.append(stripes_of(table.column("lot")[0].as_py(), lang, buckets, names, drawer[starts], np.append(starts, len(codes)), nexts, counts))
        return rows_of(parts, list(_TYPES))

    return ask


def counted(found: DataFrame) -> DataFrame:
    """(lang, phrase, n, words) of all frequent phrases of merged stripes."""
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases, numbers = [], [], []
            for lang, prefix, nexts, counts in zip(*(c.to_pylist() for c in batch.columns)):
                own = nexts.split(b"\n")
                phrases += [(prefix + b" " + w if prefix else w).decode() for w in own]
                numbers.append(np.frombuffer(counts, np.int64))
                langs += [lang] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(np.concatenate(numbers) if numbers else [], pa.int64())], ["lang", "phrase", "n"])

    return found.where("lot = -1").select("lang", "prefix", "nexts", "counts").mapInArrow(spell, "lang string, phrase string, n long")


def stripes(docs: DataFrame, least: int = MIN_COUNT, most_words: int = MOST_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and for each length from 1 to ``most_words`` the phrases (lang, phrase, n) that occur
    ``least`` times or more. Each is a written table."""
    lots, n_bytes = lots_of(docs, lang=F.coalesce(F.col("lang").cast("string"), F.lit("und")))
    buckets = max(1, -(-n_bytes // BUCKET_BYTES))
    found = []
    with dropping_shuffles(docs.sparkSession):
        for k in range(most_words):
            sent = asked(lots, longer(buckets), STRIPES, merged.where("lot >= 0")) if k else asked(lots, words(buckets), STRIPES)
            merged = written(met(sent, merge(least), ANSWERS), "stripes")
            found.append(merged)
    sums = found[0].where("lot = -2").select("lang", F.col("nexts").cast("string").cast("long").alias("n"))
    totals = sums.groupBy("lang").agg(F.sum("n").alias("n"))
    return totals, [counted(f) for f in found]


def collocations(docs: DataFrame, least: int = MIN_COUNT, most_words: int = MOST_WORDS, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first ``top`` phrases of 2 to ``most_words`` words.

    ``score`` is floor(1000000 a a / (l r)) for the cut of a phrase (l times the first part, r times the rest) where it is
    least; ties go to the cut after fewer words. A phrase inside of a longer one with ``share`` percent of its
    occurrences or more goes. Products are decimals of 38 digits, so they are exact for counts below 10^15.
    """
    totals, by_length = stripes(docs, least, most_words)
    phrases = by_length[0]
    for more in by_length[1:]:
        phrases = phrases.unionByName(more)
    phrases = written(phrases.withColumn("w", F.split("phrase", " ")).withColumn("size", F.size("w")), "phrases")
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    candidates = phrases.where("size > 1")
    # what a phrase's parts occur is at least what it occurs itself, so they are all in the table
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    of = lambda name, value: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(value))
    scored = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    exact = "cast({0} as decimal(19,0))"
    scored = scored.withColumn("score", F.expr(f"(cast({exact.format('a')} * {exact.format('a')} * 1000000 as decimal(38,0))) div (cast({exact.format('l')} * {exact.format('r')} as decimal(38,0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("s")).select("lang", "phrase", "s.a", "s.l", "s.r", "s.score")
    # the most that a longer phrase around each phrase occurs
    inner = candidates.where("size > 2").select("lang", "n", "w", "size", F.explode(F.expr("sequence(2, size - 1)")).alias("m")).select("lang", "n", "w", "m", F.explode(F.expr("sequence(1, size - m + 1)")).alias("at"))
    around = inner.select("lang", part(F.col("at"), F.col("m")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longest"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.coalesce(F.col("longest") * 100 < F.col("a") * share, F.lit(True)))
    # the first of each of a lang's parts are all that can be among its first, so no task sorts a whole lang
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    parts = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = parts.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = """
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT r, lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece, generate_subscripts(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]'), 1) AS p FROM d),
    q AS (SELECT r, p, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
    v AS (SELECT r, p, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM q),
    x AS (SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM v WINDOW o AS (PARTITION BY r, p ORDER BY i)),
    o AS (SELECT lang, 1 AS size, w AS phrase FROM x UNION ALL SELECT lang, 2, w || ' ' || w2 FROM x WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM x WHERE w3 IS NOT NULL),
    f AS (SELECT lang, size, phrase, count(*) AS n FROM o GROUP BY lang, size, phrase),
    t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
    c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
    k AS (SELECT lang, size, phrase, a, i AS k, array_to_string(w[1:i], ' ') AS x, array_to_string(w[i + 1:size], ' ') AS y FROM c, generate_series(1, 2) AS g(i) WHERE i < size),
    s AS (SELECT k.*, l.n AS l, r.n AS r, ((1000000::HUGEINT * a * a) // (l.n::HUGEINT * r.n))::BIGINT AS score FROM k JOIN f l ON l.lang = k.lang AND l.phrase = x JOIN f r ON r.lang = k.lang AND r.phrase = y),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS again FROM s) WHERE again = 1),
    m AS (SELECT lang, phrase, max(n) AS longest FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a AS n FROM c WHERE size = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE size = 3) GROUP BY lang, phrase),
    e AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN m ON b.lang = m.lang AND b.phrase = m.phrase WHERE longest IS NULL OR 100 * longest < 50 * a)
    SELECT e.lang, rank, phrase, a, l, r, t.n, score FROM e JOIN t ON t.lang = e.lang WHERE rank <= 2000"""

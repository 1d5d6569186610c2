"""Substring dedup against brute force over all windows, on cases of every alignment and on odd rows."""

import random

import pytest

from hydrospark.llm import lots, substrings
from hydrospark.llm.catalog import QUERIES

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, window=13):
    """(doc_id, words, kept words) of each row."""
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, words in texts:
        for s in range(len(words) - window + 1):
            key, own = tuple(words[s : s + window]), float("-inf") if i is None else i
            least[key] = min(least.get(key, own), own)
    out = []
    for i, words in texts:
        gone = set()
        for s in range(len(words) - window + 1):
            if least[tuple(words[s : s + window])] < (float("-inf") if i is None else i):
                gone |= set(range(s, s + window))
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=repr)


def found(spark, rows, window=13):
    df = spark.createDataFrame([(i, t, None) for i, t in rows], SCHEMA)
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.without_repeats(df, window).collect()), key=repr)


def some_rows(seed, n=60):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passages = [[word() for _ in range(k)] for k in (12, 13, 14, 20, 26, 60)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(0, 80))]
        for p in rng.sample(passages, rng.randrange(0, 4)):
            at = rng.randrange(len(words) + 1)
            a = rng.randrange(0, len(p) // 2)
            words[at:at] = p[a:] if rng.random() < 0.5 else p
        rows.append((i * 7 % n, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(lots, "LOT_BYTES", 3000)  # several lots
    monkeypatch.setattr(substrings, "BUCKET_PROBES", 500)  # several buckets
    rows = some_rows(seed)
    got = found(spark, rows)
    assert got == brute(rows) and any(r[2] for r in got)


def test_all_alignments_and_lengths(spark):
    base = [f"a{k}" for k in range(40)]
    rows = [(0, " ".join(base))]
    for shift in range(14):
        for size in (12, 13, 15):
            rows.append((100 + len(rows), " ".join([f"x{len(rows)}y{k}" for k in range(shift)] + base[shift : shift + size] + ["end"])))
    got = {r[0]: r[2] for r in found(spark, rows)}
    want = {r[0]: r[2] for r in brute(rows)}
    assert got == want and {want[r[0]] for r in rows[1:]} >= {0, 13, 15}


def test_other_window_lengths(spark):
    rows = some_rows(3, 30)
    assert found(spark, rows, 6) == brute(rows, 6) and found(spark, rows, 1) == brute(rows, 1)


def test_repeats_are_maximal_and_inner_ones_stay(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(5, f"one two {passage} three"), (9, f"{passage} x {passage}"), (2, f"{passage} {passage}")]
    df = spark.createDataFrame([(i, t, "a") for i, t in rows], SCHEMA)
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in substrings.without_repeats(df).collect()}
    assert spans == {5: [(2, 22)], 9: [(0, 20), (21, 41)], 2: []}


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lots, "LOT_BYTES", 400)
    text = " ".join(f"t{k}" for k in range(15))
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, text), (None, text), (4, text), (4, text), (7, f"é b {text}\x0b\x0c\r"), (-3, text), (8, "ab " * 30)]
    df = spark.createDataFrame([(i, t, "n", 1, 2) for i, t in rows], "doc_id long, text string, lot string, bucket int, codes int")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.without_repeats(df).collect()), key=repr)
    assert got == brute(rows)
    assert substrings.without_repeats(df.limit(0)).collect() == []


def test_a_very_long_text_and_a_hot_passage(spark):
    rng = random.Random(5)
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(200_000))
    passage = " ".join(f"h{k}" for k in range(50))
    rows = [(0, f"start {passage}"), (1, long), (2, long + " more")] + [(10 + k, f"own{k} {passage} tail{k}") for k in range(300)]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.without_repeats(spark.createDataFrame([(i, t, None) for i, t in rows], SCHEMA)).collect()}
    assert got[0] == got[1] == 0 and got[2] == 200_000 and all(got[10 + k] == 50 for k in range(300))


def test_query_equals_brute_force(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows))
    assert sorted(map(tuple, QUERIES["op11_substrings"](spark, sf).collect())) == want

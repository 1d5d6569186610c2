"""Phrase collocations against counters over all phrases, in exact integers."""

import random
import re
from collections import Counter

import pytest

from hydrospark.llm import lots, phrases
from hydrospark.llm.catalog import QUERIES

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least=10, most_words=3, share=50, top=2000):
    """Rows (text, lang) to the contract's rows."""
    lower = {i: i + 32 for i in range(65, 91)}
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, most_words + 1):
                for i in range(len(words) - n + 1):
                    count[lang, tuple(words[i : i + n])] += 1
    candidates = {k: n for k, n in count.items() if len(k[1]) > 1 and n >= least}
    gone = set()
    for (lang, words), n in candidates.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                inner = (lang, words[i : i + m])
                if inner in candidates and 100 * n >= share * candidates[inner]:
                    gone.add(inner)
    out = []
    for (lang, words), a in candidates.items():
        if (lang, words) in gone:
            continue
        cuts = [(1000000 * a * a // (count[lang, words[:k]] * count[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, count[lang, words[:k]], count[lang, words[k:]], total[lang], score))
    found = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        found += [(o[0], i + 1, *o[1:]) for i, o in enumerate(own[:top])]
    return sorted(found)


def found(df, **how):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in phrases.collocations(df, **how).collect())


def some_rows(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"W{k}" for k in range(12)] + ["New", "york", "CITY", "é", "a b"]
    ends = [" ", " ", " ", " ", "\t ", ". ", ",", "\n", "! "]
    text = lambda: "".join(rng.choice(["new York city", rng.choice(vocabulary), rng.choice(vocabulary[:4])]) + rng.choice(ends) for _ in range(rng.randrange(30)))
    return [(text(), rng.choice(["en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(lots, "LOT_BYTES", 2000)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(phrases, "DRAWER", 40)  # hot prefixes have several drawers
    rows = some_rows(seed)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    got = found(df)
    assert got == brute(rows) and len(got) > 20
    assert found(df, top=3) == brute(rows, top=3)


def test_longer_phrases(spark):
    rows = some_rows(7, 60)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    assert found(df, most_words=4, least=4, share=80) == brute(rows, most_words=4, least=4, share=80)


def test_odd_rows(spark):
    rows = [(None, "en"), ("", "en"), ("  \t", None), (". . .", "en"), *[("Ab cd", None)] * 12, ("ab cd " * 5000, "und"), ("x y. x y, " * 10, "fr")]
    df = spark.createDataFrame([(None, *r, 1, "q") for r in rows], SCHEMA + ", lot int, phrase string")
    assert found(df) == brute(rows) and found(df)
    assert found(df.limit(0)) == [] and found(df.where("lang = 'en'")) == []


def test_large_counts_are_exact(spark):
    n = 10**9
    assert spark.sql(f"SELECT (cast(cast({n + 1} as decimal(19,0)) * cast({n + 1} as decimal(19,0)) * 1000000 as decimal(38,0))) div (cast(cast({n + 7} as decimal(19,0)) * cast({n + 9} as decimal(19,0)) as decimal(38,0))) AS s").first()["s"] == 1000000 * (n + 1) ** 2 // ((n + 7) * (n + 9))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_phrases"](spark, sf).collect())) == brute(rows)

"""The near-copy stage of the pipeline against brute-force similarity of word shingles."""

import random

import corpus_pipeline
from hydrospark.llm import near_copies, simhash
from hydrospark.llm.common import documents
from tests.llm.test_corpus import SCHEMA

SF = "/root/testdata/sf0.001"


def brute_kept(rows):
    """Least doc_id of each component of texts with a Jaccard similarity of 0.8 or more."""
    sets = {}
    for d, text in rows:
        w = (text or "").encode().lower().split()
        sets[d] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return sorted({root(d) for d in ids})


def kept(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in rows], SCHEMA)
    found = corpus_pipeline.near_copies(spark, docs, SF)
    assert found.columns == docs.columns
    return sorted(r["doc_id"] for r in found.collect())


def test_tables_as_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF).collect()]
    want = brute_kept(rows)
    assert kept(spark, rows) == want and len(want) < len(rows)


def test_chains_groups_and_boilerplate(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(4000)}"
    legal = [word() for _ in range(40)]
    rows, n = [(0, None), (1, "  "), (2, "one two"), (3, "ONE  two")], 10
    for g in range(25):
        base = [word() for _ in range(rng.choice((8, 30, 60, 200)))]
        for _ in range(rng.choice((1, 2, 12))):
            some = list(base)
            for _ in range(rng.randrange(0, 3)):
                some[rng.randrange(len(some))] = word()
            if g % 3 == 0:
                base = some  # a chain, whose ends are less alike
            rows.append((n, " ".join(legal + some if g % 2 else some)))
            n += 1
    rng.shuffle(rows)
    want = brute_kept(rows)
    assert 30 < len(want) < len(rows)
    assert kept(spark, rows) == want


def test_pigeonholes_come_first(spark, monkeypatch):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), k)) for f in fps[:20] for k in (1, 4, 5)]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    distinct = spark.createDataFrame([(k, [signed(f), 0]) for k, f in enumerate([*fps, fps[0]])], "key long, fp array<long>")
    parent = list(range(len(fps) + 1))
    root = lambda d: d if parent[d] == d else root(parent[d])
    for r in near_copies.pigeonholed(distinct).collect():
        assert r["a"] < r["b"]
        parent[root(r["b"])] = root(r["a"])
    # every set within five bits of another is linked to it
    assert all(root(40 + 3 * i + k) == root(i) for i in range(20) for k in range(3)) and root(len(fps)) == root(0)
    assert len({root(i) for i in range(40)}) == 40
    # rows that stay come through simhash.links with these blocks
    seen, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *args, **named: (seen.append(named["blocks"]), links(*args, **named))[1])
    base = " ".join(f"w{i}" for i in range(300))
    assert kept(spark, [(1, base), (2, base + " x"), (3, "other words that are here alone now")]) == [1, 3]
    assert seen == [near_copies.BLOCKS] and sum(near_copies.BLOCKS) == 64

"""Corpus operators against brute force, exact round trips and odd inputs."""

import base64
import hashlib
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hydrospark.llm import bpe, catalog, exact_dedup, fingerprints, mixing, pii, quality, sharding, simhash, token_files, toxicity
from tests.llm.test_phrases import brute as phrases_of

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "The quick brown fox.\nIt's  a test   of  white\t space   and　more!! 12345 don't", "en", "a", 9), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "   ", "en", None, 3),
    (5, "x" * 5000, "en", "b", 5000), (6, "the same text, twice over and over again, for everyone to read", "en", "a", 1), (7, "the same text, twice over and over again, for everyone to read", "fr", "b", 1),
    (7, "the same text, twice over and over again, for everyone to read", "fr", "b", 1), (None, "a row without an id", "en", "a", 1), (9, "é日本語 \U0001f600 " * 50 + "<|endoftext|>", "ja", "c", 1),
    (10, "write to ann.lee+x@mail.example.co.uk or +1 (414) 555-7134, 4602-8008 0748 5450, 10.0.255.1, 300.1.1.1, 1.2.3.4.5, 4602800807485451", "en", "c", 1),
    (11, "The Quick brown fox.\nit's a test of white space and more!! 12345 don't", "en", "c", 1),
]

TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    """A folder of tables with odd rows, extra columns of clashing names, and odd labels."""
    path = str(tmp_path_factory.mktemp("odd"))
    odd.select("*", *[F.lit(1).alias(c) for c in ("h", "key", "size", "shard", "row", "label", "score", "fp", "base", "digest", "ids")]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, None, None), (None, 0, 1), (6, 0, 1), (6, 0, 1), (10, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    turns = [(1, 0, "user", "a."), (1, 0, "user", "a."), (None, None, None, None), (2, 5, "tool", ""), (2, None, "system", "x" * 5000)]
    spark.createDataFrame([(*t, 1, "q") for t in turns], f"{TURNS}, copy int, audit string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="module")
def nothing(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nothing"))
    odd.where("false").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], TURNS).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_odd_rows_and_no_rows(spark, folder, nothing, name):
    # conversations have a row each, phrases those that are found
    rows = {"op12_conversation_repair": 3, "op13_phrases": len(phrases_of([r[1:3] for r in ODD]))}.get(name, len(ODD))
    assert rows and catalog.QUERIES[name](spark, folder).count() == rows
    assert catalog.QUERIES[name](spark, nothing).count() == 0


def text_of(rows):
    return [(r["doc_id"], r["text"] or "") for r in rows]


# --- fingerprints


def test_entropy_is_that_of_each_window():
    data = np.frombuffer(b"the cat sat on the mat, the cat sat still aaaaaaaaaaaaaaaaaaaaaaaa \x00\xff", np.uint8)
    got = fingerprints.entropy_bins(data)
    for i in range(len(data) - fingerprints.WINDOW + 1):
        p = np.unique(data[i : i + fingerprints.WINDOW], return_counts=True)[1] / fingerprints.WINDOW
        assert abs(got[i] - fingerprints.BINS * -(p * np.log2(p)).sum() / np.log2(fingerprints.WINDOW)) <= 1.01


def test_features_do_not_depend_on_what_stands_beside_or_on_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 110, n).astype(np.uint8)) for n in (5, 16, 17, 40, 300, 5000)]
    ranks = fingerprints.ranks_of(fingerprints.count_bins(texts))
    each = [fingerprints.features([t], ranks)[1].tolist() for t in texts]
    owner, found = fingerprints.features(texts, ranks)
    assert [found[owner == i].tolist() for i in range(len(texts))] == each
    monkeypatch.setattr(fingerprints, "PIECE", 64)
    owner, found = fingerprints.features(texts, ranks)
    assert [found[owner == i].tolist() for i in range(len(texts))] == each
    assert (fingerprints.ranks_of(fingerprints.count_bins(texts)) == ranks).all()


def test_likeness():
    rng = np.random.default_rng(1)
    a, b = (bytes(rng.integers(97, 120, 3000).astype(np.uint8)) for _ in range(2))
    ranks = fingerprints.ranks_of(fingerprints.count_bins([a, b]))
    x, y, half, none = fingerprints.chains([a, b, a[:1500] + b[1500:], b""], ranks)
    assert fingerprints.likeness(x, x) == 1 and fingerprints.likeness(none, none) == 1 and fingerprints.likeness(x, none) == 0
    assert fingerprints.likeness(x, y) < 0.1 and 0.3 < fingerprints.likeness(x, half) < 0.7
    again = fingerprints.from_string(fingerprints.as_string(half))
    assert fingerprints.likeness(again, half) == 1 and fingerprints.likeness(x, half) == fingerprints.likeness(half, x)


def test_fingerprint_query(spark, docs):
    rows = sorted(text_of(docs.collect()))
    got = sorted(catalog.op1_fingerprints(spark, SF).collect(), key=lambda r: r["doc_id"])
    for i, r in enumerate(got):
        text, after = rows[i][1], rows[(i + 1) % len(rows)][1]
        changed = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
    assert np.mean([r["near_edited"] for r in got]) > 0.6 and np.mean([r["near_next"] for r in got]) < 0.1
    by_text = {}
    for (_, text), r in zip(rows, got):
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]


def test_blocks_hold_each_successor(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_BLOCK", 7)
    rows = spark.createDataFrame([(i * 3 % 101, f"text {i}") for i in range(101)], "doc_id long, text string")
    got = fingerprints.in_blocks(rows).collect()
    assert len({r["block"] for r in got}) > 5
    after = {}
    for p, q in zip(got, got[1:]):
        if p["block"] == q["block"] and not p["tail"]:
            after[p["doc_id"]] = q["doc_id"]
    assert after == {i: (i + 1) % 101 for i in range(101)}


def test_fingerprint_keeps_columns(spark, odd):
    assert fingerprints.fingerprint(odd).columns == [*odd.columns, "fingerprint"]


# --- sharding


def test_room_tree_is_a_sorted_list():
    rng = np.random.default_rng(2)
    tree, plain = sharding.RoomTree(), []
    for _ in range(3000):
        key = (int(rng.integers(0, 300)),)
        if key in plain:
            tree.remove(key)
            plain.remove(key)
        else:
            tree.add(key)
            plain.append(key)
        probe = (int(rng.integers(0, 310)),)
        assert tree.ceiling(probe) == min((k for k in plain if k >= probe), default=None)
        assert tree.largest() == max(plain, default=None)

    def depth(t):
        return 1 + max(depth(t[2]), depth(t[3])) if t else 0

    assert depth(tree.root) <= 2 * np.log2(len(plain) + 1) + 1


def test_best_fit_takes_the_tightest_bin():
    assert sharding.best_fit_bins([6, 5, 4, 3, 2], 10) == [0, 1, 0, 1, 1]
    assert sharding.best_fit_bins([20, 3, 3], 5) == [0, 1, 2]
    assert sharding.best_fit([5, 4, 3], [5, 4, 3]) == [0, 1, 2]


def test_shards(spark, docs):
    texts = dict(text_of(docs.collect()))
    got = catalog.op2_sharding(spark, SF).collect()
    loads = np.zeros(40)
    shard_of = {}
    for r in got:
        text = texts[r["doc_id"]].encode()
        assert r["size"] == len(text) + 16 and r["text_crc32"] == zlib.crc32(text)
        assert shard_of.setdefault(text, r["shard"]) == r["shard"]
        loads[r["shard"]] += r["size"]
    for s in range(40):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    largest = max(sum(len(t.encode()) + 16 for d, t in texts.items() if t == u) for u in set(texts.values()))
    assert loads.max() <= max(loads.mean() * 1.05, largest)


def test_levels_even_out_what_is_large(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PER_BUCKET", 50)
    rng = np.random.default_rng(4)
    sizes = [int(x) for x in rng.pareto(1.2, 3000) * 100 + 16]
    groups = spark.createDataFrame([(i.to_bytes(4, "big"), s) for i, s in enumerate(sizes)], "key binary, size long")
    got = {bytes(r["key"]): r["shard"] for r in sharding.pack(groups, 10).collect()}
    loads = np.bincount([got[i.to_bytes(4, "big")] for i in range(len(sizes))], sizes, 10)
    assert len(got) == len(sizes) and np.sort(loads)[:-1].max() / np.sort(loads)[:-1].min() < 1.05


# --- byte BPE


def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktokens_and_decodes(spark, docs, odd):
    e = tiktoken_encoding()
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    for r in bpe.decode(bpe.encode(rows)).collect():
        assert r["ids"] == e.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()


def test_higher_order_fold_is_the_same(spark):
    e = tiktoken_encoding()
    texts = ["", "a", " the", "Unbelievable", "éèê", "aaaaaaaaaaaa", "abababab", "\n\n  \n", "0123456789", "ndhaed", "!!!!", "日本語", "zqxjkvb"]
    table = spark.createDataFrame([(t,) for t in texts], "word string")
    ranks = bpe.read_ranks(bpe.VOCABULARY)
    for r in bpe.encode_words(table).collect():
        assert r["ids"] == (bpe.fold(r["word"].encode(), ranks) if r["word"] else [])
        if len(e.encode_ordinary(r["word"])) and len(re.findall(r"\S+|\s+", r["word"])) == 1 and r["word"].isalpha():
            assert r["ids"] == e.encode_ordinary(r["word"])


# --- exact dedup


def test_exact_dedup(spark, odd):
    want = {}
    for doc_id, text, *_ in ODD:
        want.setdefault(text or "", []).append(doc_id)
    got = exact_dedup.exact_duplicates(odd).collect()
    assert len(got) == len(ODD)
    for r in got:
        ids = next(v for t, v in want.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        top = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (top, len(ids))
    for text, ids in want.items():
        kept = [r["doc_id"] for r in got if r["kept"] and r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()]
        assert kept == [max((i for i in ids if i is not None), default=None)]
    assert sorted(map(repr, exact_dedup.drop_exact_duplicates(odd).select("doc_id").collect())) == sorted(repr(r) for r in odd.sparkSession.createDataFrame([(r["doc_id"],) for r in got if r["kept"]], "doc_id long").collect())


def test_directory_doubles_where_buckets_are_full():
    assert exact_dedup.directory({}, 10, 4) == (0, [0])
    depth, entries = exact_dedup.directory({0: 8, 1: 8, 15: 3}, 10, 4)
    assert depth == 4 and entries[0] == 0 and entries[1] == 1 and set(entries[2:4]) == {2} and set(entries[4:8]) == {4} and set(entries[8:]) == {8}
    depth, entries = exact_dedup.directory({3: 100}, 10, 4)  # cannot split further
    assert depth == 4 and entries[3] == 3


def test_colliding_hashes_are_chained(spark, odd, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    index = exact_dedup.build_index(odd).entries.collect()
    assert len(index) == len({t or "" for _, t, *_ in ODD}) and sorted(r["link"] for r in index) == list(range(len(index)))
    assert sum(r["group_size"] for r in index) == len(ODD)


# --- mixing


def test_mix_follows_budgets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 13)), "en", s, 0) for i, s in enumerate(["a"] * 300 + ["b"] * 30 + ["c"] * 100 + [None] * 50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    source = {r[0]: r[3] for r in rows}
    for s in ("a", "b", "c", None):
        mine = [r for r in got if source[r["doc_id"]] == s]
        size, target, taken = sum(r["size"] for r in mine), mine[0]["target"], sum(r["taken"] for r in mine)
        assert mine[0]["source_size"] == size and target <= 2 * size + 1e-9 and abs(taken - target) <= 13
        assert all(r["taken"] <= 2 * r["size"] for r in mine)
    total = sum(r["size"] for r in got)
    assert sum({source[r["doc_id"]]: r["target"] for r in got}.values()) == pytest.approx(1.5 * total)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["taken"] // r["size"] for r in got)


def test_threshold_is_the_sorted_one(spark):
    rng = np.random.default_rng(6)
    rows = [("s", int(n), int(h)) for n, h in zip(rng.integers(0, 50, 500), rng.integers(0, 1 << 60, 500))]
    for budget in (0.5, 100.0, 6000.0):
        limit = mixing.thresholds(spark.createDataFrame(rows, "source string, size long, h long"), spark.createDataFrame([("s", budget)], "source string, budget double"), 1).first()["below"]
        want, before = set(), 0
        for _, n, h in sorted(rows, key=lambda r: r[2]):
            if before * 2 + n <= budget * 2:
                want.add(h)
            before += n
        assert {h for _, _, h in rows if h < limit} == want


# --- token files


def test_token_files_read_back(spark, docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.VOCABULARY)
    for rows in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        got = {}
        for r in token_files.read_files(spark, token_files.write_files(rows)).collect():
            got.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
        start = 0
        for doc_id, text in sorted(text_of(rows.collect()), key=lambda x: (x[0] is not None, x[0] or 0)):
            ids = [*t.encode(text, add_special_tokens=False).ids, 0]
            assert (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) in got[doc_id]
            start += len(ids)


def test_files_are_flat_and_mapped(spark, docs):
    table = token_files.write_files(docs)
    parts = sorted(table.collect(), key=lambda r: r["part"])
    assert parts[0]["width"] == 2 and [p["start"] for p in parts] == list(np.cumsum([0] + [p["ids"] for p in parts])[:-1])
    one = token_files.open_map(f"{parts[0]['folder']}/{parts[0]['part']}.bin", "<u2")
    assert isinstance(one, np.memmap) and len(one) == parts[0]["ids"]
    assert token_files.open_map(f"{parts[0]['folder']}/{parts[0]['part']}.off", "<i8")[-1] == parts[0]["ids"]


# --- classifiers


def test_trees_find_a_rule():
    rng = np.random.default_rng(7)
    x = rng.random((2000, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.6) ^ (x[:, 7] > 0.5)).astype(float)
    trees = quality.fit(x[:1500], y[:1500])
    assert ((trees.scores(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    # the flat arrays give what a walk down each tree gives
    row = x[0]
    total = trees.start
    for s, c, leaf in zip(trees.statistic, trees.cut, trees.leaf):
        node = 0
        for _ in range(quality.DEPTH):
            node = 2 * node + (2 if row[s[node]] > c[node] else 1)
        total += leaf[node - (2**quality.DEPTH - 1)]
    assert trees.scores(x[:1])[0] == pytest.approx(1 / (1 + np.exp(-total)))
    assert quality.fit(x[:0], y[:0]).scores(x[:2]).tolist() == [0.5, 0.5]


def test_quality_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in catalog.op7_quality(spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.9


def test_forward_backward_is_the_sum_over_paths():
    rng = np.random.default_rng(8)
    sizes = np.array([5, 3, 1, 0])
    push, steps, first = rng.normal(size=9), rng.normal(size=(2, 2)), rng.normal(size=2)
    got, pairs = toxicity.marginals(push, sizes, steps, first, np.array([1.0, 2.0, 1.0, 1.0]))
    want, moves, at = [], np.zeros((2, 2)), 0
    for n, times in zip(sizes, (1, 2, 1, 1)):
        weight = {}
        for code in range(2**n if n else 0):
            path = [(code >> i) & 1 for i in range(n)]
            weight[tuple(path)] = np.exp(first[path[0]] + sum(push[at + i] * p for i, p in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:])))
        z = sum(weight.values())
        want += [sum(w for p, w in weight.items() if p[i]) / z for i in range(n)]
        for p, w in weight.items():
            for a, b in zip(p, p[1:]):
                moves[a, b] += times * w / z
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, moves)


def test_toxic_words_are_found(spark):
    rng = np.random.default_rng(9)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = [plain[k] for k in rng.integers(0, 300, 40)]
        if i % 5 == 0:
            for w in ("vile", "rotten", f"nastyx{i % 7}"):
                words.insert(int(rng.integers(0, 40)), w)
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert all(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held)
    text = {r[0]: r[1] for r in rows}
    for r in held:
        if r["predicted"]:
            assert {text[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]} >= {"vile", "rotten"}
    clean = toxicity.drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i in range(400) if i % 5}


# --- SimHash


def brute_fingerprint(text, n=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode())
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_and_components(spark, docs, odd, monkeypatch):
    rows = docs.select("doc_id", "text").unionByName(odd.where("doc_id IS NOT NULL").selectExpr("doc_id + 1000 AS doc_id", "text"))
    texts = text_of(rows.collect())
    want = {d: brute_fingerprint(t) for d, t in texts}
    got = {r["doc_id"]: r for r in simhash.near_duplicates(rows).collect()}
    assert {d: r["fp"] & (2**64 - 1) for d, r in got.items()} == want
    parent = {d: d for d in want}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(want)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (want[a] ^ want[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {d: r["component_id"] for d, r in got.items()} == {d: root(d) for d in ids}
    kept = simhash.drop_near_duplicates(rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({root(d) for d in ids})
    # spark's own function is the same hash
    assert spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()["h"] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_a_very_long_text_is_counted_in_slabs(monkeypatch):
    text = " ".join(f"w{i * 31 % 977}" for i in range(3000))
    whole = simhash.simhash([text])
    monkeypatch.setattr(simhash, "_SLAB", 100)
    assert (simhash.simhash([text]) == whole).all() and int(whole[0]) == brute_fingerprint(text)


def test_large_files_are_compared_in_tiles(spark):
    rng = np.random.default_rng(10)
    centre = int(rng.integers(0, 2**63))
    fps = {centre}
    for _ in range(120):
        fps.add(centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False)))
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")

    def sets(links):
        label = {r["node"]: r["label"] for r in simhash.components(links).collect()}
        return {frozenset(k for k, v in label.items() if v == x) for x in set(label.values())}

    assert sets(simhash.links(frame, most_in_file=10)) == sets(simhash.links(frame))
    assert simhash.links(frame).count() <= 10 * len(fps)


# --- personal data


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else (int(d) * 2 - 9 if d >= "5" else int(d) * 2) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TRICKY = [
    "a@b.c_d@e.f@g.h.i", "x@y", "@a.b", "a@b.c..d@e.f", "é😀a.b@c.de 1.2.3.4", "0.0.0.0 00255.1.2.3 256.1.1.1 1.1.1.1.1.1.1.1", "4111 1111-1111 1111", "4111  1111 1111 1111", "+12345678 +123456789 +1 (2) 3.4-5 6789-",
    "+1+23456789012+3", "1" * 200, "a" * 3000 + "@b.c", "a." * 500 + "@" + "b." * 500 + "c", "0-0 0-0 0-0 0-0 0-0 0-0 00",
]


def test_base_spans_are_those_of_the_patterns(spark, docs, odd):
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(list(enumerate(TRICKY, 10**6)), "doc_id long, text string"))
    for r in rows.select("text", pii.base_spans(F.coalesce("text", F.lit(""))).alias("base")).collect():
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["base"]] == brute_spans(r["text"] or "")


def test_terms_that_give_an_entity_away(spark):
    texts = [f"Call Zbigniew at zb@x.org about item {i} today" for i in range(3)] + [f"item of today number {i}, call me" for i in range(60)] + ["nobody at no@x.org here"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = pii.sanitised(pii.find(docs)).orderBy("doc_id").collect()
    assert all({s["value"] for s in r["extra"]} >= {"zbigniew"} and "today" not in {s["value"] for s in r["extra"]} for r in got[:3])
    assert all(not r["extra"] for r in got[3:])
    assert "[EMAIL]" in got[0]["clean"] and "Zbigniew" not in got[0]["clean"] and got[10]["clean"] == texts[10]
    assert got[0]["clean"].endswith("item 0 today")


def test_pii_runs_no_python(spark):
    plan = catalog.op10_pii(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- long words, special strings, session settings


def test_a_run_of_letters_is_folded_in_seconds():
    rng = np.random.default_rng(11)
    ranks, e = bpe.read_ranks(bpe.VOCABULARY), tiktoken_encoding()
    for n in (65, 1000, 200_000):
        word = bytes(rng.integers(97, 107, n).astype(np.uint8))
        began = time.time()
        ids = bpe.fold(word, ranks)
        assert time.time() - began < 20 and ids == e._encode_single_piece(word)


def test_words_are_folded_together_as_alone(monkeypatch):
    rng = np.random.default_rng(12)
    e, merges = tiktoken_encoding(), bpe.Merges(bpe.VOCABULARY)
    words = [rng.choice(list(b"ab c\xc3\xa9the\x00\xff"), int(n)).astype(np.uint8).tobytes() for n in rng.integers(1, 90, 2000)]
    want = [e._encode_single_piece(w) for w in words]
    for room in (0, bpe.CACHED_BYTES):
        monkeypatch.setattr(bpe, "CACHED_BYTES", room)
        for _ in range(2):
            assert [np.frombuffer(x, np.int32).tolist() for x in merges.fold_all(words)] == want
    assert len(merges.known) == len(set(words))


def test_long_texts_are_encoded_whole(spark):
    rng = np.random.default_rng(13)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz  \n,é"))
    texts = ["".join(rng.choice(letters[:26], 50_000)), "".join(rng.choice(letters, 300_000)), " " * 10_000 + "x", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    e = tiktoken_encoding()
    got = {r["doc_id"]: r for r in bpe.digests(rows).collect()}
    for i, text in enumerate(texts):
        ids = e.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_special_strings_are_tokens_in_files(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.VOCABULARY)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", " <|endoftext|>  <|endoftext|> ", "<|endoftext |> <| endoftext|>"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_files.read_files(spark, token_files.write_files(rows)).collect()}
    for i, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert (got[i]["n_tokens"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_one_hot_id_is_in_several_parts(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 3).alias("text")).repartition(8)
    table = token_files.write_files(rows)
    assert table.count() > 2 and token_files.read_files(spark, table).count() == 20_000


def test_one_encoder_serves_a_worker():
    assert token_files.encoder(token_files.VOCABULARY) is token_files.encoder(token_files.VOCABULARY)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_leave_the_session_as_it_was(spark, name):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    catalog.QUERIES[name](spark, SF).count()
    assert spark.conf.get(setting) == before


# --- toxic words without a cue, long lines


def test_a_toxic_word_without_a_cue_is_tagged_from_its_context():
    rng = np.random.default_rng(14)
    plain, bad = [f"w{i}" for i in range(200)], ["vile", "rotten", "nasty", "filthy", "scummy", "wretched"]
    texts, toxic = [], []
    for i in range(300):
        words = [plain[k] for k in rng.integers(0, 200, 40)]
        if i % 3 == 0:
            run = [bad[k] for k in rng.integers(0, 6, 5)]
            if i % 2:
                run[2] = f"{'qzxvkjpy'[i % 8]}{i}"  # seen once, so no cue
            at = int(rng.integers(0, 35))
            words[at:at] = run
        texts.append(" ".join(words))
        toxic.append(int(i % 3 == 0))
    odds = {f"={w}": 5.0 for w in bad}
    field = toxicity.fit(texts, np.array(toxic), odds)
    fresh = " ".join([*plain[:10], "vile", "nasty", "unheard", "filthy", "rotten", *plain[10:20]])
    alone = " ".join([*plain[:10], "unheard", *plain[10:20]])
    score, spans = toxicity.scored(field, [fresh, alone], {})
    assert [fresh[s["start"] : s["end"]] for s in spans[0]] == ["vile", "nasty", "unheard", "filthy", "rotten"] and not spans[1]
    assert score[0] > 0.9 > 0.1 > score[1]


def test_a_score_is_that_of_the_sum_over_paths():
    """Marginals and the score of a short text from all paths of its tokens, and the features from their definition."""
    field = toxicity.Field({"=vile": 0, "^rott": 1, "$tten": 2}, np.array([3.2, 1.1, 9.9]), np.linspace(-1, 1, 3 + 3 * toxicity.STRENGTHS + 1), np.array([[0.1, -1.0], [-0.5, 0.7]]), np.array([-0.1, -2.0]), np.array([-1.0, 0.6, 0.8]))
    words = ["a", "VILE", "rotten", "b"]
    s, w = toxicity.STRENGTHS, field.weights
    push = [w[3 + 2 * s + 3], w[0] + w[3 + 3] + w[3 + 2 * s + 1], w[1] + w[2] + w[3 + 1] + w[3 + s + 3], w[3 + s + 1]]
    push = [p + w[-1] for p in push]
    weight = {}
    for code in range(16):
        path = [(code >> i) & 1 for i in range(4)]
        weight[tuple(path)] = np.exp(field.first[path[0]] + sum(p * x for p, x in zip(push, path)) + sum(field.steps[a, b] for a, b in zip(path, path[1:])))
    m = [sum(v for p, v in weight.items() if p[i]) / sum(weight.values()) for i in range(4)]
    got, spans = toxicity.scored(field, [" ".join(words), ""], {})
    top = min(max(m), 1 - 1e-4)
    z = field.link @ [1, np.log(top / (1 - top)), np.log1p(sum(m))]
    assert got[0] == pytest.approx(1 / (1 + np.exp(-z)))
    assert len(spans[0]) == sum(x >= 0.5 for x in m) and not spans[1]


def test_cues_are_those_of_plain_counts(spark):
    rng = np.random.default_rng(15)
    rows = [(" ".join([f"w{k}" for k in rng.integers(0, 50, 20)] + (["vile", "Rotten."] if y else [])), y) for y in [1] * 20 + [0] * 60]
    got = toxicity.cues(spark.createDataFrame(rows, "text string, y int"))
    assert set(got) == {"=vile", "=rotten", "^rott", "^rotte", "$tten"}
    assert all(v == pytest.approx(np.log(20.5 / 21) - np.log(0.5 / 61)) for v in got.values())


def test_terms_of_long_lines_are_all_found(spark):
    rng = np.random.default_rng(16)
    took = {}
    for n in (20_000, 40_000):
        filler = [f"{a}{b}{c}" for a, b, c in zip(*(rng.choice(list("abcdefghijklmnop"), n) for _ in range(3)))]
        for i in range(0, n, 50):
            filler[i] = "Zbigniew"
        long = " ".join(filler) + " zb@x.org"
        texts = [long] + [f"Zbigniew is at zb@x.org, item {i}" for i in range(20)] + [f"nobody of item {i} is at all" for i in range(300)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        began = time.time()
        found = {r["doc_id"]: r for r in pii.find(docs).collect()}
        took[n] = time.time() - began
        want = [(m.start(), m.end()) for m in re.finditer("Zbigniew", long)]
        assert [(s["start"], s["end"]) for s in found[0]["extra"] if s["value"] == "zbigniew"] == want
        assert [(s["start"], s["end"]) for s in found[0]["base"]] == [(len(long) - 8, len(long))]
        clean = pii.sanitised(pii.find(docs).where("doc_id = 0")).first()["clean"]
        assert "Zbigniew" not in clean and clean.endswith("[EMAIL]") and clean.count(" ") == long.count(" ")
    assert took[40_000] < 3 * took[20_000] + 5


# --- the index


def test_buckets_split_and_rows_find_them(spark, monkeypatch):
    rows = [(i, f"text {i % 700} " + "x" * (i % 700)) for i in range(2000)] + [(5000 + i, "hot") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    index = exact_dedup.build_index(docs, bucket_bytes=10_000)
    entries, slots = index.entries.collect(), {r["p"]: r["bucket"] for r in index.directory.collect()}
    assert index.depth >= 4 and len(slots) == 1 << index.depth and len(set(slots.values())) > 16
    assert all(slots[(r["h"] & (2**64 - 1)) >> (64 - index.depth)] == r["bucket"] for r in entries)
    assert len(entries) == 701 and sum(r["group_size"] for r in entries) == len(rows)
    whole = sorted(map(tuple, exact_dedup.exact_duplicates(docs).drop("bucket", "link").collect()))
    monkeypatch.setattr(exact_dedup, "FOLD_BYTES", 1000)
    monkeypatch.setattr(exact_dedup, "MOST_SENT", 0)
    assert whole == sorted(map(tuple, exact_dedup.exact_duplicates(docs).drop("bucket", "link").collect()))


def test_merges_compare_bytes(spark, monkeypatch):
    """Texts that share hash and digest are two entries all the same."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string").coalesce(1)
    got = {r["digest"].hex(): (r["keep_id"], r["group_size"]) for r in exact_dedup.build_index(docs).entries.collect()}
    assert got == {hashlib.sha256(b"a").hexdigest(): (3, 2), hashlib.sha256(b"b").hexdigest(): (2, 1)}


def test_the_same_one_of_repeated_rows_stays(spark):
    rows = [(7, "the same text", "en", s, i) for i, s in enumerate("abcdefgh")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for drop in (exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates):
        assert len({tuple(drop(docs.orderBy(F.rand(k)).repartition(k)).first()) for k in (1, 3, 5)}) == 1

"""Conversation repair against a search over all edits, one conversation at a time."""

import functools
import hashlib
import random
import re
import sys
import zlib

import numpy as np
import pytest

from hydrospark.llm import repair
from hydrospark.llm.catalog import QUERIES

sys.setrecursionlimit(10_000)
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "conv_id long, turn long, role string, text string"


def faults_of(rows):
    """Of each (role, text) its first fault."""
    seen, out = set(), []
    for role, text in rows:
        rest = text.rstrip(SPACE)
        out.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit, output) over all edits, by recursion on what is left and what the output ends in."""
    faults = faults_of(rows)
    follows = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
    names = {"u": "user", "a": "assistant"}

    @functools.cache
    def best(i, end, inserted):
        options = []
        if i == len(rows) and end in ("", "a"):
            options.append((0, "", ()))
        for role in ("u", "a"):
            if role in follows[end] and inserted < 3:
                cost, audit, out = best(i, role, inserted + 1)
                options.append((cost + 2, "I" + audit, ((names[role], ""), *out)))
        if i < len(rows):
            role, text = rows[i]
            cost, audit, out = best(i + 1, end, 0)
            options.append((cost + 3, "D" + audit, out))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if role[:1] in follows[end] and role:
                    cost, audit, out = best(i + 1, role[0], 0)
                    options.append((cost + more, "K" + audit, ((role, text), *out)))
                for to in ("u", "a"):
                    if to in follows[end]:
                        cost, audit, out = best(i + 1, to, 0)
                        options.append((cost + 2 + more, "R" + audit, ((names[to], text), *out)))
        return min(options, default=(float("inf"), "", ()))

    return best(0, "", 0)


def brute(turns):
    """Rows (conv_id, turn, role, text) to the contract's columns but the damage."""
    found = {}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2], t[3]))
        rows, numbers = [(t[2], t[3]) for t in own], {t[1] for t in own} - {None}
        faults, initials = faults_of(rows), [r[:1] for r, _ in rows]
        cost, audit, out = cheapest(tuple(rows))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
        found[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])), cost, audit, list(out))
    return found


def found(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], [(t["role"], t["text"]) for t in r["repaired"]]) for r in df.collect()}


def random_turns(seed, n=400, most=9):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", " ", "sage", "usher"]
    texts = ["a.", "b!", "c?", "open", "", " \n", "d. ", "é…", "?", "end.\x0b"]
    return [(c, rng.choice([k, k, k, rng.randrange(12), None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{rng.random()}.") for c in range(n) for k in range(rng.randrange(1, most))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_search_over_all_edits(spark, seed):
    turns = random_turns(seed)
    assert found(repair.repair(spark.createDataFrame(turns, SCHEMA))) == brute(turns)


def test_small_lots_and_a_long_conversation(spark, monkeypatch):
    rng = random.Random(3)
    turns = random_turns(4, 60) + [(999, k, rng.choice(["user", "assistant", "tool"]), rng.choice(["x.", "open", f"n{k}."])) for k in range(150)]
    want = brute(turns)
    df = spark.createDataFrame(turns, SCHEMA)
    assert found(repair.repair(df)) == want
    rows = sorted(((c, t is not None, t or 0, r, x) for c, t, r, x in turns))
    monkeypatch.setattr(repair, "LOT_ROWS", 7)
    import pyarrow as pa

    def batch(part):
        ends = [x.rstrip(SPACE)[-1:] for *_, x in part]
        kinds = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("there", pa.bool_()), ("blank", pa.bool_()), ("open", pa.bool_())])
        return pa.RecordBatch.from_pydict({"conv_id": [p[0] for p in part], "turn": [p[2] if p[1] else None for p in part], "role": [p[3] for p in part], "text": [p[4] for p in part], "there": [True] * len(part), "blank": [not e for e in ends], "open": [e not in (".", "!", "?") for e in ends]}, schema=kinds)

    for size in (1, 5, 64):
        got = {}
        for out in repair.in_conversations(batch(rows[a : a + size]) for a in range(0, len(rows), size)):
            for r in out.to_pylist():
                assert r["conv_id"] not in got
                got[r["conv_id"]] = (r["cost"], r["audit"])
        assert got == {c: w[5:7] for c, w in want.items()}


def test_ranks_tell_paths_apart():
    rng = np.random.default_rng(1)
    n = 300
    arcs = np.full((n, 4), -1, np.int64)
    for i in range(n - 1):
        for letter in range(4):
            if rng.random() < 0.5:
                arcs[i, letter] = rng.integers(i + 1, min(n, i + 4))
    roots = np.arange(0, n, 7)
    for root, path in zip(roots, repair.least_paths(arcs, roots)):
        want = [int(root)]
        while (arcs[want[-1]] >= 0).any():
            want.append(int(arcs[want[-1]][np.flatnonzero(arcs[want[-1]] >= 0)[0]]))
        assert path.tolist() == want


def test_odd_rows(spark):
    turns = [(1, None, None, None), (1, None, "user", "a."), (1, 3, "assistant", "b."), (None, 1, "user", "x."), (None, 1, "user", "x."), (2, 0, "", "a."), (3, 0, "user", "  ")]
    want = brute([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in turns])
    df = spark.createDataFrame([(*t, "extra", 1, 2) for t in turns], SCHEMA + ", audit string, blank int, open int")
    assert found(repair.repair(df)) == want
    assert repair.repair(df.limit(0)).collect() == []
    none = repair.repair(df.where("conv_id = 3").select("*", (df["turn"] > 5).alias("there"))).first()
    assert none[1:8] == (0, 0, 0, 0, 0, 0, "") and none["repaired"] == []


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns, blank = [], lambda x: " " if x is None else x
    for c, t, r, x in rows:
        fault, r, x = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20, blank(r), blank(x)
        if fault:
            turns += [(c, t, "user" if fault == 4 else r, "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x)] * (2 if fault == 3 else 1)
    want = {c: (*w[:7], hashlib.sha256("\n".join(f"{r}:{x}" for r, x in w[7]).encode()).hexdigest()) for c, w in brute(turns).items()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op12_conversation_repair"](spark, sf).collect()}
    assert got == {c: want.get(c, empty) for c in {r[0] for r in rows}}
    assert sum(w[5] for w in got.values()) > 100 and {"K", "D", "I", "R"} <= set("".join(w[6] for w in got.values()))

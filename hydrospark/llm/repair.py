"""Repair of conversation structure: the cheapest edits that make roles alternate, and of these the least audit.

A conversation is a path through nodes (rows done, state), where a state is what the output so far ends in: nothing,
a system turn, a user turn, an assistant turn. Arcs are edits: K keeps a row, R gives it a role, D deletes it, I inserts an
empty turn; the audit is the string of their letters. Costs to the end come from one pass backwards over the rows.
Arcs that lose nothing against them are optimal, and each node has at most one for a letter.

Which optimal arc each node takes is found by ranks: nodes are ranked by the first letter of the least audit from them, then
by its first two, four, eight letters: the rank of twice a length is the rank of the pair (own rank, rank of the node that the
pointer of that length leads to), and pointers are doubled along. An arc whose target has the least rank of a
letter's arcs is the least path's. The path is read by doubling too, from the longest pointers down.

JVM expressions damage rows and tell what is wrong with them; tasks get each conversation's rows in order and work on many
conversations at once in arrays. A conversation is in one task, since its audit is one value of its row; its rows take about 500 bytes each there.

Defined cases: null values are one space, so a null role is kept by no edit and null turns come first; a null conv_id is a
conversation; rows of a turn go by role, then text; equal rows are duplicates after the first; a conversation of which no
row is left has zeros, an empty audit and the hash of an empty string; other columns of any name do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

LOT_ROWS = 20_000  # rows of whole conversations that are worked on at once; a longer conversation is on its own
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1  # that a truncated row costs unless it is deleted
LETTERS = sorted(COST)  # D, I, K, R
_TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the turn that an inserted or renamed row makes after a state
_NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
_FAR = 1 << 60


def plain(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, there) with faults by crc32 of ``conv_id:turn``, modulo 20: 0 drops a row (it stays, marked as not there),
    1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes the user say it."""
    fault = F.pmod(F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn")).cast("binary")), F.lit(20))
    text = F.when(fault == 1, "").when(fault == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    rows = turns.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"), (fault != 0).alias("there"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows


def judged(rows: DataFrame) -> DataFrame:
    """Rows with what their text alone tells: ``blank``, and ``open`` if it ends in the middle of a sentence."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    return rows.withColumns({"blank": last == "", "open": ~last.isin(".", "!", "?")})


def costs_to_end(usable: np.ndarray, state: np.ndarray, open_: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least cost from (row, state) to the end, for rows of conversations one after the other, each followed by a place for its end.

    All conversations go backwards at once, by their distance from the end. ``state`` is what a kept row makes (-1: nothing it may be kept as).
    """
    n = len(usable)
    costs = np.full((n, 4), _FAR)
    final = np.array([0, 2 * COST[INSERT], COST[INSERT], 0])
    costs[ends] = final
    starts = np.concatenate(([0], ends[:-1] + 1))
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    for d in range(1, int(lengths.max(initial=0)) + 1):
        at = ends[order[: np.searchsorted(-lengths[order], -d, side="right")]] - d
        after = costs[at + 1]
        now = after + COST[DELETE]
        use, extra = usable[at], open_[at] * TRUNCATED
        for s in range(4):
            turn = _TURN[s]
            now[:, s] = np.where(use, np.minimum(now[:, s], after[:, turn] + COST[REROLE] + extra), now[:, s])
            fits = use & ((state[at] == turn) | ((state[at] == SYSTEM) & (s == START)))
            now[:, s] = np.where(fits, np.minimum(now[:, s], after[np.arange(len(at)), np.maximum(state[at], 0)] + extra), now[:, s])
        for _ in range(3):  # as many insertions as may follow one another at no loss
            for s in range(4):
                now[:, s] = np.minimum(now[:, s], now[:, _TURN[s]] + COST[INSERT])
        costs[at] = now
    return costs


def optimal_arcs(usable: np.ndarray, state: np.ndarray, open_: np.ndarray, ends: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """(node, letter) to the node that the optimal arc of that letter leads to, -1 if there is none. Node: row * 4 + state."""
    n = len(usable)
    arcs = np.full((n, 4, len(LETTERS)), -1, np.int64)
    is_end = np.zeros(n, bool)
    is_end[ends] = True
    row, extra = np.arange(n), open_ * TRUNCATED
    after = costs[np.minimum(row + 1, n - 1)]
    for s in range(4):
        turn, own = _TURN[s], costs[:, s]
        step = {DELETE: (~is_end, after[:, s] + COST[DELETE], row * 4 + 4 + s), REROLE: (~is_end & usable, after[:, turn] + COST[REROLE] + extra, row * 4 + 4 + turn), INSERT: (np.ones(n, bool), costs[:, turn] + COST[INSERT], row * 4 + turn)}
        kept = np.maximum(state, 0)
        fits = ~is_end & usable & ((state == turn) | ((state == SYSTEM) & (s == START)))
        step[KEEP] = (fits, after[row, kept] + extra, row * 4 + 4 + kept)
        for letter, (may, cost, to) in step.items():
            arcs[:, s, LETTERS.index(letter)] = np.where(may & (cost == own), to, -1)
    return arcs.reshape(n * 4, len(LETTERS))


def least_paths(arcs: np.ndarray, roots: np.ndarray) -> list[np.ndarray]:
    """The nodes on the least path from each root on, its end included.

    A node without arcs points to itself and ranks below all letters. Of a node's arcs the one with the least pair of its letter and
    the rank of the node that it leads to is taken, once ranks tell whole audits apart.
    """
    n = len(arcs)
    some = arcs >= 0
    follow = lambda of: np.where(some.any(1), arcs[np.arange(n), of], np.arange(n))
    first = some.argmax(1)  # letters are in their order
    rank, pointer = np.where(some.any(1), first + 1, 0), follow(first)
    while True:
        _, pair = np.unique(rank * (rank.max(initial=0) + 1) + rank[pointer], return_inverse=True)
        further = pointer[pointer]
        rank, ended, pointer = pair.reshape(-1), (further == pointer).all(), further
        if ended:
            break
    best = np.where(some, np.arange(len(LETTERS)) * (rank.max(initial=0) + 1) + rank[np.maximum(arcs, 0)], np.iinfo(np.int64).max).argmin(1)
    pointers, depth = [follow(best)], some.any(1).astype(np.int64)
    while (pointers[-1] != pointers[-1][pointers[-1]]).any():
        depth = depth + depth[pointers[-1]]
        pointers.append(pointers[-1][pointers[-1]])
    found: list[np.ndarray] = [np.empty(0, np.int64)] * len(roots)
    turns = np.ceil(np.log2(depth[roots] + 1)).astype(int)
    for k in np.unique(turns):
        own = np.flatnonzero(turns == k)
        paths = roots[own][:, None]
        for step in reversed(pointers[:k]):  # places that are multiples of twice the step's length are known; it adds those half way between
            paths = np.stack((paths, step[paths]), axis=2).reshape(len(own), -1)
        for i, path in zip(own, paths):
            found[i] = path[: depth[roots[i]] + 1]
    return found


OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def repaired(table: pa.Table) -> pa.RecordBatch:
    """Whole conversations, rows in order, to one row each."""
    ids, turns, roles, texts, there, blank, open_ = (table.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "there", "blank", "open"))
    new = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
    rows: list[int] = []  # of the table; -1 stands for a conversation's end
    ends, seen_again, notes = [], [], []
    for a, b in zip(new, [*new[1:], len(ids)]):
        own = [i for i in range(a, b) if there[i]]
        known: set[tuple[str, str]] = set()
        counts = [0, 0, 0]
        for i in own:
            key = (roles[i], texts[i])
            again = not blank[i] and key in known
            known.add(key)
            seen_again.append(again)
            counts[0] += blank[i]
            counts[1] += again
            counts[2] += open_[i] and not blank[i] and not again
        initials = [roles[i][:1] for i in own]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        numbers = {turns[i] for i in own} - {None}
        notes.append((max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *counts, illegal))
        rows += [*own, -1]
        ends.append(len(rows) - 1)
        seen_again.append(False)
    real = np.array(rows) >= 0
    usable = real & np.array([i >= 0 and not blank[i] for i in rows]) & ~np.array(seen_again, bool)
    state = np.array([{"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(roles[i][:1], -1) if i >= 0 else -1 for i in rows], np.int64)
    cut_off = np.array([i >= 0 and open_[i] for i in rows]) & usable
    ends = np.array(ends)
    costs = costs_to_end(usable, state, cut_off, ends)
    arcs = optimal_arcs(usable, state, cut_off, ends, costs)
    starts = np.concatenate(([0], ends[:-1] + 1))
    audits, texts_out = [], []
    for path in least_paths(arcs, starts * 4 + START):
        audit, said = [], []
        for x, y in zip(path.tolist(), path[1:].tolist()):
            letter = LETTERS[arcs[x].tolist().index(y)]
            audit.append(letter)
            if letter == INSERT:
                said.append({"role": _NAMES[y & 3], "text": ""})
            elif letter != DELETE:
                i = rows[x >> 2]
                said.append({"role": roles[i] if letter == KEEP else _NAMES[y & 3], "text": texts[i]})
        audits.append("".join(audit))
        texts_out.append(said)
    columns = [pa.array([n[k] for n in notes], pa.int64()) for k in range(5)]
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    return pa.RecordBatch.from_arrays([table.column("conv_id").take(pa.array(new)).combine_chunks(), *columns, pa.array(costs[starts, START], pa.int64()), pa.array(audits, pa.string()), pa.array(texts_out, turn)], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"])


def in_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows to one row for each conversation; about LOT_ROWS rows are worked on at once."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_pylist()
        cut = next((i for i in range(len(ids) - 1, 0, -1) if ids[i] != ids[i - 1]), 0 if held and ids[0] != last else None)
        if cut is not None and n + cut >= LOT_ROWS:
            if cut:
                held.append(batch.slice(0, cut))
            yield repaired(pa.Table.from_batches(held))
            held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n, last = n + batch.num_rows, ids[-1]
    if held:
        yield repaired(pa.Table.from_batches(held))


def repair(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) to a row for each conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired).

    With a column ``there``, rows for which it is false only say that there is such a conversation.
    """
    there = F.col("there") if "there" in turns.columns else F.lit(True)
    copy = [F.col("copy")] if "copy" in turns.columns else []
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), plain("role").alias("role"), plain("text").alias("text"), there.alias("there"), *copy)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text", *copy]
    dealt = judged(rows).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "there", "blank", "open")
    return dealt.mapInArrow(in_conversations, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {OUT}")

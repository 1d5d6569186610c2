"""Fixed-point jobs over edges: connected components, and what drains into what in a forest, all sets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hydrospark.plans.joins import by_size, by_sort
from hydrospark.plans.scratch import drop_written, written


def components(edges: DataFrame, table: str = "components") -> DataFrame:
    """``edges`` (a, b) to (node, label): all nodes of a connected set have the least of them as label.

    Each round a node takes the least label of its neighbours and tells it to its own label too, then labels are
    followed to their labels; that shortens a chain to a share of its length. A round is a written table.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{table}-edges")
    # sides that are few may be collected by Spark, others are merged
    many = both.count()
    state = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), table)
    while True:
        near = by_size(both, many).join(state.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        met = by_size(state, many).join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("least"))
        told = met.select("node", "least").union(met.select(F.col("label").alias("node"), "least")).groupBy("node").agg(F.min("least").alias("least"))
        told = written(told, f"{table}-told")
        jumped = by_size(told, many).join(told.select(F.col("node").alias("least"), F.col("least").alias("further")), "least", "left").select("node", F.coalesce("further", "least").alias("label"))
        after = written(jumped, table)
        changed = by_size(after, many).join(state.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        drop_written(told)
        if not changed:
            return after
        drop_written(state)
        state = after


def reached(starts: DataFrame, edges: DataFrame, table: str = "reached") -> DataFrame:
    """``starts`` (root, node) and ``edges`` (node, next) to (root, node, level): all that each root reaches, with the fewest steps.

    A frontier goes on from round to round; what a root has reached is taken out, so cycles end.
    """
    frontier = written(starts.select("root", "node", F.lit(0).alias("level")).distinct(), table)
    parts = [frontier]
    while frontier.limit(1).count():
        step = frontier.join(edges, "node").select("root", F.col("next").alias("node"), (F.col("level") + 1).alias("level")).distinct()
        for part in parts:
            step = step.join(part.select("root", "node"), ["root", "node"], "left_anti")
        frontier = written(step, table)
        parts.append(frontier)
        if len(parts) > 8:  # few tables, whatever the depth
            parts = [written(_union(parts[:-1]), table), frontier]
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def nearest_stops(after: DataFrame, stops: DataFrame, table: str = "stops") -> DataFrame:
    """``after`` (node, next; one row a node) and ``stops`` (node) to (node, stop, steps): the first stop on the way from each node on, itself if it is one.

    Pointers are doubled: each round a node's pointer becomes that of the node that it points to, so a way of any length takes the
    logarithm of its length in rounds. Nodes whose way ends or goes round without a stop are left out.
    """
    at = stops.select("node").distinct()
    last = at.select("node", F.col("node").alias("to"), F.lit(0).cast("long").alias("steps"), F.lit(True).alias("there"))
    first = after.where("next IS NOT NULL").select("node", F.col("next").alias("to"), F.lit(1).cast("long").alias("steps"), F.lit(False).alias("there")).join(by_sort(at), "node", "left_anti")
    state = written(last.unionByName(first), table)
    many = state.count()
    rounds = max(1, many).bit_length() + 1  # more are only needed by a way that goes round
    for _ in range(rounds):
        under_way = state.where("NOT there")
        if not under_way.limit(1).count():
            break
        far = state.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"), F.col("there").alias("ends"))
        moved = by_size(under_way, many).join(far, "to").select("node", F.col("further").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("there"))
        before, state = state, written(state.where("there").unionByName(moved), table)
        drop_written(before)
    return state.where("there").select("node", F.col("to").alias("stop"), "steps")


def drained(after: DataFrame, targets: DataFrame, table: str = "drained") -> DataFrame:
    """``after`` (node, next) and ``targets`` (node) to (target, node, steps): all nodes whose way leads through a target, itself with no steps.

    Each node knows its nearest target. Targets that lie on one another's ways are a small forest of their own; the ways in
    it are doubled too (targets within 2^k, and the one 2^k on), so no step waits for a level of nodes.
    """
    near = written(nearest_stops(after, targets, table), f"{table}-nearest")
    onward = after.where("next IS NOT NULL").join(targets.select("node").distinct(), "node").select(F.col("node").alias("low"), F.col("next").alias("node"))
    jump = written(onward.join(near, "node").select("low", F.col("stop").alias("high"), (F.col("steps") + 1).alias("way")).where("low <> high"), f"{table}-targets")
    within = targets.select(F.col("node").alias("low"), F.col("node").alias("high"), F.lit(0).cast("long").alias("way")).distinct()
    rounds = max(1, jump.count()).bit_length() + 1
    for _ in range(rounds):
        if not jump.limit(1).count():
            break
        on = lambda df: jump.select("low", F.col("high").alias("mid"), F.col("way").alias("first")).join(df.select(F.col("low").alias("mid"), "high", "way"), "mid").select("low", "high", (F.col("first") + F.col("way")).alias("way"))  # noqa: B023, E731
        # targets on a round way meet themselves; the fewest steps count
        within = written(within.unionByName(on(within)).groupBy("low", "high").agg(F.min("way").alias("way")), f"{table}-within")
        jump = written(on(jump).where("low <> high"), f"{table}-targets")
    return near.join(within, near["stop"] == within["low"]).select(F.col("high").alias("target"), "node", (F.col("steps") + F.col("way")).alias("steps"))

"""Smallest reachable ids by contraction: roots hook to their smallest neighbour, pointers jump to the end, edges shrink.

A root that stays has had a neighbour hook to its tree, or hooks itself in the round after, so at least half of the roots
go in any two rounds; pointers jump twice as far each time. Nothing is returned before no edge joins two roots.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More than 2 log2 of any number of ids; to reach it is an error, not an answer.
MAX_ROUNDS = 128


def smallest_reachable(both: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """id, comp for every id of ``both`` (a, b): stored edges in both directions, without loops; ``store`` cuts lineages."""
    edges, state = both, None
    for r in range(MAX_ROUNDS):
        up = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("up"))
        up = store(up, f"{r}-hooked")
        for j in range(MAX_ROUNDS):
            next_ = up.select(F.col("id").alias("up"), F.col("up").alias("over"))
            jumped = up.join(next_, "up").select("id", F.col("over").alias("up"), (F.col("up") != F.col("over")).alias("moved"))
            jumped = store(jumped, f"{r}-jumped-{j}")
            up = jumped.select("id", "up")
            if jumped.where("moved").isEmpty():
                break
        else:
            raise RuntimeError(f"pointers still move after {MAX_ROUNDS} jumps")
        if state is None:
            state = up.select("id", F.col("up").alias("comp"))
        else:
            moved = state.join(up.select(F.col("id").alias("comp"), "up"), "comp", "left")
            state = store(moved.select("id", F.coalesce("up", "comp").alias("comp")), f"{r}-labels")
        root = lambda c: up.select(F.col("id").alias(c), F.col("up").alias(f"{c}_root"))
        edges = edges.join(root("a"), "a").join(root("b"), "b").where("a_root <> b_root")
        edges = store(edges.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), f"{r}-edges")
        if edges.isEmpty():
            return state
    raise RuntimeError(f"components have not settled after {MAX_ROUNDS} rounds")

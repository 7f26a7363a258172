"""Connected components over an edge table, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Label every vertex of ``edges(a, b)`` with the smallest vertex reachable.

    Parent pointers are hooked onto smaller grandparents and halved in every
    round (Shiloach-Vishkin in its min form), so a component of diameter d needs
    about log(d) rounds. Everything stays in tables: each round is joins and
    ``min`` aggregates, which combine before the shuffle, so a vertex with very
    many neighbours costs no task more than its share. Each round's table is
    written to the shared folder. Nothing but one counter reaches the driver.

    Null ends are ignored; repeated edges and self-loops change nothing; an
    empty edge table gives an empty result. Returns ``v``, ``root``. Raises if
    ``rounds`` do not suffice rather than return a partial labelling.
    """
    both = edges.filter("a is not null and b is not null and a <> b").select("a", "b")
    both = cut(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    state = cut(both.groupBy("a").agg(F.min("b").alias("m"))
                .select(F.col("a").alias("v"), F.least("a", "m").alias("root")), "cc-state")
    held = state
    for _ in range(rounds):
        parent = state.select(F.col("v").alias("p"), F.col("root").alias("grand"))
        grand = state.join(parent, state["root"] == parent["p"]).select("v", "root", "grand")
        grand = cut(grand, "cc-grand")
        near = (both.join(grand.select(F.col("v").alias("b"), "grand"), "b")
                .groupBy("a").agg(F.min("grand").alias("low")))
        hooks = grand.join(near, grand["v"] == near["a"]).select("v", "root", "grand", "low")
        own = hooks.select("v", F.least("root", "grand", "low").alias("to"))
        far = hooks.select(F.col("root").alias("v"), F.col("low").alias("to"))
        new = (own.union(far).groupBy("v").agg(F.min("to").alias("new"))
               .join(state, "v").select("v", F.col("new").alias("root"), (F.col("new") != F.col("root")).alias("moved")))
        new = cut(new, "cc-state")
        discard(grand)
        discard(held)
        moved = new.filter("moved").limit(1).count()
        state, held = new.select("v", "root"), new
        if not moved:
            return state
    raise RuntimeError(f"no fixed point after {rounds} rounds")

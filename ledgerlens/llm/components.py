"""Connected components of a graph given as edges, by alternating stars.

Large star: every node hangs its larger neighbours on its smallest neighbour;
small star: every node hangs itself and its smaller neighbours on the smallest
of them.  Both only move edges, so memory does not depend on a component's
size, and a few rounds end with every node on its component's smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _smallest(edges: DataFrame, other: str = "b") -> DataFrame:
    """Per node a its smallest neighbour, written: both sides of the join that
    follows are then plain shuffles, which adaptive execution can split."""
    return materialise(edges.groupBy("a").agg(F.min(other).alias("m")), "cc-min")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select("b", "a")) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = both.join(_smallest(both), "a")
    m = F.least("m", "a") if large else F.col("m")
    hung = joined.where("b > a") if large else joined.where("b != m")
    out = hung.select(F.col("b").alias("a"), m.alias("b"))
    if not large:  # the node itself, too
        out = out.union(joined.select("a", F.col("m").alias("b")))
    return materialise(out.where("a != b").distinct(), "cc-edges")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b): every node that has an edge to another one, except the smallest
    of its component, with that smallest node.  ``edges``: two columns of one
    orderable type; loops and repeated edges are fine."""
    first, second = edges.columns
    now = materialise(edges.select(F.col(first).alias("a"), F.col(second).alias("b"))
                      .where("a != b").distinct(), "cc-edges")
    # the pair of sums tells whether a round changed the set of edges
    state = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = None
    for _ in range(max_rounds):
        after = now.agg(state.alias("s")).first().s
        if after == before or after[0] == 0:
            return now
        before = after
        now = _star(_star(now, large=True), large=False)
    raise RuntimeError(f"components need more than {max_rounds} rounds")

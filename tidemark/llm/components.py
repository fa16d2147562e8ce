"""Connected components of a link table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    First every node is merged with its smallest neighbour, in one pass: of the many links within a dense group
    few are left, and only those go through the rounds. In each round every node hooks itself and its parent to the smallest grandparent among its neighbours and
    jumps to its own grandparent, so the number of rounds grows with the logarithm of the longest path. Only
    minima per node are kept, so a hub costs no task more than its share: sums are partly built before the
    shuffle, and the join on a hub's edges can be split. Empty input gives an empty table. Self links and
    repeated links change nothing; links with a null end are ignored.
    """
    edges = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).dropna()
    both = materialize(edges.union(edges.select(F.col("v"), F.col("u"))).distinct(), "links")
    first = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("f")), "first")
    left, right = first.select("u", F.col("f").alias("p")), first.select(F.col("u").alias("v"), F.col("f").alias("q"))
    merged = both.where("u < v").join(left, "u").join(right, "v").where("p != q")
    merged = merged.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct()
    rest = _labels(materialize(merged, "merged"), max_rounds)
    out = first.join(rest, first.f == rest.node, "left")
    return out.select(F.col("u").alias("node"), F.coalesce("component", "f").alias("component"))


def _labels(edges: DataFrame, max_rounds: int) -> DataFrame:
    """(node, component) of distinct links (u, v)."""
    both = materialize(edges.union(edges.select(F.col("v"), F.col("u"))), "links")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("f")), "labels")
    total = _total(labels)
    for _ in range(max_rounds):
        parents = labels.select(F.col("node").alias("p"), F.col("f").alias("gf"))
        now = labels.join(parents, labels.f == parents.p).select("node", "f", "gf")
        near = both.join(now.select(F.col("node").alias("v"), "gf"), "v").groupBy("u").agg(F.min("gf").alias("m"))
        step = now.join(near, now.node == near.u).select(
            F.explode(
                F.array(
                    F.struct(F.col("f").alias("node"), F.col("m").alias("f")),
                    F.struct(F.col("node"), F.least("m", "gf").alias("f")),
                )
            ).alias("x")
        )
        new = materialize(step.select("x.*").groupBy("node").agg(F.min("f").alias("f")), "labels")
        discard(labels)
        labels, before = new, total
        total = _total(labels)
        if total == before:
            break
    else:
        raise RuntimeError("connected_components: no end within max_rounds")
    return labels.select("node", F.col("f").alias("component"))


def _total(labels: DataFrame):
    return labels.agg(F.sum(F.col("f").cast("decimal(20,0)"))).first()[0]

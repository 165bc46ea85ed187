"""Connected components by alternating star steps, written to the shared folder after each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tokenloom.session import materialise


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges and their mark, number and hash, taken from the same job; equal marks mean that nothing changed.

    A task that is repeated after an executor was lost may be counted twice.  Then marks differ that should not, and
    another round is made.
    """
    seen = Observation()
    stored = materialise(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "edges")
    return stored, (seen.get["n"], seen.get["h"])


def _star(pairs: DataFrame) -> DataFrame:
    """``(a, b)`` with b the least of a node's neighbours and the node, for each neighbour a.

    The least one per node is a partial aggregate; the join back is a plain join of two tables, in
    which Spark splits a node with very many neighbours.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _both(edges: DataFrame, *ends: tuple) -> DataFrame:
    """A row ``(u, v)`` for each pair of columns, in one pass over the edges."""
    return edges.select(F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in ends])).alias("e")).select("e.*")


def _round(now: DataFrame) -> DataFrame:
    """All larger neighbours of a node point to its least neighbour, then all smaller ones."""
    large = _star(_both(now, ("a", "b"), ("b", "a"))).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return _both(_star(large), ("v", "m"), ("u", "m")).where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for all nodes of the undirected edges ``(a, b)``; root is the least node.

    Rounds grow with the logarithm of the longest path.  Nothing is collected but two figures.
    """
    now, mark = _stored(edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct())
    for _ in range(rounds):
        if not mark[0]:
            break
        last = mark
        now, mark = _stored(_round(now))
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b"), F.col("b")).distinct())

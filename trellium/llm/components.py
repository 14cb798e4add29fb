"""Connected components by alternating large-star and small-star contraction.

Each round is two aggregations and two equi-joins over the edge table; minima are
combined before the shuffle. Nodes of more than ``HUB`` edges, of which there are at most
twice the edges over ``HUB``, have their minima broadcast, so their edges are not
shuffled and do not meet in one task. The contraction ends when all edges are stars.
No edge, label or component reaches the driver; only two numbers do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.llm.scratch import Stored, store

MAX_ROUNDS = 60
HUB = 200_000


def _large_star(edges: DataFrame, hubs: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
    if not hubs:
        met = both.join(low, "u")
    else:
        few = F.broadcast(low.where(F.col("c") > HUB))
        rest = both.join(few.select("u"), "u", "left_anti").join(low.where(F.col("c") <= HUB), "u")
        met = both.join(few, "u").unionByName(rest)
    return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _shape(edges: DataFrame) -> tuple[int, int]:
    """How many nodes are no part of a star (the larger end of one edge, or the smaller of some), and the largest degree."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    per = ends.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    row = per.agg(F.count_if((F.col("up") > 1) | (F.col("up") == 1) & (F.col("down") > 0)), F.max(F.col("up") + F.col("down"))).first()
    return row[0], row[1] or 0


def connected_components(edges: DataFrame) -> Stored:
    """Roots of the nodes that have links.

    ``edges`` has two columns ``u`` and ``v`` of one orderable type, structs among them;
    loops, repeats and either direction are allowed, rows with a null end are ignored. Returns a stored table
    ``u, root`` with one row per node that is not the smallest of its component;
    a node that is missing from it is its own root. An empty input gives an empty table.
    """
    start = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    held = store(start, "edges")
    for _ in range(MAX_ROUNDS):
        moving, degree = _shape(held.df)
        if not moving:
            break
        later = store(_small_star(_large_star(held.df, degree > HUB)), "edges")
        held.drop()
        held = later
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return Stored(held.spark, held.path, held.df.select("u", F.col("v").alias("root")))


def extended(known: Stored, links: DataFrame) -> Stored:
    """The roots of ``known`` after more links (u, v): only the graph of the roots that they join is contracted anew.

    Takes the place of ``known``, which is dropped.
    """
    roots = known.df.select(F.col("u").alias("node"), "root")
    left = links.join(roots.withColumnRenamed("root", "a"), F.col("u") == F.col("node"), "left").select(F.coalesce("a", "u").alias("u"), "v")
    both = left.join(roots.withColumnRenamed("root", "b"), F.col("v") == F.col("node"), "left").select("u", F.coalesce("b", "v").alias("v"))
    joined = connected_components(both)
    after = joined.df.select(F.col("u").alias("old"), F.col("root").alias("new"))
    moved = known.df.join(after, F.col("root") == F.col("old"), "left").select("u", F.coalesce("new", "root").alias("root"))
    merged = store(moved.unionByName(joined.df), "roots")
    joined.drop()
    known.drop()
    return merged

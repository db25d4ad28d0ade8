"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import discard, materialise, owning


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return owning(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least)


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. Edges come with u > v."""
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return owning(moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), least)


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own, after which what it was made from goes."""
    out = materialise(df, name)
    discard(df)
    return out


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """The component of every node that has an edge to another one.

    ``edges``: two columns ``u`` and ``v`` of one orderable type. Null ends and loops are ignored; repeated and
    reversed edges count once. Returns ``node, root``: ``root`` is the least node of the component and has a row
    itself. An empty input gives an empty result. Every round is a written table in the shared folder, and those of the
    round before go. Minima are pre-aggregated before each shuffle and written too: a join of two tables is one whose hot
    keys the adaptive planner splits, which it can't where a side is aggregated in the join's own stage.
    """
    edges = edges.where("u is not null and v is not null and u <> v")
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head()
        if not state[0]:
            break
        large = _written(_large_star(edges), "large")
        after = _written(_small_star(large), "stars")
        discard(large)
        same = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head() == state
        discard(edges)
        edges = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return owning(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()), edges)

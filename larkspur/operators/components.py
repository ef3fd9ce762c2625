"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import cut

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (null ends are left out). Returns id, component (the smallest id of the component).

    Alternating large-star and small-star steps: an edge set of the same order as the input is rewritten until every
    node hangs on its component's smallest id. Each round is cut by a checkpoint. A node of any degree costs one
    aggregated minimum, not a collected list.
    Doubling the reach every round, it settles after few rounds; if it hasn't after ``MAX_ROUNDS``, that is an error.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        links = cut(small)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components haven't settled after {MAX_ROUNDS} rounds")
    return nodes.join(links.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))

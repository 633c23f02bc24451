"""Connected components of an edge table, by alternating large-star and small-star steps
(Kiveris et al. 2014). Each step is a partial aggregation and an equi-join; nothing is collected."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every neighbour of u (large: above u; small: below u, and u) with u's least neighbour."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("_low")).select("u", F.least("_low", "u").alias("_low"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_low").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("_low").alias("v")).unionByName(least.select("u", F.col("_low").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges(u, v) → (node, component): the least node that each node reaches. Nodes without an edge
    are absent; loops and repeated edges do not matter. An empty table gives an empty one."""
    edges = written(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most):
        edges = written(_star(_star(edges, large=True), large=False), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), F.count_distinct("u").alias("d")).first()
        if now == before or now["n"] == 0:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def connected_components(edges: DataFrame, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """edges: (u long, v long). Returns (node, comp): comp is the smallest node of node's component; only nodes with an edge occur.

    Nulls and self edges are ignored; repeated edges count once. Each round's edges are written to the shared
    folder, so lineage stays short and lost executors cost one round; nothing is gathered on the driver but a count and a hash.
    An error if more than max_rounds are needed.
    """
    e = cut(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        tag,
    )
    seen = None
    for _ in range(max_rounds):
        both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(e.select(F.col("v").alias("a"), F.col("u").alias("b")))
        # Written, so that both sides of the join come straight from a shuffle: then a node with very many edges is split over tasks.
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")), tag)
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("u"), F.least("a", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = cut(small, tag)
        drop_cut(low)
        drop_cut(e)
        e = after
        now = tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())

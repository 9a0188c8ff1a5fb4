"""Connected components by alternating large and small stars, every step a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame, scratch: shared.Scratch | None = None, most_rounds: int = 60) -> DataFrame:
    """``edges``: longs ``a``, ``b``.  -> ``node``, ``root`` (the least node of its component) for nodes with an edge.

    Self-edges, nulls and repeated edges don't matter; no edges give an empty result.  The number of rounds grows with the
    logarithm of the longest path.  Minima of neighbours are aggregated before the shuffle, so a hub is one row of each
    task; they are written, so that both sides of the join with them are shuffled and a hub's rows can be split there.  The
    result reads a table of ``scratch`` or, without one, a table of its own; earlier rounds' tables are deleted.
    """
    spark = edges.sparkSession
    old = shared.Scratch(spark, "edges", scratch)
    start = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = old.put(start, "edges"), None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before, new = state, shared.Scratch(spark, "edges", scratch)
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = new.put(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = new.put(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large-star")
        least = new.put(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = new.put(small.union(least.select("u", "m")).distinct(), "small-star")
        old.drop()
        old = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
    if scratch is None:
        out = shared.materialise(out, "components")
        old.drop()
    return out

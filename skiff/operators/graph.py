"""Connected components."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiff.operators.store import discard, stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) longs to (node, component): component is the smallest node reachable. Nodes without edges are not returned.

    Alternates large-star and small-star steps, each a partial aggregation and an equi-join (which adaptive execution
    splits where a node has very many edges); each round's edges go to the shared folder, and the last round's leave it."""
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node whose least is itself keeps its own edges: they are (v, u) there already
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(pair).alias("e")).select("e.*")
        e, last = stored(small.where("u <> v").distinct()), e
        discard(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == mark or not now[0]:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    own = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)

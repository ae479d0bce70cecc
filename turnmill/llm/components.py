"""Connected components by alternating stars (Kiveris et al. 2014), all in joins and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import cut


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root for every node of edges (a, b), where root is the smallest node it reaches.

    Each round hangs every node on a smaller neighbour's minimum; the rounds needed grow with
    the logarithm of the longest path. A hub's edges meet its minimum in a join, which adaptive
    execution splits when it is skewed; no node's neighbours are ever gathered. Self links are
    allowed and keep a lone node; null ends are dropped; without edges there are no rows.
    """
    now = cut(
        edges.where("a is not null and b is not null")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        name,
    )
    before = None
    while True:
        state = now.agg(
            F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(u as decimal(38)) + v)")
        ).first()
        if state == before:
            break
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Larger neighbours hang on the minimum of all neighbours ...
        large = both.where("v >= u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # ... then smaller ones, and the node itself, on the minimum of the smaller ones.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(low.select("u", "m")).where("u >= v").distinct(), name)
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))

"""Connected components as a checkpointed DataFrame loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomflux.plans.lineage import materialize, release


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Smallest reachable node of each node that has an edge.

    ``edges``: columns ``a`` and ``b`` of one orderable type, any direction, repeats and loops allowed; rows with a null are
    left out. Returns ``node``, ``label``. Each round is a large-star and a small-star: neighbours above a node are hooked on
    the least of its neighbourhood, then those below it, so rounds grow with the square of the logarithm at most. The loop ends
    when the links are stars, whose centres are then the least nodes; if ``max_rounds`` do not reach that, it raises. The
    aggregates combine on the map side, so a hub is never gathered in one task. The joins are merges: tables that shrink from
    round to round would else be broadcast by way of the driver, each time anew.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    links = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(max_rounds):
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").limit(1).count():
            return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = materialize(both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct(), "large")
        release(links)
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        # The row of the least itself hooks its own node, so the aggregate is made once.
        small = large.join(least.hint("merge"), "a").select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"))
        links = materialize(small.distinct(), "links")
        release(large)
    raise RuntimeError(f"components not found in {max_rounds} rounds")

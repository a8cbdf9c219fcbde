"""Connected components of a graph too large for one machine, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import release, stored


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """Every node's larger (or not larger) neighbours are linked to the smallest node it knows of."""
    if large:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
    linked = both.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("root").alias("b")).union(
            least.select("a", F.col("root").alias("b"))
        )
    return out.where("a <> b").distinct()


def connected_components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, root) for every node `a` of the links (a, b) that is not the smallest of its component.

    Each round is one aggregate and one join for each star, both splittable where a node has very many
    links, and its links are written to the shared folder, so a lost executor never restarts earlier rounds.
    A round's links go once the next round's are written. Rounds grow with the logarithm of the longest chain; the loop ends when the links no longer change.
    """
    links = stored(pairs.select("a", "b").where("a <> b").distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        before, links = links, stored(_stars(_stars(links, True), False), "links")
        release(before)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return links.select("a", F.col("b").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")

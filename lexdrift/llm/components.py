"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdrift.plans.workspace import stored

MAX_ROUNDS = 60


def _star(links: DataFrame, smallest: DataFrame) -> DataFrame:
    """Every far end of a link takes the smallest neighbour of the near end."""
    return links.join(smallest, "near").select(F.col("far").alias("near"), F.col("least").alias("far"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b: long); the component is its
    smallest node. Large and small stars in turn, until each component is one star. Minima
    are aggregated before the shuffle; a hub's links meet its one minimum in a sort-merge
    join, which the engine splits. Every round is written, so none depends on lost tasks.

    Defined cases: links that are null, loops or repeated add nothing; no links, no rows."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("near"), F.least("a", "b").alias("far"))
    edges = stored(edges.distinct(), "links")
    mark = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("far").alias("near"), F.col("near").alias("far")))
        least = both.groupBy("near").agg(F.least("near", F.min("far")).alias("least"))
        large = _star(both.where("far > near"), least).where("near <> far").distinct()
        # Here `near` is the larger end again: a large star links every node to a smaller one.
        least = large.groupBy("near").agg(F.min("far").alias("least"))
        small = _star(large, least).where("near <> far").unionByName(
            least.select("near", F.col("least").alias("far"))
        )
        edges = stored(small.distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("near", "far").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("near").alias("node"), F.col("far").alias("component"))
    centres = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.unionByName(centres)

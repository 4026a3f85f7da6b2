"""Connected components of a graph of links, by alternating star contractions.

Each round a node's links are moved to the smallest node it is linked with.  Rounds
are joins and aggregations over the links, stored in the shared folder; no node's
links are ever gathered, and the driver sees only a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wayside.llm.common import stored


# Links of a round up to which the smallest neighbours are broadcast: at most twice as
# many rows of two numbers.
FEW = 200_000


def _moved(links: DataFrame, few: bool) -> DataFrame:
    """Links (node, other) of every node moved to its smallest neighbour.

    Few are broadcast.  Many are dealt out once more, by another hash, so that both sides
    of the join are plain shuffles: Spark can then split the links of a hub.
    """
    smallest = links.groupBy("node").agg(F.min("other").alias("least"))
    side = F.broadcast(smallest) if few else smallest.repartition(F.xxhash64("node"))
    return links.join(side, "node")


def _large_star(links: DataFrame, few: bool) -> DataFrame:
    """May give a link several times; the other step ends with distinct ones."""
    both = links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other")))
    return (
        _moved(both, few)
        .withColumn("least", F.least("node", "least"))
        .filter("other > node")
        .select(F.col("other").alias("node"), F.col("least").alias("other"))
    )


def _small_star(links: DataFrame, few: bool) -> DataFrame:
    moved = _moved(links, few)
    return (
        moved.filter("other != least")
        .select(F.col("other").alias("node"), F.col("least").alias("other"))
        .unionByName(moved.select("node", F.col("least").alias("other")))
        .distinct()
    )


def _stored(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The finished links, with their number and a checksum taken as they are written."""
    seen = Observation()
    total = F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))
    kept = stored(links.observe(seen, F.count("*").alias("n"), total.alias("total")), "links")
    return kept, (seen.get["n"], seen.get["total"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (node, other) that is not the smallest
    of its component, which is the root."""
    ordered = (
        links.filter("node != other")
        .select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other"))
        .distinct()
    )
    links, state = _stored(ordered)
    while state[0]:
        before = state
        few = state[0] <= FEW
        links, state = _stored(_small_star(_large_star(links, few), few))
        if before == state:
            break
    return links.withColumnRenamed("other", "root")

"""Connected components of a link table, by alternating stars.

Large and small stars (Kiveris et al., 2014) turn the links into stars around the
smallest node of each component in a logarithmic number of rounds. Each round is
two aggregates and two joins; the links are written to the shared folder after
it, and only their number and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.text import staged


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select("u", F.least("u", "least").alias("least"))
    return both.join(least, "u").filter("v > u").select(
        F.col("v").alias("u"), F.col("least").alias("v")
    ).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    moved = down.join(least, "u").filter("v != least").select(
        F.col("v").alias("u"), F.col("least").alias("v")
    )
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots; a root is the smallest node reachable.

    ``links`` has two columns of one type; their order and repeats do not matter.
    No links give an empty result.
    """
    links = links.toDF("u", "v").filter("u != v")
    before = None
    links = staged(links.distinct(), "links")
    while True:
        links = staged(_small_star(_large_star(links)), "links")
        now = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == before:
            return links.toDF("node", "root")
        before = now

"""Connected components of a link table, on Spark: alternating large and small stars.

Every half-step is a minimum per node (combined before the shuffle) and a join on the
node. The minima are written first, so both sides of the join are plain exchanges that
AQE splits when one node has very many links. Nothing is collected; rounds end when the
links no longer change (about the logarithm of the longest chain).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import reliable_checkpoint


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u > v) in, links (u > v) out."""
    if large:      # all neighbours above a node point to its smallest neighbour
        sides = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = reliable_checkpoint(sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
        out = sides.filter("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:          # all neighbours below a node, and the node, point to the smallest
        low = reliable_checkpoint(links.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"))
        moved = links.join(low, F.col("u") == F.col("k")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return reliable_checkpoint(out.distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node above the smallest of its component; columns a, b in."""
    now = reliable_checkpoint(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not seen[0] or seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = seen
        now = _star(_star(now, True), False)

"""Connected components of a table of links, by alternating stars.

Large star: each node links its larger neighbours to its smallest one. Small star: each node links its
smaller neighbours, and itself, to the smallest of them. Both are an aggregation to minima, which
combines before the shuffle, and a join back, which adaptive execution splits where a node has very
many neighbours. The links end as one star per component. Every round is written to the shared
folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoscope.llm import files


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Takes links (a, b) with b < a."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    others = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """``node, root`` for every node that has a link to another; the root, the component's smallest node,
    has no row of its own. Links are (a, b) in any direction, repeated ones and loops included; those with
    a null are no links. Returns the table and where it lies, for :func:`files.drop`."""
    spark = links.sparkSession
    start = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = files.written(start, "links")
    before = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")), path
        stars = _small_star(_large_star(now).distinct()).distinct()
        following, to = files.written(stars, "links")
        files.drop(spark, path)
        now, path, before = following, to, state

"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpanel.sources.sinks import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in `links` (a, b): label is the smallest id that it reaches.

    Alternates two star steps: neighbours larger than a node are linked to its smallest neighbour, then
    smaller ones likewise. Every step keeps the components and the minimum is combined before the
    shuffle; a chain of n links needs about log n rounds. Each round is a written table, so the loss
    of an executor repeats one round at most.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialize(links.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select(b, a))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").filter(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        edges = materialize(small.union(low.select("a", "m")).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(b.alias("id")).distinct()
    return edges.select(a.alias("id"), b.alias("label")).union(roots.select("id", F.col("id").alias("label")))

"""Connected components of a graph given by its links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.llm import common as K


def roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that isn't itself the smallest of its component.

    Each round points the larger neighbours of every node at its smallest neighbour
    (large star), then the smaller ones and the node itself (small star), until the
    links no longer change. A round is written to the shared folder, so no lineage
    grows. Minima are aggregated before they are shuffled.
    """
    now = K.settled(
        links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    state = _state(now)
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("least").alias("lo"))
        large = K.settled(large.distinct())
        lowest = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = (
            large.join(lowest, "hi").where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
            .unionAll(lowest)
        )
        now = K.settled(small.distinct())
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _state(links: DataFrame) -> tuple:
    return tuple(
        links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")),
        ).first()
    )

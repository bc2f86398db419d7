"""The best rows of a table, however many are asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysieve.functions.lineage import stored

#: Up to so many rows one task can hold the best of all tasks.
HEAP_ROWS = 10_000
_BINS = 4096


def best(rows: DataFrame, limit: int, score: str, order: Sequence[str]) -> DataFrame:
    """The ``limit`` rows that come first by ``score``, highest first, then by ``order``.

    A few rows are the best of each task's best. For more, a histogram of the scores
    (4,096 bins between the least and the greatest) says which bin the limit falls in:
    rows above it are taken as they are, and only that bin's rows are sorted, by ranges of
    score and ``order`` over all tasks, and cut after as many as are left. So no task holds
    more than its part, whatever the limit, and equal scores spread like others. Null and
    NaN scores come last. ``order`` must tell all rows apart; ``rows`` is read twice.
    """
    value = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    ordering = [value.desc_nulls_last(), *(F.asc(c) for c in order)]
    if limit <= HEAP_ROWS:
        return rows.orderBy(*ordering).limit(limit)
    least, most = rows.agg(F.min(value), F.max(value)).first()
    span = (most - least) if least is not None else 0.0
    at = F.floor((value - F.lit(least)) * F.lit(_BINS / span)) if 0 < span < float("inf") else F.when(value.isNotNull(), F.lit(0))
    place = F.coalesce(at.cast("long"), F.lit(-1).cast("long"))
    counts = {r["bin"]: r["n"] for r in rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()}
    left, last = limit, None
    for name in sorted(counts, reverse=True):
        if counts[name] >= left:
            last = name
            break
        left -= counts[name]
    if last is None:
        return rows
    above = rows.where(place > last)
    return above.unionByName(_first(rows.where(place == last), left, ordering))


def _first(rows: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """The first rows in an order, by a range sort and the sizes of its parts."""
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(
        {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    )
    held = stored(numbered)
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    # One row per part.
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    return held.join(F.broadcast(starts), "_part").where(F.col("_before") + F.col("_at") < limit).select(*rows.columns)

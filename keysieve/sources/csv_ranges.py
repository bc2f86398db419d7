"""CSV whose records may span lines, read in byte ranges.

A line break ends a record if the quotes before it in the file are even in number. A task
can't know that number for its range, but it can count the quotes in it; a running sum
over ranges (one row each) then tells every range how it starts. So a file is read by as
many tasks as it has ranges. What a range holds of a record that began before it is a
fragment; fragments, two a range at most, are put together afterwards.

Quotes inside values are doubled, as this package writes them.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysieve.functions.lineage import stored

_WHOLE, _OPENS, _GOES_ON, _CLOSES = range(4)


def _values(text: str) -> list[str]:
    """Values of a record; none of a blank line."""
    csv.field_size_limit(sys.maxsize)
    return next(csv.reader(io.StringIO(text, newline=""), strict=False), [])


def _records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Values of whole records and texts of fragments of each range, numbered; a range's rows come in their order."""
    names = ["file", "block", "number", "kind", "text", "v"]
    now, number, parts, odd, inside = None, 0, [], False, False

    def ended() -> Iterator[tuple]:
        if parts:
            # The range ends within a record that began in it, or before it.
            yield (*now, number, _GOES_ON if inside else _OPENS, "".join(parts), None)

    for frame in frames:
        out = []
        for file, block, start, line in zip(frame["file"], frame["block"], frame["odd"], frame["line"]):
            if (file, block) != now:
                if now is not None:
                    out.extend(ended())
                now, number, parts, odd = (file, block), 0, [], bool(start)
                inside = odd
            parts.append(line + "\n")
            odd ^= bool(line.count('"') & 1)
            if not odd:
                text = "".join(parts)
                out.append((*now, number, _CLOSES, text, None) if inside else (*now, number, _WHOLE, None, _values(text)))
                number, parts, inside = number + 1, [], False
        if out:
            yield pd.DataFrame(out, columns=names)
    out = list(ended()) if now is not None else []
    if out:
        yield pd.DataFrame(out, columns=names)


def read_csv_ranges(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, nulls and missing values as empty, and ``row_id``: files by name, rows by place.

    Every file starts with a header; the first file's names count, further values of a row
    are dropped. Blank lines between records are no rows. The rows are stored.
    """
    names = spark.read.option("header", True).option("escape", '"').csv(path).columns
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.make_valid_utf8("value").alias("line"),
    )
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes")).select(
        F.col("file").alias("_file"), F.col("block").alias("_block"), (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("odd")
    )
    # One row per range: it goes to the lines, which so keep their order.
    known = lines.join(F.broadcast(starts), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))).drop("_file", "_block")
    parts = stored(known.mapInPandas(_records, "file string, block long, number long, kind int, text string, v array<string>"))
    pieces = parts.where(F.col("kind") != _WHOLE)
    opened = F.count_if(F.col("kind") == _OPENS).over(Window.partitionBy("file").orderBy("block", "number"))

    @F.pandas_udf("array<string>")
    def values(texts: pd.Series) -> pd.Series:
        return pd.Series([_values(t) for t in texts], dtype=object)

    joined = (
        pieces.withColumn("_record", opened).groupBy("file", "_record")
        .agg(F.sort_array(F.collect_list(F.struct("block", "number", "text"))).alias("p"))
        .select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["number"].alias("number"),
                values(F.array_join(F.transform("p", lambda x: x["text"]), "")).alias("v"))
    )
    whole = parts.where(F.col("kind") == _WHOLE).select("file", "block", "number", "v")
    parsed = stored(whole.unionByName(joined).where(F.size("v") > 0))
    counts = parsed.groupBy("file", "block").agg(F.count(F.lit(1)).alias("rows"))
    # One row per range; every file's header takes a number that no row gets.
    ahead = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    files = F.dense_rank().over(Window.orderBy("file"))
    placed = counts.select(
        F.col("file").alias("_file"), F.col("block").alias("_block"), (F.coalesce(F.sum("rows").over(ahead), F.lit(0)) - files).alias("ahead"),
        F.row_number().over(order).alias("nth"),
    )
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("number"))
    rows = parsed.withColumn("at", place).join(
        F.broadcast(placed), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))
    ).where((F.col("nth") > 1) | (F.col("at") > 1))
    return rows.select(
        *(F.coalesce(F.get("v", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)), (F.col("ahead") + F.col("at") - 1).cast("long").alias("row_id")
    )


# Functions travel to the executors whole, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

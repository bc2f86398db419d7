"""Pattern search over landed files, and attaching content to the hits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType

from keysieve import catalog as C
from keysieve.functions.paths import raw_url
from keysieve.operators.anchors import Patterns, held_by

# Characters of patterns that go to the tasks at a time.
PART_CHARS = 1 << 22
# Files are numbered below this, so that a pattern's hits have their own range of numbers.
FILE_ORDS = 1 << 40
_SALTS = 64


def _holds(part: pa.Table, context: SparkContext) -> Callable[[Column], Column]:
    """Array of the (pattern, pattern_ord) of a part that a folded text holds; null holds none."""
    folded = part["folded"].to_pylist()
    known = [i for i, p in enumerate(folded) if p is not None]
    fields = pa.struct([part.schema.field(n) for n in ("pattern", "pattern_ord")])
    named = part.select(["pattern", "pattern_ord"]).take(pa.array(known, pa.int64())).combine_chunks()
    rows = pa.StructArray.from_arrays([pa.concat_arrays([pa.array([], f.type), *c.chunks]) for f, c in zip(fields, named.columns)], fields=list(fields))
    empty = np.array([i for i, k in enumerate(known) if folded[k] == ""], np.int64)
    shared = context.broadcast((Patterns([folded[k].encode() for k in known]), rows, empty))

    def holds(texts: pa.Array) -> pa.Array:
        patterns, rows, always = shared.value
        offsets, found = held_by(texts, patterns)
        if len(always):
            # The empty pattern is in every text, null apart.
            there = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
            row = np.concatenate([np.repeat(np.arange(len(texts)), np.diff(offsets)), np.repeat(there, len(always))])
            found = np.concatenate([found, np.tile(always, len(there))])
            pairs = np.unique(np.column_stack([row, found]), axis=0)
            found = pairs[:, 1]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(pairs[:, 0], minlength=len(texts)))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows.take(pa.array(found, pa.int64())))

    return F.arrow_udf(holds, ArrayType(from_arrow_type(fields)))


def pattern_hits(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row per file and pattern whose text the file contains, in any case.

    Patterns go to the texts: as flat tables, ``PART_CHARS`` characters of them at a
    time, so that neither the driver nor a task ever holds more. Each part is searched
    in one pass over the files, which look for all its patterns at once; no text is
    shuffled and no file is paired with a pattern it doesn't hold. Null texts hold
    nothing, null patterns are nowhere, the empty pattern is in every text; a repeated
    pattern row is a pattern of its own.
    """
    wanted = patterns.select("pattern", "pattern_ord", F.lower("pattern").alias("folded"))
    kept = [c for c in files.columns if c not in ("content", "pattern", "pattern_ord")]
    parts = 1 + (wanted.agg(F.sum(F.octet_length("folded"))).first()[0] or 0) // PART_CHARS
    number = F.pmod(F.xxhash64("pattern", "pattern_ord"), F.lit(parts))

    def hits(part: int) -> DataFrame:
        held = wanted if parts == 1 else wanted.where(number == part)
        holds = _holds(held.toArrow(), files.sparkSession.sparkContext)
        return files.select(*kept, F.explode(holds(F.lower("content"))).alias("_hit")).select(
            *kept, "_hit.pattern", "_hit.pattern_ord"
        )

    return reduce(DataFrame.unionAll, map(hits, range(parts)))


def numbered(hits: DataFrame, newest: str = "file_ord") -> DataFrame:
    """All hits with ``hit_ord``, unique and in search order: patterns in turn, newest files first."""
    return hits.withColumn("hit_ord", (F.col("pattern_ord") + 1).cast("long") * FILE_ORDS - F.col(newest))


def newest_per_pattern(hits: DataFrame, pages: int = 1, newest: str = "file_ord") -> DataFrame:
    """Only the newest ``100 * pages`` hits of each pattern, numbered by ``hit_ord``.

    For views of a search service's size; a scan takes all hits.

    A pattern may own a large part of all hits, so the limit is taken within
    salted parts of each pattern first; only what survives is ranked together.
    """
    limit = C.HITS_PER_PAGE * pages
    order = [F.desc(newest), F.asc("file_id")]
    parts = Window.partitionBy("pattern_ord", "_salt").orderBy(*order)
    whole = Window.partitionBy("pattern_ord").orderBy(*order)
    return (
        hits.withColumn("_salt", F.pmod(F.xxhash64("file_id"), F.lit(_SALTS)))
        .withColumn("_part_rank", F.row_number().over(parts))
        .where(F.col("_part_rank") <= limit)
        .withColumn("hit_rank", F.row_number().over(whole))
        .where(F.col("hit_rank") <= limit)
        # Unique and in search order: patterns in turn, newest first.
        .withColumn("hit_ord", F.col("pattern_ord").cast("long") * limit + F.col("hit_rank"))
        .drop("_salt", "_part_rank")
    )


def scan_hits(hits: DataFrame) -> DataFrame:
    """The raw-hit columns of a report."""
    return hits.select(
        F.col("repository").alias("Repository"),
        F.col("path").alias("File Path"),
        F.col("url").alias("URL"),
        F.col("pattern").alias("Pattern Source"),
        raw_url(F.col("url")).alias("Raw URL"),
        "hit_ord",
    )


def attach_content(hits: DataFrame, contents: DataFrame, once_per_file: bool = False) -> DataFrame:
    """Source files of raw hits; hits without an address or content are dropped.

    ``contents`` has ``raw_url`` and ``content``; files of ``land_by_address`` are
    joined where they lie, so only hits move. With ``once_per_file`` only a
    file's first hit is kept, which spares reading the same text once per
    pattern and loses no candidate: later copies only repeat the first one's.
    """
    wanted = hits.where(F.col("Raw URL").isNotNull() & (F.col("Raw URL") != ""))
    if once_per_file:
        first = Window.partitionBy("Repository", "File Path", "Raw URL").orderBy("hit_ord")
        wanted = wanted.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    texts = contents.select("raw_url", "content").where(F.col("content").isNotNull())
    return texts.join(wanted, texts["raw_url"] == wanted["Raw URL"]).select(
        F.col("hit_ord").alias("file_id"),
        F.col("hit_ord").alias("file_ord"),
        F.col("Repository").alias("repository"),
        F.col("File Path").alias("path"),
        F.col("URL").alias("url"),
        texts["raw_url"],
        F.col("content"),
        F.col("Pattern Source").alias("pattern_source"),
    )

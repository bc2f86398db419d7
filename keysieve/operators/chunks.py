"""Files too large for one row: read in byte ranges, searched in chunks of whole lines.

Spark's text reader gives each task a byte range of a file, whatever the file's size. A
task packs its lines into chunks; a token run never spans a line break, so no value is
cut. What a chunk needs of its surroundings comes from a running sum over the chunks'
sizes, rows without text: the characters and line breaks before it, and the ends of its
neighbours, which candidates near its edges show in their windows.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.functions import paths
from keysieve.functions.lineage import stored
from keysieve.functions.paths import raw_url
from keysieve.operators.recover import SEGMENT_CHARS, recover_candidates

CHUNK_CHARS = 1 << 20
_HALO = C.ASSET_WINDOW
# Neighbours that a halo reaches over at most; chunks shorter than a halo are merged within their range.
_NEIGHBOURS = 4
_TOKEN = re.compile(C.TOKEN_CLASS + "*")
_PACKED = pa.schema([("path", pa.string()), ("block", pa.int64()), ("number", pa.int64()), ("content", pa.string())])


def _packed(chars: int, least: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of lines of one file and byte range, of about ``chars`` characters, longer lines cut between runs.

        Lines are measured and joined by Arrow, so that only whole chunks become Python texts.
        """
        now, number, held, parts, size = None, 0, None, [], 0

        def row(text: str) -> tuple:
            nonlocal number
            number += 1
            return (*now, number, text)

        def ended() -> Iterator[tuple]:
            nonlocal held, parts, size
            rest = "".join(parts)
            parts, size = [], 0
            # A short rest goes with what came before it.
            if held is not None and len(rest) < least:
                rest, held = held + rest, None
            for text in (held, rest):
                if text:
                    yield row(text)
            held = None

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows), _PACKED.types)], schema=_PACKED
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            paths_, blocks, lines = (batch.column(c) for c in ("path", "block", "line"))
            same = pc.and_(pc.equal(paths_[1:], paths_[:-1]), pc.equal(blocks[1:], blocks[:-1])).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(~same.astype(bool)) + 1).tolist(), len(lines)]
            ends = np.cumsum(pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            for at, stop in zip(edges, edges[1:]):
                own = (paths_[at].as_py(), blocks[at].as_py())
                if own != now:
                    if now is not None:
                        out.extend(ended())
                    now, number = own, 0
                while at < stop:
                    before = int(ends[at - 1]) if at else 0
                    # Up to the line that fills the chunk.
                    upto = min(int(np.searchsorted(ends, before + chars - size)) + 1, stop)
                    parts.append(_joined(lines[at:upto]))
                    size += int(ends[upto - 1]) - before
                    at = upto
                    while size >= chars:
                        whole = "".join(parts)
                        cut = len(whole)
                        if cut >= 2 * chars:
                            cut = _TOKEN.match(whole, chars).end()
                        if held:
                            out.append(row(held))
                        held, parts = whole[:cut], [whole[cut:]]
                        size = len(parts[0])
            if out:
                yield sent(out)
        out = list(ended()) if now is not None else []
        if out:
            yield sent(out)

    return pack


def _joined(lines: pa.Array) -> str:
    """The text of the lines, each with its break."""
    offsets = pa.array([0, len(lines)], pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, lines), pa.scalar("\n", lines.type))[0].as_py() + "\n"


def read_chunks(
    spark: SparkSession, path: str, repository: str = "", base_url: str = "", chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """Chunks of the files under ``path``, as source files whose ``content`` has a halo on both sides.

    Columns of a source file, and ``lead`` (characters of the halo before), ``core``
    (characters between the halos) and ``chars_before``, ``lines_before``,
    ``column_before``: what precedes the halo in the file, ``column_before`` on its line.
    A file counts one line break at its end, whether it has it or not. Python files are
    left out: their context needs the whole file (``read_text_files``). The chunks
    are stored. A line is read whole by one task, however chunks are cut.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    rows = lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.make_valid_utf8("value").alias("line"),
    )
    least = min(_HALO, chunk_chars)
    packed = rows.mapInArrow(_packed(chunk_chars, least), "path string, block long, number long, content string")
    # Asked of chunks, not of every line.
    chunks = stored(packed.where(paths.language(F.col("path")) != "python"))
    after_break = F.length(F.substring_index("content", "\n", -1))
    sizes = chunks.select(
        "path", "block", "number", F.length("content").alias("chars"), (F.size(F.split("content", "\n", -1)) - 1).alias("breaks"),
        after_break.alias("open"), F.left("content", F.lit(_HALO)).alias("head"), F.right("content", F.lit(_HALO)).alias("tail"),
    )
    order = Window.partitionBy("path").orderBy("block", "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    near = F.concat(*(F.coalesce(F.lag("tail", k).over(order), F.lit("")) for k in range(_NEIGHBOURS, 0, -1)))
    next_ = F.concat(*(F.coalesce(F.lead("head", k).over(order), F.lit("")) for k in range(1, _NEIGHBOURS + 1)))
    # Characters since the last line break: of the chunks after the last one with a break.
    group = F.count_if(F.col("breaks") > 0).over(before)
    placed = sizes.select(
        "path", "block", "number", "chars", F.right(near, F.lit(_HALO)).alias("before"), F.left(next_, F.lit(_HALO)).alias("after"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("ahead"), F.coalesce(F.sum("breaks").over(before), F.lit(0)).alias("lines"),
        F.col("open"), F.col("breaks"), group.alias("group"),
    )
    within = Window.partitionBy("path", "group").orderBy("block", "number").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("breaks") > 0, 0).otherwise(F.col("open"))
    last_open = F.max_by(F.when(F.col("breaks") > 0, F.col("open")), F.when(F.col("breaks") > 0, F.struct("block", "number"))).over(before)
    placed = placed.withColumn("start", F.coalesce(last_open, F.lit(0)) + F.coalesce(F.sum(own).over(within), F.lit(0)))
    halo_breaks = F.size(F.split("before", "\n", -1)) - 1
    lead = F.length("before")
    relative = F.regexp_replace("path", r"^.*?\Q%s\E/" % path.rstrip("/"), "")
    url = F.concat(F.lit(base_url), relative)
    file_id = F.xxhash64("path")
    whole = placed.select(
        F.col("path").alias("_path"), F.col("block").alias("_block"), F.col("number").alias("_number"), "before", "after", lead.alias("lead"),
        F.col("chars").alias("core"), (F.col("ahead") - lead).alias("chars_before"), (F.col("lines") - halo_breaks).alias("lines_before"),
        F.when(halo_breaks == 0, F.col("start") - lead).otherwise(0).alias("column_before"),
    )
    same = (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")) & (F.col("number") == F.col("_number"))
    return chunks.join(whole, same).select(
        file_id.alias("file_id"), file_id.alias("file_ord"), F.lit(repository).alias("repository"), relative.alias("path"),
        url.alias("url"), raw_url(url).alias("raw_url"), F.concat("before", "content", "after").alias("content"),
        "lead", "core", "chars_before", "lines_before", "column_before",
    )


_PLACE = ("lead", "core", "chars_before", "lines_before", "column_before")


def recover_from_chunks(
    chunks: DataFrame, signatures: Sequence[C.Signature] = C.SIGNATURES, segment_chars: int = SEGMENT_CHARS
) -> DataFrame:
    """Candidates of chunks with their places in the whole files, as ``recover_candidates`` gives them.

    The signatures' values must lie between line breaks, as the catalogue's do.
    """
    found = recover_candidates(chunks, signatures, segment_chars, keep=_PLACE)
    inside = (F.col("start_index") >= F.col("lead")) & (F.col("start_index") < F.col("lead") + F.col("core"))
    first_line = F.when(F.col("line_number") == 1, F.col("column_before")).otherwise(0)
    return found.where(inside).withColumns({
        "start_index": (F.col("start_index") + F.col("chars_before")).cast("long"),
        "end_index": (F.col("end_index") + F.col("chars_before")).cast("long"),
        "column_number": (F.col("column_number") + first_line).cast("long"),
        "line_number": (F.col("line_number") + F.col("lines_before")).cast("long"),
    }).drop(*_PLACE)


# Functions travel to the executors whole, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

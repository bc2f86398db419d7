"""Best-fit packing of documents into sequences, with certified bin counts.

Pieces are dealt into groups of bounded size, and each group is packed best-fit
decreasing. Dual-feasible functions give a lower bound on the bins that its pieces
need: a group at its bound is certified and final. While all groups together use more
bins than the bound of all pieces (taken from the 1,024 counts by length), groups with
a gap exchange: the pieces of their bins with free room are dealt anew and packed
again, and the new bins stay where they are fewer, until a round saves none.
"""

from __future__ import annotations

import itertools
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve.llm import common as K
from keysieve.llm.tokens import BatchEncoder

CAPACITY = 1024
END_ID = 2
#: Pieces of a group, about; more pieces make more groups.
GROUP = 40_000

_PIECE = "piece int, start long, length long, ids_crc32 long"


def piece_lengths(size: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole if it fits, else full ones after a first that may be shorter."""
    if size <= capacity:
        return [size]
    first = size % capacity
    return ([first] if first else []) + [capacity] * (size // capacity)


def document_pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, ids_as: str | None = None) -> DataFrame:
    """Pieces of every document: its token ids and ``end_id``, cut only where they exceed ``capacity``.

    A null text is empty and has the end id alone. The checksum is that of the ids as
    little-endian unsigned 32-bit integers; ``ids_as`` names a type to add the ids in.
    """
    schema = T.StructType([documents.schema["doc_id"]])
    for field in T.StructType.fromDDL(_PIECE):
        schema.add(field)
    if ids_as:
        schema.add("ids", T.BinaryType())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or BatchEncoder(tokenizer)
            texts = batch.column(1).to_pylist()
            sizes = [len(t or "") for t in texts]
            lo = 0
            while lo < len(texts):
                hi, n = lo, 0
                while hi < len(texts) and (hi == lo or n + sizes[hi] <= K.BLOCK_BYTES):
                    n += sizes[hi]
                    hi += 1
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, own in enumerate(encoder.encode(texts[lo:hi]), lo):
                    own = np.append(own, end_id).astype("<u4")
                    at = 0
                    for k, size in enumerate(piece_lengths(len(own), capacity)):
                        raw = own[at : at + size].tobytes()
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(raw))
                        if ids_as:
                            ids.append(own[at : at + size].astype(ids_as).tobytes())
                        at += size
                columns = [
                    batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if ids_as else []), schema.names)
                lo = hi

    return K.in_batches(documents).select("doc_id", "text").mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and each bin's free room, best-fit decreasing.

    Open bins are kept by free room; a set bit marks each room that some bin has, so the
    tightest bin that a piece fits in is the lowest set bit from its length on.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, free = 0, []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            own, room = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i] = own, capacity - room
        left = room - size
        free[own] = left
        if left:
            by_room[left].append(own)
            rooms |= 1 << left
    return bins, offsets, np.array(free, np.int64)


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """Lower bound on bins for ``counts[length]`` pieces, the best of two families of dual-feasible functions."""
    size = np.arange(len(counts))
    best = -(-int((counts * size).sum()) // capacity)
    # Threshold functions: over capacity - t counts as a full bin, under t as nothing.
    total, weight = np.cumsum(counts), np.cumsum(counts * size)
    t = np.arange(0, capacity // 2 + 1)
    large = total[-1] - total[capacity - t]
    middle = weight[capacity - t] - np.where(t > 0, weight[np.maximum(t - 1, 0)], 0)
    best = max(best, int((large - (-middle // capacity)).max()))
    # Rounding functions: a multiple of 1 / (k + 1) keeps its size, others round down to 1 / k.
    for k in range(1, 51):
        parts = (k + 1) * size
        exact = parts % capacity == 0
        value = np.where(exact, size * k, parts // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


_PLACED = "bin long, offset long, free long, bins long, bound long"


def _pack_group(capacity: int):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame["length"].to_numpy()
        bins, offsets, free = best_fit(lengths, capacity)
        bound = least_bins(np.bincount(lengths, minlength=capacity + 1), capacity)
        return frame.assign(bin=bins, offset=offsets, free=free[bins], bins=len(free), bound=bound)

    return pack


def _dealt(rows: DataFrame, groups: int, turn: int) -> DataFrame:
    """Rows dealt evenly, whatever repeats in them; the place of a row in its stored file sets equal rows apart."""
    return rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id(), F.lit(turn)), F.lit(groups)))


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length``) and ``sequence_id``, ``offset``: all in sequences of at most ``capacity``.

    Stored pieces are expected, as every round reads them again. Equal lengths and
    repeated rows are packed like any others; no pieces give no sequences.
    """
    own = pieces.columns
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    bound, total = least_bins(counts, capacity), 0
    pool, waiting, final = pieces, int(counts.sum()), []
    schema = T.StructType([*pieces.schema.fields, T.StructField("group", T.LongType()), *T.StructType.fromDDL(_PLACED)])
    earlier, earlier_bins = None, None
    for turn in itertools.count():
        groups = max(1, -(-waiting // GROUP))
        placed = K.settled(
            _dealt(pool, groups, turn).groupBy("group").applyInPandas(_pack_group(capacity), schema)
            .withColumn("sequence_id", F.lit(turn << 44) + F.col("group") * (1 << 18) + F.col("bin"))
        )
        by_group = placed.groupBy("group").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"))
        bins, gaps = by_group.agg(F.coalesce(F.sum("bins"), F.lit(0)), F.count_if(F.col("bins") > F.col("bound"))).first()
        if earlier_bins is not None and bins >= earlier_bins:
            final.append(earlier)
            break
        total += bins - (earlier_bins or 0)
        # Beyond the certificates of groups, rounding up in each may cost a bin: their open bins exchange too.
        if total <= bound or groups == 1:
            final.append(placed)
            break
        gap = (F.col("bins") > F.col("bound")) | F.lit(gaps == 0)
        opened = gap & (F.col("free") > 0)
        final.append(placed.where(~opened))
        pool = placed.where(opened)
        waiting, earlier_bins = pool.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        earlier, pool = pool, pool.select(*own)
        if not waiting:
            break
    out = final[0].select(*own, "sequence_id", "offset")
    for rows in final[1:]:
        out = out.unionAll(rows.select(*own, "sequence_id", "offset"))
    return out


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its sequence and the place in it."""
    return packed(K.settled(document_pieces(documents, tokenizer, capacity, end_id)), capacity)


cloudpickle.register_pickle_by_value(sys.modules[__name__])

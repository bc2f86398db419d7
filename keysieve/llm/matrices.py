"""Packed token-id matrices on disk, with segment bounds and position resets.

Overlong documents are split without loss; pieces are dealt into groups of bounded size
and packed best-fit decreasing. A segment tree over free capacities finds the tightest
sequence that a piece fits in. Each stored row is one row of the id matrix: padded ids,
the cumulative lengths of its segments, position ids that start anew with every
segment, and which piece of which document each segment is.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keysieve.llm import common as K
from keysieve.llm.packing import CAPACITY, END_ID, document_pieces

#: Text bytes whose pieces are packed together, about.
GROUP_BYTES = 16 << 20
PAD_ID = 0


class CapacityTree:
    """Segment tree over free capacities 0 to ``capacity``: finds the smallest that is enough."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._open = [0] * (2 * self._leaves)
        self._bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _count(self, free: int, by: int) -> None:
        node = free + self._leaves
        while node:
            self._open[node] += by
            node >>= 1

    def put(self, own: int, free: int) -> None:
        self._bins[free].append(own)
        self._count(free, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """A bin with the least free capacity of ``size`` or more, and that capacity; None if no bin has it."""
        node = size + self._leaves
        while not self._open[node]:
            # Up to the first subtree that lies to the right, unless the row of the tree ends here.
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self._leaves:
            node = 2 * node if self._open[2 * node] else 2 * node + 1
        free = node - self._leaves
        self._count(free, -1)
        return self._bins[free].pop(), free


def fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Pieces of every sequence, in order, best-fit decreasing."""
    tree, sequences = CapacityTree(capacity), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        got = tree.take(size)
        if got is None:
            got = len(sequences), capacity
            sequences.append([])
        sequences[got[0]].append(i)
        if got[1] > size:
            tree.put(got[0], got[1] - size)
    return sequences


def _id_type(tokenizer: str) -> str:
    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def write_matrices(
    documents: DataFrame, folder: str, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = PAD_ID
) -> None:
    """Store all ``documents`` (doc_id, text) as packed rows below ``folder``.

    A null text is empty and has the end id alone; repeated rows are packed each. Ids are
    little-endian unsigned integers of 16 bits if the vocabulary allows it, else 32;
    position ids likewise by capacity.
    """
    ids_as = _id_type(tokenizer)
    at_as = "<u2" if capacity <= 1 << 16 else "<u4"
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-size // GROUP_BYTES))
    pieces = document_pieces(documents, tokenizer, capacity, end_id, ids_as).select(
        "doc_id", "piece", "start", "length", "ids",
        F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)).alias("group"),
    )
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        lengths, ids = frame["length"].to_numpy(), frame["ids"].tolist()
        docs = [None if pd.isna(d) else d for d in frame["doc_id"]]
        numbers, starts = frame["piece"].to_numpy(), frame["start"].to_numpy()
        pad, base, rows = np.array([pad_id], ids_as).tobytes(), int(frame["group"].iloc[0]) << 32, []
        for k, own in enumerate(fit(lengths, capacity)):
            bounds = np.concatenate([[0], np.cumsum(lengths[own])])
            places = np.arange(bounds[-1]) - np.repeat(bounds[:-1], lengths[own])
            rest = capacity - int(bounds[-1])
            rows.append((
                base + k, b"".join(ids[i] for i in own) + pad * rest, np.append(places, np.zeros(rest)).astype(at_as).tobytes(),
                bounds.astype(np.int32), [docs[i] for i in own], numbers[own], starts[own],
            ))
        return pd.DataFrame(rows, columns=["sequence_id", "ids", "position_ids", "cu_seqlens", "doc_ids", "pieces", "starts"])

    packed = pieces.groupBy("group").applyInPandas(
        pack,
        f"sequence_id long, ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<{id_type}>, pieces array<int>, starts array<long>",
    )
    packed.write.option("compression", "zstd").parquet(folder)


def read_pieces(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """Every stored segment: its piece, place and the checksum of its ids as 32-bit integers; positions are verified."""
    rows = spark.read.parquet(folder)
    ids_as = _id_type(tokenizer)
    id_type = rows.schema["doc_ids"].dataType.elementType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for sequence, ids, places, bounds, docs, pieces, starts in frame.itertuples(index=False):
                ids = np.frombuffer(ids, ids_as).astype("<u4")
                places = np.frombuffer(places, "<u2" if len(places) == 2 * len(ids) else "<u4")
                for a, b, doc, piece, start in zip(bounds[:-1], bounds[1:], docs, pieces, starts):
                    if not np.array_equal(places[a:b], np.arange(b - a)):
                        raise ValueError(f"positions of sequence {sequence} don't restart at {a}")
                    out.append((None if doc is None else str(doc), piece, start, b - a, zlib.crc32(ids[a:b].tobytes()), sequence, a))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # Ids travel as text, so that a null among them turns no other into a float.
    sent = rows.select("sequence_id", "ids", "position_ids", "cu_seqlens", F.col("doc_ids").cast("array<string>"), "pieces", "starts")
    got = sent.mapInPandas(read, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return got.withColumn("doc_id", F.col("doc_id").cast(id_type))


cloudpickle.register_pickle_by_value(sys.modules[__name__])

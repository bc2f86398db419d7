"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints of at most three differing bits are linked. To find such pairs, one of
four 16-bit blocks is left out in turn. If the block left out holds one of the
differing bits, at most two differ in the other 48, and two balls of half that
radius meet: every fingerprint emits its 48 kept bits with each one of them flipped.
(If all differing bits lie in one block, the kept bits are equal without a flip.)
The variants are shuffled; fingerprints that collide on one are verified bit by bit
and linked to one member of their cluster, never pair by pair. Keys have 48 bits, so
chance collisions stay rare up to billions of fingerprints.

Equal fingerprints are one node, however many documents share them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.llm import common as K
from keysieve.llm.components import roots

WORDS = 3
RADIUS = 3
SEED = 42
BLOCK = 16
_LOW = (1 << BLOCK) - 1
#: Largest group compared by a table of its members' differences; larger ones walk neighbours.
SMALL = 64
_PIECE = 1 << 16


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; no words give zero."""
    words = text.lower().split()
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    start, span = end - size, min(WORDS, len(words))
    whole, one = b" ".join(words), xxhash.xxh64_intdigest
    first, last = start[: len(words) - span + 1].tolist(), (end[span - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(first), _PIECE):
        spans = zip(first[lo : lo + _PIECE], last[lo : lo + _PIECE])
        hashes = np.array([one(whole[a:b], SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    bits = np.packbits(2 * ones > len(first), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, print) of every row; the print is the 64-bit value as a signed long."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t) for t in K.encoded(batch)], np.uint64).view(np.int64))

    return K.in_batches(documents).select("doc_id", prints("text").alias("print"))


def variants(prints: DataFrame) -> DataFrame:
    """(key, print): every print under its kept bits of each block, plain and with one bit flipped.

    The low 16 bits of a key say which block was left out and whether a bit was flipped.
    """
    own = F.col("print")
    turned = [
        F.struct(
            F.lit(b).alias("block"),
            (own if b == 0 else F.shiftrightunsigned(own, BLOCK * b).bitwiseOR(F.shiftleft(own, 64 - BLOCK * b))).alias("bits"),
        )
        for b in range(64 // BLOCK)
    ]
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)).cast("long") for i in range(BLOCK, 64)))
    return (
        prints.select("print", F.explode(F.array(*turned)).alias("t"))
        .select("print", "t", F.explode(flips).alias("flip"))
        .select(
            F.col("t.bits").bitwiseAND(F.lit(_signed(~_LOW & (1 << 64) - 1)).cast("long")).bitwiseXOR(F.col("flip"))
            .bitwiseOR((F.col("t.block") * 2 + (F.col("flip") != 0).cast("int")).cast("long")).alias("key"),
            "print",
        )
    )


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cluster(key: int, prints: np.ndarray) -> np.ndarray:
    """For each member of a group, the index of a member that a chain of links leads to."""
    if len(prints) <= SMALL:
        near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= RADIUS
        name = np.arange(len(prints))
        while True:
            least = np.where(near, name[None, :], len(prints)).min(1)
            if (least == name).all():
                return name
            name = least
    # Members of one group agree in the kept bits but for the flipped ones, so the block
    # left out decides: equal or one bit apart after a flip, up to three apart without.
    tag = key & _LOW
    part = ((prints >> np.uint64(BLOCK * (tag >> 1))) & np.uint64(_LOW)).astype(np.int64)
    reach = range(1, 2 if tag & 1 else RADIUS + 1)
    masks = [sum(1 << i for i in bits) for n in reach for bits in combinations(range(BLOCK), n)]
    values, first, which = np.unique(part, return_index=True, return_inverse=True)
    name = np.full(1 << BLOCK, 1 << BLOCK)
    name[values] = values
    while True:
        least = name[values]
        for mask in masks:
            least = np.minimum(least, name[values ^ mask])
        least = name[least]
        if (least == name[values]).all():
            break
        name[values] = least
    at = np.zeros(1 << BLOCK, np.int64)
    at[values] = first
    return at[name[values]][which]


def _linked(key: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole groups of a sorted run of keys."""
    start = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    size = np.diff(start, append=len(key))
    two = start[size == 2]
    close = np.bitwise_count(prints[two] ^ prints[two + 1]) <= RADIUS
    a, b = [prints[two][close]], [prints[two + 1][close]]
    for lo, n in zip(start[size > 2], size[size > 2]):
        group = prints[lo : lo + n]
        to = _cluster(int(key[lo]), group)
        other = to != np.arange(n)
        a.append(group[other])
        b.append(group[to[other]])
    return np.concatenate(a), np.concatenate(b)


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of rows sorted by key; a group that a batch cuts is carried into the next.

    A group's size is bounded by its key: 49 kept parts times 65,536 block values.
    """
    key, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for frame in chain(frames, (None,)):
        if frame is not None:
            key = np.concatenate([key, frame["key"].to_numpy()])
            prints = np.concatenate([prints, frame["print"].to_numpy().view(np.uint64)])
        if not len(key):
            continue
        done = len(key) if frame is None else int(np.searchsorted(key, key[-1], "left"))
        if done:
            a, b = _linked(key[:done], prints[:done])
            key, prints = key[done:], prints[done:]
            if len(a):
                yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def links(prints: DataFrame) -> DataFrame:
    """(a, b) links that connect all prints within ``RADIUS`` bits, for distinct ``prints``."""
    keyed = variants(prints).repartition("key").sortWithinPartitions("key")
    return keyed.mapInPandas(_links, "a long, b long").distinct()


def components(documents: DataFrame) -> DataFrame:
    """(doc_id, print, component_id) for every row of ``documents``.

    ``component_id`` is the smallest id that links reach. Null and empty texts have
    the print zero; rows with a null id count towards no minimum.
    """
    prints = K.settled(fingerprints(documents))
    nodes = K.settled(prints.groupBy("print").agg(F.min("doc_id").alias("first")))
    up = roots(links(nodes.select("print")))
    joined = K.settled(
        nodes.join(up, nodes["print"] == up["node"], "left")
        .select("print", "first", F.coalesce("root", "print").alias("root"))
    )
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(joined.join(least, "root").select("print", "component_id"), "print")


def kept(documents: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id.

    Rows that repeat an id are copies of one document, of which one row stays. Rows
    with a null id are compared with nothing and all stay.
    """
    groups = K.settled(components(documents.where("doc_id IS NOT NULL")))
    odd_id = K.fresh("odd_id", documents)
    odd = K.settled(
        groups.groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("rows"), F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("first")
        ).where("first = 0 OR rows > 1")
    )
    ids = odd.select(F.col("doc_id").alias(odd_id))
    # Rows that can't be odd stay where they are; the others meet the odd ids, which decide.
    maybe = K.may_hold(odd)
    out = documents.where(~maybe).unionByName(
        documents.where(maybe).join(ids, F.col("doc_id") == F.col(odd_id), "left_anti")
    )
    again = odd.where("first = 1").select(F.col("doc_id").alias(odd_id))
    if not again.isEmpty():
        repeated = documents.where(maybe).join(again, F.col("doc_id") == F.col(odd_id), "left_semi")
        out = out.unionByName(repeated.dropDuplicates(["doc_id"]))
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])

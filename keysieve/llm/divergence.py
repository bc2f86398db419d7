"""How far the sources of a language differ in their words, from count-level bitmaps.

Tasks count the terms of their texts by group (language and source) in one pass over
bytes; Spark adds the counts up. Terms of at least ``MIN_DOCS`` documents of a language
are kept and numbered, frequent ones in narrow chunks (64 terms), the others in wide ones
(4,096). For each chunk, group and count the numbers of the terms with that count are
stored as a bitset of 64-bit words. The sum over all terms of a pair of groups then needs
no term: AND and popcount of two bitsets give the number of terms with those two counts,
and that number is multiplied by what one such term adds. Terms that a group lacks form
the level of count zero, the complement of all its other levels within the chunk.

A task holds one slice of a language (about 16,384 terms) and two blocks of about 64
sources, whatever the number of terms and sources. All arithmetic is in integers.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysieve.llm import common as K

MIN_DOCS = 3
TOP_TERMS = 200
#: Shares are whole numbers out of this many.
SCALE = 1_000_000_000
#: Terms below this total are rare: they have few levels and fill wide chunks.
RARE = 512
_WIDE, _NARROW, _SLICE = 12, 6, 14
_BLOCK_SOURCES = 64
_HELD_TERMS = 300_000
_PIECE_BYTES = 1 << 20
_STRIP = 1 << 21

# Terms are runs of ASCII letters, lower-cased, and non-ASCII characters.
_TERM_BYTES = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> Counter:
    """How often each term occurs in a text; a long text is split piece by piece."""
    found: Counter = Counter()
    start = 0
    while start < len(text):
        end = min(start + _PIECE_BYTES, len(text))
        # A piece ends where a term can't go on.
        while end < len(text) and _TERM_BYTES[text[end]] != 32:
            end += 1
        found.update(text[start:end].translate(_TERM_BYTES).split())
        start = end
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by group and term, of as many texts as a bounded table holds."""
    document = 1 << 44  # one number holds both: documents above, occurrences below
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    size = 0

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in held.items():
            words, numbers = list(own), list(own.values())
            for i in range(0, len(words), 50_000):
                part, values = words[i : i + 50_000], numbers[i : i + 50_000]
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(part), pa.string()), "source": pa.array([source] * len(part), pa.string()),
                    "term": pa.array(part, pa.binary()).cast(pa.string()),
                    "n": pa.array([v % document for v in values], pa.int64()), "docs": pa.array([v // document for v in values], pa.int64()),
                })

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            own = held.setdefault((lang, source), {})
            size -= len(own)
            for term, n in terms_of(text).items():
                own[term] = own.get(term, 0) + n + document
            size += len(own)
            if size > _HELD_TERMS:
                yield from given()
                held.clear()
                size = 0
    yield from given()


def _share(n: Column, total: Column, kept: Column) -> Column:
    """The share p of a term that occurs ``n`` times among ``total`` occurrences of ``kept`` terms, out of ``SCALE``."""
    above = (n + 1).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    # A language without kept terms has nothing to divide; its shares go into no sum.
    return 1 + F.call_function("div", above, F.greatest(total + kept, F.lit(1)).cast("decimal(20,0)")).cast("long")


def kept_terms(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Kept terms: (lang, term, total, chunk, bit, cells), cells being the (source, n) of each source that has it.

    Null text, lang and source are empty. Each row is a document, repeated ones too. The table is stored.
    """
    texts = documents.select(
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    counts = (
        texts.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    terms = (
        counts.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells"))
        .where(F.col("docs") >= min_docs).drop("docs")
    )
    # Numbers run in order of frequency within a task, so terms with like counts share chunks.
    level = F.length(F.bin("total"))
    placed = terms.withColumn("_level", level).sortWithinPartitions("lang", F.desc("_level")).withColumns({
        "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1), "_part": F.spark_partition_id().cast("long"),
    })
    rare = F.col("total") < RARE
    chunk = F.shiftleft("_part", 34) + F.when(rare, (1 << 33) + F.shiftright("_at", _WIDE)).otherwise(F.shiftright("_at", _NARROW))
    bit = F.when(rare, F.col("_at").bitwiseAND((1 << _WIDE) - 1)).otherwise(F.col("_at").bitwiseAND((1 << _NARROW) - 1))
    with K.small_batches(documents.sparkSession):
        return K.settled(placed.select("lang", "term", "total", chunk.alias("chunk"), bit.cast("int").alias("bit"), "cells"))


def count_bitmaps(terms: DataFrame) -> DataFrame:
    """(lang, chunk, source, n, word, mask): the terms of each group that occur n times, as words of a bitset. Stored."""
    cells = terms.select("lang", "chunk", "bit", F.explode("cells").alias("c"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63))
    return K.settled(
        cells.groupBy("lang", "chunk", F.col("c.source").alias("source"), F.col("c.n").alias("n"), F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(one).alias("mask"))
    )


def group_sizes(documents: DataFrame, terms: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Every (lang, source) that occurs, with the sums its shares are taken of and its block of sources. Stored."""
    every = documents.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    own = bitmaps.groupBy("lang", "source").agg(F.sum(F.col("n") * F.bit_count("mask")).alias("n_own"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("n_lang"))
    blocks = every.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / _BLOCK_SOURCES).cast("int").alias("blocks"))
    zero = F.lit(0).cast("long")
    return K.settled(
        every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").join(blocks, "lang").select(
            "lang", "source", "blocks", *(F.coalesce(c, zero).alias(c) for c in ("n_own", "kept", "n_lang")),
            F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"),
        )
    )


def _excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pair_sums(bits: np.ndarray, shares: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray, sums: np.ndarray) -> None:
    """Add to ``sums[g, h]`` what the terms of one chunk give, for owners g of the ``left`` levels and h of the ``right`` ones.

    ``bits`` has a bitset per level, ``shares`` and ``owner`` its share and group.
    """
    strip = max(1, _STRIP // max(1, len(right)))
    for at in range(0, len(left), strip):
        own = left[at : at + strip]
        cells = np.zeros((len(own), len(right)), np.int64)
        for w in range(bits.shape[1]):
            cells += np.bitwise_count(bits[own, w][:, None] & bits[right, w][None, :])
        i, j = np.nonzero(cells)
        a, b = own[i], right[j]
        np.add.at(sums, (owner[a], owner[b]), cells[i, j] * _excess(shares[a], shares[b]))


def _levels(rows: pd.DataFrame, number: dict[str, int], zero_share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitsets, shares and owners of one chunk, the zero level of every group included."""
    every = rows["source"].isna().to_numpy()
    words, masks = rows["word"].to_numpy(), rows["mask"].to_numpy().view(np.uint64)
    full = np.zeros(words.max() + 1, np.uint64)
    full[words[every]] = masks[every]
    own = rows[~every]
    owners = own["source"].map(number).to_numpy()
    level = own.groupby([owners, own["n"].to_numpy()], sort=False).ngroup().to_numpy()
    count = level.max() + 1 if len(own) else 0
    bits = np.zeros((count + len(number), len(full)), np.uint64)
    bits[level, words[~every]] = masks[~every]
    first = np.unique(level, return_index=True)[1]
    owner = np.concatenate([owners[first], np.arange(len(number))]).astype(np.int64)
    shares = np.concatenate([own["share"].to_numpy()[first], zero_share]).astype(np.int64)
    used = np.zeros((len(number), len(full)), np.uint64)
    np.bitwise_or.at(used, owner[:count], bits[:count])
    bits[count:] = full & ~used
    return bits, shares, owner


def _slice_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    lang, _, a, b = key
    known = rows["chunk"].to_numpy() < 0
    names = rows[known]
    number = {s: i for i, s in enumerate(names["source"])}
    in_block = names["block"].to_numpy()
    sums = np.zeros((len(number), len(number)), np.int64)
    for _, chunk in rows[~known].groupby("chunk", sort=False):
        bits, shares, owner = _levels(chunk, number, names["share"].to_numpy())
        left, right = (np.flatnonzero(in_block[owner] == side) for side in (a, b))
        pair_sums(bits, shares, owner, left, right, sums)
        if a != b:
            pair_sums(bits, shares, owner, right, left, sums)
    i, j = np.nonzero((in_block[:, None] == a) & (in_block[None, :] == b) | (in_block[:, None] == b) & (in_block[None, :] == a))
    i, j = i[i != j], j[i != j]
    source = names["source"].to_numpy()
    return pd.DataFrame({"lang": lang, "source": source[i], "item": source[j], "value": sums[i, j]})


def pair_divergence(groups: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each group and each other source of its language."""
    slices = F.shiftright("kept", _SLICE) + 1
    place = F.pmod(F.xxhash64("chunk"), slices).alias("slice")
    sides = [F.least("block", "_other").alias("a"), F.greatest("block", "_other").alias("b")]
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other")
    known = groups.select(
        "lang", "source", "block", "blocks", _share(F.lit(0).cast("long"), F.col("n_own"), F.col("kept")).alias("share"),
        F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"),
    ).select("*", others)
    names = known.select("lang", "slice", *sides, F.lit(-1).cast("long").alias("chunk"), "source", "block", "share",
                         F.lit(0).cast("long").alias("n"), F.lit(0).alias("word"), F.lit(0).cast("long").alias("mask"))
    levels = bitmaps.join(groups, ["lang", "source"]).select(
        "lang", place, "chunk", "source", "block", _share(F.col("n"), F.col("n_own"), F.col("kept")).alias("share"), "n", "word", "mask", others
    ).select("lang", "slice", *sides, "chunk", "source", "block", "share", "n", "word", "mask")
    langs = groups.select("lang", "blocks", "kept").distinct()
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.explode(F.flatten(F.transform(blocks, lambda a: F.transform(
        F.sequence(a, F.col("blocks") - 1), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    full = bitmaps.groupBy("lang", "chunk", "word").agg(F.bit_or("mask").alias("mask")).join(langs, "lang").select(
        "lang", place, "chunk", "word", "mask", pairs.alias("p")
    ).select("lang", "slice", "p.a", "p.b", "chunk", F.lit(None).cast("string").alias("source"), F.lit(0).alias("block"),
             F.lit(0).cast("long").alias("share"), F.lit(0).cast("long").alias("n"), "word", "mask")
    sums = names.unionByName(levels).unionByName(full).groupBy("lang", "slice", "a", "b").applyInPandas(
        _slice_sums, "lang string, source string, item string, value long"
    )
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_divergence(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each kept term that a group has with a larger share than its language."""
    cells = terms.select("lang", "term", "total", F.explode("cells").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    p, q = F.col("p"), F.col("q")
    return (
        cells.join(groups, ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("n_own"), F.col("kept")).alias("p"),
                _share(F.col("total"), F.col("n_lang"), F.col("kept")).alias("q"))
        .where(p > q).select("lang", "source", "item", F.call_function("div", (p - q) * (p - q), q).alias("value"))
    )


def divergence(documents: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for all other sources, ``term`` rows to rank ``top_terms``.

    ``documents`` has text, lang and source; nulls are read as empty, further columns
    are ignored. A group without any term is a group all the same, a language without
    kept terms has pairs of value 0. No documents give no rows. Equal values rank by
    item in the order of UTF-8 bytes.
    """
    terms = kept_terms(documents, min_docs)
    bitmaps = count_bitmaps(terms)
    groups = group_sizes(documents, terms, bitmaps)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_divergence(groups, bitmaps).withColumn("rank", F.row_number().over(order))
    top = term_divergence(groups, terms).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*names).unionByName(top.withColumn("part", F.lit("term")).select(*names))


cloudpickle.register_pickle_by_value(sys.modules[__name__])

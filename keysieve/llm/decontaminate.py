"""Benchmark passages in training text, found through an FM-index per shard.

A task gathers the words of its texts into shards of bounded size. Words that no test
phrase holds become one gap symbol, so the alphabet is the benchmark's. Each shard gets
an FM-index; all phrases are searched backward through its wavelet matrix at once,
their places come from sampled suffix positions, and overlapping finds merge into
spans. A text longer than a shard goes in pieces that overlap by a phrase.

The benchmark goes to the executors in parts of a bounded size (``PART_CHARS``). One
part is searched where the texts are read. A larger benchmark takes a pass over the texts
for each part, and driver and tasks hold one part at a time; what a pass finds is stored by
the MD5 of the text, finds of all passes merge by it, and only texts that have some meet them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.llm import common as K
from keysieve.llm.fmindex import FMIndex

WINDOW = 10
PART_CHARS = 8 << 20
SHARD = 1 << 19

# Words are runs of digits, letters a-z and non-ASCII characters, lower-cased A-Z.
_WORD_BYTES = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOUND = "n_words int, starts array<int>, ends array<int>, items array<string>"
_END, _GAP = 0, 1


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Phrases:
    """Windows of a part of the benchmark as rows of word numbers, and the items of each."""

    def __init__(self, vocabulary: dict[bytes, int], patterns: np.ndarray, sizes: np.ndarray, items: list[list[str]]):
        self.vocabulary, self.patterns, self.sizes, self.items = vocabulary, patterns, sizes, items

    @classmethod
    def of(cls, rows: list[tuple[str | None, bytes]]) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        windows: dict[tuple, set[str]] = {}
        for item, text in rows:
            own = [vocabulary.setdefault(w, len(vocabulary) + 2) for w in words(text)]
            for i in range(max(1, len(own) - WINDOW + 1) if own else 0):
                found = windows.setdefault(tuple(own[i : i + WINDOW]), set())
                if item is not None:
                    found.add(item)
        patterns = np.zeros((len(windows), WINDOW), np.int32)
        sizes = np.zeros(len(windows), np.int64)
        for i, window in enumerate(windows):
            patterns[i, : len(window)], sizes[i] = window, len(window)
        return cls(vocabulary, patterns, sizes, [sorted(x) for x in windows.values()])

    def _in_shard(self, pieces: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, ...]:
        """Finds of one shard as (text, first word, past last word) and (text, window) arrays."""
        gap = np.array([_GAP], np.int32)
        symbols = np.concatenate([x for _, _, own in pieces for x in (own, gap)] + [np.array([_END], np.int32)])
        size = [len(own) + 1 for _, _, own in pieces]
        text = np.repeat([t for t, _, _ in pieces] + [-1], size + [1])
        start = np.cumsum([0] + size)
        place = np.arange(len(symbols)) - np.repeat(start, size + [1]) + np.repeat([w for _, w, _ in pieces] + [0], size + [1])
        stays = symbols != _GAP
        stays[1:] |= symbols[:-1] != _GAP
        symbols, text, place = symbols[stays], text[stays], place[stays]
        index = FMIndex(symbols)
        low, high = index.ranges(self.patterns, self.sizes)
        count = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(count)), count)
        slots = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        at = index.places(slots)
        return text[at], place[at], place[at] + self.sizes[which], which

    def search(self, texts: list[bytes]) -> list[dict]:
        """For each text its number of words, merged spans of found words, and items found."""
        counts = np.zeros(len(texts), np.int64)
        finds: list[tuple[np.ndarray, ...]] = []
        shard: list[tuple[int, int, np.ndarray]] = []
        filled = 0

        def close() -> None:
            nonlocal shard, filled
            if shard and len(self.sizes):
                finds.append(self._in_shard(shard))
            shard, filled = [], 0

        number = self.vocabulary.get
        for i, text in enumerate(texts):
            own = words(text)
            counts[i] = len(own)
            own = np.array([number(w, _GAP) for w in own], np.int32)
            for lo in range(0, len(own), SHARD):
                piece = own[lo : lo + SHARD + WINDOW - 1]
                if filled + len(piece) > SHARD:
                    close()
                shard.append((i, lo, piece))
                filled += len(piece)
        close()
        found = [{"n_words": int(n), "starts": [], "ends": [], "items": set()} for n in counts]
        if finds:
            text, start, end, which = (np.concatenate(x) for x in zip(*finds))
            order = np.lexsort((start, text))
            for t, s, e in zip(text[order].tolist(), start[order].tolist(), end[order].tolist()):
                own = found[t]
                if own["ends"] and s <= own["ends"][-1]:
                    own["ends"][-1] = max(own["ends"][-1], e)
                else:
                    own["starts"].append(s)
                    own["ends"].append(e)
            for t, w in set(zip(text.tolist(), which.tolist())):
                found[t]["items"].update(self.items[w])
        for own in found:
            own["items"] = sorted(own["items"])
        return found


def _parts(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """Benchmark rows (item, text, part) in parts of about ``PART_CHARS`` characters, and the number of parts."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text IS NOT NULL").distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // PART_CHARS) or 1
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    return (K.settled(rows) if n > 1 else rows), n


def _broadcast(parts: DataFrame, i: int) -> Broadcast:
    """Part ``i``; it alone comes to the driver."""
    p = Phrases.of([(r.item, K.encoded([r.text])[0]) for r in parts.where(F.col("part") == i).collect()])
    return parts.sparkSession.sparkContext.broadcast((p.vocabulary, p.patterns, p.sizes, p.items))


def _merged(found: list[dict]) -> dict:
    """One text's finds from all parts of the benchmark."""
    if len(found) == 1:
        return found[0]
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted((s, e) for f in found for s, e in zip(f["starts"], f["ends"])):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    items = sorted({i for f in found for i in f["items"]})
    return {"n_words": found[0]["n_words"], "starts": starts, "ends": ends, "items": items}


def _find(shared: Broadcast):
    """Column function: number of words, spans of found words (end excluded), sorted item ids of one part."""

    @F.pandas_udf(_FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        phrases = Phrases(*shared.value)
        for batch in batches:
            texts, out = K.encoded(batch), []
            for lo, hi in K.blocks(texts, 4 * K.BLOCK_BYTES):
                out += phrases.search(texts[lo:hi])
            yield pd.DataFrame(out, columns=["n_words", "starts", "ends", "items"])

    return find


_SPANS = "key string, starts array<int>, ends array<int>, items array<string>"


def _finds(texts: DataFrame, parts: DataFrame, n: int) -> DataFrame:
    """(key, finds) of every text (key, text) that holds a phrase: a pass for each part, then the merged finds."""
    passes = []
    for i in range(n):
        shared = _broadcast(parts, i)

        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            phrases = Phrases(*shared.value)
            for frame in frames:
                keys, own = frame["key"].to_numpy(), K.encoded(frame["text"])
                for lo, hi in K.blocks(own, 4 * K.BLOCK_BYTES):
                    rows = [(k, f["starts"], f["ends"], f["items"]) for k, f in zip(keys[lo:hi], phrases.search(own[lo:hi])) if f["starts"]]
                    yield pd.DataFrame(rows, columns=["key", "starts", "ends", "items"])

        found = texts.where("key IS NOT NULL").select("key", "text").mapInPandas(search, _SPANS)
        # Copies say the same.
        passes.append(K.settled(found.dropDuplicates(["key"])))
        shared.destroy()
    rows = passes[0]
    for more in passes[1:]:
        rows = rows.unionByName(more)

    @F.pandas_udf(_FOUND)
    def merged(starts: pd.Series, ends: pd.Series, items: pd.Series) -> pd.DataFrame:
        out = [
            _merged([{"n_words": 0, "starts": s, "ends": e, "items": i} for s, e, i in zip(*own)])
            for own in zip(starts, ends, items)
        ]
        return pd.DataFrame(out, columns=["n_words", "starts", "ends", "items"])

    found = rows.groupBy("key").agg(F.collect_list(F.struct("starts", "ends", "items")).alias("f"))
    return K.settled(found.select("key", merged("f.starts", "f.ends", "f.items").alias("finds")))


def _met(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``rows`` with what ``found`` has of their ``key``; rows that it can't have are not shuffled."""
    others = [F.lit(None).cast(t).alias(c) for c, t in found.dtypes if c != key]
    may = K.may_hold(found, key)
    return rows.where(may).join(found, key, "left").select(*rows.columns, *(c for c in found.columns if c != key)).unionByName(
        rows.where(~may).select("*", *others)
    )


def _with_finds(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, found): number of words, spans of found words (end excluded), sorted item ids.

    A null text has no words. An item with a null id is searched for but not named;
    one with a null or wordless text has no phrases.
    """
    parts, n = _parts(benchmark)
    if n == 1:
        return documents.select("doc_id", _find(_broadcast(parts, 0))("text").alias("found"))

    @F.pandas_udf("int")
    def word_count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words(t)) for t in K.encoded(texts)], dtype="int32")

    rows = documents.select("doc_id", "text", F.md5("text").alias("key"))
    met = _met(rows, _finds(rows, parts, n), "key")
    return met.select("doc_id", F.struct(
        word_count("text").alias("n_words"), *(F.coalesce(f"finds.{c}", F.array().cast(t)).alias(c) for c, t in (
            ("starts", "array<int>"), ("ends", "array<int>"), ("items", "array<string>"),
        ))
    ).alias("found"))


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``documents``: words, hit words, items found and their digest, spans."""
    rows = _with_finds(K.in_batches(documents), benchmark)
    hits = F.aggregate(
        F.arrays_zip("found.starts", "found.ends"), F.lit(0).cast("long"), lambda sum_, x: sum_ + (x["ends"] - x["starts"])
    )
    return rows.select(
        "doc_id", F.col("found.n_words").cast("long").alias("n_words"), hits.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("found.starts") > 0).alias("contaminated"),
        F.arrays_zip(F.col("found.starts").alias("first_word"), F.col("found.ends").alias("past_word")).alias("spans"),
    )


def cut(text: str, starts: list[int], ends: list[int]) -> str:
    """``text`` without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    edges = [0] + [x for s, e in zip(starts, ends) for x in (at[s][0], at[e - 1][1])] + [len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _clean(shared: Broadcast):
    """Column function: a text without its passages, searched and cut until one part finds nothing."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        phrases = Phrases(*shared.value)
        for batch in batches:
            texts, out = K.encoded(batch), list(batch)
            todo = list(range(len(texts)))
            while todo:
                again = []
                for lo, hi in K.blocks([texts[i] for i in todo], 4 * K.BLOCK_BYTES):
                    own = todo[lo:hi]
                    for i, f in zip(own, phrases.search([texts[i] for i in own])):
                        if f["starts"]:
                            out[i] = cut(out[i], f["starts"], f["ends"])
                            texts[i] = out[i].encode("utf-8")
                            again.append(i)
                todo = again
            yield pd.Series(out, dtype=object)

    return clean


def _all_clean(texts: DataFrame, parts: DataFrame, n: int) -> DataFrame:
    """(origin, clean) of every text (origin: its MD5) that holds a phrase: rounds of search and cut, all parts in each."""

    @F.pandas_udf("string")
    def without(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([cut(*row) for row in zip(texts, starts, ends)], dtype=object)

    now, rounds = texts, []
    while True:
        keyed = now.withColumn("key", F.md5("text"))
        found = _finds(keyed, parts, n)
        hit = keyed.where(K.may_hold(found, "key")).join(found, "key").dropDuplicates(["origin"])
        now = K.settled(hit.select("origin", without("text", "finds.starts", "finds.ends").alias("text")))
        rounds.append(now)
        if now.isEmpty():
            break
    # A text's last cut is the one that the next round did not touch.
    done = rounds[0].limit(0)
    for own, later in zip(rounds, rounds[1:]):
        done = done.unionByName(own.join(later.select("origin"), "origin", "left_anti"))
    return K.settled(done.withColumnRenamed("text", "clean"))


def cleaned(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All rows, with benchmark passages cut from ``text`` and ``n_chars`` set anew where that happened.

    What a cut brings together is searched again, until nothing is found.
    """
    parts, n = _parts(benchmark)
    new = K.fresh("clean", documents)
    K.in_batches(documents)
    if n == 1:
        rows = documents.withColumn(new, _clean(_broadcast(parts, 0))("text"))
    else:
        key = K.fresh("origin", documents)
        found = _all_clean(documents.where("text IS NOT NULL").select(F.md5("text").alias("origin"), "text"), parts, n)
        rows = _met(documents.withColumn(key, F.md5("text")), found.toDF(key, new), key).withColumn(new, F.coalesce(new, "text"))
    changed = ~F.col(new).eqNullSafe(F.col("text"))
    columns = [
        F.col(new).alias("text") if c == "text"
        else F.when(changed, F.length(new)).otherwise(F.col(c)).cast(documents.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(f"`{c}`")
        for c in documents.columns
    ]
    return rows.select(*columns)


cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Toxicity from class-conditional Kneser-Ney models of words.

One model stands for toxic text and one for ordinary text. Each discounts its own
counts of a word after another, backs off to its word counts, to its counts of word stems, and from there to continuation
counts (how many different words a word follows) that both classes share, so a rare
expression weighs about the same in both. A text is judged by the difference of
its length-normalised log-likelihoods, with and without the word before, and by its few
most telling words and word pairs; a logistic
curve, fitted on labelled rows that gave no counts, turns these into a score.

Counts come from every labelled row of the counting folds and are exact: words are told
apart by 64-bit hashes, stems by their bytes. The tables of all words, stems and pairs are
stored and grow with the corpus. The most frequent words and stems, a bounded number, go to
the tasks; texts meet the others by a join on the words that a map of bits does not rule out.

Pairs travel as sorted, packed blocks: those of two frequent words as differences of their
ranks, the others by hash. A block of texts asks each part of the table for the counts of its
different pairs and gets them back in the order it asked; the block itself, words as ranks,
lies in a table with buckets, so it is written once and never shuffled.
"""

from __future__ import annotations

import math
import pickle
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.llm import common as K

STEM_BYTES = 4
#: Words and stems, the most frequent, that go to the tasks at most; the others are joined.
TOP_ROWS = 1 << 19
#: Size of the map of all other words: it only spares texts the join, whatever it holds.
MAP_BITS = 26
#: Words of the texts that a task turns into one block.
BLOCK_WORDS = 1 << 19
#: Labelled words for each part of the table of pairs.
PART_WORDS = 1 << 20
#: Pairs after this many of the most frequent words are spread over all parts.
HEAVY = 1 << 10
#: Rows of rare words or stems that a task packs at a time.
FACT_ROWS = 1 << 18
PAIR, WORD, STEM = 0, 1, 2
TELLING = 4
#: Labels, in hash order of their ids, that the logistic curve is fitted on at most.
CURVE_ROWS = 50_000
#: Labels that go to the texts at most; more meet them by a shuffle.
SENT_LABELS = 1 << 20
FOLDS = 5

# Letters in lower case and all non-ASCII bytes make words.
_LETTERS = bytes(
    b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def fold(doc_id, folds: int = FOLDS):
    """CRC-32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds, F.lit(-1))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers, stems and text numbers of all words of a block, in order.

    A word's number is its 64-bit hash, its stem the first four bytes themselves.
    """
    buffer, at = K.joined(texts, _LETTERS)
    starts, ends = K.runs(buffer != 32)
    stem = np.zeros(len(starts), np.int64)
    for k in range(STEM_BYTES):
        stem = stem << 8 | np.where(starts + k < ends, buffer[np.minimum(starts + k, len(buffer) - 1)], 0)
    return K.SpanHashes(buffer).of(starts, ends), stem, np.searchsorted(at, starts, "right") - 1


def _prior(word: np.ndarray, text: np.ndarray, start) -> np.ndarray:
    """The word before each word; ``start`` at a text's start."""
    return np.where(np.diff(text, prepend=-1) == 0, np.roll(word, 1), start)


def _pair(prior: np.ndarray, word: np.ndarray) -> np.ndarray:
    return K.mixed(word ^ K.mixed(prior + np.uint64(1)))


def _parsed(frames: Iterator[pd.DataFrame], column: str) -> Iterator[tuple]:
    """(values of ``column``, word, stem, text number) of about ``BLOCK_WORDS`` words at a time."""
    held, texts_held, size = [], 0, 0
    for frame in frames:
        texts, values = K.encoded(frame["text"]), frame[column].to_numpy(np.int64)
        for lo, hi in K.blocks(texts):
            word, stem, text = _words(texts[lo:hi])
            held.append((values[lo:hi], word, stem, text + texts_held))
            texts_held, size = texts_held + hi - lo, size + hi - lo + len(word)
            if size >= BLOCK_WORDS:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, texts_held, size = [], 0, 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _tallied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each word stands and how often a word follows it, by class; word 0 is a text's start."""
    for toxic, word, stem, text in _parsed(frames, "toxic"):
        if not len(word):
            continue
        bad = toxic[text]
        which, own = pd.factorize(word)
        stems = np.zeros(len(own), np.int64)
        stems[which] = stem
        leads, opens = np.diff(text, append=-1) == 0, np.diff(text, prepend=-1) != 0
        c1, c = np.bincount(which, bad, len(own)), np.bincount(which, minlength=len(own))
        n1, n = np.bincount(which[leads], bad[leads], len(own)), np.bincount(which[leads], minlength=len(own))
        yield pd.DataFrame({
            "word": own.view(np.int64), "stem": stems, "c0": c - c1.astype(np.int64), "c1": c1.astype(np.int64),
            "n0": n - n1.astype(np.int64), "n1": n1.astype(np.int64),
        })
        begun, begun_bad = int(opens.sum()), int(bad[opens].sum())
        yield pd.DataFrame({
            "word": [0], "stem": pd.array([None], "Int64"), "c0": [0], "c1": [0], "n0": [begun - begun_bad], "n1": [begun_bad],
        })


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers, none negative, in few bytes: bytes of one weight together, compressed."""
    values = np.ascontiguousarray(values, np.min_scalar_type(int(values.max(initial=0))))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return bytes([values.itemsize]) + len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(load: bytes, kind=np.int64) -> np.ndarray:
    width, n = load[0], int.from_bytes(load[1:9], "little")
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(load[9:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(kind)


def _rising(values: np.ndarray) -> bytes:
    """``_packed`` for sorted numbers of 64 bits."""
    return _packed(np.diff(values, prepend=np.uint64(0)))


def _risen(load: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(load, np.uint64), dtype=np.uint64)


def _grouped(code: np.ndarray) -> list[bytes]:
    """Sorted pairs of ranks: first ranks as differences, how many pairs each has, and the second ranks as differences."""
    first, second = (code >> np.uint64(32)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.diff(first, prepend=-1) != 0
    at = np.flatnonzero(new)
    second[1:] -= np.where(new[1:], 0, second[:-1])
    return [_packed(np.diff(first[at], prepend=0)), _packed(np.diff(at, append=len(code))), _packed(second)]


def _ungrouped(load: list[bytes]) -> np.ndarray:
    first, n, second = map(_unpacked, load)
    run = np.cumsum(second)
    begin = np.cumsum(n) - n
    second = run - np.repeat(run[begin] - second[begin], n)
    return (np.repeat(np.cumsum(first), n) << 32 | second).astype(np.uint64)


def _sent(spark: SparkSession, value):
    """A compressed broadcast; its files lie on the disks of driver and executors until it is destroyed."""
    return spark.sparkContext.broadcast(pa.compress(raw := cloudpickle.dumps(value), "zstd", asbytes=True) + len(raw).to_bytes(8, "little"))


def _opener(shared) -> Callable:
    """Gives what ``_sent`` sent, opened once in a task."""
    held = []

    def value():
        if not held:
            load = shared.value
            held.append(pickle.loads(pa.decompress(load[:-8], int.from_bytes(load[-8:], "little"), "zstd", asbytes=True)))
        return held[0]

    return value


class Names:
    """Ranks of the most frequent words; the last rank is that of word 0, a text's start."""

    def __init__(self, number: np.ndarray, count: np.ndarray):
        self.__setstate__(np.append(number[np.lexsort((number, -count))], 0).astype(np.int64).view(np.uint64))

    def __getstate__(self):
        return self.word

    def __setstate__(self, word: np.ndarray) -> None:
        self.word, self.start = word, len(word) - 1
        self._order = np.argsort(word)
        self._sorted = word[self._order]

    def rank(self, word: np.ndarray) -> np.ndarray:
        """Ranks, -1 for other words."""
        at = np.minimum(np.searchsorted(self._sorted, word), len(self._sorted) - 1)
        return np.where(self._sorted[at] == word, self._order[at], -1)


class Pairs:
    """Different pairs of a block by part and number; ``which`` leads from each occurrence to its pair.

    Pairs stay with their first word; those after a frequent word are spread by the second.
    """

    def __init__(self, number: np.ndarray, prior: np.ndarray, word: np.ndarray, heavy: np.ndarray, parts: int):
        order = np.argsort(number)
        number = number[order]
        new = np.ones(len(number), bool)
        new[1:] = number[1:] != number[:-1]
        first = order[new]
        salt = np.where(heavy[first], (K.mixed(word[first]) >> np.uint64(58)) + np.uint64(1), np.uint64(0))
        part = (K.mixed(prior[first] + K.mixed(salt)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.uint32)
        by = np.argsort(part, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.which = np.empty(len(order), np.int64)
        self.which[order] = place[np.cumsum(new) - 1]
        self.first, self.number = first[by], number[new][by]
        self.edges = np.searchsorted(part[by], np.arange(parts + 1))


def _both_kinds(prior_rank: np.ndarray, prior: np.ndarray, rank: np.ndarray, word: np.ndarray, names: Names, parts: int) -> list:
    """(occurrences, their ``Pairs``) of pairs of two ranks, numbered by these, and of all others, numbered by hash."""
    heavy = (prior_rank == names.start) | ((prior_rank >= 0) & (prior_rank < HEAVY))
    named = (prior_rank >= 0) & (rank >= 0)
    out = []
    for at in (np.flatnonzero(named), np.flatnonzero(~named)):
        if out:
            number = _pair(prior[at], word[at])
        else:
            number = (prior_rank[at] << 32 | rank[at]).astype(np.uint64)
        out.append((at, Pairs(number, prior[at], word[at], heavy[at], parts)))
    return out


_TABLE = "part int, load array<binary>"
_TABLES = "part int, kind int, load array<binary>"


def _counted(shared, parts: int):
    """Counts of each word after each other word, by class: for each block and part one packed row."""

    opened = _opener(shared)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = opened()
        for toxic, word, _, text in _parsed(frames, "toxic"):
            which, own = pd.factorize(word)
            rank = names.rank(own)[which]
            prior = _prior(word, text, np.uint64(0))
            loads = []
            for at, pairs in _both_kinds(_prior(rank, text, names.start), prior, rank, word, names, parts):
                n = len(pairs.first)
                c1 = np.bincount(pairs.which, toxic[text[at]], n).astype(np.int64)
                c0 = np.bincount(pairs.which, minlength=n) - c1
                own = at[pairs.first]
                loads.append((pairs, c0, c1, prior[own], word[own]))
            rows = []
            for part in range(parts):
                (a, b), (c, d) = ((x[0].edges[part], x[0].edges[part + 1]) for x in loads)
                if a < b or c < d:
                    (pairs, c0, c1, _, _), (_, d0, d1, q, w) = loads
                    rows.append((part, _table_load(pairs.number[a:b], c0[a:b], c1[a:b], q[c:d], w[c:d], d0[c:d], d1[c:d])))
            yield pd.DataFrame(rows, columns=["part", "load"])

    return counted


def _table_load(code, c0, c1, prior, word, d0, d1) -> list[bytes]:
    order = np.argsort(prior)
    return [*_grouped(code), _packed(c0), _packed(c1), _rising(prior[order]), *(_packed(x[order]) for x in (word, d0, d1))]


def _table(load) -> tuple:
    """Codes, their counts; words of the other pairs, their counts."""
    return (
        _ungrouped(load[:3]), _unpacked(load[3]), _unpacked(load[4]), _risen(load[5]), _unpacked(load[6], np.uint64),
        _unpacked(load[7]), _unpacked(load[8]),
    )


def _summed(number: np.ndarray, *counts: np.ndarray) -> tuple:
    """Different numbers, sorted, the place of one of each, and their summed counts."""
    order = np.argsort(number)
    number = number[order]
    new = np.ones(len(number), bool)
    new[1:] = number[1:] != number[:-1]
    at = np.flatnonzero(new)
    return number[at], order[at], *(np.add.reduceat(c[order], at) if len(at) else c for c in counts)


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """One part of the table from the rows of all blocks."""
    code, c0, c1, prior, word, d0, d1 = (np.concatenate(x) for x in zip(*map(_table, rows["load"])))
    code, _, c0, c1 = _summed(code, c0, c1)
    _, at, d0, d1 = _summed(_pair(prior, word), d0, d1)
    return pd.DataFrame({"part": rows["part"][:1], "load": [_table_load(code, c0, c1, prior[at], word[at], d0, d1)]})


def _marginals(shared):
    """After how many words each word stands, and by class how many follow it."""

    opened = _opener(shared)

    def marginals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named = opened().word
        for frame in frames:
            for load in frame["load"]:
                code, c0, c1, prior, word, d0, d1 = _table(load)
                prior = np.concatenate([named[(code >> np.uint64(32)).astype(np.int64)], prior])
                word = np.concatenate([named[(code & np.uint64(0xFFFFFFFF)).astype(np.int64)], word])
                which, own = pd.factorize(np.concatenate([word, prior]))
                n, first = len(own), which[len(word):]
                yield pd.DataFrame({
                    "word": own.view(np.int64), "contexts": np.bincount(which[: len(word)], minlength=n),
                    **{f"k{c}": np.bincount(first[np.concatenate(x) > 0], minlength=n) for c, x in enumerate(((c0, d0), (c1, d1)))},
                })

    return marginals


def _rare_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many pairs stand once and twice, by class."""
    for frame in frames:
        for load in frame["load"]:
            _, c0, c1, _, _, d0, d1 = _table(load)
            own = {0: np.concatenate([c0, d0]), 1: np.concatenate([c1, d1])}
            yield pd.DataFrame({f"c{c}_{k}": [int((own[c] == k).sum())] for c in (0, 1) for k in (1, 2)})


_STORE = "block long, load array<binary>"


def _stored(shared):
    """Blocks of different texts. Ids of words: their rank; beyond the start's, the other words that may be in the table; then stems."""

    opened = _opener(shared)

    def stored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, bits, _, _ = opened()
        seen: set[int] = set()

        def unseen():
            for frame in frames:
                # Copies need to be looked up once.
                new = ~(frame["key"].duplicated() | frame["key"].isin(seen)).to_numpy()
                seen.update(frame["key"][new])
                yield frame[new]

        for keys, word, stem, text in _parsed(unseen(), "key"):
            which, own = pd.factorize(word)
            stems = np.zeros(len(own), np.int64)
            stems[which] = stem
            ids = names.rank(own)
            rare = np.flatnonzero((ids < 0) & _marked(bits, own))
            ids[rare] = names.start + 1 + np.arange(len(rare))
            left = np.flatnonzero(ids < 0)
            code, other = pd.factorize(stems[left])
            ids[left] = names.start + 1 + len(rare) + code
            load = [keys.view(np.uint64), np.bincount(text, minlength=len(keys)), ids[which], own[rare], stems[rare], other]
            yield pd.DataFrame({"block": [uuid.uuid4().int >> 65], "load": [[_packed(x) for x in load]]})

    return stored


class Dealt:
    """Numbers in order of their part, sorted in each."""

    def __init__(self, number: np.ndarray, parts: int):
        part = K.mixed(number) % np.uint64(parts)
        self.order = np.lexsort((number, part))
        self.number = number[self.order]
        self.edges = np.searchsorted(part[self.order], np.arange(parts + 1).astype(np.uint64))


class Block:
    """A stored block: texts by key, its words' ids, its pairs that may be in the table, and what else it needs from there."""

    def __init__(self, load, names: Names, roots: Top, parts: int):
        self.keys, self.size, self.ids, self.rare, stems, other = (
            _unpacked(x, kind) for x, kind in zip(load, (np.uint64, np.int64, np.int64, np.uint64, np.int64, np.int64))
        )
        self.text = np.repeat(np.arange(len(self.size)), self.size)
        may = names.start + 1 + len(self.rare)
        prior = _prior(self.ids, self.text, names.start)
        self.at = np.flatnonzero((self.ids < may) & (prior < may))
        word = np.concatenate([names.word, self.rare])
        self.prior, own = prior[self.at], self.ids[self.at]
        rank = lambda x: np.where(x <= names.start, x, -1)
        self.kinds = _both_kinds(rank(self.prior), word[self.prior], rank(own), word[own], names, parts)
        self.stems = np.concatenate([stems, other])
        self.root, self.root_gain = roots.find(self.stems)
        self.words = Dealt(self.rare, parts)
        self.far = np.unique(self.stems[~self.root])
        self.far_stems = Dealt(self.far.astype(np.uint64), parts)


def _asked(shared, parts: int):
    """What each block asks each part of the tables for."""
    opened = _opener(shared)

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, _, roots, _ = opened()
        for frame in frames:
            for block, load in zip(frame["block"], frame["load"]):
                own, rows = Block(load, names, roots, parts), []
                kinds = [*(x for _, x in own.kinds), own.words, own.far_stems]
                for part in range(parts):
                    code, *others = (x.number[x.edges[part] : x.edges[part + 1]] for x in kinds)
                    if len(code) or any(map(len, others)):
                        rows.append((part, block, [*_grouped(code), *map(_rising, others)]))
                yield pd.DataFrame(rows, columns=["part", "block", "load"])

    return asked


def _facts_by_part(kind: int, columns: tuple, parts: int):
    """Rows of words or stems, packed for each part."""

    def packed(rows: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(rows)
        own = Dealt(rows["number"].to_numpy(np.int64).view(np.uint64), parts)
        values, out = [rows[x].to_numpy(float)[own.order].view(np.uint64) for x in columns], []
        for part in range(parts):
            lo, hi = own.edges[part], own.edges[part + 1]
            if lo < hi:
                out.append((part, kind, [_rising(own.number[lo:hi]), *(_packed(x[lo:hi]) for x in values)]))
        return pd.DataFrame(out, columns=["part", "kind", "load"])

    def facts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size >= FACT_ROWS:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return facts


def _no_rows(*columns: str) -> pd.DataFrame:
    return pd.DataFrame({x: pd.Series([], dtype=object) for x in columns})


def _found(number: np.ndarray, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each number asked for is among the sorted ones, and the places of those that are."""
    at = np.searchsorted(number, ask)
    found = np.zeros(len(ask), bool)
    inside = at < len(number)
    found[inside] = number[at[inside]] == ask[inside]
    return found, at[found]


def _answered(asked: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    """What blocks ask one part for, in the order asked: counts of pairs (zero for those it lacks), and rare words and stems that it has."""
    if not len(asked) or not len(table):
        return _no_rows("block", "part", "load")
    loads = {k: [load for kind, load in zip(table["kind"], table["load"]) if kind == k] for k in (PAIR, WORD, STEM)}
    code, c0, c1, prior, word, d0, d1 = _table(loads[PAIR][0] if loads[PAIR] else _NO_PAIRS)
    pair = _pair(prior, word)
    order = np.argsort(pair)
    pairs = ((code, c0, c1), (pair[order], d0[order], d1[order]))
    facts = []
    for kind, width in ((WORD, len(_FACTS)), (STEM, 1)):
        none = np.zeros(0, np.uint64)
        number = np.concatenate([none, *(_risen(x[0]) for x in loads[kind])])
        order = np.argsort(number)
        facts.append((number[order], *(np.concatenate([none, *(_unpacked(x[1 + k], np.uint64) for x in loads[kind])])[order] for k in range(width))))
    out = []
    for load in asked["load"]:
        own = []
        for (number, *counts), ask in zip(pairs, (_ungrouped(load[:3]), _risen(load[3]))):
            found, at = _found(number, ask)
            for count in counts:
                told = np.zeros(len(ask), np.int64)
                told[found] = count[at]
                own.append(_packed(told))
        for (number, *values), ask in zip(facts, map(_risen, load[4:])):
            found, at = _found(number, ask)
            own += [_packed(found), *(_packed(x[at]) for x in values)]
        out.append(own)
    return pd.DataFrame({"block": asked["block"], "part": asked["part"], "load": out})


class Top:
    """The most frequent rows of one kind: gains by number."""

    def __init__(self, number: np.ndarray, gain: np.ndarray):
        order = np.argsort(number)
        self.number, self.gain = number[order], gain[order]

    def find(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each number is here, and its gain if so."""
        if not len(self.number):
            return np.zeros(len(number), bool), np.zeros(len(number))
        at = np.minimum(np.searchsorted(self.number, number), len(self.number) - 1)
        return self.number[at] == number, self.gain[at]


def _top_of(text: np.ndarray, gain: np.ndarray, texts: int) -> np.ndarray:
    """The ``TELLING`` largest gains of each text, whose words stand together; zero where there are fewer."""
    out, gain = np.zeros((texts, TELLING)), gain.copy()
    starts = np.flatnonzero(np.diff(text, prepend=-1))
    for k in range(TELLING if len(text) else 0):
        most = np.full(texts, -np.inf)
        most[text[starts]] = np.maximum.reduceat(gain, starts)
        out[:, k] = np.where(most > -np.inf, most, 0.0)
        at = np.flatnonzero((gain == most[text]) & (gain > -np.inf))
        gain[at[np.diff(text[at], prepend=-1) != 0]] = -np.inf
    return out


_FACTS = ("p0", "p1", "n0", "n1", "left0", "left1")
_NO_PAIRS = _table_load(*(np.zeros(0, x) for x in (np.uint64, int, int, np.uint64, np.uint64, int, int)))


def _signs(shared, parts: int, unseen: float, cut: list[float]):
    """Signs of the texts of one block from its own row and what the tables told."""
    opened = _opener(shared)

    def signs(stored: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(stored):
            return _no_rows("key", "signs")
        names, _, roots, known = opened()
        own = Block(stored["load"].iloc[0], names, roots, parts)
        n, rare = len(own.keys), len(own.rare)
        counts = [np.zeros((2, len(pairs.first))) for _, pairs in own.kinds]
        more, far = np.full((len(_FACTS), rare), np.nan), np.full(len(own.far), unseen)
        for part, load in zip(told["part"], told["load"]):
            for k, (_, pairs) in enumerate(own.kinds):
                counts[k][:, pairs.edges[part] : pairs.edges[part + 1]] = [_unpacked(x) for x in load[2 * k : 2 * k + 2]]
            for dealt, values, load in ((own.words, more, load[4 : 5 + len(_FACTS)]), (own.far_stems, far[None], load[5 + len(_FACTS) :])):
                places = dealt.order[dealt.edges[part] : dealt.edges[part + 1]][_unpacked(load[0], bool)]
                values[:, places] = [_unpacked(x, np.uint64).view(float) for x in load[1:]]
        facts = np.concatenate([known, more], axis=1)
        other = own.root_gain
        other[~own.root] = far[np.searchsorted(own.far, own.stems[~own.root])]
        p0, p1, _, _, left0, left1 = facts
        # A word that the table lacks has its stem's gain and no shift.
        gain = np.log(p1 / p0)
        lacks = np.flatnonzero(np.isnan(more[0]))
        gain[names.start + 1 + lacks] = other[lacks]
        gain = np.concatenate([gain, other[rare:]])
        shift = np.concatenate([np.nan_to_num(np.log(left1 / left0)), np.zeros(len(other) - rare)])
        word_gain = gain[own.ids]
        leads = np.diff(own.text, append=-1) == 0
        size = np.maximum(own.size, 1)
        after = np.bincount(own.text[leads], shift[own.ids[leads]], n) + shift[names.start] * (own.size > 0)

        pair_gain = np.full(len(own.text), -np.inf)
        for (at, pairs), count in zip(own.kinds, counts):
            first = at[pairs.first]
            here = count.sum(0) > 0
            q, w = own.prior[first][here], own.ids[own.at[first]][here]
            likely = [np.maximum(count[c, here] - cut[c], 0.0) / np.maximum(facts[2 + c, q], 1) + facts[4 + c, q] * facts[c, w] for c in (0, 1)]
            value, beyond = np.full(len(here), -np.inf), np.zeros(len(here))
            value[here] = np.log(likely[1] / likely[0])
            beyond[here] = value[here] - gain[w] - shift[q]
            pair_gain[own.at[at]] = value[pairs.which]
            after += np.bincount(own.text[own.at[at]], beyond[pairs.which], n)
        mean = np.bincount(own.text, word_gain, n) / size
        out = np.column_stack([mean, _top_of(own.text, word_gain, n), mean + after / size, _top_of(own.text, pair_gain, n)])
        return pd.DataFrame({"key": own.keys.view(np.int64), "signs": list(out)})

    return signs


class KneserNey:
    """Both class models: ``words`` and ``roots`` (stems) with what they add, ``pairs`` with the packed counts of each part.

    A gain is a word's toxic minus ordinary log-likelihood. A word that stands in no
    labelled text has the gain of its stem, a new stem has ``unseen``. A pair's gain is
    that of its second word after the first. After a word that it never followed, a word
    gains its own gain and the other's shift, what the discounts there leave; a pair's
    shift is what it gains beyond that.
    """

    def __init__(self, words: DataFrame, roots: DataFrame, pairs: DataFrame, names: Names, least: int, parts: int, totals: dict, paths: list):
        self.words, self.roots, self.pairs, self.names, self.parts, self.totals = words, roots, pairs, names, parts, totals
        self.unseen, self.paths = _unseen(totals), paths
        self.rare = words.where(F.col("count") < least)
        self.bits = _bits(self.rare)
        got = words.where(F.col("count") >= least).select("number", *_FACTS).toArrow()
        self.known = np.full((len(_FACTS), names.start + 1), np.nan)
        self.known[:, names.rank(got["number"].to_numpy().view(np.uint64))] = [got[x].to_numpy() for x in _FACTS]
        self.known[:, names.start] = totals["start"]
        self.least_root = _least(roots)
        top = roots.where(F.col("count") >= self.least_root).select("number", "gain").toArrow()
        self.top_roots = Top(top["number"].to_numpy(), top["gain"].to_numpy())

    def signs(self, documents: DataFrame) -> DataFrame:
        """(key, signs) of each different text: the length-normalised difference and its largest single ones, by words and by pairs.

        ``key`` is the 64-bit hash of a text.
        """
        spark, parts = documents.sparkSession, self.parts
        shared = _sent(spark, (self.names, self.bits, self.top_roots, self.known))
        blocks = documents.select(F.xxhash64("text").alias("key"), "text").mapInPandas(_stored(shared), _STORE)
        name, path, buckets = f"toxicity_{uuid.uuid4().hex}", K.shared_folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
        blocks.write.bucketBy(buckets, "block").option("path", path).option("compression", "uncompressed").format("parquet").saveAsTable(name)
        try:
            stored = spark.table(name)
            kind = lambda k: F.lit(k).alias("kind")
            far = self.roots.where(F.col("count") < self.least_root).select("number", "gain")
            tables = self.pairs.select("part", kind(PAIR), "load").unionByName(
                self.rare.select("number", *_FACTS).mapInPandas(_facts_by_part(WORD, _FACTS, parts), _TABLES)
            ).unionByName(far.mapInPandas(_facts_by_part(STEM, ("gain",), parts), _TABLES))
            told = stored.mapInPandas(_asked(shared, parts), "part int, block long, load array<binary>").groupBy("part").cogroup(
                tables.groupBy("part")
            ).applyInPandas(_answered, "block long, part int, load array<binary>")
            rows = stored.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(
                _signs(shared, parts, self.unseen, self.totals["pair_cut"]), "key long, signs array<double>"
            )
            return K.settled(rows.dropDuplicates(["key"]))
        finally:
            spark.sql(f"DROP TABLE {name}")
            K.forget(spark, path)
            shared.destroy()


def _marked(bits: np.ndarray, number: np.ndarray) -> np.ndarray:
    at = number.view(np.uint64) >> np.uint64(64 - MAP_BITS)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _bits(rows: DataFrame) -> np.ndarray:
    """A map of fixed size with the bit of every number set."""
    at = F.shiftrightunsigned("number", 64 - MAP_BITS)
    got = rows.groupBy(F.shiftright(at, 6).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))).alias("set")
    ).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    bits[got["at"].to_numpy()] = got["set"].to_numpy()
    return bits.view(np.uint64)


def _least(rows: DataFrame) -> int:
    """The least count of the most frequent rows, at most ``TOP_ROWS``; all rows with that count are among them."""
    found = rows.groupBy(F.floor(F.log2("count")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, room = 62, TOP_ROWS
    for power, n in sorted(found, reverse=True):
        room -= n
        if room < 0:
            break
        least = power
    return 1 << least


def _cut(ones: float, twos: float) -> float:
    """The absolute discount that the counts of counts suggest."""
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones else 0.5


def _backed(t: dict, c: int, stem_count, shared_stem):
    """Likelihood of a stem in class ``c``."""
    n = max(1.0, t[f"n{c}"])
    return F.greatest(stem_count - t[f"stem_cut{c}"], F.lit(0.0)) / n + t[f"stem_cut{c}"] * max(1.0, t[f"stem_kinds{c}"]) / n * shared_stem


def _left(t: dict, c: int) -> float:
    """What the discount of class ``c`` leaves for stems."""
    return t[f"cut{c}"] * max(1.0, t[f"kinds{c}"]) / max(1.0, t[f"n{c}"])


def _unseen(t: dict) -> float:
    """Gain of a word whose stem stands in no labelled text."""
    left = [_left(t, c) * t[f"stem_cut{c}"] * max(1.0, t[f"stem_kinds{c}"]) / max(1.0, t[f"n{c}"]) for c in (0, 1)]
    return math.log(left[1] / left[0])


def fit_models(labelled: DataFrame) -> KneserNey:
    """Both models from all rows of ``labelled`` (text, toxic 0/1)."""
    spark = labelled.sparkSession
    at = {x: K.shared_folder(spark) for x in ("counts", "facts", "stems", "pairs", "words", "roots")}
    labelled = labelled.select("text", F.col("toxic").cast("long").alias("toxic"))
    counts = K.settled(
        labelled.mapInPandas(_tallied, "word long, stem long, c0 long, c1 long, n0 long, n1 long").groupBy("word")
        .agg(F.max("stem").alias("stem"), *(F.sum(x).alias(x) for x in ("c0", "c1", "n0", "n1"))), at["counts"]
    )
    count = (F.col("c0") + F.col("c1")).alias("count")
    frequent = counts.where("c0 + c1 > 0").select("word", count)
    least = _least(frequent)
    got = frequent.where(F.col("count") >= least).toArrow()
    names = Names(got["word"].to_numpy(), got["count"].to_numpy())
    shared = _sent(spark, names)
    parts = 1 + (counts.agg(F.sum("c0") + F.sum("c1")).first()[0] or 0) // PART_WORDS
    after = K.settled(labelled.mapInPandas(_counted(shared, parts), _TABLE).groupBy("part").applyInPandas(_merged, _TABLE), at["pairs"])
    # A word's counts, and as a context the counts and kinds of what follows it; context 0 is a text's start.
    zero = F.lit(0).cast("long")
    sides = counts.select("*", *(zero.alias(x) for x in ("contexts", "k0", "k1"))).unionByName(
        after.mapInPandas(_marginals(shared), "word long, contexts long, k0 long, k1 long")
        .select("*", F.lit(None).cast("long").alias("stem"), *(zero.alias(x) for x in ("c0", "c1", "n0", "n1")))
    )
    facts = K.settled(sides.groupBy("word").agg(
        F.max("stem").alias("stem"), *(F.sum(x).alias(x) for x in ("c0", "c1", "contexts", "n0", "n1", "k0", "k1"))
    ), at["facts"])
    shared.destroy()
    K.forget(spark, at["counts"])
    words = facts.where("contexts > 0")
    stems = K.settled(
        words.groupBy("stem").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), F.sum("contexts").alias("contexts")), at["stems"]
    )

    def summed(rows: DataFrame) -> dict:
        parts = [F.count(F.lit(1)).alias("kinds"), F.sum("contexts").alias("contexts")]
        for c in ("c0", "c1"):
            parts += [F.sum(c).alias(c), *(F.count_if(test).alias(f"{c}_{name}") for name, test in (
                ("kinds", F.col(c) > 0), ("ones", F.col(c) == 1), ("twos", F.col(c) == 2),
            ))]
        return {k: v or 0 for k, v in rows.agg(*parts).first().asDict().items()}

    w, s = summed(words), summed(stems)
    t = {"contexts": w["contexts"], "words": w["kinds"], "stems": s["kinds"]}
    for c in (0, 1):
        t |= {
            f"n{c}": w[f"c{c}"], f"kinds{c}": w[f"c{c}_kinds"], f"stem_kinds{c}": s[f"c{c}_kinds"],
            f"cut{c}": _cut(w[f"c{c}_ones"], w[f"c{c}_twos"]), f"stem_cut{c}": _cut(s[f"c{c}_ones"], s[f"c{c}_twos"]),
        }
    names_of = [f"c{c}_{k}" for c in (0, 1) for k in (1, 2)]
    tally = after.mapInPandas(_rare_counts, ", ".join(f"{x} long" for x in names_of)).agg(*(F.sum(x).alias(x) for x in names_of)).first()
    cut = t["pair_cut"] = [_cut(tally[f"c{c}_1"] or 0, tally[f"c{c}_2"] or 0) for c in (0, 1)]
    left = [F.when(F.col(f"n{c}") > 0, cut[c] * F.col(f"k{c}") / F.col(f"n{c}")).otherwise(1.0).alias(f"left{c}") for c in (0, 1)]
    begin = facts.where("word = 0").select(F.lit(None).cast("double").alias("p0"), F.lit(None).cast("double").alias("p1"), "n0", "n1", *left).first()
    t["start"] = [math.nan, math.nan, *begin[2:]] if begin else [math.nan, math.nan, 0, 0, 1.0, 1.0]
    shared_stem = (F.col("contexts") + 0.5) / (t["contexts"] + 0.5 * t["stems"] + 1)
    roots = stems.select(
        "stem", (F.col("c0") + F.col("c1")).alias("count"), shared_stem.alias("shared_stem"),
        *(_backed(t, c, F.col(f"c{c}"), shared_stem).alias(f"backed{c}") for c in (0, 1)),
    )
    ending = F.least(F.lit(1.0), (F.col("contexts") + 0.5) / (t["contexts"] + 0.5 * t["words"] + 1) / F.col("shared_stem"))
    likely = [
        F.greatest(F.col(f"c{c}") - t[f"cut{c}"], F.lit(0.0)) / max(1.0, t[f"n{c}"]) + _left(t, c) * F.col(f"backed{c}") * ending for c in (0, 1)
    ]
    root_gain = F.log(_left(t, 1) * F.col("backed1") / (_left(t, 0) * F.col("backed0")))
    known = K.settled(words.join(roots.drop("count"), "stem").select(
        F.col("word").alias("number"), count, *(p.alias(f"p{c}") for c, p in enumerate(likely)), "n0", "n1", *left
    ), at["words"])
    stem_gains = K.settled(roots.select(F.col("stem").alias("number"), "count", root_gain.alias("gain")), at["roots"])
    K.forget(spark, at["facts"], at["stems"])
    return KneserNey(known, stem_gains, after, names, least, parts, t, [at[x] for x in ("pairs", "words", "roots")])


class Scorer:
    """The signs of all texts and the curve that turns them into scores."""

    def __init__(self, signs: DataFrame):
        self.signs = signs
        self.center, self.scale, self.weights = 0.0, 1.0, None
        self.flat = 0.0

    def fit_curve(self, labelled: DataFrame) -> None:
        """Fit on ``labelled`` (key, toxic), a bounded sample."""
        rows = labelled.join(self.signs, "key").select("signs", F.col("toxic").cast("double").alias("toxic")).collect()
        y = np.array([r.toxic for r in rows])
        self.flat = float(y.sum() / (len(y) + 1))
        if len(set(y)) == 2:
            x = np.array([r.signs for r in rows])
            self.center, self.scale = x.mean(0), x.std(0) + 1e-3
            self.weights = K.logistic_fit((x - self.center) / self.scale, y)

    def scores(self) -> DataFrame:
        """(key, score): probability of the label toxic by the hash of the text."""
        center, scale, weights = self.center, self.scale, self.weights

        @F.pandas_udf("double")
        def score(signs: pd.Series) -> pd.Series:
            z = (np.array(signs.tolist()).reshape(len(signs), len(center)) - center) / scale
            return pd.Series(K.sigmoid(weights[0] + z @ weights[1:]))

        return self.signs.select("key", score("signs").alias("score"))


def fit_scorer(documents: DataFrame, labels: DataFrame) -> Scorer:
    """Fit on labelled documents outside fold 0: fold 4 for the curve, the rest for the counts.

    The counts take every labelled row, the curve at most ``CURVE_ROWS`` labels. A label
    that is null, or whose id is null, teaches nothing; an id that stands more than once
    counts once for each of its rows. Without both labels in the last fold the score is
    the same number for every text, the share of toxic ones; without any label it is zero.
    """
    documents = K.in_batches(documents)
    with K.freed_shuffles(documents.sparkSession):
        marks = labels.select("doc_id", "toxic").where("toxic IN (0, 1)").dropDuplicates(["doc_id", "toxic"])
        marks = marks.withColumn("_fold", fold("doc_id"))
        counting = marks.where((F.col("_fold") > 0) & (F.col("_fold") < FOLDS - 1)).drop("_fold")
        texts = documents.select("doc_id", "text").where("doc_id IS NOT NULL")
        inside = texts.where((fold("doc_id") > 0) & (fold("doc_id") < FOLDS - 1))
        few = counting.limit(SENT_LABELS + 1).count() <= SENT_LABELS
        if few:
            # Sent labels pick the texts alone: a map of ids would only keep a second Python worker for each task.
            labelled = inside.join(F.broadcast(counting), "doc_id")
        else:
            # Texts without a label are not shuffled.
            labelled = inside.where(K.may_hold(counting)).join(counting, "doc_id")
        model = fit_models(labelled)
        scorer = Scorer(model.signs(documents))
        K.forget(documents.sparkSession, *model.paths)
        curve = (
            marks.where(F.col("_fold") == FOLDS - 1).drop("_fold").orderBy(F.xxhash64("doc_id"), "toxic").limit(CURVE_ROWS)
        )
        last = texts.where(fold("doc_id") == FOLDS - 1).select("doc_id", F.xxhash64("text").alias("key"))
        scorer.fit_curve(last.join(F.broadcast(curve), "doc_id"))
        return scorer


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``documents`` with ``held_out``, ``score`` and ``predicted``.

    Columns of these names in the input are replaced. Empty tables give an empty result.
    """
    scorer = fit_scorer(documents, labels)
    documents = documents.withColumn("held_out", fold("doc_id") == 0)
    if scorer.weights is None:
        rows = documents.withColumn("score", F.lit(scorer.flat))
    else:
        key, score = K.fresh("_key", documents), K.fresh("_score", documents)
        found = scorer.scores().toDF(key, score)
        rows = documents.withColumn(key, F.xxhash64("text")).join(found, key).withColumn("score", F.col(score)).drop(key, score)
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def kept(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are not predicted toxic, unchanged."""
    scorer = fit_scorer(documents, labels)
    if scorer.weights is None:
        return documents.where(F.lit(scorer.flat) < 0.5)
    key = K.fresh("_key", documents)
    bad = K.settled(scorer.scores().where("score >= 0.5").select(F.col("key").alias(key)))
    rows, may = documents.withColumn(key, F.xxhash64("text")), K.may_hold(bad, key)
    # Only texts that may be toxic are shuffled.
    return rows.where(~may).unionByName(rows.where(may).join(bad, key, "left_anti")).drop(key)


cloudpickle.register_pickle_by_value(sys.modules[__name__])

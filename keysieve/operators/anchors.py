"""Which of very many patterns each text holds, in one pass over the texts.

Four bytes of a pattern are its anchor. For each block of texts the anchor is the
pattern's rarest four bytes in that block, so common beginnings don't matter; places of
the block whose four bytes are some anchor are looked up in a flat table, and what is
left is compared with the whole pattern, all places at once. The work depends on the
texts' length and on how often rare stretches occur, not on the number of patterns.

Patterns are held as one buffer with offsets, so a part of them has a known size.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

ANCHOR = 4
#: Bytes of text that are searched at a time.
BLOCK_BYTES = 1 << 22
_BUCKETS = 1 << 20
_PAIRS = 1 << 20


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _grams(buffer: np.ndarray) -> np.ndarray:
    """The four bytes at each place as one number."""
    b = buffer.astype(np.uint32)
    return b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint32(0x9E3779B1)) >> np.uint32(12)


class Patterns:
    """Folded patterns as UTF-8; what is derived from them is built where it is first used."""

    def __init__(self, patterns: list[bytes]):
        self._buffer = b"".join(patterns)
        self._sizes = np.fromiter(map(len, patterns), np.int64, len(patterns))
        self._ready = None

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def _tables(self):
        if self._ready is None:
            buffer = np.frombuffer(self._buffer, np.uint8)
            ends = np.cumsum(self._sizes)
            starts = ends - self._sizes
            long = np.flatnonzero(self._sizes >= ANCHOR)
            windows = self._sizes[long] - ANCHOR + 1
            at = _places(starts[long], windows)
            grams = _grams(buffer)[at] if len(at) else np.zeros(0, np.uint32)
            # Short ones are looked for one by one; empty ones are never found.
            is_short = (self._sizes > 0) & (self._sizes < ANCHOR)
            short = [(int(i), self._buffer[starts[i] : ends[i]]) for i in np.flatnonzero(is_short)]
            self._ready = buffer, starts, long, windows, grams, np.cumsum(windows) - windows, short
        return self._ready

    def found(self, texts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, pattern) pairs, by text and pattern; ``offsets`` cut ``texts`` into texts."""
        buffer, starts, long, windows, grams, first, short = self._tables()
        begins, ends = offsets[:-1], offsets[1:]
        pairs = [np.zeros((0, 2), np.int64)]
        for i, pattern in short:
            held = [t for t in range(len(begins)) if pattern in texts[begins[t] : ends[t]].tobytes()]
            pairs.append(np.column_stack([held, np.full(len(held), i)]).astype(np.int64).reshape(-1, 2))
        if len(long) and len(texts) >= ANCHOR:
            here = _bucket(_grams(texts))
            often = np.bincount(here, minlength=_BUCKETS)
            counts = often[_bucket(grams)]
            rarest = np.minimum.reduceat(counts, first)
            # The first window of each pattern that is as rare as its rarest.
            is_rarest = np.flatnonzero(counts == np.repeat(rarest, windows))
            owner = np.repeat(np.arange(len(long)), windows)[is_rarest]
            anchor_owner, at = np.unique(owner, return_index=True)
            chosen = is_rarest[at]
            present = rarest[anchor_owner] > 0
            anchor_owner, chosen = anchor_owner[present], chosen[present]
            bucket = _bucket(grams[chosen])
            order = np.argsort(bucket, kind="stable")
            bucket, pattern, shift = bucket[order], long[anchor_owner[order]], (chosen - first[anchor_owner])[order]
            size = np.bincount(bucket, minlength=_BUCKETS)
            low = np.cumsum(size) - size
            places = np.flatnonzero(size[here])
            many = size[here[places]]
            # Bounded numbers of (place, pattern) pairs are compared at a time.
            cuts = np.searchsorted(np.cumsum(many), np.arange(_PAIRS, many.sum() + _PAIRS, _PAIRS)) if len(many) else []
            last = 0
            for cut in [*cuts, len(places)]:
                cut = min(max(cut, last + 1), len(places))
                if last >= len(places):
                    break
                own, n = places[last:cut], many[last:cut]
                which = _places(low[here[own]], n)
                pairs.append(self._equal(texts, begins, ends, np.repeat(own, n) - shift[which], pattern[which], buffer, starts))
                last = cut
        every = np.unique(np.concatenate(pairs), axis=0)
        return every[:, 0], every[:, 1]

    def _equal(self, texts, begins, ends, at, pattern, buffer, starts) -> np.ndarray:
        """Those of the places ``at`` where the whole pattern stands within one text, as distinct (text, pattern) pairs."""
        size = self._sizes[pattern]
        inside = (at >= 0) & (at + size <= len(texts))
        at, pattern, size = at[inside], pattern[inside], size[inside]
        text = np.searchsorted(begins, at, "right") - 1
        inside = at + size <= ends[text]
        at, pattern, size, text = at[inside], pattern[inside], size[inside], text[inside]
        step = 0
        while len(at):
            # Eight bytes at a time; most wrong places fail at once.
            upto = np.minimum(size - step, 8)
            same = np.ones(len(at), bool)
            for k in range(8):
                on = k < upto
                same[on] &= texts[at[on] + step + k] == buffer[starts[pattern[on]] + step + k]
            at, pattern, size, text = at[same], pattern[same], size[same], text[same]
            step += 8
            done = size <= step
            if done.all():
                break
        return np.unique(np.column_stack([text, pattern]), axis=0).astype(np.int64).reshape(-1, 2)


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts with about ``BLOCK_BYTES`` together; nulls are empty."""
    texts = texts.cast(pa.large_binary())
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    values = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        upto = int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1
        upto = min(max(upto, row + 1), len(texts))
        yield row, values[offsets[row] : offsets[upto]], offsets[row : upto + 1] - offsets[row]
        row = upto


def held_by(texts: pa.Array, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by row and the numbers of the patterns that each text holds, in ascending order."""
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, values, offsets in blocks(texts):
        row, pattern = patterns.found(values, offsets)
        rows.append(row + first)
        found.append(pattern)
    counts = np.bincount(np.concatenate(rows), minlength=len(texts))
    return np.concatenate([[0], np.cumsum(counts)]), np.concatenate(found)


# The functions travel to the executors whole, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Byte-level BPE token ids of many texts at once.

Texts are split into the pieces of the byte-level pattern (contractions; runs of
letters, of numbers or of other signs, each with the blank before it; white space) by
array steps over a whole block. Every distinct piece is merged once, by the tokenizer's
vocabulary, and the block's ids are gathered from those. A vocabulary whose ids don't
follow its merges is left to the tokenizer itself.
"""

from __future__ import annotations

import json
import os
import sys

import numpy as np
import regex
import tiktoken
from pyspark import cloudpickle
from tokenizers import Tokenizer

from keysieve.llm import common as K

_OTHER, _LETTER, _NUMBER, _SPACE, _BREAK = range(5)
_BREAK_CHAR = 0x110000
#: Distinct pieces remembered; beyond it the memory starts anew.
REMEMBERED = 1 << 20
_QUOTE = ord("'")
_ONE = np.array([ord(c) for c in "stmd"])
_TWO = [(ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l"))]


def _merger(path: str) -> tiktoken.Encoding | None:
    """The file's vocabulary as merge ranks, if each merge makes the next id."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if [model["vocab"].get(m) for m in made] != list(range(256, 256 + len(made))):
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(made)}
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def _kinds() -> np.ndarray:
    every = "".join(map(chr, range(0x110000)))
    kinds = np.zeros(_BREAK_CHAR + 1, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    kinds[_BREAK_CHAR] = _BREAK
    return kinds


def piece_starts(chars: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Starts of all pieces of a block of code points in which ``_BREAK_CHAR`` ends each text."""
    kind = kinds[chars]
    start = np.empty(len(kind), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    heads = np.flatnonzero(start)
    start |= kind == _BREAK
    ends = np.append(heads[1:], len(kind))
    # The last of several blanks before a piece goes with it if it is a space, else stands alone.
    blank = kind[heads] == _SPACE
    before = blank & (ends < len(kind)) & (kind[np.minimum(ends, len(kind) - 1)] != _BREAK)
    last = ends[before] - 1
    start[last] = True
    lent = last[chars[last] == 32]
    start[lent + 1] = False
    # A lone apostrophe that no space precedes takes a short ending from the letters after it.
    quote = heads[(chars[heads] == _QUOTE) & (ends - heads == 1) & start[heads]]
    quote = quote[quote + 1 < len(kind)]
    quote = quote[kind[quote + 1] == _LETTER]
    if len(quote):
        first, second = chars[quote + 1], chars[np.minimum(quote + 2, len(chars) - 1)]
        one = np.isin(first, _ONE)
        two = np.zeros(len(quote), bool)
        for a, b in _TWO:
            two |= (first == a) & (second == b)
        took = np.where(one, 1, np.where(two, 2, 0))
        quote, took = quote[took > 0], took[took > 0]
        start[quote + 1] = False
        rest = quote + 1 + took
        rest = rest[rest < len(kind)]
        start[rest] |= kind[rest] == _LETTER
    return np.flatnonzero(start)


class BatchEncoder:
    """Token ids without added special tokens, equal to the tokenizer's own."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._merger = _merger(path)
        self._kinds = _kinds()
        self._forget()

    def _forget(self) -> None:
        self._known, self._slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._start, self._size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._pool = np.zeros(0, np.int32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null is empty. A text that spells a special token goes whole."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if text and any(s in text for s in self._special):
                out[i] = np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
            elif text:
                plain.append(i)
        sizes = [len(texts[i]) for i in plain]
        lo = 0
        while lo < len(plain):
            hi, n = lo, 0
            while hi < len(plain) and (hi == lo or n + sizes[hi] < K.BLOCK_BYTES >> 1):
                n += sizes[hi]
                hi += 1
            for i, ids in zip(plain[lo:hi], self._block([texts[i] for i in plain[lo:hi]])):
                out[i] = ids
            lo = hi
        return out

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        sizes = np.array([len(t) for t in texts])
        stop = np.cumsum(sizes + 1)
        chars = np.empty(stop[-1], np.uint32)
        inside = np.ones(stop[-1], bool)
        inside[stop - 1] = False
        chars[inside] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        chars[~inside] = _BREAK_CHAR
        starts = piece_starts(chars, self._kinds)
        ends = np.append(starts[1:], len(chars))
        real = chars[starts] != _BREAK_CHAR
        starts, ends = starts[real], ends[real]
        text = np.searchsorted(stop, starts, "right")

        run = np.zeros(len(chars) + 1, np.uint64)
        up, down = K.POWERS.upto(len(chars) + 1)
        np.cumsum(K.mixed(chars.astype(np.uint64) + np.uint64(1)) * up[: len(chars)], out=run[1:])
        key = K.mixed((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        keys, first, which = np.unique(key, return_index=True, return_inverse=True)
        slot = self._slots(keys, chars, starts[first], ends[first])[which]

        size = self._size[slot]
        total = np.bincount(text, size, len(texts)).astype(np.int64)
        done = np.cumsum(size)
        ids = self._pool[np.arange(done[-1]) + np.repeat(self._start[slot] - (done - size), size)]
        return np.split(ids, np.cumsum(total)[:-1])

    def _slots(self, keys: np.ndarray, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where each distinct piece's ids are; new pieces are encoded first."""
        if len(self._known) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self._known, keys)
        new = np.ones(len(keys), bool)
        if len(self._known):
            new = self._known[np.minimum(at, len(self._known) - 1)] != keys
        if new.any():
            pieces = [chars[a:b].tobytes().decode("utf-32-le") for a, b in zip(starts[new], ends[new])]
            if self._merger:
                ids = [self._merger.encode_ordinary(p) for p in pieces]
            else:
                ids = [e.ids for e in self._tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            begin = len(self._pool) + np.cumsum(size) - size
            self._pool = np.concatenate([self._pool, np.fromiter((x for own in ids for x in own), np.int32, size.sum())])
            slots = len(self._size) + np.arange(len(ids))
            self._size, self._start = np.concatenate([self._size, size]), np.concatenate([self._start, begin])
            known = np.concatenate([self._known, keys[new]])
            order = np.argsort(known, kind="stable")
            self._known, self._slot = known[order], np.concatenate([self._slot, slots])[order]
            at = np.searchsorted(self._known, keys)
        return self._slot[at]


cloudpickle.register_pickle_by_value(sys.modules[__name__])

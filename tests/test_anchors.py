"""Many patterns at once against plain substring tests."""

import random
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keysieve.operators import anchors as A
from keysieve.operators import search as S


def plain(texts, patterns):
    return [[i for i, p in enumerate(patterns) if t is not None and p and p in t] for t in texts]


def got(texts, patterns):
    offsets, found = A.held_by(pa.array(texts, pa.string()), A.Patterns([p.encode() for p in patterns]))
    return [found[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


WORDS = st.text("ab_é日\n", max_size=24)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | WORDS, max_size=12), st.lists(st.text("ab_é日\n", min_size=1, max_size=20), max_size=30), st.sampled_from([5, 40, 1 << 22]), st.sampled_from([1, 7, 1 << 20]))
def test_found_equals_contains(texts, patterns, block, pairs):
    with mock.patch.multiple(A, BLOCK_BYTES=block, _PAIRS=pairs):
        assert got(texts, patterns) == plain(texts, patterns)


def test_patterns_never_reach_across_texts():
    assert got(["xxab", "cdyy", "abcd", None, ""], ["abcd", "xabc"]) == [[], [], [0], [], []]


def test_a_hundred_thousand_patterns(spark, files):
    rng = random.Random(3)
    names = [f"service_{i:06d}_{rng.randrange(16**8):08x}" for i in range(100_000)]
    texts = [" ".join(rng.choice("the quick service_ lazy fox and_so_on".split()) for _ in range(60)) for _ in range(300)]
    held = {i: sorted(rng.sample(range(100_000), 3)) for i in range(0, 300, 7)}
    landed = files(*[(f"f{i}.txt", t + "".join(f" {names[k].upper()}," for k in held.get(i, ()))) for i, t in enumerate(texts)])
    patterns = spark.createDataFrame(list(enumerate(names)), "pattern_ord int, pattern string")
    for part in (S.PART_CHARS, 1 << 20):
        with mock.patch.object(S, "PART_CHARS", part):
            found = S.pattern_hits(landed, patterns).collect()
        assert sorted((r.file_id - 1, r.pattern_ord) for r in found) == sorted((i, k) for i, ks in held.items() for k in ks)


@pytest.mark.parametrize("texts", [["a" * 1_000_000, "ab" * 400_000]])
def test_common_stretches_stay_linear(texts):
    assert got(texts, ["a" * 50, "b" + "a" * 60, "abab", "x"]) == [[0], [2]]


def test_nulls_empties_and_repeated_patterns(spark, files):
    landed = files(("a.txt", "Key_One"), ("b.txt", ""), ("c.txt", None))
    rows = [("key_one", 0), ("KEY_ONE", 1), ("key_one", 0), ("", 2), (None, 3), ("k", 4)]
    patterns = spark.createDataFrame(rows, "pattern string, pattern_ord int")
    found = sorted((r.path, r.pattern_ord) for r in S.pattern_hits(landed, patterns).collect())
    assert found == [("a.txt", 0), ("a.txt", 0), ("a.txt", 1), ("a.txt", 2), ("a.txt", 4), ("b.txt", 2)]
    assert S.pattern_hits(landed, patterns.limit(0)).count() == 0
    assert S.pattern_hits(landed.limit(0), patterns).count() == 0

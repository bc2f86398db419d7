"""Divergence of sources against a plain version over terms."""

import re
from collections import Counter
from unittest import mock

import numpy as np
import pytest

from keysieve.llm import divergence as D

DOCS = "doc_id long, text string, lang string, source string, n long, term string, chunk string"


def plain(rows, min_docs=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
            for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen, total, groups = Counter(), Counter(), {}
        for own, source, words in docs:
            if own == lang:
                seen.update(set(words))
                total.update(words)
                groups.setdefault(source, Counter()).update(words)
        kept = [t for t in seen if seen[t] >= min_docs]
        share = lambda count: {t: 1 + 10**9 * (count[t] + 1) // (sum(count[k] for k in kept) + len(kept)) for t in kept}
        q = share(total)
        ps = {s: share(c) for s, c in groups.items()}
        for s, p in ps.items():
            pairs = [(sum((p[t] - o[t]) ** 2 // o[t] for t in kept), i) for i, o in ps.items() if i != s]
            terms = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if groups[s][t] and p[t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def got(spark, rows, **more):
    table = spark.createDataFrame([(i, t, a, b, 1, "x", "y") for i, (t, a, b) in enumerate(rows)], DOCS).repartition(3)
    return sorted(map(tuple, D.divergence(table, **more).collect()))


def made(seed, sources, size):
    rng = np.random.default_rng(seed)
    words = [f"w{a}{b}" for a in "abcdefghijklmnopqrst" for b in "aäé日z"]
    words = [w.translate({ord("w"): None}) for w in words]
    rows = []
    for _ in range(size):
        picked = rng.zipf(1.4, rng.integers(0, 60)) % len(words)
        rows.append((" ".join(words[i].upper() if i % 7 == 0 else words[i] for i in picked), str(rng.choice(["en", "de"])), f"s{rng.integers(sources)}"))
    return rows


def test_many_sources_equal_the_plain_version(spark):
    rows = made(1, 7, 300)
    with mock.patch.object(D, "_HELD_TERMS", 50):
        assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("blocks, wide, narrow", [(2, 3, 2), (3, 12, 6)])
def test_blocks_chunks_and_slices_change_nothing(spark, blocks, wide, narrow):
    rows = made(2, 9, 200)
    with mock.patch.multiple(D, _BLOCK_SOURCES=blocks, _WIDE=wide, _NARROW=narrow, _SLICE=4, RARE=20, _STRIP=64):
        assert got(spark, rows, top_terms=5) == plain(rows, top=5)


def test_nulls_ties_repeats_long_and_empty_texts(spark):
    rows = [
        (None, None, None), ("", "en", "a"), ("Ab ab AB", "en", "a"), ("Ab ab AB", "en", "a"), ("ab cd", "en", "b"),
        ("cd cd ef", "en", None), ("ef cd", "en", "c"), ("ef", "en", "c"), ("123 !!", "xx", "p"), ("one", "xx", "q"),
        ("long " * 400_000, "en", "d"), ("é" * 3_000_000, "en", "d"),
    ]
    want = plain(rows)
    assert got(spark, rows) == want
    assert ("xx", "p", "pair", "q", 0, 1) in want


def test_no_documents_give_no_rows(spark):
    table = spark.createDataFrame([], DOCS)
    found = D.divergence(table)
    assert found.collect() == [] and found.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_a_long_text_is_cut_between_terms():
    with mock.patch.object(D, "_PIECE_BYTES", 3):
        assert D.terms_of("Abc déf, abc-x".encode()) == Counter({b"abc": 2, "déf".encode(): 1, b"x": 1})

"""FM-index and benchmark passages against brute force."""

import hashlib

import numpy as np
import pytest

from keysieve.llm import decontaminate as D
from keysieve.llm.fmindex import FMIndex, suffix_order

DOCS = "doc_id long, text string, lang string, n_chars int, clean string"


@pytest.mark.parametrize("n, symbols", [(1, 2), (7, 2), (300, 3), (2000, 60)])
def test_index_counts_and_finds(n, symbols):
    rng = np.random.default_rng(n)
    text = np.append(np.tile(rng.integers(1, symbols, -(-n // 2)), 2)[:n], 0).astype(np.int32)
    assert suffix_order(text).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
    index = FMIndex(text)
    for size in (1, 2, 5):
        patterns = np.zeros((30, 10), np.int32)
        patterns[:, :size] = rng.integers(1, symbols + 2, (30, size))
        for pattern, lo, hi in zip(patterns, *index.ranges(patterns, np.full(30, size))):
            want = [i for i in range(n + 1 - size) if (text[i : i + size] == pattern[:size]).all()]
            assert sorted(index.places(np.arange(lo, hi))) == want


def plain(text, items):
    words = D.words((text or "").encode())
    hit, found = set(), set()
    for item, passage in items:
        own = D.words((passage or "").encode())
        for k in range(max(1, len(own) - 9) if own else 0):
            window = own[k : k + 10]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found |= {item} - {None}
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


PASSAGE = "The quick, brown fox-jumps over 13 lazy dogs near the Älteste river bank today"
ITEMS = [(11, PASSAGE), (2, "tiny item"), (3, None), (4, "..."), (None, "nameless words here"), (2, "tiny item"), (11, "more of eleven a b c d e f g h")]
TEXTS = [
    (1, "before " + PASSAGE.upper().replace("Ä", "Ä") + " after"), (2, "a TINY   item, tiny\nitem tiny"), (3, None), (4, ""),
    (5, "fox jumps over 13 lazy dogs near the Älteste"), (6, "nameless words here"), (None, PASSAGE), (1, "clean text"),
    (7, " ".join(["tiny"] * 3000) + " item"), (8, "tiny brown fox jumps over 13 lazy dogs near the Älteste river item"),
]


@pytest.mark.parametrize("shard", [D.SHARD, 16])
def test_report_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(D, "SHARD", shard)
    docs = spark.createDataFrame([(i, t, "en", len(t or ""), "x") for i, t in TEXTS], DOCS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for chars in (D.PART_CHARS, 40):
        monkeypatch.setattr(D, "PART_CHARS", chars)
        rows = D.report(docs, items).collect()
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows), key=str)
        assert got == sorted(((i, *plain(t, ITEMS)) for i, t in TEXTS), key=str)
    assert D.report(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in D.report(docs, items.limit(0)).collect())


def test_a_large_benchmark_comes_in_parts_that_give_the_same(spark, monkeypatch):
    rows = [(i, t, "en", len(t or ""), "x") for i, t in TEXTS * 2]
    # A cut that brings two halves of a phrase together, of which one part knows only one phrase.
    rows.append((20, "nameless words " + PASSAGE + " here tiny nameless words here item", "en", 1, None))
    docs = spark.createDataFrame(rows, DOCS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = sorted(map(tuple, D.cleaned(docs, items).collect()), key=str)
    sizes, of = [], D.Phrases.of
    monkeypatch.setattr(D, "PART_CHARS", 40)
    monkeypatch.setattr(D.Phrases, "of", lambda part: sizes.append(sum(len(t) for _, t in part)) or of(part))
    assert sorted(map(tuple, D.cleaned(docs, items).collect()), key=str) == whole
    assert D._parts(items)[1] > 2 and max(sizes) < sum(len(t or "") for _, t in ITEMS)
    assert D.cleaned(docs.limit(0), items).count() == 0
    assert D.cleaned(docs, items).schema == docs.schema
    assert next(r[1] for r in whole if r[0] == 20).strip() == ""


def test_cleaned_texts_hold_no_passage_and_clean_ones_stay(spark):
    docs = spark.createDataFrame([(i, t, "en", len(t or ""), "x") for i, t in TEXTS], DOCS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = D.cleaned(docs, items)
    assert out.schema == docs.schema
    rows = out.collect()
    assert len(rows) == len(TEXTS)
    assert not any(plain(r.text, ITEMS)[4] for r in rows)
    for r in rows:
        assert r.n_chars == len(r.text or "")
    before = {(i, t) for i, t in TEXTS if not plain(t, ITEMS)[4]}
    assert before <= {(r.doc_id, r.text) for r in rows}
    assert ("before ", " after") == next((r.text[:7], r.text[-6:]) for r in rows if r.text and r.text.startswith("before"))

"""Tokens, packing and stored matrices: equal to the tokenizer, lossless, certified."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keysieve.llm import common, matrices, packing
from keysieve.llm.tokens import BatchEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, length long, bin string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers(tokenizer):
    random.seed(4)
    parts = [*"ab'stmdrevlLS  \n\t\r\x85é日1２½.,!?\x00\x1cÀÑ", "'s", "'re", "'ll", " '", "\n ", "  ", "<|endoftext|>", "̀", "\U0001f600", " "]
    texts = ["".join(random.choices(parts, k=random.randint(0, 25))) for _ in range(4000)] + [None, "", " ", "'", "'s", "''s", "x'llama", "\n's"]
    for text, ids in zip(texts, BatchEncoder(PATH).encode(texts)):
        assert ids.tolist() == plain_ids(tokenizer, text), repr(text)


def test_ids_survive_forgetting(tokenizer, monkeypatch):
    import keysieve.llm.tokens as tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    encoder, texts = BatchEncoder(PATH), [f"number {i} of words{i}" for i in range(300)]
    for lo in range(0, 300, 30):
        for text, ids in zip(texts[lo : lo + 30], encoder.encode(texts[lo : lo + 30])):
            assert ids.tolist() == plain_ids(tokenizer, text)


@pytest.mark.parametrize("capacity", [1, 7, 64, 1024])
def test_best_fit_both_ways_and_its_bound(capacity):
    rng = np.random.default_rng(capacity)
    for n in (0, 1, 40, 2000):
        lengths = rng.integers(1, capacity + 1, n)
        bins, offsets, free = packing.best_fit(lengths, capacity)
        for b in range(len(free)):
            own = np.flatnonzero(bins == b)
            order = own[np.argsort(offsets[own])]
            assert offsets[order].tolist() == (np.cumsum(lengths[order]) - lengths[order]).tolist()
            assert lengths[own].sum() + free[b] == capacity
        assert packing.least_bins(np.bincount(lengths, minlength=capacity + 1), capacity) <= len(free)
        rows = matrices.fit(lengths, capacity)
        assert len(rows) == len(free) and sorted(i for r in rows for i in r) == list(range(n))


def test_bound_sees_large_and_middling_pieces():
    counts = np.zeros(11, np.int64)
    counts[6], counts[4] = 5, 2
    assert packing.least_bins(counts, 10) == 5
    counts[:] = 0
    counts[4] = 6
    assert packing.least_bins(counts, 10) == 3
    counts[:] = 0
    counts[7], counts[4] = 4, 4
    assert packing.least_bins(counts, 10) >= 5


def check_placement(pieces, capacity):
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_groups_with_gaps_exchange(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 60)
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 40, 1500)
    rows = spark.createDataFrame([(i % 900, 0, 0, int(n), 5) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.packed(common.settled(rows), 64).collect()
    assert sorted(r.length for r in got) == sorted(lengths.tolist())
    used = check_placement(got, 64)
    bound = packing.least_bins(np.bincount(lengths, minlength=65), 64)
    assert bound <= used <= bound * 1.02 + 1
    assert packing.packed(common.settled(rows.limit(0)), 64).count() == 0


ROWS = [(1, "one two three " * 900), (2, None), (3, ""), (3, ""), (None, "no id <|endoftext|> here"), (4, "x"), (5, "y " * 1023), (6, "y " * 4000)]


def expected(tokenizer):
    out = []
    for doc, text in ROWS:
        ids = [*plain_ids(tokenizer, text), 2]
        sizes = packing.piece_lengths(len(ids), 1024)
        assert sum(sizes) == len(ids) and (len(ids) <= 1024) == (len(sizes) == 1) and all(s == 1024 for s in sizes[1:])
        start = 0
        for k, size in enumerate(sizes):
            out.append((doc, k, start, size, zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes())))
            start += size
    return sorted(out, key=str)


def test_documents_are_packed_whole(spark, tokenizer):
    docs = spark.createDataFrame([(d, t, 9, "x") for d, t in ROWS], DOCS)
    got = packing.pack_documents(docs, PATH).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == expected(tokenizer)
    check_placement(got, 1024)
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_matrices_read_back_whole(spark, tokenizer):
    docs = spark.createDataFrame([(d, t, 9, "x") for d, t in ROWS], DOCS)
    for rows, many in ((docs, len(ROWS)), (docs.limit(0), 0)):
        folder = common.shared_folder(spark)
        matrices.write_matrices(rows, folder, PATH)
        got = matrices.read_pieces(spark, folder, PATH).collect()
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == (expected(tokenizer) if many else [])
        check_placement(got, 1024)
        for r in spark.read.parquet(folder).collect():
            assert len(r.ids) == len(r.position_ids) == 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] <= 1024

"""Fingerprints and their components against plain versions."""

import numpy as np
import pytest
import xxhash

from keysieve.llm import simhash
from keysieve.llm.components import roots


def plain_print(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0d]+", text.lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(prints):
    prints = list(prints)
    name = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= 3 and name[i] != name[j]:
                old, new = max(name[i], name[j]), min(name[i], name[j])
                name = [new if n == old else n for n in name]
    return name


@pytest.mark.parametrize("text", ["", "  \t\n", "One", "one TWO", "a b c d a b c", "Ünï Cödé ÀB\x0bx", "x " * 70000, "a b c"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_print(text.encode())


def planted(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        base = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(2))
        out.append(base)
        for distance in (0, 1, 2, 3, 4):
            for bits in ([int(b) for b in rng.choice(64, distance, replace=False)], [int(b) for b in rng.choice(16, distance, replace=False)]):
                out.append(base ^ sum(1 << b for b in bits))
    return out + [0, 0, 1, (1 << 64) - 1, (1 << 64) - 2]


def test_links_connect_all_within_three_bits(spark):
    prints = sorted(set(planted(12, 1)))
    rows = spark.createDataFrame([(simhash._signed(p),) for p in prints], "print long")
    up = {r.node: r.root for r in roots(simhash.links(rows)).collect()}
    got = [up.get(simhash._signed(p), simhash._signed(p)) for p in prints]
    want = plain_components(prints)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


@pytest.mark.parametrize("tag, reach", [(0, 3), (1, 1)])
def test_large_groups_walk_neighbours_like_small_ones(monkeypatch, tag, reach):
    rng = np.random.default_rng(3)
    parts = np.unique(rng.integers(0, 1 << 16, 500)).astype(np.uint64)
    kept = np.uint64(0xABCDEF012345 << 16)
    prints = parts | kept
    if tag:
        prints = prints ^ (np.uint64(1) << rng.integers(16, 64, len(prints)).astype(np.uint64))
    key = simhash._signed(int(kept) | tag)
    walked = simhash._cluster(key, prints)
    monkeypatch.setattr(simhash, "SMALL", 10_000)
    compared = simhash._cluster(key, prints)
    pairs = set(zip(walked.tolist(), compared.tolist()))
    if not tag:
        assert len(pairs) == len(set(walked.tolist())) == len(set(compared.tolist()))
        return
    # After a flip a group answers for pairs that differ in two kept bits and at most one other;
    # those with equal kept bits meet again without a flip.
    assert len(pairs) == len(set(walked.tolist()))
    part, rest = prints & np.uint64(0xFFFF), prints >> np.uint64(16)
    near = (np.bitwise_count(part[:, None] ^ part) <= 1) & (np.bitwise_count(rest[:, None] ^ rest) == 2)
    assert near.any() and all(walked[i] == walked[j] for i, j in zip(*np.nonzero(near)))


def test_components_of_texts_ties_nulls_and_repeats(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(9, long), (4, long), (4, long), (7, long + " tail"), (5, None), (2, ""), (8, "alone here now"), (None, long), (None, "nobody")]
    docs = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, print string, odd_id int")
    got = simhash.components(docs).collect()
    assert len(got) == len(rows)
    prints = [plain_print((t or "").encode()) for _, t in rows]
    name = plain_components(prints)
    least = {n: min((d for (d, _), m in zip(rows, name) if m == n and d is not None), default=None) for n in name}
    want = sorted(((d, least[n]) for (d, _), n in zip(rows, name)), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == want
    kept = simhash.kept(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "4", "8", "None", "None"])
    assert simhash.components(docs.limit(0)).count() == 0 == simhash.kept(docs.limit(0)).count()


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path).collect()
    prints = [plain_print((d.text or "").encode()) for d in docs]
    name = plain_components(prints)
    least = {n: min(d.doc_id for d, m in zip(docs, name) if m == n) for n in name}
    got = {r.doc_id: (r.print, r.component_id) for r in simhash.components(spark.read.parquet(path)).collect()}
    assert got == {d.doc_id: (simhash._signed(p), least[n]) for d, p, n in zip(docs, prints, name)}

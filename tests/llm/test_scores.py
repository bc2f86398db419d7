"""Toxicity models and the quality field: edge rows, exact marginals, held-out accuracy."""

import itertools
import zlib

import numpy as np
import pytest

from keysieve.llm import common, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars int, score double"
LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=400):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(n):
        toxic, poor = i % 5 == 0, i % 7 == 0
        lines = []
        for _ in range(3):
            own = rng.choice(words, 12).tolist()
            if toxic:
                own[rng.integers(12)] = rng.choice(["nastier", "nastyish", "vileness"])
            lines.append(" ".join(f"{w}###" for w in own) if poor else " ".join(own) + ".")
        docs.append((i, "\n".join(lines), "en", "s", 1, 0.0))
        if i % 3:
            labels.append((i, int(not poor), int(toxic)))
    docs += [(None, None, None, None, None, None), (n, None, None, None, None, None), (n + 1, "", "", "", 0, 0.0), (n + 1, "", "", "", 0, 0.0)]
    docs.append((n + 2, "word1 " * 300_000, "en", "s", 1, 0.0))
    labels += [(None, 1, 1), (3, None, None), (n, 1, 0), (n, 1, 0)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize("module, folds, held, truth, cut", [
    (toxicity, 5, 0, lambda i: i % 5 == 0, 0.5), (quality, 4, 2, lambda i: i % 7 != 0, 0.7),
])
def test_scores_hold_out_and_cover_every_row(spark, module, folds, held, truth, cut):
    docs, labels = corpus(spark)
    rows = module.scored(docs, labels).collect()
    assert len(rows) == 405
    own = [r for r in rows if r.doc_id is not None and r.doc_id < 400]
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == held)
    unseen = [r for r in own if r.held_out]
    assert np.mean([r.predicted == truth(r.doc_id) for r in unseen]) > 0.95
    again = {r.doc_id: r.score for r in module.scored(docs.repartition(7), labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in own)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_labels_missing_or_of_one_class_give_one_score(spark, module):
    docs, labels = corpus(spark, 40)
    for few in (labels.limit(0), labels.where("toxic = 0 AND quality = 1")):
        assert len({r.score for r in module.scored(docs, few).collect()}) == 1
    assert module.kept(docs, labels.limit(0)).count() == docs.count()
    assert module.scored(docs.limit(0), labels).count() == 0
    assert module.kept(docs.limit(0), labels).columns == docs.columns


def test_toxicity_counts_grow_with_every_labelled_row(spark):
    docs, labels = corpus(spark, 200)
    joined = docs.join(labels.where("toxic IS NOT NULL"), "doc_id").select("text", "toxic")
    model = toxicity.fit_models(joined)
    tokens = sum(len(r.text.translate(str.maketrans("#.", "  ", "0123456789")).split()) for r in joined.collect() if r.text)
    assert model.totals["n0"] + model.totals["n1"] == tokens


def marked_corpus(spark, mark, n=400):
    """Every fifth text is toxic; ``mark`` makes its words from a generator and the label."""
    rng = np.random.default_rng(11)
    docs = [(i, " ".join(mark(rng, i % 5 == 0)), "en", "s", 1, 0.0) for i in range(n)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(n)], LABELS)


def held_out_accuracy(docs, labels):
    rows = toxicity.scored(docs, labels).where("held_out").collect()
    return np.mean([r.predicted == (r.doc_id % 5 == 0) for r in rows])


def test_toxic_word_is_told_from_a_common_word_of_its_bucket(spark):
    names = ["".join(x) for x in itertools.product("bdfg", "aeiou", "klmn", "aeiou", "rst", "aeiou")]
    buffer, _ = common.joined([" ".join(names).encode()], bytes(range(256)))
    bucket = common.SpanHashes(buffer).of(*common.runs(buffer != 32)) >> np.uint64(18) & np.uint64((1 << 21) - 1)
    order = np.argsort(bucket, kind="stable")
    k = order[np.flatnonzero(bucket[order][1:] == bucket[order][:-1])[0] :][:1][0]
    bad, common_word = (names[i] for i in np.flatnonzero(bucket == bucket[k])[:2])

    def mark(rng, toxic):
        own = rng.choice([f"word{c}{d}" for c in "abcdefgh" for d in "pqrs"], 20).tolist() + [common_word] * rng.integers(1, 7)
        own.append(bad if toxic else common_word)
        return rng.permutation(own).tolist()

    assert held_out_accuracy(*marked_corpus(spark, mark)) > 0.97


def test_toxic_expression_of_ordinary_words_is_told_by_their_order(spark):
    def mark(rng, toxic):
        own = [f"{w}" for w in rng.choice([f"word{c}{d}" for c in "abcdefgh" for d in "pqrs"], 20)]
        own[4:6], own[10:12] = (["drop", "dead"], ["drop", "dead"]) if toxic else (["dead", "drop"], ["dead", "drop"])
        return own

    assert held_out_accuracy(*marked_corpus(spark, mark)) > 0.97


@pytest.mark.parametrize("rows, bits", [(0, 26), (8, 7)])
def test_joined_words_score_like_sent_ones(spark, monkeypatch, rows, bits):
    docs, labels = corpus(spark)
    whole = sorted((r.doc_id or -1, r.score) for r in toxicity.scored(docs, labels).collect())
    monkeypatch.setattr(toxicity, "TOP_ROWS", rows)
    monkeypatch.setattr(toxicity, "MAP_BITS", bits)
    split = sorted((r.doc_id or -1, r.score) for r in toxicity.scored(docs, labels).collect())
    np.testing.assert_allclose(split, whole, atol=1e-5)


def test_labels_without_documents_use_up_no_sample(spark, monkeypatch):
    docs, labels = corpus(spark)
    monkeypatch.setattr(quality, "TRAIN_ROWS", 100)
    absent = spark.range(1_000, 21_000).selectExpr("id AS doc_id", "CAST(0 AS int) AS quality", "CAST(0 AS int) AS toxic")
    rows = quality.scored(docs, labels.unionByName(absent)).where("held_out AND doc_id < 400").collect()
    assert np.mean([r.predicted == (r.doc_id % 7 != 0) for r in rows]) > 0.95


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    text = np.repeat([0, 1, 2], [1, 4, 6])
    score, link = rng.normal(size=(11, 2)), rng.normal(size=(2, 2))
    got, pairs, whole = quality.Chains(text, 3).marginals(score, link)
    log_z, expected = 0.0, np.zeros((2, 2))
    for t in range(3):
        rows = np.flatnonzero(text == t)
        weight = {}
        for labels in itertools.product((0, 1), repeat=len(rows)):
            weight[labels] = np.exp(sum(score[r, y] for r, y in zip(rows, labels)) + sum(link[a, b] for a, b in zip(labels, labels[1:])))
        z = sum(weight.values())
        log_z += np.log(z)
        for k, r in enumerate(rows):
            assert got[r, 1] == pytest.approx(sum(w for y, w in weight.items() if y[k]) / z)
        for y, w in weight.items():
            for a, b in zip(y, y[1:]):
                expected[a, b] += w / z
    assert whole == pytest.approx(log_z)
    np.testing.assert_allclose(pairs, expected)


def test_line_features_follow_lines():
    x, length, text = quality.line_features([b"One two.\n\nAA AA AA", b"", b"x"])
    assert text.tolist() == [0, 0, 0, 1, 2]
    assert length.tolist() == [8, 0, 8, 0, 1]
    assert x[2, 1] == 1 and x[2, 2] == pytest.approx(2 / 3) and x[1, 12] == 1


def test_span_hashes_tell_words_apart():
    buffer, at = common.joined([b"same same other", b"same"], bytes(range(256)))
    starts, ends = common.runs(buffer != 32)
    h = common.SpanHashes(buffer).of(starts, ends)
    assert at.tolist() == [1, 17] and h[0] == h[1] == h[3] != h[2]


def test_held_out_accuracy_on_driver_tables(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    for module, label, least in ((toxicity, "toxic", 0.95), (quality, "quality", 0.98)):
        held = module.scored(docs, labels).where("held_out").join(labels, "doc_id")
        right = held.where(f"predicted = {label}").count() / held.count()
        assert right > least

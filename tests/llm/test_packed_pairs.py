"""Packed pairs of words: what they hold, and how much the toxicity models leave on disk."""

import os
import uuid

import numpy as np
import pytest

from keysieve.llm import common
from keysieve.llm import toxicity as T


@pytest.mark.parametrize("n", [0, 1, 7, 5_000])
def test_packed_numbers_come_back(n):
    rng = np.random.default_rng(n)
    code = np.unique((rng.integers(0, 50, n) << 32 | rng.integers(0, 400, n)).astype(np.uint64))
    number = np.unique(rng.integers(0, 2**64 - 1, n, dtype=np.uint64))
    assert T._ungrouped(T._grouped(code)).tolist() == code.tolist()
    assert T._risen(T._rising(number)).tolist() == number.tolist()


@pytest.mark.parametrize("labels_sent", [0, 1 << 20])
def test_scoring_leaves_less_on_disk_than_the_texts(spark, tmp_path, monkeypatch, labels_sent):
    rng = np.random.default_rng(3)
    words = ["".join(x) for x in rng.choice(list("abcdefghijklmnop"), (20_000, 7))]
    docs = [(i, " ".join([*rng.choice(words, 300), *["vile"] * (i % 4 == 0)])) for i in range(600)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    monkeypatch.setattr(T, "SENT_LABELS", labels_sent, raising=False)
    monkeypatch.setattr(common, "shared_folder", lambda _: f"{tmp_path}/{uuid.uuid4().hex}")
    rows = T.scored(table, labels).collect()
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in rows]) > 0.97
    left = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(tmp_path) for f in files)
    assert left < sum(len(text) for _, text in docs) / 2


@pytest.mark.parametrize("labels_sent", [0, 1 << 20])
def test_counting_holds_one_python_worker_for_each_task(spark, monkeypatch, labels_sent):
    class Fitted(Exception):
        pass

    def fit_models(labelled):
        raise Fitted(labelled)

    rows = [(1, "a"), (1, "b"), (2, "c"), (5, "d"), (9, "e"), (None, "f"), (77, "g")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(1, 0), (1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    monkeypatch.setattr(T, "SENT_LABELS", labels_sent)
    monkeypatch.setattr(T, "fit_models", fit_models)
    with pytest.raises(Fitted) as stopped:
        T.fit_scorer(table, labels)
    labelled = stopped.value.args[0]
    folds = {r.doc_id: r.f for r in table.select("doc_id", T.fold("doc_id").alias("f")).collect()}
    marks = {(1, 0), (1, 1), (2, 0), (5, 1), (9, 1)}
    want = sorted((i, t, m) for i, t in rows for j, m in marks if i == j and 0 < folds[i] < T.FOLDS - 1)
    assert sorted((r.doc_id, r.text, r.toxic) for r in labelled.collect()) == want and want
    # A shuffle parts the map of ids from the counting; without one, both would hold a worker in the same task.
    steps = labelled._jdf.queryExecution().sparkPlan().toString()
    assert ("ArrowEvalPython" in steps) == (labels_sent == 0)

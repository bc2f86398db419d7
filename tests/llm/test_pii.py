"""Personal data: patterns against plain regular expressions, trees against what they must learn."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keysieve.llm import boosting
from keysieve.llm import pii as P

DOCS = "doc_id long, text string, lang string, spans string, features string, _spans string"


def plain(text):
    """The contract's patterns as they are written, run by Python's engine."""
    found = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        if 14 <= len(digits) <= 19 and sum(v // 10 + v % 10 for v in twice) % 10 == 0:
            found.append((2, *m.span()))
    found += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "Z", "@", "@", ".", "-", "+", "%", " ", "\n", "(", ")", "0", "00", "4", "255", "256", "é", "日",
                                 "x@y.z", "1.2.3.4", "4111 1111-1111 1111", "+1 (017) 555-7713"]), max_size=40).map("".join))
def test_patterns_equal_plain_regular_expressions(text):
    assert sorted(P.base_spans(text)) == sorted(plain(text))


def test_patterns_stay_linear_on_long_texts():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "@" * 200_000, "+1" + " " * 400_000, "a@" * 100_000, "1 " * 200_000):
        spans = P.base_spans(text)
        assert [s for s in P.candidates(text, spans) if s in spans] == sorted(spans, key=lambda s: (s[1], s[0], s[2]))


def documents():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(good):
        while True:
            digits = "4" + number(15)
            if P.luhn(digits) == good:
                return digits

    kinds = [
        lambda: f"{word()}.{number(2)}@mail{number(1)}.example.com", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        lambda: card(True), lambda: f"+1 ({number(3)}) 555-{number(4)}", lambda: card(False), lambda: number(8), lambda: f"{number(1)}.{number(1)}",
        lambda: f"300.{number(3)}.1.2", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
    ]
    return [(i, " ".join([*(word() for _ in range(12)), kinds[i % len(kinds)](), *(word() for _ in range(9))])) for i in range(1800)]


EXTRA = [
    (9001, "write to andré.müller.34@mail7.example.com today and so on"), (9002, None), (9003, ""), (9004, "nothing here at all"),
    (9005, "one 4111 1111 1111 1111 two 4111 1111 1111 1112 three"), (9005, "one 4111 1111 1111 1111 two 4111 1111 1111 1112 three"),
    (9006, "é日 " * 50_000 + "x.12@mail1.example.com"), (None, "ip 10.0.0.1 and 256.1.1.1"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "en", "s", "f", "_") for i, t in documents() + EXTRA]
    table = spark.createDataFrame(rows, DOCS).repartition(4)
    return table, P.detect(table).collect()


def test_all_pattern_spans_stay_and_clean_texts_stay_clean(found):
    texts = {i: t for i, t in documents() + EXTRA}
    assert len(found[1]) == len(documents() + EXTRA)
    for row in found[1]:
        text = texts[row.doc_id] or ""
        base = [(P.KINDS.index(s.kind), s.start, s.end) for s in row.spans if s.base]
        assert base == sorted(plain(text), key=lambda s: (s[1], s[0]))
        if row.doc_id is None or row.doc_id < 9000 or row.doc_id in (9004, 9005):
            assert [s for s in row.spans if not s.base] == []


def test_an_address_with_accents_is_added_whole(found):
    (row,) = (r for r in found[1] if r.doc_id == 9001)
    whole = "andré.müller.34@mail7.example.com"
    assert {(s.kind, s.base, EXTRA[0][1][s.start : s.end]) for s in row.spans} == {
        ("email", False, whole), ("email", True, "ller.34@mail7.example.com")}
    assert P.blanked(EXTRA[0][1], row.spans) == "write to [EMAIL] today and so on"


def test_digests_spell_spans(spark, found):
    table, rows = found
    spans = {r.doc_id: r for r in P.digests(P.detect(table.where("doc_id >= 9003 or doc_id < 900"))).collect()}
    assert spans[9005].n_card == 1 and spans[9005].n_email == 0 and spans[9005].spans == "card:4:23"
    assert spans[9005].base_sha256 == hashlib.sha256(b"card:4:23").hexdigest()
    assert spans[9003].spans == "" and spans[9003].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert spans[9006].spans == "email:150000:150022"


def test_redaction_keeps_all_else(spark):
    rows = [(i, t, "en", "s", "f", "_") for i, t in documents()[:400] + EXTRA if i is not None]
    table = spark.createDataFrame(rows, DOCS).dropDuplicates(["doc_id"])
    out = P.redacted(table)
    assert out.columns == table.columns and out.count() == table.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[9002] is None and texts[9004] == EXTRA[3][1] and texts[9005].startswith("one [CARD] two 4111")
    assert not any(plain(t) for t in texts.values() if t)


def test_no_documents_and_no_positives(spark):
    none = spark.createDataFrame([], DOCS)
    assert P.detect(none).collect() == []
    only = spark.createDataFrame([(1, "7086638319846192", "", "", "", "")] * 30, DOCS)
    assert {len(r.spans) for r in P.detect(only).collect()} == {0}


def test_trees_learn_what_no_single_split_can():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4_000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.2)).astype(float)
    trees = boosting.fit(x[:3_000], y[:3_000])
    assert ((trees.scores(x[3_000:]) > 0.5) == y[3_000:]).mean() > 0.97
    for ys in (np.ones(5), np.zeros(5)):
        scores = boosting.fit(np.zeros((5, 3)), ys).scores(np.zeros((2, 3)))
        assert (scores == scores[0]).all() and (scores[0] > 0.5) == bool(ys[0])
    assert 0 < boosting.fit(np.zeros((0, 3)), np.zeros(0)).scores(np.zeros((1, 3)))[0] < 1


def test_trees_learn_from_every_candidate(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, [3, 200, 90], (12_000, 3)).astype(np.float32)
    y = ((x[:, 1] > 120) ^ (x[:, 0] == 1)).astype(int)
    table = spark.createDataFrame([(r.tobytes(), int(v), 1) for r, v in zip(x, y)], "x binary, y int, n long").repartition(3)
    plain = boosting.fit(x.astype(float), y.astype(float), rounds=5)
    for most in (boosting.LOCAL_ROWS, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(boosting, "LOCAL_ROWS", most)
            trees = boosting.fit_table(table, 3, rounds=5)
        np.testing.assert_allclose(trees.scores(x.astype(float)), plain.scores(x.astype(float)), atol=1e-9)


def test_no_candidate_is_left_out(spark, monkeypatch):
    # More spans of a kind than any bound of the trees' sample had.
    taught = []
    fit = boosting.fit_table
    monkeypatch.setattr(boosting, "fit_table", lambda rows, *a, **k: taught.append(rows) or fit(rows, *a, rounds=2, **k))
    held = []
    at = P._thresholds
    monkeypatch.setattr(P, "_thresholds", lambda rows, trees: held.append(rows) or at(rows, trees))
    texts = spark.range(0, 9_000, numPartitions=4).selectExpr("id AS doc_id", "concat('to ann', id, '@mail.example.com now') AS text")
    model = P.train(P.looked_at(texts))
    counted = [rows.where("y = 1").agg(F.sum("n")).first()[0] for rows in (taught[0], held[0])]
    assert sum(counted) == 9_000 and 2_000 < counted[1] < 2_500
    assert model.thresholds[P.EMAIL] <= 1

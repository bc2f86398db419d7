"""Scores, thresholds and encodings against plain folds."""

import itertools
import random

import pytest

from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.operators.encode import encoded, numeric
from keysieve.operators.heuristic import baseline_scorer
from keysieve.operators.report import risk_level, risk_score
from keysieve.operators.supervised import approval_threshold, probability

FLAGS = [n for _, n, _ in (*C.BASELINE_ADDS, *C.BASELINE_SUBTRACTS) if n != "entropy"] + ["is_template_file", "is_hex"]


def random_rows(count, seed=1):
    rng = random.Random(seed)
    for i in range(count):
        row = {name: rng.random() < 0.4 for name in FLAGS}
        row.update(
            i=i, entropy=rng.choice([0.0, 3.9999, 4.0, 5.1]), signature_confidence=rng.choice(
                ["CRITICAL", "HIGH", "MEDIUM", "LOW", "other", "critical"]),
            provider=rng.choice([s.provider for s in C.SIGNATURES] + ["generic x", "Custom"]),
            has_database_asset=rng.random() < 0.3, context_window=rng.choice(["", "a JOB_ID b", "x.png", "y"]),
            file_path=rng.choice(["a.py", "x/ReconX/keys.md"]),
        )
        yield row


def fold(row):
    score = dict(C.TIER_BASE_SCORES).get(row["signature_confidence"].upper(), C.TIER_BASE_DEFAULT)
    reasons = []
    for weight, name, reason in C.BASELINE_ADDS:
        if row["entropy"] >= 4.0 if name == "entropy" else row[name]:
            score += weight
            reasons.append(reason)
    for weight, name, reason in C.BASELINE_SUBTRACTS:
        if row[name]:
            score -= weight
            reasons.append(reason)
    if row["provider"].startswith("Generic") and row["is_hex"]:
        score -= C.GENERIC_HEX_PENALTY[0]
        reasons.append(C.GENERIC_HEX_PENALTY[1])
    template = row["has_template_language"] or row["has_placeholder_signal"]
    placed = row["is_template_file"] or row["is_documentation_or_test_path"]
    if template and placed and not row["has_asset_reference"] and not row["has_downstream_usage"]:
        score -= C.DOC_TEMPLATE_PENALTY[0]
        reasons.append(C.DOC_TEMPLATE_PENALTY[1])
    return score, max(0.0, min(0.99, score)), reasons


def test_baseline_is_the_ordered_fold(spark):
    rows = list(random_rows(3000))
    got = baseline_scorer()(spark.createDataFrame(rows)).orderBy("i").collect()
    for row, out in zip(rows, got):
        raw, confidence, reasons = fold(row)
        assert (out["raw_score"], out["confidence"], out["reasons"]) == (raw, confidence, reasons)
        assert out["approved"] == (confidence >= 0.62)


def test_sum_order_decides_at_the_threshold(spark):
    row = dict.fromkeys(FLAGS, False) | dict(
        variable_is_sensitive=True, is_assignment_context=True, has_secret_term_nearby=True, entropy=3.0,
        signature_confidence="MEDIUM", provider="Generic 32-char Candidate",
    )
    out = baseline_scorer()(spark.createDataFrame([row])).first()
    assert out["confidence"] == 0.6199999999999999 and not out["approved"]


def test_missing_features_count_as_false(spark):
    out = baseline_scorer()(spark.createDataFrame([("x",)], "provider string")).first()
    assert out["confidence"] == 0.22 and out["reasons"] == []


def test_risk(spark):
    rows = list(random_rows(1000, 2))
    data = spark.createDataFrame(rows).withColumn("confidence", F.round(F.rand(3), 2))
    data = data.withColumn("risk", risk_score(F.col("provider"), F.col("confidence")))
    for out in data.withColumn("level", risk_level(F.col("risk"))).collect():
        score = out["confidence"]
        if out["provider"].startswith(C.RISK_PROVIDER_PREFIXES):
            score += 0.10
        for weight, name in C.RISK_ADDS:
            score += weight if out[name] else 0.0
        score = max(0.0, min(1.0, score - (0.10 if out["is_documentation_or_test_path"] else 0.0)))
        assert out["risk"] == score
        assert out["level"] == next((n for n, least in C.RISK_BANDS if score >= least), "LOW")


def test_thresholds(spark):
    def want(r):
        p = r["provider"]
        generic = p.startswith("Generic") or p == "UUID-like Secret"
        if not generic:
            return 0.62
        window = r["context_window"].lower()
        bound = r["variable_is_sensitive"] or r["has_secret_term_nearby"]
        if p == "UUID-like Secret" and any(t in window for t in C.OPERATIONAL_UUID_TERMS):
            return 0.995
        if r["has_placeholder_signal"] or r["has_template_language"] or r["has_hash_or_identifier_term"]:
            return 0.995
        if "reconx/keys.md" in r["file_path"].lower() or r["is_documentation_or_test_path"]:
            return 0.995
        if r["is_assignment_context"] and (bound or r["has_asset_reference"]):
            return 0.90
        return 0.94 if bound and r["has_asset_reference"] else 0.995

    rows = list(random_rows(2000, 5))
    data = spark.createDataFrame(rows)
    got = data.withColumn("t", approval_threshold(data)).orderBy("i").collect()
    assert [g["t"] for g in got] == [want(r) for r in rows]


def test_lenient_numbers(spark):
    cases = {None: 0.0, "": 0.0, " True ": 1.0, "yes": 1.0, "real_secret": 1.0, "no": 0.0, "false_positive": 0.0,
             " 2.5 ": 2.5, "abc": 0.0, "nan": 0.0, "1e3": 1000.0, "-4": -4.0}
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, v string")
    got = rows.select("i", numeric(F.col("v")).alias("n")).orderBy("i").collect()
    assert [g["n"] for g in got] == list(cases.values())
    assert spark.range(1).select(numeric(F.lit(True)).alias("n")).first()["n"] == 1.0


def test_derived_inputs(spark):
    rows = spark.createDataFrame(
        [("high", "GENERIC x", None, "Python", "", "7"), ("LOW", "My GitHub thing", "30", "config", "bad", "x"),
         ("", "z", "500", "documentation", None, None)],
        "signature_confidence string, provider string, nearest_secret_term_distance string, language string, "
        "parse_error string, extra string",
    )
    order = ("signature_confidence_score", "provider_is_generic", "provider_is_critical_type",
             "secret_term_proximity_score", "language_is_python", "language_is_config", "language_is_documentation",
             "parse_error_present", "extra", "absent")
    got = rows.select(*[c.alias(n) for n, c in encoded(rows, order).items()]).collect()
    assert [tuple(g) for g in got] == [
        (0.75, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 7.0, 0.0),
        (0.25, 0.0, 1.0, 0.75, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0),
        (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0),
    ]


def test_probability_sources(spark):
    from pyspark.ml.functions import array_to_vector

    vector = lambda *v: array_to_vector(F.array(*map(F.lit, v)))
    base = spark.range(1)
    both = base.select(vector(0.2, 0.8).alias("probability"), vector(-1.0, 1.0).alias("rawPrediction"))
    raw = base.select(vector(-1.0, 1.0).alias("rawPrediction"), F.lit(1.0).alias("prediction"))
    plain = spark.createDataFrame([(1.0,), (0.0,)], "prediction double")
    assert both.select(probability(both).alias("p")).first()["p"] == 0.8
    assert abs(raw.select(probability(raw).alias("p")).first()["p"] - 0.7310585786) < 1e-9
    assert [r["p"] for r in plain.select(probability(plain).alias("p")).collect()] == [0.99, 0.01]


def test_signature_order_is_total():
    assert len({s.provider for s in C.SIGNATURES}) == 17
    assert len(C.FEATURE_ORDER) == 34
    assert [len(v) for v in C.SEARCH_PATTERNS.values()] == [48, 18, 19]
    assert all(len(list(g)) == 1 for _, g in itertools.groupby(sorted(C.FEATURE_ORDER)))


def test_window_widths_are_arguments(files):
    from keysieve.operators.context import add_context
    from keysieve.operators.features import add_features
    from keysieve.operators.recover import recover_candidates

    key = "Lt3whkyVHH7iAtP28iNIq7hVNlK638vR"
    text = "https://far.acme.io " + "pad " * 30 + "left token " + key + " right " + "pad " * 20
    found = add_context(recover_candidates(files(("a.txt", text))))
    wide, narrow = add_features(found).first(), add_features(found, context_width=6, asset_width=20).first()
    assert narrow["context_window"] == f"token {key} right" and narrow["asset_reference_count"] == 0
    assert len(wide["context_window"]) > 200 and wide["asset_reference_count"] == 2
    with pytest.raises(ValueError):
        add_features(found, context_width=5000)

"""The fit against an independent solver, the split and the guards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keysieve.operators.evaluate import report_of
from keysieve.operators.labels import BOTH_FLAGS, labelled_rows, resolved_labels
from keysieve.operators.linear import LinearModel, fit_linear
from keysieve.operators.supervised import supervised_scorer
from keysieve.operators.training import stratified_split, train


def newton(x, y):
    """Minimise sum of weighted log losses plus half the squared norm."""
    mean, std = x.mean(0), x.std(0)
    z = np.where(std > 0, (x - mean) / np.where(std > 0, std, 1), 0.0)
    z = np.hstack([z, np.ones((len(z), 1))])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 0
    beta = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ beta))
        step = np.linalg.solve(
            (z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (p - y)) + ridge @ beta
        )
        beta -= step
        if abs(step).max() < 1e-13:
            break
    return 1 / (1 + np.exp(-z @ beta))


def test_fit_solves_the_usual_objective(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 4)) * [1, 10, 0.1, 1]
    x[:, 3] = 7.0
    y = (x[:, 0] + x[:, 1] / 10 + rng.normal(size=120) > 0.8).astype(int)
    rows = spark.createDataFrame([(i, int(t), *map(float, v)) for i, (v, t) in enumerate(zip(x, y))], "i int, y int, a double, b double, c double, d double")
    model = fit_linear(rows.repartition(5), ["a", "b", "c", "d"])
    assert model.scale[3] == 0 and model.coefficients[3] == 0
    again = LinearModel.from_json(model.to_json())
    assert again == model
    got = [r.p for r in rows.orderBy("i").select(again.probability({n: F.col(n) for n in "abcd"}).alias("p")).collect()]
    assert np.abs(np.array(got) - newton(x, y)).max() < 1e-9


def test_fit_holds_where_classes_part_cleanly(spark):
    rows = spark.createDataFrame([(int(i >= 50), float(i), float(i % 2)) for i in range(100)] , "y int, a double, b double")
    model = fit_linear(rows, ["a", "b"])
    x, y = np.array([(i, i % 2) for i in range(100)], float), np.arange(100) >= 50
    got = [r.p for r in rows.select(model.probability({n: F.col(n) for n in "ab"}).alias("p")).collect()]
    assert np.abs(np.array(got) - newton(x, y.astype(int))).max() < 1e-9
    with pytest.raises(ValueError, match="at least one positive"):
        fit_linear(rows.where("y = 0"), ["a", "b"])


def test_split_keeps_class_shares_and_ignores_partitions(spark):
    rows = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))

    def chosen(parts):
        split = stratified_split(rows.repartition(parts), ["row_id"])
        return {r["row_id"] for r in split.where("is_test").collect()}, split

    first, split = chosen(1)
    sizes = {r["y"]: r["n"] for r in split.where("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert abs(sizes[0] - 225) <= 2 and abs(sizes[1] - 25) <= 1
    assert first == chosen(7)[0]
    assert split.count() == 1000


def sample(spark, n):
    rows = [(i, 5.0 if i % 3 else 2.0, bool(i % 3), "real_secret" if i % 3 else "fp") for i in range(n)]
    return spark.createDataFrame(rows, "row_id int, entropy double, variable_is_sensitive boolean, label string")


def test_metrics_and_report(spark):
    rows = sample(spark, 60).unionByName(
        spark.createDataFrame([(100, 1.0, True, "review"), (101, 1.0, True, "")], sample(spark, 1).schema))
    model, metrics = train(rows, feature_order=["entropy", "variable_is_sensitive"])
    assert {k: metrics[k] for k in ("input_rows", "training_rows", "positive_rows", "negative_rows", "ignored_review_rows")} == {
        "input_rows": 62, "training_rows": 60, "positive_rows": 40, "negative_rows": 20, "ignored_review_rows": 2}
    assert metrics["classification_report"]["accuracy"] == 1.0
    scored = supervised_scorer(model, ["entropy", "variable_is_sensitive"])(rows.where("row_id < 60"))
    assert scored.where("(confidence > 0.5) != (label = 'real_secret' OR confidence > 0.5)").count() == 0


def test_small_sets_are_fitted_whole(spark):
    _, metrics = train(sample(spark, 4), feature_order=["entropy"])
    assert metrics["classification_report"].startswith("Not generated")


def test_guards(spark):
    with pytest.raises(ValueError, match="at least one positive"):
        train(sample(spark, 6).where("label = 'fp'"))
    with pytest.raises(ValueError, match="Available columns: x"):
        labelled_rows(spark.createDataFrame([(1,)], "x int"))
    with pytest.raises(Exception, match=BOTH_FLAGS[:20]):
        labelled_rows(spark.createDataFrame([(1, 1)], "real_secret int, false_positive int")).collect()
    only = labelled_rows(spark.createDataFrame([("1.0",), ("0",), ("",)], "real_secret string"))
    assert [r["y"] for r in only.collect()] == [1]
    for kind, values in (("string", ("1.5", "1", " Yes", "2")), ("double", (1.5, 1.0, float("nan"), 2.0))):
        rows = spark.createDataFrame([(v,) for v in values], f"label {kind}")
        want = [0, 1, 1, 0] if kind == "string" else [1, 1, 0, 0]
        assert [r.y for r in resolved_labels(rows).collect()] == want


def test_report_averages_and_zero_division(spark):
    rows = spark.createDataFrame([(1, 0), (1, 0), (0, 0), (0, 0), (0, 0)], "y int, predicted int")
    out = report_of(rows).first()
    report = out["classification_report"]
    assert out["accuracy"] == 0.6 and out["confusion_matrix"] == [[3, 0], [2, 0]]
    assert report["1"]["precision"] == 0.0 and report["1"]["support"] == 2
    assert report["0"]["f1_score"] == 0.7499999999999999
    assert round(report["macro avg"]["recall"], 10) == 0.5
    assert round(report["weighted avg"]["precision"], 10) == 0.36

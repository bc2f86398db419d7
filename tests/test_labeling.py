"""Quotas, ties, seeds and the queue."""

import random

import pytest
from pyspark.sql import functions as F

from keysieve.operators import topk
from keysieve.operators.labeling import bootstrap_labels, bootstrap_summary, labelled_table, review_queue

COLUMNS = "row_id int, File string, `Secret Type` string, `Classifier Confidence` double, context_window string, " \
          "language string, `Associated Variable` string, label string, real_secret string, false_positive string"


def table(spark, *rows):
    return spark.createDataFrame(rows, COLUMNS)


def strong(i, confidence, label="", real="", false=""):
    """A provider-specific key in code: suggested as real."""
    return (i, "src/a.py", "AWS Access Key", confidence, "AWS", "python", "x", label, real, false)


def near(i, confidence, label=""):
    """A generic key in code that falls just short."""
    return (i, "src/a.py", "Generic 32-char Candidate", confidence, "plain", "python", "api_key", label, "", "")


def noise(i, label="", real="", false=""):
    return (i, "a.txt", "Generic 32-char Candidate", 0.1, "plain", "plain_text", "", label, real, false)


def result(labelled):
    return {r["row_id"]: r for r in labelled.collect()}


def test_quota_takes_the_best_then_near_misses(spark):
    rows = table(spark, strong(0, 0.3), strong(1, 0.5), strong(2, 0.5), near(3, 0.4), near(4, 0.5), noise(5))
    by_id = result(bootstrap_labels(rows, target=2))
    assert [by_id[i]["label_source"] for i in range(6)] == [
        "", "bootstrap_positive", "bootstrap_positive", "needs_review", "needs_review", "bootstrap_negative"]
    assert (by_id[0]["label"], by_id[0]["real_secret"]) == ("", "")
    assert (by_id[3]["real_secret"], by_id[3]["label"]) == (None, "")
    by_id = result(bootstrap_labels(rows, target=4))
    assert by_id[4]["label_source"] == "bootstrap_near_miss_positive" and by_id[4]["real_secret"] == "1"
    assert by_id[3]["label_source"] == "needs_review"


def test_ties_go_by_row_order(spark):
    rows = table(spark, *[strong(i, 0.5) for i in range(6)]).repartition(5)
    by_id = result(bootstrap_labels(rows, target=3))
    assert [i for i in range(6) if by_id[i]["label_source"] == "bootstrap_positive"] == [0, 1, 2]


def test_existing_positives_use_up_the_quota(spark):
    rows = table(spark, noise(0, real="1", false="0"), noise(1, label=" Real_Secret "), strong(2, 0.6))
    labelled = bootstrap_labels(rows, target=2)
    by_id = result(labelled)
    assert [by_id[i]["label_source"] for i in range(3)] == ["manual_seed", "manual_seed", ""]
    assert by_id[1]["label"] == "real_secret"
    summary = bootstrap_summary(labelled).first()
    assert (summary["rows"], summary["existing_positive_rows"], summary["promoted_positive_rows"]) == (3, 2, 0)
    # As with the flags, a text label alone does not count as a final positive.
    assert summary["final_positive_rows"] == 1
    assert summary["review_buckets"] == {"code_config_real_key": 1, "low_priority_noise": 2}


def test_manual_negative_is_replaced_but_a_sourced_one_is_kept(spark):
    rows = table(spark, noise(0, real="0", false="1"), strong(1, 0.5, real="0", false="1")).withColumn(
        "label_source", F.lit(""))
    by_id = result(bootstrap_labels(rows, target=1))
    assert by_id[0]["label_source"] == "bootstrap_negative"
    assert (by_id[1]["label"], by_id[1]["real_secret"], by_id[1]["false_positive"]) == ("real_secret", "1", "0")
    kept = result(bootstrap_labels(rows.withColumn("label_source", F.lit("reviewer")), target=0))
    assert kept[0]["label_source"] == "reviewer" and kept[0]["label"] == "false_positive"


def test_label_columns_are_added(spark):
    rows = table(spark, noise(0)).drop("label", "real_secret", "false_positive")
    labelled = labelled_table(bootstrap_labels(rows))
    assert labelled.schema["real_secret"].dataType.simpleString() == "int"
    assert labelled.first()["false_positive"] == 1


def test_queue_order_and_limit(spark):
    rows = table(spark, near(0, 0.35), near(1, 0.45), near(2, 0.40), near(3, 0.45), noise(4))
    queue = review_queue(bootstrap_labels(rows, target=0), limit=3).collect()
    assert [r["row_id"] for r in queue] == [1, 3, 2]


def test_named_dump_list_is_configurable(spark):
    rows = table(spark, (0, "dumps/list.md", "Generic 32-char Candidate", 0.5, "password", "documentation", "", "", "", ""))
    default = bootstrap_labels(rows).first()["review_bucket"]
    named = bootstrap_labels(rows, named_dumps=("dumps/list.md",)).first()["review_bucket"]
    assert (default, named) == ("low_priority_noise", "near_miss_high_confidence")


def test_a_large_quota_is_cut_exactly(spark, monkeypatch):
    """Beyond a heap's rows the same rows are chosen, ties across tasks included."""
    rng = random.Random(2)
    rows = [(i, rng.choice([0.1, 0.25, 0.25, 0.4, 0.5, None, float("nan")]), f"x{i:05d}") for i in range(5_000)]
    table_ = spark.createDataFrame(rows, "row_id int, _score double, name string").repartition(7)
    key = lambda r: (r[1] is None or r[1] != r[1], -(r[1] if r[1] and r[1] == r[1] else 0), r[2])
    want = [r[0] for r in sorted(rows, key=key)]
    monkeypatch.setattr(topk, "HEAP_ROWS", 10)
    for limit in (11, 700, 2_900, 4_999, 5_000, 9_000):
        got = {r.row_id for r in topk.best(table_, limit, "_score", ["name"]).collect()}
        assert got == set(want[:limit])
    plan = topk.best(table_, 700, "_score", ["name"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan.replace("SinglePartition, ENSURE_REQUIREMENTS", "")
    empty = table_.limit(0)
    assert topk.best(empty, 100, "_score", ["name"]).count() == 0
    quota = table(spark, *[strong(i, 0.5) for i in range(60)]).repartition(5)
    by_id = result(bootstrap_labels(quota, target=30))
    assert [i for i in range(60) if by_id[i]["label_source"] == "bootstrap_positive"] == list(range(30))


def test_a_repeated_row_id_is_refused(spark):
    with pytest.raises(ValueError, match="row_id must be unique"):
        bootstrap_labels(table(spark, strong(1, 0.5), noise(1)))

"""The logistic-regression job: split, weigh, fit, report, save."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.functions.lineage import stored
from keysieve.operators.encode import encoded
from keysieve.operators.evaluate import report_of
from keysieve.operators.labels import with_label
from keysieve.operators.linear import LinearModel, fit_linear
from keysieve.operators.supervised import save_bundle

_BUCKETS = 10_000


def stratified_split(
    rows: DataFrame, key: Sequence[str], test_fraction: float = C.TEST_FRACTION, seed: int = C.SPLIT_SEED
) -> DataFrame:
    """Add ``is_test``: the same share of each class, fixed by a hash of ``key``.

    Rows fall into buckets by the MD5 of their key, which any engine can tell; per class the lowest buckets that make up the
    share are the test part. The bucket table has a known bound, so no class is
    ever sorted as a whole and the split does not depend on partitions.
    """
    digest = F.md5(F.concat_ws(":", *key, F.lit(seed)).cast("binary"))
    bucketed = rows.withColumn("_bucket", F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long") % _BUCKETS)
    whole = Window.partitionBy("y")
    upto = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    share = F.greatest(F.lit(1.0), F.round(F.sum("n").over(whole) * test_fraction))
    cut = (
        bucketed.groupBy("y", "_bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("y", "_bucket", (F.sum("n").over(upto) <= share).alias("is_test"))
    )
    return bucketed.join(F.broadcast(cut), ["y", "_bucket"]).drop("_bucket")


def class_weights(rows: DataFrame) -> DataFrame:
    """Add ``weight``: rows over twice the size of the row's class."""
    sizes = rows.groupBy("y").agg(F.count(F.lit(1)).alias("_n"))
    # Two rows, one per class.
    total = F.sum("_n").over(Window.partitionBy(F.lit(1)))
    weights = sizes.select("y", (total / (2 * F.col("_n"))).alias("weight"))
    return rows.join(F.broadcast(weights), "y")


def train(
    rows: DataFrame,
    label_column: str = "label",
    feature_order: Sequence[str] = C.FEATURE_ORDER,
    test_fraction: float = C.TEST_FRACTION,
    key: Sequence[str] = ("row_id",),
) -> tuple[LinearModel, dict]:
    """Fit on labelled rows; returns the model and its metrics."""
    # Rows without a usable label are kept until they are counted, so the input is read once.
    labelled = with_label(rows, label_column)
    names = [f"x{i}" for i in range(len(feature_order))]
    columns = [c.alias(n) for c, n in zip(encoded(labelled, feature_order).values(), names)]
    every = stored(labelled.select(F.concat_ws(":", *key).alias("key"), "y", *columns))
    totals = {r["y"]: r["count"] for r in every.groupBy("y").count().collect()}
    seen = sum(totals.values())
    n = seen - totals.pop(None, 0)
    if len(totals) < 2:
        raise ValueError("Training data must contain at least one positive and one negative example.")
    usable = every.where(F.col("y").isNotNull())
    metrics: dict = {
        "input_rows": seen,
        "training_rows": n,
        "positive_rows": totals[1],
        "negative_rows": totals[0],
        "ignored_review_rows": seen - n,
    }
    if n >= 6 and min(totals.values()) >= 2:
        split = stored(stratified_split(usable, ["key"], test_fraction))
        found = fit_linear(split.where("NOT is_test"), names)
        positive = (found.margin({n: F.col(n) for n in names}) > 0).cast("int")
        predicted = split.where("is_test").select("y", positive.alias("predicted"))
        metrics["classification_report"] = report_of(predicted).head().asDict(recursive=True)
    else:
        found = fit_linear(usable, names)
        metrics["classification_report"] = "Not generated: dataset too small for stratified split."
    model = replace(found, feature_order=tuple(feature_order))
    return model, metrics


def train_and_save(
    rows: DataFrame,
    path: str,
    label_column: str = "label",
    feature_order: Sequence[str] = C.FEATURE_ORDER,
    test_fraction: float = C.TEST_FRACTION,
    key: Sequence[str] = ("row_id",),
) -> dict:
    """Train and persist the bundle; returns the metrics."""
    model, metrics = train(rows, label_column, feature_order, test_fraction, key)
    save_bundle(model, path, feature_order, C.SUPERVISED_MODEL, metrics)
    return metrics


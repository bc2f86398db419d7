"""Metrics of a scorer on labelled feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.operators.heuristic import Scorer, baseline_scorer
from keysieve.operators.labels import with_label


def normal_rows(rows: DataFrame) -> DataFrame:
    """Feature rows under the names the scorers use, whatever names they came with."""
    have = rows.columns

    def text(*names: str, default: str = "") -> Column:
        found = [F.col(f"`{n}`").cast("string") for n in names if n in have]
        return F.coalesce(*found, F.lit(default))

    def number(name: str) -> Column:
        value = F.col(f"`{name}`").try_cast("double") if name in have else F.lit(0.0)
        return F.coalesce(value, F.lit(0.0))

    columns = {
        "repository": text("Repository"),
        "url": text("URL"),
        "raw_url": text("Raw URL"),
        "file_path": text("file_path", "File"),
        "provider": text("provider", "Secret Type"),
        "signature_confidence": text("signature_confidence", default="LOW"),
        "line_number": number("Line").cast("int"),
        "entropy": number("entropy"),
        "language": text("language"),
        "variable_name": text("variable_name", "Associated Variable"),
        "value": text("Raw Value", "Masked Value"),
    }
    return rows.withColumns(columns)


def confusion_counts() -> list[Column]:
    y, predicted = F.col("y"), F.col("predicted")

    def cell(truth: int, said: int) -> Column:
        return F.count_if((y == truth) & (predicted == said))

    return [
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"),
    ]


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def _per_class(hit: Column, said: Column, truth: Column) -> Column:
    precision, recall = _ratio(hit, said), _ratio(hit, truth)
    return F.struct(
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * precision * recall, precision + recall).alias("f1_score"),
        truth.alias("support"),
    )


def report_columns() -> dict[str, Column]:
    """Accuracy, confusion matrix and report from the four counts."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    no = _per_class(tn, tn + fn, tn + fp)
    yes = _per_class(tp, tp + fp, tp + fn)

    def average(weight_no: Column, weight_yes: Column, over: Column) -> Column:
        return F.struct(
            *[
                _ratio(no[m] * weight_no + yes[m] * weight_yes, over).alias(m)
                for m in ("precision", "recall", "f1_score")
            ],
            total.alias("support"),
        )

    one = F.lit(1.0)
    return {
        "accuracy": _ratio(tn + tp, total),
        "confusion_matrix": F.array(F.array(tn, fp), F.array(fn, tp)),
        "classification_report": F.create_map(
            F.lit("0"), no,
            F.lit("1"), yes,
            F.lit("macro avg"), average(one, one, F.lit(2.0)),
            F.lit("weighted avg"), average(tn + fp, tp + fn, total),
        ),
    }


def report_of(predicted: DataFrame) -> DataFrame:
    """One row of metrics for ``y`` and ``predicted``: a single aggregate."""
    return predicted.agg(*confusion_counts()).select(
        *[column.alias(name) for name, column in report_columns().items()]
    )


def evaluate(rows: DataFrame, label_column: str = "label", scorer: Scorer | None = None) -> DataFrame:
    """Metrics of ``scorer`` (the rule baseline by default) on labelled rows, as one row.

    Rows without a usable label only count as input, so one pass gives all
    figures.
    """
    truth = with_label(rows, label_column)
    scored = (scorer or baseline_scorer())(normal_rows(truth))
    known = F.col("y").isNotNull()
    counted = scored.select(
        "y", F.col("approved").cast("int").alias("predicted"), "confidence", "model_name"
    ).agg(
        *confusion_counts(),
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(known).alias("rows"),
        F.coalesce(F.avg(F.when(known, F.col("confidence"))), F.lit(0.0)).alias("average_confidence"),
        F.max("model_name").alias("model"),
    )
    return counted.select(
        "model",
        "input_rows",
        "rows",
        (F.col("input_rows") - F.col("rows")).alias("ignored_review_rows"),
        *[column.alias(name) for name, column in report_columns().items()],
        "average_confidence",
    )

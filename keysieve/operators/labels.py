"""Ground-truth labels in their various layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.functions.text import strip

BOTH_FLAGS = "A row marks both 'real_secret' and 'false_positive'; keep one true label per row."


def normal_label(value: Column) -> Column:
    """1 for a positive spelling, a text that spells the number one, or a number that truncates to it, else 0."""
    text = strip(F.lower(value.cast("string")))
    number = text.try_cast("double")
    is_one = F.when(F.typeof(value).isin("string", "boolean"), number == 1).otherwise((number >= 1) & (number < 2))
    return F.when(F.coalesce(text.isin(*C.POSITIVE_LABELS) | is_one, F.lit(False)), F.lit(1)).otherwise(F.lit(0))


def _one_hot(rows: DataFrame, label_column: str) -> tuple[Column, Column]:
    present = [c for c in ("real_secret", "false_positive") if c in rows.columns]
    if not present:
        raise ValueError(
            f"Label column '{label_column}' was not found, and no 'real_secret'/'false_positive' columns "
            f"were present. Available columns: {', '.join(rows.columns)}"
        )
    yes, no = (
        normal_label(F.col(c)) if c in present else F.lit(0) for c in ("real_secret", "false_positive")
    )
    # Checked as rows are read, so that no pass over the table is needed before.
    checked = F.when((yes == 1) & (no == 1), F.raise_error(F.lit(BOTH_FLAGS)).cast("int")).otherwise(yes)
    return checked, no


def with_label(rows: DataFrame, label_column: str = "label") -> DataFrame:
    """All rows with their usable label ``y``; null for review, blank and unknown ones."""
    if label_column in rows.columns:
        text = strip(F.lower(F.col(label_column).cast("string")))
        y = F.when(text.isin(*C.POSITIVE_LABELS), 1).when(text.isin(*C.NEGATIVE_LABELS), 0)
    else:
        yes, no = _one_hot(rows, label_column)
        y = F.when((yes == 1) & (no == 0), 1).when((no == 1) & (yes == 0), 0)
    return rows.withColumn("y", y)


def labelled_rows(rows: DataFrame, label_column: str = "label") -> DataFrame:
    """Only the rows with a usable label."""
    return with_label(rows, label_column).where(F.col("y").isNotNull())


def resolved_labels(rows: DataFrame, label_column: str = "label") -> DataFrame:
    """All rows with a label ``y``; whatever is not positive is 0."""
    if label_column in rows.columns:
        return rows.withColumn("y", normal_label(F.col(label_column)))
    yes, no = _one_hot(rows, label_column)
    return rows.withColumn("y", F.when((yes == 1) & (no == 0), 1).otherwise(0))

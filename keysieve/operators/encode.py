"""Numeric model inputs from feature rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysieve import catalog as C
from keysieve.functions.text import contains_any, strip

# Alternate names of the same feature-row value, first present wins.
ALTERNATE_NAMES = {
    "file_path": ("file_path", "File"),
    "provider": ("provider", "Secret Type"),
    "variable_name": ("variable_name", "Associated Variable"),
}


_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|[+-]?inf(?:inity)?"


def numeric(value: Column, kind: T.DataType | None = None) -> Column:
    """Number of a boolean or numeric column, else a lenient one: blanks 0, truth words 1 and 0, the rest 0.

    Null and NaN are 0.
    """
    if isinstance(kind, T.BooleanType):
        return as_double(value)
    if isinstance(kind, T.NumericType):
        return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    text = strip(F.lower(value.cast("string")))
    number = F.when(text.rlike(f"^(?:{_NUMBER})$"), text.try_cast("double")).otherwise(0.0)
    return (
        F.when(value.isNull() | (text == ""), F.lit(0.0))
        .when(text.isin(*C.NUMERIC_TRUE), F.lit(1.0))
        .when(text.isin(*C.NUMERIC_FALSE), F.lit(0.0))
        .otherwise(number)
    )


def as_double(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)).cast("double")


def encoded(rows: DataFrame, order: Sequence[str] = C.FEATURE_ORDER) -> dict[str, Column]:
    """Encoded column by name; features the table lacks are 0."""
    have = set(rows.columns)

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in have else F.lit("")

    def tier_score() -> Column:
        out = F.lit(0.0)
        for tier, score in C.TIER_SCORES:
            out = F.when(F.upper(text("signature_confidence")) == tier, F.lit(score)).otherwise(out)
        return out

    def proximity() -> Column:
        if "nearest_secret_term_distance" not in have:
            return F.lit(0.0)
        distance = F.col("nearest_secret_term_distance").try_cast("double")
        near = 1.0 - F.least(distance, F.lit(C.PROXIMITY_SPAN)) / C.PROXIMITY_SPAN
        return F.when(distance.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), near))

    provider, language = F.lower(text("provider")), F.lower(text("language"))
    derived = {
        "signature_confidence_score": tier_score,
        "provider_is_generic": lambda: as_double(provider.startswith("generic")),
        "provider_is_critical_type": lambda: as_double(contains_any(provider, C.CRITICAL_PROVIDER_TERMS)),
        "secret_term_proximity_score": proximity,
        "language_is_python": lambda: as_double(language == "python"),
        "language_is_config": lambda: as_double(language == "config"),
        "language_is_documentation": lambda: as_double(language == "documentation"),
        "parse_error_present": lambda: as_double(text("parse_error") != ""),
    }
    return {
        name: derived[name]() if name in derived
        else numeric(F.col(f"`{name}`"), rows.schema[name].dataType) if name in have
        else F.lit(0.0)
        for name in order
    }


def assemble(rows: DataFrame, order: Sequence[str] = C.FEATURE_ORDER, output: str = "features") -> DataFrame:
    """Add the encoded inputs as one vector, in ``order``."""
    columns = encoded(rows, order)
    prefixed = {f"__{name}": column for name, column in columns.items()}
    vectors = VectorAssembler(inputCols=list(prefixed), outputCol=output, handleInvalid="error")
    return vectors.transform(rows.withColumns(prefixed)).drop(*prefixed)

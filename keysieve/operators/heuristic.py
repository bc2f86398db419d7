"""Rule baseline: a transparent score from the feature columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.functions.text import keep_present

Scorer = Callable[[DataFrame], DataFrame]


def _flag(name: str, columns: list[str]) -> Column:
    """A boolean feature; absent or null means false."""
    if name not in columns:
        return F.lit(False)
    return F.coalesce(F.col(name).try_cast("boolean"), F.lit(False))


def _text(name: str, columns: list[str], default: str = "") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in columns else F.lit(default)


def base_score(tier: Column) -> Column:
    out = F.lit(C.TIER_BASE_DEFAULT)
    for name, score in C.TIER_BASE_SCORES:
        out = F.when(F.upper(tier) == name, F.lit(score)).otherwise(out)
    return out


def baseline_scorer(approve_threshold: float = C.APPROVE_THRESHOLD) -> Scorer:
    """Scorer that adds ``label, confidence, approved, model_name, reasons, raw_score``."""

    def score(rows: DataFrame) -> DataFrame:
        have = rows.columns

        def flag(name: str) -> Column:
            if name == "entropy":
                number = F.col(name).try_cast("double") if name in have else F.lit(0.0)
                return F.coalesce(number, F.lit(0.0)) >= C.HIGH_ENTROPY
            return _flag(name, have)

        generic_hex = _text("provider", have).startswith("Generic") & flag("is_hex")
        doc_template = (
            (flag("has_template_language") | flag("has_placeholder_signal"))
            & (flag("is_template_file") | flag("is_documentation_or_test_path"))
            & ~flag("has_asset_reference")
            & ~flag("has_downstream_usage")
        )
        steps = [(w, flag(n), reason) for w, n, reason in C.BASELINE_ADDS]
        steps += [(-w, flag(n), reason) for w, n, reason in C.BASELINE_SUBTRACTS]
        steps += [
            (-C.GENERIC_HEX_PENALTY[0], generic_hex, C.GENERIC_HEX_PENALTY[1]),
            (-C.DOC_TEMPLATE_PENALTY[0], doc_template, C.DOC_TEMPLATE_PENALTY[1]),
        ]
        # Doubles in this order: the sums decide on thresholds to the last bit.
        raw = base_score(_text("signature_confidence", have, "LOW"))
        for weight, condition, _ in steps:
            raw = raw + F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
        reasons = keep_present([F.when(cond, F.lit(reason)) for _, cond, reason in steps])
        return decide(
            rows.withColumn("raw_score", raw).withColumn("reasons", reasons),
            F.least(F.lit(C.MAX_CONFIDENCE), F.greatest(F.lit(0.0), F.col("raw_score"))),
            F.lit(approve_threshold),
            C.BASELINE_MODEL,
        )

    return score


def decide(rows: DataFrame, confidence: Column, threshold: Column, model_name: str) -> DataFrame:
    """Turn a confidence and a threshold into the decision columns."""
    return (
        rows.withColumn("confidence", confidence)
        .withColumn("approved", F.col("confidence") >= threshold)
        .withColumn(
            "label", F.when(F.col("approved"), F.lit("REAL_SECRET")).otherwise(F.lit("FALSE_POSITIVE"))
        )
        .withColumn("model_name", F.lit(model_name))
    )


def may_validate(confidence: Column, threshold: float = C.VALIDATION_THRESHOLD) -> Column:
    """Gate for checks that cost something: only confident findings pass."""
    return confidence >= threshold

"""Risk-ranked, masked and explained findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.functions.text import any_of, mask
from keysieve.operators.features import redact, redact_evidence


def approved_only(analyses: DataFrame) -> DataFrame:
    return analyses.where("approved")


def risk_score(provider: Column, confidence: Column) -> Column:
    """Confidence raised by provider, use and assets, lowered for documentation paths."""
    critical = any_of(provider.startswith(p) for p in C.RISK_PROVIDER_PREFIXES)
    score = confidence + F.when(critical, F.lit(C.RISK_PROVIDER_WEIGHT)).otherwise(F.lit(0.0))
    for weight, flag in C.RISK_ADDS:
        score = score + F.when(F.col(flag), F.lit(weight)).otherwise(F.lit(0.0))
    score = score - F.when(F.col("is_documentation_or_test_path"), F.lit(C.RISK_DOC_PENALTY)).otherwise(
        F.lit(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def risk_level(score: Column) -> Column:
    level = F.lit("LOW")
    for name, least in reversed(C.RISK_BANDS):
        level = F.when(score >= least, F.lit(name)).otherwise(level)
    return level


def finding_evidence() -> Column:
    """Feature evidence, classifier reasons and the window, each once, in order."""
    window = F.col("context_window")
    return F.array_distinct(
        F.concat(
            F.col("evidence"),
            F.transform(
                F.col("reasons"), lambda r: F.concat(F.lit("Classifier reason: "), r, F.lit("."))
            ),
            F.when(window != "", F.array(F.concat(F.lit("Context: "), window))).otherwise(
                F.array().cast("array<string>")
            ),
        )
    )


def build_findings(analyses: DataFrame) -> DataFrame:
    """Findings of the approved candidates, unsorted."""
    return (
        approved_only(analyses)
        .withColumn("risk_score", risk_score(F.col("provider"), F.col("confidence")))
        .select(
            "file_ord", "sig_ord", "start_index", "repository", "file_path", "url", "line_number",
            F.col("value").alias("raw_value"),
            mask(F.col("value")).alias("masked_value"),
            F.col("provider").alias("secret_type"),
            "ast_node_type",
            "variable_name",
            F.col("downstream_calls").alias("usage_calls"),
            F.col("first_assets").alias("asset_references"),
            "confidence",
            "risk_score",
            risk_level(F.col("risk_score")).alias("risk_level"),
            finding_evidence().alias("evidence"),
            "model_name",
            F.lit(None).cast("string").alias("validation_details"),
        )
    )


# Highest risk first; recovery order settles ties.
PRIORITY = ("-risk_score", "-confidence", "file_ord", "sig_ord", "start_index")


def priority_order() -> list[Column]:
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in PRIORITY]


def rank_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*priority_order())


def report_rows(findings: DataFrame, include_raw: bool = False, redacted: bool = True) -> DataFrame:
    """The 16 report columns. Values inside any text are masked unless asked otherwise."""
    value = F.col("raw_value")
    hide = redacted and not include_raw

    def shown(text: Column) -> Column:
        return redact(text, value) if hide else text

    evidence = F.array_join(redact_evidence(F.col("evidence"), value) if hide else F.col("evidence"), " | ")
    columns = [
        shown(F.col("repository")).alias("Repository"),
        shown(F.col("file_path")).alias("File"),
        shown(F.col("url")).alias("URL"),
        F.col("line_number").alias("Line"),
        F.col("masked_value").alias("Masked Value"),
        F.col("secret_type").alias("Secret Type"),
        F.coalesce(F.col("ast_node_type"), F.lit("")).alias("AST Node"),
        shown(F.coalesce(F.col("variable_name"), F.lit(""))).alias("Associated Variable"),
        shown(F.array_join("usage_calls", " | ")).alias("Usage Calls"),
        shown(F.array_join("asset_references", " | ")).alias("Asset References"),
        F.round("confidence", 4).alias("Confidence"),
        F.round("risk_score", 4).alias("Risk Score"),
        F.col("risk_level").alias("Risk Level"),
        F.col("model_name").alias("Model"),
        evidence.alias("Contextual Evidence"),
        F.coalesce(F.col("validation_details"), F.lit("")).alias("Validation Details"),
    ]
    if include_raw:
        columns.append(value.alias("Raw Value"))
    return findings.select(*columns)


def top_findings(findings: DataFrame, limit: int = 10) -> DataFrame:
    """The few rows a person looks at first."""
    return (
        findings.orderBy(*priority_order())
        .limit(limit)
        .select(
            F.col("risk_level").alias("Risk"),
            F.round("confidence", 4).alias("Confidence"),
            F.col("secret_type").alias("Type"),
            F.col("masked_value").alias("Masked Value"),
            F.concat("file_path", F.lit(":"), "line_number").alias("Location"),
            F.concat(
                F.coalesce(F.col("ast_node_type"), F.lit("")),
                F.lit(" / "),
                F.coalesce(F.col("variable_name"), F.lit("")),
            ).alias("AST / Variable"),
        )
    )


def remaining_count(findings: DataFrame, shown: int = 10) -> DataFrame:
    """How many findings the top view leaves out."""
    return findings.agg(F.greatest(F.count(F.lit(1)) - shown, F.lit(0)).alias("remaining"))

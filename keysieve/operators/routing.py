"""Which check a finding would go to, and what can be said without making it.

No credential is ever tried against a service. Findings that would need a live
check get a status that says so; verdicts made elsewhere come in as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.functions.text import strip
from keysieve.operators.heuristic import may_validate
from keysieve.operators.report import report_rows


def resolve_service(secret_type: Column, requested: Column | str = "auto") -> Column:
    """Requested service, else passive for sensitive types, else by name, else generic."""
    asked = strip(F.lower(F.lit(requested) if isinstance(requested, str) else requested))
    kind = strip(F.lower(secret_type))
    route = F.lit("generic")
    for name in reversed(C.PROVIDER_ROUTES):
        route = F.when(kind.contains(name), F.lit(name)).otherwise(route)
    route = F.when(kind.isin(*C.PASSIVE_TYPES), F.lit("passive")).otherwise(route)
    return F.when((asked != "") & (asked != "auto"), asked).otherwise(route)


def outcome(service: Column, value: Column, secret_type: Column) -> Column:
    """struct<valid,details,status> of a route."""

    def result(details: Column, status: str) -> Column:
        return F.struct(
            F.lit(False).alias("valid"), details.alias("details"), F.lit(status).alias("status")
        )

    label = F.when(
        secret_type.isNull() | (secret_type == ""), F.lit("sensitive provider")
    ).otherwise(secret_type)
    before, after = C.PASSIVE_DETAILS
    route = F.lower(service)
    return (
        F.when(route == "passive", result(F.concat(F.lit(before), label, F.lit(after)), "skipped"))
        .when(
            route.isin(*C.PROVIDER_ROUTES),
            result(F.lit(""), "external_check_required"),
        )
        .when(F.length(value) > 20, result(F.lit(C.GENERIC_LONG_DETAILS), "unsupported"))
        .otherwise(result(F.lit(C.GENERIC_SHORT_DETAILS), "unsupported"))
    )


def route_findings(
    findings: DataFrame, service: str = "auto", threshold: float = C.VALIDATION_THRESHOLD
) -> DataFrame:
    """Confident findings with their route, outcome and annotated details."""
    routed = (
        findings.where(may_validate(F.col("confidence"), threshold))
        .withColumn("service", resolve_service(F.col("secret_type"), service))
        .withColumn("outcome", outcome(F.col("service"), F.col("raw_value"), F.col("secret_type")))
    )
    details = F.col("outcome.details")
    return routed.withColumns({
        "validation_details": F.when(
            details != "", F.concat(F.col("service"), F.lit(": "), details)
        ).otherwise(F.col("validation_details")),
        "valid": F.col("outcome.valid"),
        "status": F.col("outcome.status"),
    }).drop("outcome")


def with_verdicts(routed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Apply verdicts made elsewhere: ``file_ord, sig_ord, start_index, valid, details``."""
    key = ["file_ord", "sig_ord", "start_index"]
    said = verdicts.select(*key, F.col("valid").alias("_valid"), F.col("details").alias("_details"))
    return (
        routed.join(said, key, "left")
        .withColumn(
            "validation_details",
            F.when(
                F.coalesce("_details", F.lit("")) != "",
                F.concat(F.col("service"), F.lit(": "), F.col("_details")),
            ).otherwise(F.col("validation_details")),
        )
        .withColumn("valid", F.coalesce("_valid", "valid"))
        .withColumn("status", F.when(F.col("_valid"), F.lit("valid")).otherwise(F.col("status")))
        .drop("_valid", "_details")
    )


def confirmed_rows(routed: DataFrame) -> DataFrame:
    """Report rows of the findings confirmed as live."""
    return report_rows(routed.where("valid"))

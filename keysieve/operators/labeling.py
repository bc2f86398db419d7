"""Bootstrap labels: suggest, promote up to a quota, queue the rest for review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.functions.lineage import stored
from keysieve.functions.text import SPACE, any_of, contains_any, rlike_any, strip, truthy
from keysieve.operators.topk import best

NEAR_MISS = "near_miss_high_confidence"

# Whether a binding stands in a text: what precedes its name doesn't matter, and what follows it holds no white space and
# no sign. Trying each start of a name with each of its lengths takes the JVM engine quadratic time.
_NAME_REST = "[A-Za-z0-9_.-]*"
_BINDING = C.SENSITIVE_BINDING_REGEX.replace("(" + _NAME_REST, "(", 1).replace(_NAME_REST + ")", _NAME_REST + "+)", 1)


def _first_present(rows: DataFrame, names: tuple[str, ...], default: str = "") -> Column:
    for name in names:
        if name in rows.columns:
            return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(default))
    return F.lit(default)


def _present_flag(rows: DataFrame, name: str) -> Column:
    return truthy(F.col(name)) if name in rows.columns else F.lit(False)


def current_label(rows: DataFrame) -> Column:
    """Text label if there is one, else what the one-hot columns say, else null."""
    text = strip(F.lower(_first_present(rows, ("label",))))

    def hot(name: str) -> Column:
        return strip(F.lower(_first_present(rows, (name,)))).isin(*C.ONE_HOT_TRUE)

    yes, no = hot("real_secret"), hot("false_positive")
    return (
        F.when(text != "", text)
        .when(yes & ~no, F.lit("real_secret"))
        .when(no & ~yes, F.lit("false_positive"))
    )


def _texts(rows: DataFrame) -> dict[str, Column]:
    """The texts the flags search, each made once."""
    return {
        "_window": F.lower(_first_present(rows, ("context_window",))),
        "_path": F.lower(_first_present(rows, ("File", "file_path"))),
        "_kind": _first_present(rows, ("Secret Type", "provider")),
        "_variable": strip(_first_present(rows, ("Associated Variable", "variable_name"))),
    }


def review_flags(rows: DataFrame, named_dumps: Sequence[str] = C.NAMED_DUMP_PATHS) -> dict[str, Column]:
    """The flags the review buckets are decided on, over the columns of ``_texts``."""
    window, path, kind, variable = (F.col(c) for c in ("_window", "_path", "_kind", "_variable"))

    def flag(name: str) -> Column:
        return _present_flag(rows, name)

    return {
        "is_doc_path": flag("is_documentation_or_test_path") | rlike_any(path, C.DOC_PATH_HINTS),
        "is_code_or_config": rlike_any(path, C.CODE_PATH_HINTS)
        | F.lower(_first_present(rows, ("language",))).isin(*C.CODE_LANGUAGES),
        "has_placeholder": flag("has_placeholder_signal") | flag("has_template_language"),
        "has_realistic_terms": contains_any(window, C.REALISTIC_TERMS),
        "has_hash_noise": flag("has_hash_or_identifier_term") | contains_any(window, C.HASH_NOISE_TERMS),
        "has_explicit_placeholder": contains_any(window, C.EXPLICIT_PLACEHOLDER_TERMS),
        "has_asset": flag("has_asset_reference"),
        "provider_specific": kind.isin(*C.PROVIDER_SPECIFIC_TYPES),
        "generic_type": kind.isin(*C.GENERIC_TYPES),
        "sensitive_variable": flag("variable_is_sensitive"),
        "is_assignment": flag("is_assignment_context"),
        "has_binding": variable.rlike("(?i)" + C.SENSITIVE_NAME_REGEX)
        | window.rlike("(?i)" + _BINDING.replace(r"\s", f"[{SPACE}]")),
        "is_named_dump": any_of(path.contains(d) for d in named_dumps),
        "is_operational_id": (kind == C.UUID_PROVIDER) & contains_any(window, C.OPERATIONAL_ID_TERMS),
        "is_fake_key": window.contains("fake_key") | window.contains("false_key"),
    }


def _fold(steps: list[tuple[Column, Column]]) -> Column:
    """Sum of the weights whose condition holds, added from left to right."""
    total = F.lit(0.0)
    for condition, weight in steps:
        total = total + F.when(condition, weight).otherwise(F.lit(0.0))
    return total


def with_suggestion(rows: DataFrame, named_dumps: Sequence[str] = C.NAMED_DUMP_PATHS) -> DataFrame:
    """Add ``suggested_label``, ``review_bucket`` and the unrounded ``_score``."""
    raw = _first_present(rows, ("Classifier Confidence",), "0")
    confidence = F.coalesce(raw.try_cast("double"), F.lit(0.0))
    flags = {f"_{k}": v for k, v in review_flags(rows, named_dumps).items()}
    texts = _texts(rows)
    flagged = rows.withColumns(texts).withColumns({**flags, "_confidence": confidence}).drop(*texts)
    f = {k[1:]: F.col(k) for k in flags}
    confidence = F.col("_confidence")
    generic, code, doc = f["generic_type"], f["is_code_or_config"], f["is_doc_path"]
    realistic, hashy, binding = f["has_realistic_terms"], f["has_hash_noise"], f["has_binding"]

    positive = _fold([
        (f["provider_specific"], F.lit(0.75)),
        (realistic, F.lit(0.30)),
        (code, F.lit(0.20)),
        (f["has_asset"], F.lit(0.10)),
        (F.lit(True), F.least(confidence, F.lit(0.60))),
        (generic & code & (binding | f["sensitive_variable"]) & (confidence >= 0.30), F.lit(0.20)),
    ])
    negative = _fold([
        (f["has_placeholder"] | f["has_explicit_placeholder"], F.lit(0.90)),
        (hashy, F.lit(0.45)),
        (doc & ~realistic & ~f["has_asset"], F.lit(0.30)),
        (f["is_fake_key"], F.lit(0.60)),
        (generic & doc, F.lit(0.40)),
        (generic & f["is_named_dump"], F.lit(0.25)),
        (f["is_operational_id"], F.lit(0.95)),
    ])
    scored = flagged.withColumn("_negative", negative).withColumn("_score", positive - F.col("_negative"))
    score = F.col("_score")

    def answer(label: str, bucket: str | Column) -> Column:
        named = F.lit(bucket) if isinstance(bucket, str) else bucket
        return F.struct(F.lit(label).alias("label"), named.alias("bucket"))

    noise = answer("false_positive", "low_priority_noise")
    review = answer("review", NEAR_MISS)

    def review_if(condition: Column) -> Column:
        return F.when(condition, review).otherwise(noise)

    decision = (
        F.when(generic & f["is_operational_id"], answer("false_positive", "operational_ids"))
        .when(F.col("_negative") >= 0.80, answer("false_positive", "docs_placeholders"))
        .when(generic & f["is_named_dump"], review_if(realistic & ~f["has_placeholder"] & ~hashy))
        .when(generic & doc, review_if(realistic & binding & ~f["has_placeholder"] & ~hashy))
        .when(generic & ~code, review_if(realistic & binding & ~hashy))
        .when(generic & ~(binding | f["sensitive_variable"] | f["is_assignment"]), review_if(score >= 0.80))
        .when(
            score >= 0.95,
            answer(
                "real_secret",
                F.when(code, F.lit("code_config_real_key")).otherwise(F.lit("docs_real_keys")),
            ),
        )
        .when(score >= 0.70, review)
        .otherwise(noise)
    )
    return (
        scored.withColumn("_decision", decision)
        .withColumn("suggested_label", F.col("_decision.label"))
        .withColumn("review_bucket", F.col("_decision.bucket"))
        .drop("_decision", "_negative", "_confidence", *flags)
    )


def review_priority(bucket: Column) -> Column:
    return (
        F.when(bucket.isin("code_config_real_key", "docs_real_keys"), F.lit(1))
        .when(bucket == NEAR_MISS, F.lit(2))
        .otherwise(F.lit(4))
    )


def seeded(rows: DataFrame) -> DataFrame:
    """Add the label columns a table may lack, and carry existing labels over."""
    known = current_label(rows)
    for name in ("label", "label_source"):
        rows = rows.withColumn(name, _first_present(rows, (name,)))
    for name in ("real_secret", "false_positive"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("int"))
    blank_source = strip(F.col("label_source")) == ""
    return (
        rows.withColumn("_known", known)
        .withColumn(
            "label_source",
            F.when((F.col("_known") == "real_secret") & blank_source, F.lit("manual_seed")).otherwise(
                F.col("label_source")
            ),
        )
        .withColumn(
            "label",
            F.when(F.col("_known") == "real_secret", F.lit("real_secret"))
            .when((F.col("_known") == "false_positive") & (strip(F.col("label")) == ""), F.lit("false_positive"))
            .otherwise(F.col("label")),
        )
    )


def suggested(rows: DataFrame, named_dumps: Sequence[str] = C.NAMED_DUMP_PATHS) -> DataFrame:
    """Seeded rows with suggestion, rounded score and priority."""
    return (
        seeded(with_suggestion(rows, named_dumps))
        .withColumn("review_score", F.round("_score", 4))
        .withColumn("review_priority", review_priority(F.col("review_bucket")))
    )


def _promotions(rows: DataFrame, target: int, order: Sequence[str]) -> DataFrame | None:
    """Row ids to promote with the source they get; None when the target is met."""
    is_open = F.coalesce(F.col("_known") != "real_secret", F.lit(True))
    first = is_open & (F.col("suggested_label") == "real_secret")
    second = is_open & (F.col("suggested_label") == "review") & (F.col("review_bucket") == NEAR_MISS)
    # Counted by row_id first, so that one pass also says whether an id is repeated.
    by_id = rows.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_known") == "real_secret").alias("existing"), F.count_if(first).alias("first")
    )
    counts = by_id.agg(
        F.max("rows").alias("most"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("existing", "first"))
    ).first()
    if (counts["most"] or 0) > 1:
        raise ValueError("row_id must be unique: a repeated one would be promoted with every row it names.")
    needed = max(0, target - counts["existing"])
    taken = min(needed, counts["first"])

    def chosen(condition: Column, limit: int, source: str) -> DataFrame:
        open_rows = rows.where(condition).select(*dict.fromkeys(("row_id", "_score", *order)))
        return best(open_rows, limit, "_score", order).select("row_id", F.lit(source).alias("_promoted"))

    if needed == 0:
        return None
    out = chosen(first, needed, "bootstrap_positive")
    if needed - taken:
        out = out.unionByName(chosen(second, needed - taken, "bootstrap_near_miss_positive"))
    return out


def bootstrap_labels(
    rows: DataFrame,
    target: int = C.TARGET_POSITIVES,
    order: Sequence[str] = ("row_id",),
    named_dumps: Sequence[str] = C.NAMED_DUMP_PATHS,
) -> DataFrame:
    """Labelled rows: the best suggestions promoted up to ``target`` positives.

    ``row_id`` identifies a row and ``order`` settles ties. The suggestions are
    written once, since counting, ranking and marking each read them.
    """
    known = stored(suggested(rows, named_dumps))
    chosen = _promotions(known, target, order)
    marked = (
        known.join(chosen, "row_id", "left")
        if chosen is not None
        else known.withColumn("_promoted", F.lit(None).cast("string"))
    )
    promoted = F.col("_promoted").isNotNull()
    settled = F.coalesce(F.col("_known") == "real_secret", F.lit(False)) | (
        strip(F.col("label_source")) != ""
    )
    negative = ~promoted & ~settled & (F.col("suggested_label") == "false_positive")
    queued = ~promoted & ~settled & ~negative & (F.col("review_bucket") == NEAR_MISS)

    def hot(name: str, when_promoted: int, when_negative: int) -> Column:
        kind = known.schema[name].dataType
        return (
            F.when(promoted, F.lit(when_promoted).cast(kind))
            .when(negative, F.lit(when_negative).cast(kind))
            .when(queued, F.lit(None).cast(kind))
            .otherwise(F.col(name))
        )

    return marked.withColumns({
        "real_secret": hot("real_secret", 1, 0),
        "false_positive": hot("false_positive", 0, 1),
        "label": F.when(promoted, F.lit("real_secret"))
        .when(negative, F.lit("false_positive"))
        .when(queued, F.lit(""))
        .otherwise(F.col("label")),
        "label_source": F.when(promoted, F.col("_promoted"))
        .when(negative, F.lit("bootstrap_negative"))
        .when(queued, F.lit("needs_review"))
        .otherwise(F.col("label_source")),
        "_existing": F.coalesce(F.col("_known") == "real_secret", F.lit(False)),
    }).drop("_known", "_score", "_promoted")


def bootstrap_summary(labelled: DataFrame) -> DataFrame:
    """One row: totals, promotions and the size of each bucket."""
    buckets = (
        labelled.groupBy("review_bucket")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("_existing").alias("existing"),
            F.count_if(F.col("label_source").isin("bootstrap_positive", "bootstrap_near_miss_positive")).alias(
                "promoted"
            ),
            F.count_if(F.col("real_secret").try_cast("double") == 1).alias("final"),
        )
    )
    # At most one row per bucket name is left to combine.
    return buckets.agg(
        F.sum("n").alias("rows"),
        F.sum("existing").alias("existing_positive_rows"),
        F.sum("promoted").alias("promoted_positive_rows"),
        F.sum("final").alias("final_positive_rows"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("review_bucket", "n")))).alias("review_buckets"),
    )


def labelled_table(labelled: DataFrame) -> DataFrame:
    return labelled.drop("_existing")


def review_queue(
    labelled: DataFrame, limit: int = C.REVIEW_QUEUE_LIMIT, order: Sequence[str] = ("row_id",)
) -> DataFrame:
    """The rows to look at first: by priority, then score."""
    return (
        labelled.where(F.col("label_source") == "needs_review")
        .orderBy(F.asc("review_priority"), F.desc("review_score"), *order)
        .limit(limit)
    )

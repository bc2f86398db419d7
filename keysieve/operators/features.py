"""The typed feature columns of a candidate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.functions import paths
from keysieve.functions.assets import asset_matches
from keysieve.functions.reuse import built_once
from keysieve.functions.text import contains_any, keep_present, let, mask, rlike_any, strip


# Fixed value: how much of the context window is shown.
WINDOW_SHOWN = 300


def statistical(value: Column, entropy: Column) -> dict[str, Column]:
    """Length, entropy and character make-up of the value."""
    length = F.length(value)
    digits = length - F.length(F.regexp_replace(value, r"\p{Nd}", ""))
    letters = length - F.length(F.regexp_replace(value, r"\p{L}", ""))
    empty = length == 0

    def share(count: Column) -> Column:
        return F.when(empty, F.lit(0.0)).otherwise(count / length)

    return {
        "length": length,
        "entropy": F.round(entropy, 4),
        "digit_ratio": share(digits),
        "alpha_ratio": share(letters),
        "symbol_ratio": share(length - digits - letters),
        "is_hex": ~empty & ~value.rlike("[^0-9a-fA-F-]"),
        "is_uuid_like": (length - F.length(F.replace(value, F.lit("-"), F.lit(""))) == 4) & (length == 36),
    }


def syntactic() -> dict[str, Column]:
    """What the code context says about the binding and use of the value."""
    variable = F.lower(F.coalesce("variable_name", F.lit("")))
    call = F.lower(F.coalesce("call_name", F.lit("")))
    node = F.coalesce(F.col("ast_node_type"), F.lit(""))
    parent = F.coalesce(F.col("parent_node_type"), F.lit(""))
    return {
        "has_ast_context": F.col("parse_error").isNull(),
        "has_variable_name": variable != "",
        "variable_is_sensitive": rlike_any(variable, C.SENSITIVE_NAME_TERMS),
        "call_is_auth_related": rlike_any(call, C.AUTH_CALL_TERMS),
        "downstream_call_count": F.size("downstream_calls"),
        "has_downstream_usage": F.size("downstream_calls") > 0,
        "downstream_calls_text": F.array_join(F.slice("downstream_calls", 1, 5), " | "),
        "ast_node_type": node,
        "parent_node_type": parent,
        "is_assignment_context": parent.isin("Assign", "AnnAssign") | (node == "ConfigProperty"),
    }


def nearest_term_distance(context: Column, terms: tuple[str, ...] = C.SECRET_TERMS) -> Column:
    """Distance from the middle of ``context`` to the closest start of any term, or null.

    For each term only the last start before the middle and the first one from
    it on can be closest, so two searches per term replace listing all of them.
    """
    middle = F.floor(F.length(context) / 2).cast("int")
    distances = []
    for term in terms:
        size = len(term)
        after = F.locate(term, F.substring(context, middle + 1, F.length(context)))
        distances.append(F.when(after > 0, after - 1))
        head = F.left(context, middle + size - 1)
        back = F.locate(term[::-1], F.reverse(head))
        start = F.length(head) - (back - 1) - size
        distances.append(F.when(back > 0, middle - start))
    return F.least(*distances)


def secret_list_shape(context: Column) -> Column:
    """At least two of the terms that lists of leaked keys share."""
    hits = reduce(
        lambda total, term: total + context.contains(term).cast("int"), C.SECRET_LIST_TERMS, F.lit(0)
    )
    return hits >= 2


def joined_words(context: Column) -> Column:
    return F.replace(F.lower(context), F.lit(" "), F.lit("_"))


def placeholder_signal(joined: Column) -> Column:
    """Placeholder terms in a text whose words are joined by underscores."""
    return contains_any(joined, C.PLACEHOLDER_TERMS)


def _around(width: int) -> Column:
    """The value with ``width`` characters on each side, cut from the window that recovery took."""
    if width > C.ASSET_WINDOW:
        raise ValueError(f"Recovery keeps {C.ASSET_WINDOW} characters on each side, {width} are asked for.")
    lead = F.least(F.col("window_lead"), F.lit(width))
    return F.substring(F.col("window"), F.col("window_lead") - lead + 1, lead + F.length("value") + width)


def context_text(width: int = C.CONTEXT_WINDOW) -> Column:
    """The window of ``width`` characters on each side, on one line."""
    return F.replace(_around(width), F.lit("\n"), F.lit(" "))


def contextual() -> dict[str, Column]:
    """Signals in the text around the value and in the path; needs ``context_lower`` and ``context_joined``."""
    lower = F.col("context_lower")
    path = F.col("file_path")
    weak = (paths.is_doc_or_test(path) | paths.is_template_file(path)) & ~secret_list_shape(lower)
    return {
        "context_window": F.substring(strip(F.col("context_raw")), 1, WINDOW_SHOWN),
        "nearest_secret_term_distance": nearest_term_distance(lower),
        "has_secret_term_nearby": contains_any(lower, C.SECRET_TERMS),
        "has_hash_or_identifier_term": contains_any(lower, C.HASH_OR_ID_TERMS),
        "has_placeholder_signal": placeholder_signal(F.col("context_joined")),
        "has_template_language": contains_any(lower, C.TEMPLATE_TERMS),
        "is_template_file": paths.is_template_file(path),
        "is_documentation_or_test_path": paths.is_doc_or_test(path),
        "is_weak_documentation_context": weak,
    }


def nearby_assets(width: int = C.ASSET_WINDOW) -> Column:
    """References and kinds from the context and the window of ``width`` characters on each side."""
    return let(
        asset_matches(F.col("window") if width == C.ASSET_WINDOW else _around(width)),
        lambda found: F.struct(
            F.array_distinct(
                F.concat(F.col("context_asset_references"), F.transform(found, lambda a: a["reference"]))
            ).alias("references"),
            F.array_distinct(
                F.concat(F.col("context_asset_kinds"), F.transform(found, lambda a: a["kind"]))
            ).alias("kinds"),
        ),
    )


def assets() -> dict[str, Column]:
    """Asset columns; needs ``near``."""
    refs, kinds = F.col("near.references"), F.col("near.kinds")
    return {
        "has_asset_reference": F.size(refs) > 0,
        "asset_reference_count": F.size(refs),
        "asset_kinds": F.array_join(kinds, ","),
        "first_assets": F.slice(refs, 1, 5),
        "asset_references": F.array_join(F.slice(refs, 1, 5), " | "),
        "has_database_asset": F.array_contains(kinds, "database"),
        "has_url_asset": F.array_contains(kinds, "url"),
        "has_host_asset": F.array_contains(kinds, "host"),
    }


def evidence() -> Column:
    """Sentences for an analyst: context, then text signals, then assets."""

    def name_says(flag: str, before: str, column: str, after: str) -> Column:
        return F.when(F.col(flag), F.concat(F.lit(before), F.col(column), F.lit(after)))

    def says(flag: str, sentence: str) -> Column:
        return F.when(F.col(flag), F.lit(sentence))

    rest = keep_present([
        name_says("variable_is_sensitive", "Variable name '", "variable_name", "' contains a secret-related term."),
        name_says("call_is_auth_related", "Call '", "call_name", "' appears authentication or client related."),
        says("is_assignment_context", "Candidate is bound through assignment or configuration property."),
        says("has_downstream_usage", "Candidate has downstream data-flow usage after assignment."),
        says("has_secret_term_nearby", "Nearby context contains secret-related terminology."),
        says("has_hash_or_identifier_term",
             "Nearby context contains hash/id terminology associated with false positives."),
        says("has_placeholder_signal", "Nearby context contains placeholder or example terminology."),
        says("has_template_language", "Nearby context contains template instructions."),
        says("is_documentation_or_test_path", "File path suggests documentation, tests, examples, or fixtures."),
        says("is_weak_documentation_context", "Documentation context lacks strong leaked-key list structure."),
        F.when(
            F.col("has_asset_reference"),
            F.concat(
                F.lit("Candidate is near asset reference(s): "),
                F.array_join(F.slice("near.references", 1, 3), ", "),
                F.lit("."),
            ),
        ),
    ])
    return F.concat(F.col("context_evidence"), rest)


@built_once
def _feature_steps(context_width: int, asset_width: int) -> tuple[dict[str, Column], ...]:
    """Feature columns in steps; a step may use the columns of the ones before."""
    return (
        {**statistical(F.col("value"), F.col("entropy")), **syntactic(), "context_raw": context_text(context_width)},
        {
            "context_lower": F.lower("context_raw"),
            "context_joined": joined_words(F.col("context_raw")),
            "near": nearby_assets(asset_width),
        },
        {**contextual(), **assets()},
        {"evidence": evidence()},
    )


def add_features(
    candidates: DataFrame, context_width: int = C.CONTEXT_WINDOW, asset_width: int = C.ASSET_WINDOW
) -> DataFrame:
    """Add the four feature groups and the evidence to candidates with context.

    The widths say how many characters on each side of a value its context and its
    assets are read from, up to the ``ASSET_WINDOW`` that recovery keeps.
    """
    rows = candidates
    for columns in _feature_steps(context_width, asset_width):
        rows = rows.withColumns(columns)
    return rows.drop(
        "near", "context_raw", "context_lower", "context_joined", "window", "window_lead",
        "context_asset_references", "context_asset_kinds", "context_evidence",
    )


# The exported feature row: base columns, then the groups in order.
_BASE = (
    ("Repository", "repository"), ("File", "file_path"), ("URL", "url"), ("Line", "line_number"),
    ("Masked Value", None), ("Secret Type", "provider"), ("AST Node", "ast_node_type"),
    ("Associated Variable", "variable_name"), ("Classifier Label", "label"),
    ("Classifier Confidence", "confidence"),
)
_GROUPS = (
    "length", "entropy", "digit_ratio", "alpha_ratio", "symbol_ratio", "is_hex", "is_uuid_like",
    "has_ast_context", "has_variable_name", "variable_name", "variable_is_sensitive", "call_name",
    "call_is_auth_related", "downstream_call_count", "has_downstream_usage", "downstream_calls",
    "ast_node_type", "parent_node_type", "is_assignment_context", "parse_error",
    "context_window", "has_secret_term_nearby", "nearest_secret_term_distance",
    "has_hash_or_identifier_term", "has_placeholder_signal", "has_template_language",
    "is_template_file", "is_documentation_or_test_path", "is_weak_documentation_context",
    "has_asset_reference", "asset_reference_count", "asset_kinds", "asset_references",
    "has_database_asset", "has_url_asset", "has_host_asset",
    "provider", "signature_confidence", "file_path", "language",
)
# Columns with text from files, which may hold values.
_FREE_TEXT = (
    "Repository", "File", "URL", "Associated Variable", "variable_name", "call_name", "downstream_calls",
    "parse_error", "asset_references", "file_path",
)
FEATURE_ROW_COLUMNS = tuple(name for name, _ in _BASE) + _GROUPS


def candidate_id() -> Column:
    """Identity of a candidate: file, signature and start, which no two candidates share."""
    return F.concat_ws(":", "file_id", "sig_ord", "start_index")


def redact(text: Column, value: Column) -> Column:
    """Replace a value inside a text by its mask, and whatever else a signature matches by stars.

    The context window ends after WINDOW_SHOWN characters, so a long value may
    stand there as a head only; the text is then cut at that head.
    """
    whole = F.replace(text, value, mask(value))
    head = F.position(F.left(value, F.lit(C.MIN_VALUE_LENGTH)), whole)
    may_be_cut = F.length(value) > WINDOW_SHOWN - C.CONTEXT_WINDOW
    own = F.when(may_be_cut & (head > 0), F.concat(F.left(whole, head - 1), mask(value))).otherwise(whole)
    # Most texts have no run that a value could be; those are spared the search.
    return let(own, lambda t: F.when(t.rlike(C.VALUE_RUN) | t.contains("xox"), F.regexp_replace(t, C.ANY_VALUE, C.HIDDEN)).otherwise(t))


def redact_window(window: Column, value: Column) -> Column:
    """A redacted window, without long runs at its ends: they may be parts of values that it cuts."""
    return F.regexp_replace(redact(window, value), C.RUN_AT_AN_END, C.HIDDEN)


def redact_evidence(evidence: Column, value: Column) -> Column:
    """Redacted sentences; the one that quotes the window is treated like it."""
    quoted = C.WINDOW_SENTENCE

    def sentence(e: Column) -> Column:
        window = F.substring(e, len(quoted) + 1, F.length(e))
        return F.when(F.startswith(e, F.lit(quoted)), F.concat(F.lit(quoted), redact_window(window, value))).otherwise(redact(e, value))

    return F.transform(evidence, sentence)


def feature_rows(
    analyses: DataFrame, include_raw: bool = False, redacted: bool = True, keep: tuple[str, ...] = (),
    identified: bool = False,
) -> DataFrame:
    """The 50-column feature table of all candidates, approved or not.

    Unless ``redacted`` is off or raw values are asked for, no text column shows a
    value in clear, neither the row's own nor another. ``identified`` adds
    ``row_id``, which labelling, queue and training go by. ``keep`` names further
    columns to carry along; they stay as they are.
    """
    value = F.col("value")
    hide = redacted and not include_raw
    window = redact_window(F.col("context_window"), value) if hide else F.col("context_window")
    special = {
        "Masked Value": mask(value),
        "AST Node": F.coalesce(F.col("ast_node_type"), F.lit("")),
        "Associated Variable": F.coalesce(F.col("variable_name"), F.lit("")),
        "Classifier Confidence": F.round("confidence", 4),
        "context_window": window,
        "downstream_calls": F.col("downstream_calls_text"),
    }

    def shown(name: str, source: str | None) -> Column:
        column = special.get(name, F.col(source or name))
        return (redact(column, value) if hide and name in _FREE_TEXT else column).alias(name)

    columns = [shown(name, source) for name, source in (*_BASE, *((g, g) for g in _GROUPS))]
    if include_raw:
        columns.append(value.alias("Raw Value"))
    if identified:
        columns.append(candidate_id().alias("row_id"))
    return analyses.select(*columns, *keep)

"""Code context of a candidate: which name holds it, who uses it, near what.

Python context is looked up in the file's parsed facts, configuration and other
code in the tokens of the candidate's line; everything else gets the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.functions import paths
from keysieve.functions.assets import ASSET_TYPE, kinds, references
from keysieve.functions.reuse import built_once
from keysieve.functions.text import keep_present, let

_STRINGS = "array<string>"


def _no_strings() -> Column:
    return F.array().cast(_STRINGS)


def with_literal(candidates: DataFrame) -> DataFrame:
    """First string literal, in parse order, on the candidate's line and holding its value."""
    line, value = F.col("line_number"), F.col("value")
    literals = F.filter(
        F.col("py.facts.places"),
        lambda n: (n["start_line"] <= line) & (n["end_line"] >= line) & F.contains(n["value"], value),
    )
    return candidates.withColumn("literal", F.get(literals, F.lit(0)))


@built_once
def _usage_steps() -> tuple[dict[str, Column], ...]:
    """Columns of the usage slice in steps; a step may use the ones before."""
    line = F.col("line_number")
    variable = F.col("literal.variable")
    calls = F.when(
        variable.isNotNull() & (variable != "subscript"),
        F.filter(
            F.col("py.facts.calls"),
            lambda c: (c["call_line"] >= line) & F.array_contains(c["names_loaded"], variable),
        ),
    )
    scopes = F.filter(
        F.col("py.facts.scopes"), lambda s: (s["start_line"] <= line) & (s["end_line"] >= line)
    )
    used = F.flatten(F.transform(F.col("_calls"), lambda c: c["assets"]))
    around = F.when(F.col("_scope").isNotNull(), F.col("_scope.assets")).otherwise(
        F.col("py.file_assets")
    )
    names = F.array_compact(
        F.concat(
            F.array(F.col("literal.call_name")),
            F.coalesce(F.transform(F.col("_calls"), lambda c: c["call_name"]), _no_strings()),
        )
    )
    return (
        # The last scope in parse order is the innermost one.
        {"_calls": calls, "_scope": let(scopes, lambda s: F.get(s, F.size(s) - 1))},
        {"downstream_calls": F.array_distinct(names), "_used": F.coalesce(used, F.array().cast(ASSET_TYPE))},
        {"_assets": F.when(F.size("_used") > 0, F.col("_used")).otherwise(around)},
        {"asset_references": references(F.col("_assets")), "asset_kinds": kinds(F.col("_assets"))},
    )


def with_usage_slice(candidates: DataFrame) -> DataFrame:
    """Calls that use the literal's variable from its line on, and the assets they name.

    When no call names an asset, the innermost function or class around the
    line is read instead, and the whole file when there is none.
    """
    rows = candidates
    for columns in _usage_steps():
        rows = rows.withColumns(columns)
    return rows.drop("_calls", "_scope", "_used", "_assets")


def _quoted(before: str, value: Column, after: str) -> Column:
    """A sentence around a value; null when the value is."""
    return F.concat(F.lit(before), value, F.lit(after))


@built_once
def _context_columns() -> tuple[Column, ...]:
    """Context columns from ``language``, ``line_facts``, ``py`` and the looked-up literal."""
    kind = F.col("language")
    is_python = kind == "python"
    is_config = kind == "config"
    is_code = kind.isin(*C.LINE_TOKEN_LANGUAGES)
    parse_error = F.col("py.facts.parse_error")
    bound = is_python & F.col("literal").isNotNull()
    usage = F.coalesce(F.col("line_facts.usage"), F.lit(""))
    key = F.col("line_facts.config_key")
    name = F.col("line_facts.variable")
    call = F.col("line_facts.call")
    flow, refs = F.col("downstream_calls"), F.col("asset_references")
    # A file of a code language whose grammar is unknown stays with its family name.
    grammar = F.coalesce(paths.grammar(F.col("file_path")), kind)

    python_evidence = keep_present([
        _quoted("Candidate is inside Python AST node ", F.col("literal.node_type"), "."),
        _quoted("Associated assignment target is '", F.col("literal.variable"), "'."),
        _quoted("Candidate is used near call '", F.col("literal.call_name"), "'."),
        _quoted("Candidate is enclosed by function '", F.col("literal.enclosing_function"), "'."),
        F.when(
            F.size(flow) > 0,
            F.concat(
                F.lit("Data-flow slice links candidate to call(s): "),
                F.array_join(F.slice(flow, 1, 5), ", "),
            ),
        ),
        F.when(
            F.size(refs) > 0,
            F.concat(
                F.lit("Secret-asset association found near candidate: "),
                F.array_join(F.slice(refs, 1, 3), ", "),
            ),
        ),
    ])
    evidence = (
        F.when(bound, python_evidence)
        .when(is_python & parse_error.isNotNull(), _no_strings())
        .when(is_python, F.array(F.lit("Candidate was not attached to a Python string literal.")))
        .when(
            is_config,
            keep_present([_quoted("Candidate appears in configuration key '", key, "'.")]),
        )
        .when(
            is_code,
            keep_present([
                _quoted("Line tokens read with the naming rules of '", grammar, "'."),
                _quoted("Associated token from source line is '", name, "'."),
                _quoted("Candidate appears near call '", call, "'."),
            ]),
        )
        .otherwise(
            F.array(F.lit("No language-specific AST parser selected; using line-level context."))
        )
    )
    columns = (
        kind.alias("file_language"),
        F.when(is_code, grammar).otherwise(kind).alias("language"),
        F.when(is_python, F.lit("python-ast"))
        .when(is_config, F.lit("config-structural-parser"))
        .when(is_code, F.lit("line-token-parser"))
        .otherwise(F.lit("line-context"))
        .alias("parser_name"),
        F.when(bound, F.col("literal.node_type"))
        .when(is_python & parse_error.isNotNull(), F.lit(None))
        .when(is_python, F.lit("Module"))
        .when(is_config & key.isNotNull(), F.lit("ConfigProperty"))
        .when(is_config, F.lit("ConfigLine"))
        .otherwise(F.lit("Line"))
        .alias("ast_node_type"),
        F.when(bound, F.col("literal.parent_type"))
        .when(is_config, F.lit("ConfigurationFile"))
        .alias("parent_node_type"),
        F.when(is_python, F.col("literal.variable"))
        .when(is_config, key)
        .when(is_code, name)
        .alias("variable_name"),
        F.when(bound, F.col("literal.enclosing_function")).alias("enclosing_function"),
        F.when(bound, F.col("literal.call_name")).when(is_code, call).alias("call_name"),
        F.when(bound, flow).otherwise(_no_strings()).alias("downstream_calls"),
        F.when(bound, refs).otherwise(_no_strings()).alias("context_asset_references"),
        F.when(bound, F.col("asset_kinds")).otherwise(_no_strings()).alias("context_asset_kinds"),
        F.when(bound, F.coalesce(F.col("literal.usage"), usage)).otherwise(usage).alias("usage_context"),
        F.when(is_python, parse_error).alias("parse_error"),
        evidence.alias("context_evidence"),
    )
    return columns


def add_context(candidates: DataFrame) -> DataFrame:
    """Attach the context columns to recovered candidates."""
    rows = with_usage_slice(with_literal(candidates))
    kept = [c for c in candidates.columns if c not in ("py", "line_facts", "language")]
    return rows.select(*kept, *_context_columns())

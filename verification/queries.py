"""Registered queries: Spark callables and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.functions import paths
from keysieve.functions.assets import asset_matches, kinds, references
from keysieve.functions.text import line_at, mask, shannon_entropy
from keysieve.functions.lineage import new_path, stored
from keysieve.operators.chunks import read_chunks, recover_from_chunks
from keysieve.operators.context import add_context
from keysieve.operators.encode import encoded
from keysieve.operators.evaluate import evaluate
from keysieve.operators.features import add_features, feature_rows
from keysieve.operators.labeling import bootstrap_labels, bootstrap_summary, review_queue, suggested
from keysieve.operators.labels import labelled_rows, resolved_labels, with_label
from keysieve.operators.linear import LinearModel
from keysieve.operators.python_facts import python_facts
from keysieve.operators.recover import first_wins, recover_candidates
from keysieve.operators.report import build_findings, remaining_count, report_rows, top_findings
from keysieve.operators.routing import outcome, resolve_service, route_findings
from keysieve.operators.search import attach_content, pattern_hits
from keysieve.operators.supervised import approval_threshold, load_bundle, save_bundle, supervised_scorer
from keysieve.operators.training import class_weights, stratified_split, train
from keysieve.plans.triage import analyze, find, search, search_newest
from keysieve.sources.csv_ranges import read_csv_ranges
from keysieve.sources.readers import clean_patterns
from keysieve.sources.writers import land_by_address, write_features
from verification import oracle as O
from verification.driver_tables import NAME, VALUE, source_files, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def _analyses(spark: SparkSession, sf: str) -> DataFrame:
    return analyze(source_files(spark, sf))


# --- Findings -------------------------------------------------------------

_REPORT = f"""SELECT {O.hide('repository')} AS "Repository", {O.hide('path')} AS "File", {O.hide('url')} AS "URL",
  line_number AS "Line",
  {O.mask('value')} AS "Masked Value", provider AS "Secret Type", coalesce(ast_node_type, '') AS "AST Node",
  {O.hide("coalesce(variable_name, '')")} AS "Associated Variable",
  {O.hide("array_to_string(downstream_calls, ' | ')")} AS "Usage Calls",
  {O.hide("array_to_string(refs[1:5], ' | ')")} AS "Asset References", round(confidence, 4) AS "Confidence",
  round(risk_score, 4) AS "Risk Score", risk_level AS "Risk Level", 'heuristic-baseline-v1' AS "Model",
  array_to_string({O.hide_evidence('finding_evidence')}, ' | ') AS "Contextual Evidence",
  '' AS "Validation Details" FROM findings"""


@query("ranked_findings", O.chain("findings", _REPORT))
def ranked_findings(spark: SparkSession, sf: str) -> DataFrame:
    return report_rows(find(source_files(spark, sf)))


@query(
    "top_findings",
    O.chain(
        "findings",
        f"""SELECT risk_level AS "Risk", round(confidence, 4) AS "Confidence", provider AS "Type",
        {O.mask('value')} AS "Masked Value", path || ':' || line_number AS "Location",
        coalesce(ast_node_type, '') || ' / ' || coalesce(variable_name, '') AS "AST / Variable"
        FROM findings ORDER BY risk_score DESC, findings.confidence DESC, file_ord, sig_ord, start_index LIMIT 10""",
    ),
)
def top(spark: SparkSession, sf: str) -> DataFrame:
    return top_findings(build_findings(_analyses(spark, sf)))


@query("remaining_findings", O.chain("findings", "SELECT greatest(count(*) - 10, 0) AS remaining FROM findings"))
def remaining(spark: SparkSession, sf: str) -> DataFrame:
    return remaining_count(build_findings(_analyses(spark, sf)))


@query(
    "risk_scores",
    O.chain(
        "findings",
        "SELECT file_ord, sig_ord, start_index, provider AS secret_type, round(confidence, 6) AS confidence, "
        "round(risk_score, 6) AS risk_score, risk_level FROM findings",
    ),
)
def risk_scores(spark: SparkSession, sf: str) -> DataFrame:
    return build_findings(_analyses(spark, sf)).select(
        "file_ord", "sig_ord", "start_index", "secret_type", F.round("confidence", 6).alias("confidence"),
        F.round("risk_score", 6).alias("risk_score"), "risk_level",
    )


# --- Recovery ---------------------------------------------------------------


@query(
    "candidates",
    O.chain(
        "kept",
        "SELECT file_id, sig_ord, provider, tier AS signature_confidence, value, start_index, end_index, "
        "line_number, column_number, round(entropy, 4) AS entropy FROM kept",
    ),
)
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return recover_candidates(source_files(spark, sf)).select(
        "file_id", "sig_ord", "provider", "signature_confidence", "value", "start_index", "end_index",
        "line_number", "column_number", F.round("entropy", 4).alias("entropy"),
    )


@query(
    "first_candidates",
    O.chain("firsts", "SELECT file_id, sig_ord, provider, value, start_index, line_number FROM firsts"),
)
def first_candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = recover_candidates(source_files(spark, sf)).drop("py", "line_facts", "window")
    return first_wins(found).select("file_id", "sig_ord", "provider", "value", "start_index", "line_number")


# All contents in a few large text files, read in chunks: where a candidate stands in its line doesn't change.
@query(
    "chunked_candidates",
    O.chain("kept", "SELECT provider, value, column_number, count(*) AS n FROM kept GROUP BY provider, value, column_number"),
)
def chunked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark)
    source_files(spark, sf).select("content").where("content IS NOT NULL").write.text(path)
    found = recover_from_chunks(read_chunks(spark, path))
    return found.groupBy("provider", "value", F.col("column_number").cast("int").alias("column_number")).agg(F.count(F.lit(1)).alias("n"))


@query("text_entropy", f"SELECT doc_id, round({O.entropy('text')}, 6) AS entropy FROM documents")
def text_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select("doc_id", F.round(shannon_entropy(F.col("text")), 6).alias("entropy"))


@query(
    "path_facts",
    O.chain(
        "path_facts",
        "SELECT file_id, path, file_language AS language, grammar, doc_or_test, template_file FROM path_facts",
    ),
)
def path_facts(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    return source_files(spark, sf).select(
        "file_id", "path", paths.language(path).alias("language"), paths.grammar(path).alias("grammar"),
        paths.is_doc_or_test(path).alias("doc_or_test"), paths.is_template_file(path).alias("template_file"),
    )


@query(
    "raw_urls",
    "SELECT page_id, replace(replace(url, 'github.com', 'raw.githubusercontent.com'), '/blob/', '/') AS raw_url, "
    f"{O.mask('url')} AS masked FROM pages",
)
def raw_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", paths.raw_url(F.col("url")).alias("raw_url"), mask(F.col("url")).alias("masked")
    )


@query(
    "line_texts",
    f"""SELECT doc_id, coalesce(string_split_regex(text, {O.text(O.LINE_BREAK)})[CAST(doc_id % 7 + 1 AS INTEGER)], '')
    AS line FROM documents""",
)
def line_texts(spark: SparkSession, sf: str) -> DataFrame:
    number = (F.col("doc_id") % 7 + 1).cast("int")
    return spread(table(spark, sf, "documents")).select("doc_id", line_at(F.col("text"), number).alias("line"))


@query(
    "asset_references",
    f"""SELECT file_id, {O.ordered_distinct('r')} AS refs, {O.ordered_distinct('k')} AS kinds FROM (
      SELECT file_id, list_transform(a, lambda x: x.reference) AS r, list_transform(a, lambda x: x.kind) AS k FROM (
        SELECT file_id, {O.asset_list('content')} AS a FROM ({O.D.SOURCE_FILES}) f) g) h""",
)
def asset_references(spark: SparkSession, sf: str) -> DataFrame:
    found = source_files(spark, sf).select("file_id", asset_matches(F.col("content")).alias("a"))
    return found.select("file_id", references(F.col("a")).alias("refs"), kinds(F.col("a")).alias("kinds"))


# --- Context and features -----------------------------------------------------

# What the Python files hold is known from how they are made.
_PY = f"""py AS (
  SELECT doc_id * 2 AS file_id, text, source, {VALUE} AS planted, {NAME} AS name,
    CASE WHEN doc_id % 8 = 0 THEN 'assigned' WHEN doc_id % 40 = 3 THEN 'broken' ELSE 'argument' END AS made
  FROM documents WHERE doc_id % 8 IN (0, 3))"""


def _python_facts(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    python = source_files(spark, sf).where(paths.language(F.col("path")) == "python")
    facts = python.select("file_id", python_facts(F.col("content")).alias("facts"))
    return facts.select("file_id", F.explode(f"facts.{kind}").alias("f")).select("file_id", "f.*")


@query(
    "python_literals",
    f"""WITH {_PY} SELECT file_id, CAST(CASE made WHEN 'assigned' THEN 2 ELSE 3 END AS INTEGER) AS start_line,
      CAST(CASE made WHEN 'assigned' THEN 2 ELSE 3 END AS INTEGER) AS end_line, planted AS value,
      'Constant' AS node_type, CASE made WHEN 'assigned' THEN 'Assign' ELSE 'keyword' END AS parent_type,
      name AS variable, CASE made WHEN 'argument' THEN 'test_login' END AS enclosing_function,
      CASE made WHEN 'argument' THEN 'connect_client' END AS call_name,
      CASE made WHEN 'assigned' THEN name || ' = "' ELSE name || '="' END || planted || '"' AS usage
    FROM py WHERE made <> 'broken'
    UNION ALL
    SELECT file_id, 4, CAST(4 + length(text) - length(replace(text, chr(10), '')) AS INTEGER), text, 'Constant',
      'Assign', 'NOTES', NULL, NULL,
      left({O.strip(
        "'NOTES = ' || chr(34) || chr(34) || chr(34) || replace(replace(text, chr(92), chr(92) || chr(92)), chr(34), "
        "chr(92) || chr(34)) || chr(34) || chr(34) || chr(34)"
      )}, 240)
    FROM py WHERE made <> 'broken' AND regexp_matches(text, '[A-Za-z0-9_-]{{16}}')""",
)
def python_literals(spark: SparkSession, sf: str) -> DataFrame:
    return _python_facts(spark, sf, "literals").drop("node_ord")


@query(
    "python_calls",
    f"""WITH {_PY} SELECT file_id, CAST(3 AS INTEGER) AS call_line, c.call_name, [name] AS names_loaded,
      CASE c.call_name WHEN 'dict' THEN 'dict(key=' || name || ')'
        ELSE 'requests.get("https://api.' || source || '.example.com/v1", params=dict(key=' || name || '))' END AS source
    FROM py, (VALUES ('requests.get'), ('dict')) c(call_name) WHERE made = 'assigned'""",
)
def python_calls(spark: SparkSession, sf: str) -> DataFrame:
    return _python_facts(spark, sf, "calls").drop("node_ord")


@query(
    "python_scopes",
    f"""WITH {_PY}, bodies AS (
      SELECT file_id, '    def test_login(self):' || chr(10) || '        connect_client(' || name || '="' || planted
        || '")' AS body FROM py WHERE made = 'argument')
    SELECT file_id, CAST(1 AS INTEGER) AS start_line, CAST(3 AS INTEGER) AS end_line,
      'class TestKeys:' || chr(10) || body AS source FROM bodies
    UNION ALL SELECT file_id, 2, 3, ltrim(body) FROM bodies""",
)
def python_scopes(spark: SparkSession, sf: str) -> DataFrame:
    return _python_facts(spark, sf, "scopes").drop("node_ord")


@query(
    "python_parse_errors",
    f"WITH {_PY} SELECT file_id, 'SyntaxError: invalid syntax' AS parse_error FROM py WHERE made = 'broken'",
)
def python_parse_errors(spark: SparkSession, sf: str) -> DataFrame:
    python = source_files(spark, sf).where(paths.language(F.col("path")) == "python")
    facts = python.select("file_id", python_facts(F.col("content")).alias("facts"))
    return facts.select("file_id", F.col("facts.parse_error").alias("parse_error")).where("parse_error IS NOT NULL")


_CONTEXT_COLUMNS = (
    "file_id", "sig_ord", "start_index", "language", "parser_name", "ast_node_type", "parent_node_type",
    "variable_name", "enclosing_function", "call_name", "downstream_calls", "usage_context", "parse_error",
)


@query(
    "code_context",
    O.chain(
        "explained",
        f"SELECT {', '.join(_CONTEXT_COLUMNS)}, context_references, context_kinds, context_evidence FROM explained",
    ),
)
def code_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = first_wins(add_context(recover_candidates(source_files(spark, sf))))
    return rows.select(
        *_CONTEXT_COLUMNS,
        F.col("context_asset_references").alias("context_references"),
        F.col("context_asset_kinds").alias("context_kinds"),
        "context_evidence",
    )


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return first_wins(add_features(add_context(recover_candidates(source_files(spark, sf)))))


_KEY = "file_id, sig_ord, start_index"
_STATISTICAL = ("length", "digit_ratio", "alpha_ratio", "symbol_ratio", "is_hex", "is_uuid_like")
_SYNTACTIC = (
    "has_ast_context", "has_variable_name", "variable_name", "variable_is_sensitive", "call_name",
    "call_is_auth_related", "downstream_call_count", "has_downstream_usage", "downstream_calls_text",
    "is_assignment_context", "parse_error",
)
_CONTEXTUAL = (
    "context_window", "has_secret_term_nearby", "nearest_secret_term_distance", "has_hash_or_identifier_term",
    "has_placeholder_signal", "has_template_language", "is_weak_documentation_context",
)
_ASSETS = (
    "has_asset_reference", "asset_reference_count", "asset_kinds", "asset_references", "has_database_asset",
    "has_url_asset", "has_host_asset",
)


@query(
    "statistical_features",
    O.chain("features", f"SELECT {_KEY}, entropy_4 AS entropy, {', '.join(_STATISTICAL)} FROM features"),
)
def statistical_features(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("file_id", "sig_ord", "start_index", "entropy", *_STATISTICAL)


@query(
    "syntactic_features",
    O.chain(
        "features",
        f"SELECT {_KEY}, node_text AS ast_node_type, parent_text AS parent_node_type, {', '.join(_SYNTACTIC)} "
        "FROM features",
    ),
)
def syntactic_features(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select(
        "file_id", "sig_ord", "start_index", "ast_node_type", "parent_node_type", *_SYNTACTIC
    )


@query(
    "contextual_features",
    O.chain(
        "features",
        f"SELECT {_KEY}, template_file AS is_template_file, doc_or_test AS is_documentation_or_test_path, "
        f"{', '.join(_CONTEXTUAL)} FROM features",
    ),
)
def contextual_features(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select(
        "file_id", "sig_ord", "start_index", "is_template_file", "is_documentation_or_test_path", *_CONTEXTUAL
    )


@query("asset_features", O.chain("features", f"SELECT {_KEY}, {', '.join(_ASSETS)} FROM features"))
def asset_features(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("file_id", "sig_ord", "start_index", *_ASSETS)


# The feature row in SQL; later queries build on it.
FEATURE_ROW = f"""SELECT {O.hide('repository')} AS "Repository", {O.hide('path')} AS "File", {O.hide('url')} AS "URL",
  line_number AS "Line",
  {O.mask('value')} AS "Masked Value", provider AS "Secret Type", node_text AS "AST Node",
  {O.hide("coalesce(variable_name, '')")} AS "Associated Variable", label AS "Classifier Label",
  round(confidence, 4) AS "Classifier Confidence",
  length, entropy_4 AS entropy, digit_ratio, alpha_ratio, symbol_ratio, is_hex, is_uuid_like,
  has_ast_context, has_variable_name, {O.hide('variable_name')} AS variable_name, variable_is_sensitive,
  {O.hide('call_name')} AS call_name, call_is_auth_related,
  downstream_call_count, has_downstream_usage, {O.hide('downstream_calls_text')} AS downstream_calls,
  node_text AS ast_node_type, parent_text AS parent_node_type, is_assignment_context,
  {O.hide('parse_error')} AS parse_error,
  {O.hide_window('context_window')} AS context_window, has_secret_term_nearby,
  nearest_secret_term_distance, has_hash_or_identifier_term, has_placeholder_signal, has_template_language,
  template_file AS is_template_file, doc_or_test AS is_documentation_or_test_path, is_weak_documentation_context,
  {', '.join(f"{O.hide(c)} AS {c}" if c == 'asset_references' else c for c in _ASSETS)}, provider,
  tier AS signature_confidence, {O.hide('path')} AS file_path, language FROM decided"""


@query("feature_rows", O.chain("decided", FEATURE_ROW))
def all_feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    return feature_rows(_analyses(spark, sf))


# The feature table written as CSV and read back by byte ranges: values with line breaks and quotes included.
@query(
    "feature_csv",
    f"""SELECT "File", CAST("Line" AS VARCHAR) AS "Line", "Masked Value", "Secret Type", coalesce("Associated Variable", '') AS variable,
      coalesce(context_window, '') AS context_window, coalesce(downstream_calls, '') AS calls, coalesce(asset_references, '') AS assets,
      CAST(length AS VARCHAR) AS length, count(*) AS n
    FROM ({O.chain('decided', FEATURE_ROW)}) f GROUP BY ALL""",
)
def feature_csv(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_csv_ranges(spark, write_features(feature_rows(_analyses(spark, sf)), new_path(spark), format="csv"))
    shown = [
        "File", "Line", "Masked Value", "Secret Type", F.col("Associated Variable").alias("variable"), "context_window",
        F.col("downstream_calls").alias("calls"), F.col("asset_references").alias("assets"), "length",
    ]
    return rows.select(*shown).groupBy("File", "Line", "Masked Value", "Secret Type", "variable", "context_window", "calls", "assets", "length").agg(
        F.count(F.lit(1)).alias("n"))


@query(
    "baseline_scores",
    O.chain(
        "decided",
        f"SELECT {_KEY}, label, approved, round(confidence, 6) AS confidence, round(raw_score, 6) + 0.0 AS raw_score, "
        "reasons, confidence >= 0.82::DOUBLE AS may_validate FROM decided",
    ),
)
def baseline_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _analyses(spark, sf).select(
        "file_id", "sig_ord", "start_index", "label", "approved", F.round("confidence", 6).alias("confidence"),
        (F.round("raw_score", 6) + F.lit(0.0)).alias("raw_score"), "reasons",
        (F.col("confidence") >= C.VALIDATION_THRESHOLD).alias("may_validate"),
    )


@query("evidence", O.chain("findings", f"SELECT {_KEY}, finding_evidence AS evidence FROM findings"))
def evidence(spark: SparkSession, sf: str) -> DataFrame:
    from keysieve.operators.report import approved_only, finding_evidence

    return approved_only(_analyses(spark, sf)).select(
        "file_id", "sig_ord", "start_index", finding_evidence().alias("evidence")
    )


# --- Search -------------------------------------------------------------------

_PATTERNS = [p for name in ("shodan", "openai", "scrapingbee") for p in C.SEARCH_PATTERNS[name]]
_PATTERN_VALUES = ", ".join(f"({i}, {O.text(p)})" for i, p in enumerate(_PATTERNS))
_HITS = f"""patterns(pattern_ord, pattern) AS (VALUES {_PATTERN_VALUES}),
found AS (
  SELECT p.pattern_ord, p.pattern, f.* FROM src f JOIN patterns p ON contains(lower(f.content), lower(p.pattern))),
top_hits AS (SELECT *, CAST((pattern_ord + 1) * 1099511627776 - file_ord AS BIGINT) AS hit_ord FROM found),
raw_hits AS (
  SELECT repository AS "Repository", path AS "File Path", url AS "URL", pattern AS "Pattern Source",
    replace(replace(url, 'github.com', 'raw.githubusercontent.com'), '/blob/', '/') AS "Raw URL", hit_ord
  FROM top_hits)"""
_NEWEST = _HITS.replace(
    "SELECT *, CAST((pattern_ord + 1) * 1099511627776 - file_ord AS BIGINT) AS hit_ord FROM found",
    """SELECT *, CAST(pattern_ord * 100 + hit_rank AS BIGINT) AS hit_ord FROM (
    SELECT *, row_number() OVER (PARTITION BY pattern_ord ORDER BY file_ord DESC, file_id) AS hit_rank FROM found) r
  WHERE hit_rank <= 100""",
)


def _patterns(spark: SparkSession) -> DataFrame:
    return clean_patterns(
        spark.createDataFrame([(i, p) for i, p in enumerate(_PATTERNS)], "pattern_ord int, pattern string")
    )


def _raw_hits(spark: SparkSession, sf: str) -> DataFrame:
    return search(source_files(spark, sf), _patterns(spark))


def _attached(spark: SparkSession, sf: str) -> DataFrame:
    """Hits on files that were landed by address, attached where they lie."""
    landed = land_by_address(source_files(spark, sf), new_path(spark))
    return attach_content(search(landed, _patterns(spark)), landed)


@query(
    "pattern_file_hits",
    f"WITH {O.SRC}, {_HITS.split('top_hits AS')[0].rstrip().rstrip(',')} "
    "SELECT pattern_ord, pattern, file_id FROM found",
)
def pattern_file_hits(spark: SparkSession, sf: str) -> DataFrame:
    return pattern_hits(source_files(spark, sf), _patterns(spark)).select("pattern_ord", "pattern", "file_id")


@query("raw_hits", f"WITH {O.SRC}, {_HITS} SELECT * FROM raw_hits")
def raw_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _raw_hits(spark, sf)


@query("newest_hits", f"WITH {O.SRC}, {_NEWEST} SELECT * FROM raw_hits")
def newest_hits(spark: SparkSession, sf: str) -> DataFrame:
    return search_newest(source_files(spark, sf), _patterns(spark))


_ATTACHED = f"""{_HITS}, attached AS (
  SELECT h.hit_ord AS file_id, h.hit_ord AS file_ord, h."Repository" AS repository, h."File Path" AS path,
    h."URL" AS url, h."Raw URL" AS raw_url, s.content, h."Pattern Source" AS pattern_source,
    CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS kind
  FROM raw_hits h JOIN src s ON s.raw_url = h."Raw URL" WHERE h."Raw URL" <> '')"""


@query(
    "attached_sources",
    f"WITH {O.SRC}, {_ATTACHED} SELECT file_id, repository, path, pattern_source, length(content) AS chars, "
    "md5(content) AS digest FROM attached",
)
def attached_sources(spark: SparkSession, sf: str) -> DataFrame:
    return _attached(spark, sf).select(
        "file_id", "repository", "path", "pattern_source", F.length("content").cast("long").alias("chars"),
        F.md5("content").alias("digest"),
    )


# Files hit by several patterns come in several times; the first hit keeps the finding.
@query(
    "first_wins_over_hits",
    f"WITH {O.SRC}, {_ATTACHED}, {O.hits_cte('attached')}, "
    f"{O.CAND.replace('JOIN src s', 'JOIN attached s').replace('s.repository', 's.pattern_source, s.repository')}, "
    f"{O.FIRST} SELECT file_id, pattern_source, path, provider, value, line_number FROM firsts",
)
def first_wins_over_hits(spark: SparkSession, sf: str) -> DataFrame:
    found = recover_candidates(_attached(spark, sf)).drop("py", "line_facts", "window")
    return first_wins(found).select(
        "file_id", "pattern_source", F.col("file_path").alias("path"), "provider", "value", "line_number"
    )


# --- Model inputs and thresholds ---------------------------------------------


def _sql_number(name: str) -> str:
    return f"CAST({name} AS DOUBLE)"


def _encoded_sql(name: str) -> str:
    tiers = " ".join(f"WHEN {O.text(t)} THEN {v}" for t, v in C.TIER_SCORES)
    special = {
        "entropy": "entropy_4",
        "signature_confidence_score": f"CASE tier {tiers} ELSE 0 END",
        "provider_is_generic": "starts_with(lower(provider), 'generic')",
        "provider_is_critical_type": O.any_of("lower(provider)", C.CRITICAL_PROVIDER_TERMS),
        "secret_term_proximity_score":
            "coalesce(greatest(0, 1 - least(nearest_secret_term_distance::DOUBLE, 120::DOUBLE) / 120::DOUBLE), 0)",
        "language_is_python": "language = 'python'",
        "language_is_config": "language = 'config'",
        "language_is_documentation": "language = 'documentation'",
        "parse_error_present": "parse_error IS NOT NULL",
        "is_template_file": "template_file",
        "is_documentation_or_test_path": "doc_or_test",
    }
    return _sql_number(special.get(name, name))


@query(
    "encoded_features",
    O.chain(
        "decided",
        f"SELECT {_KEY}, " + ", ".join(f"round({_encoded_sql(n)}, 6) AS {n}" for n in C.FEATURE_ORDER) + " FROM decided",
    ),
)
def encoded_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = _features(spark, sf)
    return rows.select(
        "file_id", "sig_ord", "start_index",
        *[F.round(column, 6).alias(name) for name, column in encoded(rows).items()],
    )


_GENERIC = "(starts_with(provider, 'Generic') OR provider = 'UUID-like Secret')"
_BOUND = "(variable_is_sensitive OR has_secret_term_nearby)"
_THRESHOLD = f"""CASE
  WHEN NOT {_GENERIC} THEN 0.62
  WHEN provider = 'UUID-like Secret' AND {O.any_of('lower(context_window)', C.OPERATIONAL_UUID_TERMS)} THEN 0.995
  WHEN has_placeholder_signal OR has_template_language OR has_hash_or_identifier_term THEN 0.995
  WHEN contains(lower(path), 'reconx/keys.md') OR doc_or_test THEN 0.995
  WHEN is_assignment_context AND ({_BOUND} OR has_asset_reference) THEN 0.90
  WHEN {_BOUND} AND has_asset_reference THEN 0.94 ELSE 0.995 END::DOUBLE"""


@query("approval_thresholds", O.chain("decided", f"SELECT {_KEY}, {_THRESHOLD} AS threshold FROM decided"))
def approval_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    rows = _features(spark, sf)
    return rows.select("file_id", "sig_ord", "start_index", approval_threshold(rows).alias("threshold"))


# --- Routes and gate -----------------------------------------------------------

_PASSIVE = O.one_of("lower(provider)", C.PASSIVE_TYPES)
_ROUTE = f"""CASE WHEN {_PASSIVE} THEN 'passive' WHEN contains(lower(provider), 'shodan') THEN 'shodan'
  WHEN contains(lower(provider), 'google') THEN 'google' WHEN contains(lower(provider), 'scrapingbee') THEN 'scrapingbee'
  ELSE 'generic' END"""
_DETAILS = f"""CASE {_ROUTE} WHEN 'passive' THEN {O.text(C.PASSIVE_DETAILS[0])} || provider || {O.text(C.PASSIVE_DETAILS[1])}
  WHEN 'generic' THEN CASE WHEN length(value) > 20 THEN {O.text(C.GENERIC_LONG_DETAILS)}
    ELSE {O.text(C.GENERIC_SHORT_DETAILS)} END ELSE '' END"""
_STATUS = f"""CASE {_ROUTE} WHEN 'passive' THEN 'skipped' WHEN 'generic' THEN 'unsupported'
  ELSE 'external_check_required' END"""


@query(
    "check_routes",
    O.chain(
        "decided",
        f"SELECT {_KEY}, {_ROUTE} AS service, {_DETAILS} AS details, {_STATUS} AS status, false AS valid FROM decided",
    ),
)
def check_routes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _features(spark, sf).withColumn("service", resolve_service(F.col("provider")))
    rows = rows.withColumn("outcome", outcome(F.col("service"), F.col("value"), F.col("provider")))
    return rows.select("file_id", "sig_ord", "start_index", "service", "outcome.*")


@query(
    "validation_gate",
    O.chain(
        "findings",
        f"SELECT file_ord, sig_ord, start_index, {_ROUTE} AS service, false AS valid, {_STATUS} AS status, "
        f"CASE WHEN {_DETAILS} <> '' THEN {_ROUTE} || ': ' || {_DETAILS} END AS validation_details "
        "FROM findings WHERE findings.confidence >= 0.82::DOUBLE",
    ),
)
def validation_gate(spark: SparkSession, sf: str) -> DataFrame:
    return route_findings(build_findings(_analyses(spark, sf))).select(
        "file_ord", "sig_ord", "start_index", "service", "valid", "status", "validation_details"
    )


# --- Labels ---------------------------------------------------------------------

# Feature rows joined with the truth table. Of the low-quality documents the toxic
# ones act as seed positives and the others as seed negatives; the rest is open.
_SEEDED = O.chain(
    "decided",
    f"""SELECT concat_ws(':', file_id, sig_ord, start_index) AS row_id, l.real_secret, l.false_positive, f.*
    FROM (SELECT file_id, sig_ord, start_index, {FEATURE_ROW.removeprefix('SELECT ')}) f LEFT JOIN (
      SELECT doc_id * 2 AS label_id, CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END AS real_secret,
        CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END AS false_positive FROM labels) l
    ON l.label_id = f.file_id""",
)


def _seeded(spark: SparkSession, sf: str) -> DataFrame:
    named = feature_rows(_analyses(spark, sf), keep=("file_id",), identified=True)
    truth = table(spark, sf, "labels").select(
        (F.col("doc_id") * 2).alias("file_id"),
        F.when((F.col("quality") == 0) & (F.col("toxic") == 1), 1).otherwise(0).alias("real_secret"),
        F.when((F.col("quality") == 0) & (F.col("toxic") == 0), 1).otherwise(0).alias("false_positive"),
    )
    return named.join(truth, "file_id", "left").drop("file_id")


_FLAGS = f"""flags AS (
  SELECT *, lower(context_window) AS win, lower("File") AS low_path,
    CASE WHEN real_secret = 1 AND false_positive <> 1 THEN 'real_secret'
         WHEN false_positive = 1 AND real_secret <> 1 THEN 'false_positive' END AS known FROM seeded),
flagged AS (
  SELECT *, is_documentation_or_test_path OR {O.any_of('low_path', C.DOC_PATH_HINTS)} AS doc,
    {O.any_of('low_path', C.CODE_PATH_HINTS)} OR {O.one_of('lower(language)', C.CODE_LANGUAGES)} AS code,
    has_placeholder_signal OR has_template_language AS placeholder,
    {O.any_of('win', C.REALISTIC_TERMS)} AS realistic,
    has_hash_or_identifier_term OR {O.any_of('win', C.HASH_NOISE_TERMS)} AS hashy,
    {O.any_of('win', C.EXPLICIT_PLACEHOLDER_TERMS)} AS explicit_placeholder,
    {O.one_of('"Secret Type"', C.PROVIDER_SPECIFIC_TYPES)} AS specific,
    {O.one_of('"Secret Type"', C.GENERIC_TYPES)} AS g,
    regexp_matches("Associated Variable", '(?i)' || {O.text(C.SENSITIVE_NAME_REGEX)})
      OR regexp_matches(win, '(?i)' || {O.text(C.SENSITIVE_BINDING_REGEX)}) AS binding,
    contains(low_path, 'reconx/keys.md') AS dump,
    "Secret Type" = 'UUID-like Secret' AND {O.any_of('win', C.OPERATIONAL_ID_TERMS)} AS operational,
    contains(win, 'fake_key') OR contains(win, 'false_key') AS fake
  FROM flags),
summed AS (
  SELECT *, (((((CASE WHEN specific THEN 0.75::DOUBLE ELSE 0 END + CASE WHEN realistic THEN 0.30::DOUBLE ELSE 0 END)
      + CASE WHEN code THEN 0.20::DOUBLE ELSE 0 END) + CASE WHEN has_asset_reference THEN 0.10::DOUBLE ELSE 0 END)
      + least("Classifier Confidence", 0.60::DOUBLE))
      + CASE WHEN g AND code AND (binding OR variable_is_sensitive) AND "Classifier Confidence" >= 0.30::DOUBLE
             THEN 0.20::DOUBLE ELSE 0 END) AS pos,
    ((((((CASE WHEN placeholder OR explicit_placeholder THEN 0.90::DOUBLE ELSE 0 END
      + CASE WHEN hashy THEN 0.45::DOUBLE ELSE 0 END)
      + CASE WHEN doc AND NOT realistic AND NOT has_asset_reference THEN 0.30::DOUBLE ELSE 0 END)
      + CASE WHEN fake THEN 0.60::DOUBLE ELSE 0 END) + CASE WHEN g AND doc THEN 0.40::DOUBLE ELSE 0 END)
      + CASE WHEN g AND dump THEN 0.25::DOUBLE ELSE 0 END)
      + CASE WHEN operational THEN 0.95::DOUBLE ELSE 0 END) AS neg
  FROM flagged),
ruled AS (
  SELECT *, pos - neg AS score, CASE
    WHEN g AND operational THEN 'operational_ids'
    WHEN neg >= 0.80::DOUBLE THEN 'docs_placeholders'
    WHEN g AND dump THEN CASE WHEN realistic AND NOT placeholder AND NOT hashy
      THEN 'near_miss_high_confidence' ELSE 'low_priority_noise' END
    WHEN g AND doc THEN CASE WHEN realistic AND binding AND NOT placeholder AND NOT hashy
      THEN 'near_miss_high_confidence' ELSE 'low_priority_noise' END
    WHEN g AND NOT code THEN CASE WHEN realistic AND binding AND NOT hashy
      THEN 'near_miss_high_confidence' ELSE 'low_priority_noise' END
    WHEN g AND NOT (binding OR variable_is_sensitive OR is_assignment_context) THEN CASE WHEN pos - neg >= 0.80::DOUBLE
      THEN 'near_miss_high_confidence' ELSE 'low_priority_noise' END
    WHEN pos - neg >= 0.95::DOUBLE THEN CASE WHEN code THEN 'code_config_real_key' ELSE 'docs_real_keys' END
    WHEN pos - neg >= 0.70::DOUBLE THEN 'near_miss_high_confidence' ELSE 'low_priority_noise' END AS bucket
  FROM summed),
sorted_out AS (
  SELECT *, CASE bucket WHEN 'near_miss_high_confidence' THEN 'review'
      WHEN 'code_config_real_key' THEN 'real_secret' WHEN 'docs_real_keys' THEN 'real_secret'
      ELSE 'false_positive' END AS suggestion FROM ruled),
quota AS (
  SELECT count(*) FILTER (known = 'real_secret') AS existing,
    count(*) FILTER (known IS DISTINCT FROM 'real_secret' AND suggestion = 'real_secret') AS open_real FROM sorted_out),
first_round AS (
  SELECT row_id FROM sorted_out WHERE known IS DISTINCT FROM 'real_secret' AND suggestion = 'real_secret'
  ORDER BY score DESC, row_id LIMIT (SELECT greatest(0, 25 - existing) FROM quota)),
second_round AS (
  SELECT row_id FROM sorted_out WHERE known IS DISTINCT FROM 'real_secret' AND bucket = 'near_miss_high_confidence'
  ORDER BY score DESC, row_id
  LIMIT (SELECT greatest(0, 25 - existing - least(open_real, greatest(0, 25 - existing))) FROM quota)),
placed AS (
  SELECT *, CASE WHEN row_id IN (SELECT row_id FROM first_round) THEN 'bootstrap_positive'
      WHEN row_id IN (SELECT row_id FROM second_round) THEN 'bootstrap_near_miss_positive'
      WHEN known = 'real_secret' THEN 'manual_seed'
      WHEN suggestion = 'false_positive' THEN 'bootstrap_negative'
      WHEN bucket = 'near_miss_high_confidence' THEN 'needs_review' ELSE '' END AS src_label FROM sorted_out),
labelled AS (
  SELECT row_id, "File", "Secret Type", suggestion AS suggested_label, bucket AS review_bucket,
    round(score, 4) + 0.0 AS review_score,
    CASE WHEN bucket IN ('code_config_real_key', 'docs_real_keys') THEN 1
         WHEN bucket = 'near_miss_high_confidence' THEN 2 ELSE 4 END AS review_priority,
    src_label AS label_source,
    CASE WHEN src_label IN ('bootstrap_positive', 'bootstrap_near_miss_positive') THEN 1
         WHEN src_label = 'bootstrap_negative' THEN 0 WHEN src_label = 'needs_review' THEN NULL
         ELSE real_secret END AS real_secret,
    CASE WHEN src_label IN ('bootstrap_positive', 'bootstrap_near_miss_positive') THEN 0
         WHEN src_label = 'bootstrap_negative' THEN 1 WHEN src_label = 'needs_review' THEN NULL
         ELSE false_positive END AS false_positive,
    CASE WHEN src_label IN ('bootstrap_positive', 'bootstrap_near_miss_positive', 'manual_seed') THEN 'real_secret'
         WHEN src_label = 'bootstrap_negative' THEN 'false_positive' WHEN src_label = 'needs_review' THEN ''
         ELSE coalesce(known, '') END AS label, known
  FROM placed)"""


def _label_sql(select: str) -> str:
    return f"WITH seeded AS ({_SEEDED}), {_FLAGS} {select}"


_LABEL_COLUMNS = (
    "row_id", "File", "Secret Type", "suggested_label", "review_bucket", "review_score", "review_priority",
    "label_source", "real_secret", "false_positive", "label",
)


def _label_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        *[
            (F.col(c) + F.lit(0.0)).alias(c) if c == "review_score" else F.col(c)
            for c in _LABEL_COLUMNS
        ]
    )


@query(
    "review_buckets",
    _label_sql(
        "SELECT row_id, suggestion AS suggested_label, bucket AS review_bucket, round(score, 4) + 0.0 AS review_score "
        "FROM sorted_out"
    ),
)
def review_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return suggested(_seeded(spark, sf)).select(
        "row_id", "suggested_label", "review_bucket", (F.col("review_score") + F.lit(0.0)).alias("review_score")
    )


_LABEL_SELECT = ", ".join(f'"{c}"' for c in _LABEL_COLUMNS)


@query("bootstrap_labels", _label_sql(f"SELECT {_LABEL_SELECT} FROM labelled"))
def bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return _label_columns(bootstrap_labels(_seeded(spark, sf)))


@query(
    "bootstrap_summary",
    _label_sql(
        """SELECT CAST(count(*) AS BIGINT) AS rows, count(*) FILTER (known = 'real_secret') AS existing_positive_rows,
        count(*) FILTER (label_source IN ('bootstrap_positive', 'bootstrap_near_miss_positive')) AS promoted_positive_rows,
        count(*) FILTER (real_secret = 1) AS final_positive_rows FROM labelled"""
    ),
)
def summary(spark: SparkSession, sf: str) -> DataFrame:
    return bootstrap_summary(bootstrap_labels(_seeded(spark, sf))).drop("review_buckets")


@query(
    "bucket_counts",
    _label_sql("SELECT review_bucket, count(*) AS n FROM labelled GROUP BY review_bucket"),
)
def bucket_counts(spark: SparkSession, sf: str) -> DataFrame:
    row = bootstrap_summary(bootstrap_labels(_seeded(spark, sf)))
    return row.select(F.explode("review_buckets").alias("review_bucket", "n"))


@query(
    "review_queue",
    _label_sql(
        f"SELECT {_LABEL_SELECT} FROM labelled WHERE label_source = 'needs_review' "
        "ORDER BY review_priority, review_score DESC, row_id LIMIT 80"
    ),
)
def queue(spark: SparkSession, sf: str) -> DataFrame:
    return _label_columns(review_queue(bootstrap_labels(_seeded(spark, sf))))


# --- Training and evaluation ------------------------------------------------------

# A label in text form for every document file: spelled, blank or under review.
_TEXT_LABEL = """CASE WHEN quality = 1 AND toxic = 1 THEN 'review' WHEN quality = 1 THEN ' Real_Secret '
  WHEN quality = 0 THEN 'FP' END"""
_TRUTH = f"SELECT doc_id * 2 AS file_id, {_TEXT_LABEL} AS label FROM labels"


def _with_truth(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    truth = table(spark, sf, "labels").selectExpr("doc_id * 2 AS file_id", f"{_TEXT_LABEL} AS label")
    return rows.join(truth, "file_id", "left").withColumn("label", F.coalesce("label", F.lit("")))


def _labelled_features(spark: SparkSession, sf: str) -> DataFrame:
    named = feature_rows(_analyses(spark, sf), keep=("file_id",), identified=True)
    return _with_truth(spark, sf, named)


_Y = "CASE WHEN lower(trim(t.label)) = 'real_secret' THEN 1 WHEN lower(trim(t.label)) = 'fp' THEN 0 END"
_LABELLED = f"""labelled_features AS (SELECT d.*, {_Y} AS y FROM decided d LEFT JOIN ({_TRUTH}) t USING (file_id))"""


@query(
    "label_values",
    f"SELECT doc_id, CASE WHEN lower(trim(label)) = 'real_secret' THEN 1 ELSE 0 END AS resolved, "
    "CASE WHEN lower(trim(label)) = 'real_secret' THEN 1 WHEN lower(trim(label)) = 'fp' THEN 0 END AS usable "
    f"FROM (SELECT doc_id, {_TEXT_LABEL} AS label FROM labels) t",
)
def label_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").selectExpr("doc_id", f"{_TEXT_LABEL} AS label")
    resolved = resolved_labels(rows).withColumnRenamed("y", "resolved")
    return with_label(resolved).select("doc_id", "resolved", F.col("y").alias("usable"))


@query(
    "one_hot_labels",
    "SELECT doc_id, quality AS y FROM labels WHERE quality IN (0, 1)",
)
def one_hot_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").selectExpr(
        "doc_id", "quality AS real_secret", "1 - quality AS false_positive"
    )
    return labelled_rows(rows).select("doc_id", "y")


@query(
    "class_weights",
    "SELECT doc_id, quality AS y, round(t.n / (2.0 * c.k), 6) AS weight FROM labels "
    "JOIN (SELECT quality, count(*)::DOUBLE AS k FROM labels GROUP BY quality) c USING (quality) "
    "CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM labels) t",
)
def weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").selectExpr("doc_id", "quality AS y")
    return class_weights(rows).select("doc_id", "y", F.round("weight", 6).alias("weight"))


_SPLIT = f"""bucketed AS (
  SELECT doc_id, quality AS y, ('0x' || substr(md5(doc_id || ':{C.SPLIT_SEED}'), 1, 8))::BIGINT % 10000 AS bucket FROM labels),
cut AS (
  SELECT y, bucket, sum(n) OVER (PARTITION BY y ORDER BY bucket) <=
    greatest(1, round(sum(n) OVER (PARTITION BY y) * {C.TEST_FRACTION}::DOUBLE)) AS is_test
  FROM (SELECT y, bucket, count(*) AS n FROM bucketed GROUP BY y, bucket) counted),
parts AS (SELECT doc_id, y, is_test FROM bucketed JOIN cut USING (y, bucket))"""


def _split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").selectExpr("doc_id", "quality AS y")
    return stratified_split(rows, ["doc_id"]).select("doc_id", "y", "is_test")


@query("split_classes", f"WITH {_SPLIT} SELECT y, is_test, count(*) AS n FROM parts GROUP BY y, is_test")
def split_classes(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf).groupBy("y", "is_test").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_split", f"WITH {_SPLIT} SELECT * FROM parts")
def split(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf)


# What training reports, and that the slope of its objective vanishes where it ended.
@query(
    "training_report",
    O.chain(
        "decided",
        f"""SELECT * FROM (WITH {_LABELLED}
        SELECT count(*) AS input_rows, count(y) AS training_rows, count(*) FILTER (y = 1) AS positive_rows,
          count(*) FILTER (y = 0) AS negative_rows, count(*) - count(y) AS ignored_review_rows, TRUE AS at_optimum
        FROM labelled_features) counted""",
    ),
)
def training_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(_labelled_features(spark, sf))
    model, metrics = train(rows)
    used = labelled_rows(rows).select("row_id", "y", *(c.alias(n) for n, c in encoded(rows).items()))
    used = class_weights(stratified_split(used, ["row_id"]).where("NOT is_test"))
    pull = F.col("weight") * (model.probability({n: F.col(n) for n in C.FEATURE_ORDER}) - F.col("y"))
    slopes = [
        F.abs(F.sum(pull * (F.col(n) - m) / s) + c)
        for n, m, s, c in zip(C.FEATURE_ORDER, model.mean, model.scale, model.coefficients) if s
    ]
    counts = [F.lit(metrics[k]).cast("long").alias(k) for k in (
        "input_rows", "training_rows", "positive_rows", "negative_rows", "ignored_review_rows")]
    return used.agg((F.greatest(F.abs(F.sum(pull)), *slopes) < 1e-6).alias("at_optimum")).select(*counts, "at_optimum")


# A model with known coefficients, saved and read back, decides for every candidate.
_KNOWN = LinearModel(
    C.FEATURE_ORDER, *(tuple(float(f(j)) for j in range(len(C.FEATURE_ORDER))) for f in (
        lambda j: j % 3 / 4, lambda j: (j % 4) / 2, lambda j: (j * 7 % 11 - 4) / 8)), intercept=0.5,
)
_KNOWN_MARGIN = " + ".join(["0.5::DOUBLE", *(
    f"({c}::DOUBLE) * (({_encoded_sql(n)} - {m}::DOUBLE) / {s}::DOUBLE)"
    for n, m, s, c in zip(C.FEATURE_ORDER, _KNOWN.mean, _KNOWN.scale, _KNOWN.coefficients) if s)])


@query(
    "model_scores",
    O.chain(
        "decided",
        f"""SELECT {_KEY}, round(p, 6) AS confidence, CASE WHEN p >= threshold THEN 'REAL_SECRET' ELSE 'FALSE_POSITIVE' END AS label,
      p >= threshold AS approved, 'known-v1' AS model_name, ['supervised model probability from known-v1',
        'approval threshold=' || CASE threshold WHEN 0.62::DOUBLE THEN '0.62' WHEN 0.90::DOUBLE THEN '0.90'
          WHEN 0.94::DOUBLE THEN '0.94' ELSE '0.99' END] AS reasons
    FROM (SELECT {_KEY}, 1 / (1 + exp(-({_KNOWN_MARGIN}))) AS p, {_THRESHOLD} AS threshold FROM decided) scored""",
    ),
)
def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    scorer, _ = load_bundle(save_bundle(_KNOWN, new_path(spark), C.FEATURE_ORDER, "known-v1", {}))
    return analyze(source_files(spark, sf), scorer).select(
        "file_id", "sig_ord", "start_index", F.round("confidence", 6).alias("confidence"), "label", "approved", "model_name", "reasons"
    )


@query("supervised_scores")
def supervised_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(_labelled_features(spark, sf))
    model, _ = train(rows)
    return supervised_scorer(model)(rows).select(
        "row_id", "label", "approved", F.round("confidence", 6).alias("confidence"), "model_name", "reasons"
    )


_METRIC_SQL = O.chain(
    "decided",
    f"""SELECT * FROM (WITH {_LABELLED}, counted AS (
      SELECT count(*) AS input_rows, count(y) AS rows, avg(confidence) FILTER (y IS NOT NULL) AS average_confidence,
        count(*) FILTER (y = 0 AND NOT approved) AS tn, count(*) FILTER (y = 0 AND approved) AS fp,
        count(*) FILTER (y = 1 AND NOT approved) AS fn, count(*) FILTER (y = 1 AND approved) AS tp
      FROM labelled_features)
    SELECT 'heuristic-baseline-v1' AS model, input_rows, rows, input_rows - rows AS ignored_review_rows,
      round((tn + tp)::DOUBLE / rows, 6) AS accuracy, tn, fp, fn, tp,
      round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision_1,
      round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall_1,
      round(CASE WHEN tn + fn = 0 THEN 0 ELSE tn::DOUBLE / (tn + fn) END, 6) AS precision_0,
      round(CASE WHEN tn + fp = 0 THEN 0 ELSE tn::DOUBLE / (tn + fp) END, 6) AS recall_0,
      round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1_1,
      round(CASE WHEN 2 * tn + fp + fn = 0 THEN 0 ELSE 2.0 * tn / (2 * tn + fp + fn) END, 6) AS f1_0,
      round(average_confidence, 6) AS average_confidence FROM counted) m""",
)


@query("evaluation_report", _METRIC_SQL)
def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    row = evaluate(_labelled_features(spark, sf))
    report, matrix = F.col("classification_report"), F.col("confusion_matrix")

    def metric(name: str, kind: str):
        return F.round(report[kind][name], 6)

    return row.select(
        "model", "input_rows", "rows", "ignored_review_rows", F.round("accuracy", 6).alias("accuracy"),
        matrix[0][0].alias("tn"), matrix[0][1].alias("fp"), matrix[1][0].alias("fn"), matrix[1][1].alias("tp"),
        metric("precision", "1").alias("precision_1"), metric("recall", "1").alias("recall_1"),
        metric("precision", "0").alias("precision_0"), metric("recall", "0").alias("recall_0"),
        metric("f1_score", "1").alias("f1_1"), metric("f1_score", "0").alias("f1_0"),
        F.round("average_confidence", 6).alias("average_confidence"),
    )

"""The same questions in plain SQL, for DuckDB.

Written from the rules, not from the Spark expressions: every signature is run
over whole texts, positions are summed over matches and gaps, term distances
are tried at every position, and the context of the planted Python code is
stated from what was planted.
"""

from __future__ import annotations

from keysieve import catalog as C
from keysieve.functions.text import WHITE_SPACE
from verification import driver_tables as D

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORD = r"\p{L}\p{N}_"
NAME = rf"[A-Za-z_$][{WORD}$]*"
EDGE = rf"(?:^|[^{WORD}])"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def any_of(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(t)})" for t in terms) + ")"


def one_of(column: str, values) -> str:
    return f"{column} IN ({', '.join(text(v) for v in values)})"


def strip(column: str) -> str:
    return f"trim({column}, {text(WHITE_SPACE)})"


def group(column: str, regex: str) -> str:
    return f"nullif(regexp_extract({column}, {text(regex)}, 1), '')"


def mask(column: str) -> str:
    return (
        f"CASE WHEN length({column}) <= 8 THEN repeat('*', length({column})) "
        f"ELSE left({column}, 4) || '********' || right({column}, 4) END"
    )


# Look-around is spelled as word boundaries here: the engines' boundaries agree on what the values hold.
_ANY_VALUE = "|".join(f"(?:{s.regex})" for s in C.SIGNATURES)
_AT_AN_END = "^[A-Za-z0-9_\\-]{16,}|[A-Za-z0-9_\\-]{16,}$"


def hide(column: str) -> str:
    """A text without the row's value and without what any signature matches."""
    own = f"replace({column}, value, {mask('value')})"
    return f"regexp_replace({own}, {text(_ANY_VALUE)}, '********', 'g')"


def hide_window(column: str) -> str:
    return f"regexp_replace({hide(column)}, {text(_AT_AN_END)}, '********', 'g')"


def hide_evidence(column: str) -> str:
    window = hide_window("substr(e, 10)")
    return (
        f"list_transform({column}, lambda e: CASE WHEN starts_with(e, 'Context: ') THEN 'Context: ' || {window} "
        f"ELSE {hide('e')} END)"
    )


def entropy(column: str) -> str:
    share = f"((length({column}) - length(replace({column}, c, '')))::DOUBLE / length({column}))"
    return (
        f"abs(coalesce(list_sum(list_transform(list_distinct(string_split({column}, '')), "
        f"lambda c: {share} * log2({share}))), 0))"
    )


def asset_list(column: str) -> str:
    """List of [reference, kind] structs: databases, URLs, hosts."""

    def found(regex: str, kind: str) -> str:
        return (
            f"list_transform(regexp_extract_all({column}, {text(regex)}), "
            f"lambda m: {{'reference': rtrim(m, {text(C.ASSET_TRAILING)}), 'kind': {text(kind)}}})"
        )

    return (
        f"list_concat(list_concat({found(C.DATABASE_REGEX, 'database')}, {found(C.URL_REGEX, 'url')}), "
        f"{found(C.HOST_REGEX, 'host')})"
    )


def ordered_distinct(column: str) -> str:
    return f"list_filter({column}, lambda v, i: list_position({column}, v) = i)"


SRC = f"""src AS MATERIALIZED (
  SELECT f.*, CASE WHEN file_id % 2 = 0 THEN file_id // 2 END AS doc_id,
         CASE WHEN file_id % 2 = 0 THEN (file_id // 2) % 8 END AS kind
  FROM ({D.SOURCE_FILES}) f)"""

NAME_OF = f"""names AS (
  SELECT doc_id, {D.NAME} AS name, source, {D.VALUE} AS planted_text FROM documents)"""


def paths_cte(source: str = "src") -> str:
    """Name, suffix and language of every file."""
    lang = (
        f"CASE WHEN suffix = '.py' THEN 'python' "
        f"WHEN {one_of('file_name', C.CONFIG_NAMES)} OR {one_of('suffix', C.CONFIG_SUFFIXES)} THEN 'config' "
        f"WHEN {one_of('suffix', C.JAVASCRIPT_SUFFIXES)} THEN 'javascript' "
        f"WHEN {one_of('suffix', C.JVM_SUFFIXES)} THEN 'jvm' "
        f"WHEN {one_of('suffix', C.OTHER_CODE_SUFFIXES)} THEN 'tree_sitter_candidate' "
        f"WHEN {one_of('suffix', C.DOCUMENT_SUFFIXES)} THEN 'documentation' ELSE 'plain_text' END"
    )
    grammar = "CASE suffix " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in C.GRAMMARS.items()) + " END"
    return f"""path_facts AS (
  SELECT *, {lang} AS file_language, {grammar} AS grammar,
         {any_of("lower(replace(path, chr(92), '/'))", C.DOC_OR_TEST_PATH_MARKERS)} AS doc_or_test,
         {any_of('file_name', C.TEMPLATE_NAME_MARKERS)} AS template_file
  FROM (SELECT *, regexp_extract(file_name, '^.+(\\.[^.]+)$', 1) AS suffix
        FROM (SELECT *, lower(string_split(path, '/')[-1]) AS file_name FROM {source}) named) ended)"""


def hits_cte(source: str = "src") -> str:
    """All matches of all signatures with their offsets."""
    parts = []
    for order, sig in enumerate(C.SIGNATURES):
        rx = text(sig.regex)
        parts.append(
            f"SELECT file_id, file_ord, {order} AS sig_ord, {text(sig.provider)} AS provider, "
            f"{text(sig.tier)} AS tier, m[i] AS value, "
            "CAST(coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) "
            "+ list_sum(list_transform(g[1:i], lambda x: length(x))) AS INTEGER) AS start_index "
            f"FROM (SELECT file_id, file_ord, regexp_extract_all(content, {rx}) AS m, "
            f"string_split_regex(content, {rx}) AS g FROM {source}) x, unnest(range(1, len(m) + 1)) t(i)"
        )
    return "hits AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


CAND = f"""cand AS (
  SELECT h.*, s.repository, s.path, s.url, s.content, s.kind, s.doc_id,
         {entropy('h.value')} AS entropy,
         start_index + length(h.value) AS end_index,
         CAST(length(left(s.content, start_index)) - length(replace(left(s.content, start_index), chr(10), ''))
              + 1 AS INTEGER) AS line_number,
         CAST(length(string_split(left(s.content, start_index), chr(10))[-1]) + 1 AS INTEGER) AS column_number
  FROM hits h JOIN src s ON s.file_id = h.file_id
  WHERE length(h.value) >= 16),
kept AS (SELECT * FROM cand WHERE tier IN ('CRITICAL', 'HIGH') OR entropy >= 2.5)"""

FIRST = """firsts AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY repository, path, value, line_number
                                 ORDER BY file_ord, sig_ord, start_index) AS rn FROM kept) ranked
  WHERE rn = 1)"""

CONTEXT = f"""lined AS (
  SELECT c.*, p.file_language, p.grammar, p.doc_or_test, p.template_file, n.name, n.source, n.planted_text,
         coalesce(string_split_regex(c.content, {text(LINE_BREAK)})[c.line_number], '') AS line_text,
         CASE WHEN p.file_language = 'python' AND c.kind = 0 AND line_number = 2 THEN 'assigned'
              WHEN p.file_language = 'python' AND c.kind = 3 AND c.doc_id % 40 = 3 THEN 'broken'
              WHEN p.file_language = 'python' AND c.kind = 3 AND line_number = 3 THEN 'argument'
              WHEN p.file_language = 'python' THEN 'notes' END AS planted
  FROM firsts c JOIN path_facts p ON p.file_id = c.file_id LEFT JOIN names n ON n.doc_id = c.doc_id),
tokens AS (
  SELECT *, CASE WHEN file_language IN ('javascript', 'jvm', 'tree_sitter_candidate') THEN true ELSE false END AS is_code,
    {group('line_text', r"^\s*['\"]?([A-Za-z0-9_.\-/]+)['\"]?\s*[:=]")} AS line_key,
    coalesce({group('line_text', rf"{EDGE}(?:const|let|var)\s+({NAME})\s*=")},
             {group('line_text', rf"{EDGE}({NAME})\s*[:=]\s*['\"]")},
             {group('line_text', rf"\.({NAME})\s*=\s*['\"]")}) AS line_variable,
    {group('line_text', rf"{EDGE}([A-Za-z_$][{WORD}$.]*)\s*\(")} AS line_call,
    'https://api.' || source || '.example.com/v1' AS api_url, 'api.' || source || '.example.com' AS api_host
  FROM lined),
context AS (
  SELECT *,
    CASE WHEN is_code THEN coalesce(grammar, file_language) ELSE file_language END AS language,
    CASE WHEN file_language = 'python' THEN 'python-ast' WHEN file_language = 'config' THEN 'config-structural-parser'
         WHEN is_code THEN 'line-token-parser' ELSE 'line-context' END AS parser_name,
    CASE WHEN planted = 'broken' THEN NULL WHEN planted IS NOT NULL THEN 'Constant'
         WHEN file_language = 'config' THEN CASE WHEN line_key IS NULL THEN 'ConfigLine' ELSE 'ConfigProperty' END
         ELSE 'Line' END AS ast_node_type,
    CASE WHEN planted IN ('assigned', 'notes') THEN 'Assign' WHEN planted = 'argument' THEN 'keyword'
         WHEN file_language = 'config' THEN 'ConfigurationFile' END AS parent_node_type,
    CASE WHEN planted IN ('assigned', 'argument') THEN name WHEN planted = 'notes' THEN 'NOTES'
         WHEN planted = 'broken' THEN NULL WHEN file_language = 'config' THEN line_key
         WHEN is_code THEN line_variable END AS variable_name,
    CASE WHEN planted = 'argument' THEN 'test_login' END AS enclosing_function,
    CASE WHEN planted = 'argument' THEN 'connect_client' WHEN is_code THEN line_call END AS call_name,
    CASE WHEN planted = 'assigned' THEN ['requests.get', 'dict'] WHEN planted = 'argument' THEN ['connect_client']
         ELSE CAST([] AS VARCHAR[]) END AS downstream_calls,
    CASE WHEN planted = 'assigned' THEN [{{'reference': api_url, 'kind': 'url'}}, {{'reference': api_host, 'kind': 'host'}}]
         WHEN planted = 'notes' THEN {asset_list('content')} END AS context_assets,
    CASE WHEN planted = 'broken' THEN 'SyntaxError: invalid syntax' END AS parse_error,
    CASE WHEN planted = 'assigned' THEN name || ' = "' || planted_text || '"'
         WHEN planted = 'argument' THEN name || '="' || planted_text || '"'
         WHEN planted = 'notes' THEN left({strip("substr(content, strpos(content, chr(10) || 'NOTES = ') + 1)")}, 240)
         ELSE left({strip('line_text')}, 240) END AS usage_context
  FROM tokens),
contexts AS (
  SELECT *, coalesce(list_transform(context_assets, lambda a: a.reference), CAST([] AS VARCHAR[])) AS all_references,
            coalesce(list_transform(context_assets, lambda a: a.kind), CAST([] AS VARCHAR[])) AS all_kinds
  FROM context),
context_lists AS (
  SELECT *, {ordered_distinct('all_references')} AS context_references, {ordered_distinct('all_kinds')} AS context_kinds
  FROM contexts),
explained AS (
  SELECT *, list_filter(CASE
    WHEN planted = 'broken' THEN CAST([] AS VARCHAR[])
    WHEN planted IS NOT NULL THEN [
      'Candidate is inside Python AST node Constant.',
      'Associated assignment target is ''' || variable_name || '''.',
      'Candidate is used near call ''' || call_name || '''.',
      'Candidate is enclosed by function ''' || enclosing_function || '''.',
      CASE WHEN len(downstream_calls) > 0
        THEN 'Data-flow slice links candidate to call(s): ' || array_to_string(downstream_calls[1:5], ', ') END,
      CASE WHEN len(context_references) > 0
        THEN 'Secret-asset association found near candidate: ' || array_to_string(context_references[1:3], ', ') END]
    WHEN file_language = 'config' THEN ['Candidate appears in configuration key ''' || line_key || '''.']
    WHEN is_code THEN [
      'Line tokens read with the naming rules of ''' || language || '''.',
      'Associated token from source line is ''' || line_variable || '''.',
      'Candidate appears near call ''' || line_call || '''.']
    ELSE ['No language-specific AST parser selected; using line-level context.'] END,
    lambda x: x IS NOT NULL) AS context_evidence
  FROM context_lists)"""


def nearest(column: str) -> str:
    tries = []
    for term in C.SECRET_TERMS:
        tries.append(
            f"list_min(list_transform(list_filter(range(length({column})), "
            f"lambda p: substr({column}, CAST(p AS INTEGER) + 1, {len(term)}) = {text(term)}), "
            f"lambda p: abs(p - length({column}) // 2)))"
        )
    return f"CAST(list_min([{', '.join(tries)}]) AS INTEGER)"


def list_shape(column: str) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, {text(t)}) AS INTEGER)" for t in C.SECRET_LIST_TERMS) + ") >= 2"


FEATURES = f"""windows AS (
  SELECT *,
    replace(substr(content, greatest(start_index - 120, 0) + 1,
                   end_index + 120 - greatest(start_index - 120, 0)), chr(10), ' ') AS context_raw,
    substr(content, greatest(start_index - 360, 0) + 1, end_index + 360 - greatest(start_index - 360, 0)) AS window_wide
  FROM explained),
lowered AS (
  SELECT *, lower(context_raw) AS low, {asset_list('window_wide')} AS local_assets,
         coalesce(lower(variable_name), '') AS low_variable, coalesce(lower(call_name), '') AS low_call FROM windows),
joined AS (
  SELECT *, list_concat(context_references, list_transform(local_assets, lambda a: a.reference)) AS every_reference,
            list_concat(context_kinds, list_transform(local_assets, lambda a: a.kind)) AS every_kind FROM lowered),
near AS (
  SELECT *, {ordered_distinct('every_reference')} AS refs, {ordered_distinct('every_kind')} AS kinds FROM joined),
features AS (
  SELECT *,
    CAST(length(value) AS INTEGER) AS length, round(entropy, 4) AS entropy_4,
    length(regexp_replace(value, '[^0-9]', '', 'g'))::DOUBLE / length(value) AS digit_ratio,
    length(regexp_replace(value, '[^A-Za-z]', '', 'g'))::DOUBLE / length(value) AS alpha_ratio,
    length(regexp_replace(value, '[A-Za-z0-9]', '', 'g'))::DOUBLE / length(value) AS symbol_ratio,
    regexp_full_match(value, '[0-9a-fA-F-]*') AS is_hex,
    length(value) = 36 AND length(replace(value, '-', '')) = 32 AS is_uuid_like,
    parse_error IS NULL AS has_ast_context,
    low_variable <> '' AS has_variable_name,
    {any_of('low_variable', C.SENSITIVE_NAME_TERMS)} AS variable_is_sensitive,
    {any_of('low_call', C.AUTH_CALL_TERMS)} AS call_is_auth_related,
    CAST(len(downstream_calls) AS INTEGER) AS downstream_call_count,
    len(downstream_calls) > 0 AS has_downstream_usage,
    array_to_string(downstream_calls[1:5], ' | ') AS downstream_calls_text,
    coalesce(ast_node_type, '') AS node_text, coalesce(parent_node_type, '') AS parent_text,
    coalesce(parent_node_type IN ('Assign', 'AnnAssign'), false) OR coalesce(ast_node_type = 'ConfigProperty', false)
      AS is_assignment_context,
    left({strip('context_raw')}, 300) AS context_window,
    {nearest('low')} AS nearest_secret_term_distance,
    {any_of('low', C.SECRET_TERMS)} AS has_secret_term_nearby,
    {any_of('low', C.HASH_OR_ID_TERMS)} AS has_hash_or_identifier_term,
    {any_of("replace(low, ' ', '_')", C.PLACEHOLDER_TERMS)} AS has_placeholder_signal,
    {any_of('low', C.TEMPLATE_TERMS)} AS has_template_language,
    (doc_or_test OR template_file) AND NOT {list_shape('low')} AS is_weak_documentation_context,
    len(refs) > 0 AS has_asset_reference, CAST(len(refs) AS INTEGER) AS asset_reference_count,
    array_to_string(kinds, ',') AS asset_kinds, array_to_string(refs[1:5], ' | ') AS asset_references,
    list_contains(kinds, 'database') AS has_database_asset, list_contains(kinds, 'url') AS has_url_asset,
    list_contains(kinds, 'host') AS has_host_asset
  FROM near)"""


def _case(condition: str, weight: float) -> str:
    return f"CASE WHEN {condition} THEN {weight}::DOUBLE ELSE 0::DOUBLE END"


def _steps() -> list[tuple[str, str, float, str]]:
    flags = {
        "entropy": "entropy_4 >= 4.0::DOUBLE",
        "is_documentation_or_test_path": "doc_or_test",
    }
    steps = [("+", flags.get(n, n), w, r) for w, n, r in C.BASELINE_ADDS]
    steps += [("-", flags.get(n, n), w, r) for w, n, r in C.BASELINE_SUBTRACTS]
    steps.append(("-", "(starts_with(provider, 'Generic') AND is_hex)", *C.GENERIC_HEX_PENALTY))
    doc_template = (
        "((has_template_language OR has_placeholder_signal) AND (template_file OR doc_or_test) "
        "AND NOT has_asset_reference AND NOT has_downstream_usage)"
    )
    steps.append(("-", doc_template, *C.DOC_TEMPLATE_PENALTY))
    return steps


def _raw_score() -> str:
    base = "CASE tier " + " ".join(f"WHEN {text(t)} THEN {s}::DOUBLE" for t, s in C.TIER_BASE_SCORES)
    out = f"{base} ELSE {C.TIER_BASE_DEFAULT}::DOUBLE END"
    for sign, condition, weight, _ in _steps():
        out = f"({out} {sign} {_case(condition, weight)})"
    return out


def _reasons() -> str:
    items = ", ".join(f"CASE WHEN {cond} THEN {text(reason)} END" for _, cond, _, reason in _steps())
    return f"list_filter([{items}], lambda r: r IS NOT NULL)"


_EVIDENCE = [
    ("variable_is_sensitive", "'Variable name ''' || variable_name || ''' contains a secret-related term.'"),
    ("call_is_auth_related", "'Call ''' || call_name || ''' appears authentication or client related.'"),
    ("is_assignment_context", "'Candidate is bound through assignment or configuration property.'"),
    ("has_downstream_usage", "'Candidate has downstream data-flow usage after assignment.'"),
    ("has_secret_term_nearby", "'Nearby context contains secret-related terminology.'"),
    ("has_hash_or_identifier_term", "'Nearby context contains hash/id terminology associated with false positives.'"),
    ("has_placeholder_signal", "'Nearby context contains placeholder or example terminology.'"),
    ("has_template_language", "'Nearby context contains template instructions.'"),
    ("doc_or_test", "'File path suggests documentation, tests, examples, or fixtures.'"),
    ("is_weak_documentation_context", "'Documentation context lacks strong leaked-key list structure.'"),
    ("has_asset_reference",
     "'Candidate is near asset reference(s): ' || array_to_string(refs[1:3], ', ') || '.'"),
]

SCORED = f"""scored AS (
  SELECT *, {_raw_score()} AS raw_score, {_reasons()} AS reasons,
    list_concat(context_evidence, list_filter([
      {', '.join(f'CASE WHEN {c} THEN {s} END' for c, s in _EVIDENCE)}], lambda e: e IS NOT NULL)) AS evidence
  FROM features),
decided AS (
  SELECT *, least(0.99::DOUBLE, greatest(0::DOUBLE, raw_score)) AS confidence,
    least(0.99::DOUBLE, greatest(0::DOUBLE, raw_score)) >= 0.62::DOUBLE AS approved,
    CASE WHEN least(0.99::DOUBLE, greatest(0::DOUBLE, raw_score)) >= 0.62::DOUBLE
         THEN 'REAL_SECRET' ELSE 'FALSE_POSITIVE' END AS label
  FROM scored)"""


def _risk() -> str:
    prefix = " OR ".join(f"starts_with(provider, {text(p)})" for p in C.RISK_PROVIDER_PREFIXES)
    out = f"(confidence + {_case(prefix, C.RISK_PROVIDER_WEIGHT)})"
    for weight, flag in C.RISK_ADDS:
        out = f"({out} + {_case(flag, weight)})"
    return f"greatest(0::DOUBLE, least(1::DOUBLE, {out} - {_case('doc_or_test', C.RISK_DOC_PENALTY)}))"


FINDINGS = f"""risky AS (
  SELECT *, {_risk()} AS risk_score,
    list_concat(list_concat(evidence, list_transform(reasons, lambda r: 'Classifier reason: ' || r || '.')),
                CASE WHEN context_window <> '' THEN ['Context: ' || context_window] ELSE CAST([] AS VARCHAR[]) END)
      AS all_evidence
  FROM decided WHERE approved),
findings AS (
  SELECT *, {ordered_distinct('all_evidence')} AS finding_evidence,
    CASE WHEN risk_score >= 0.85::DOUBLE THEN 'CRITICAL' WHEN risk_score >= 0.72::DOUBLE THEN 'HIGH'
         WHEN risk_score >= 0.55::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
  FROM risky)"""


def chain(upto: str, select: str) -> str:
    """A query over the chain of common table expressions up to one of them."""
    steps = {
        "src": [SRC],
        "path_facts": [SRC, paths_cte()],
        "kept": [SRC, hits_cte(), CAND],
        "firsts": [SRC, hits_cte(), CAND, FIRST],
    }
    steps["explained"] = [SRC, NAME_OF, paths_cte(), hits_cte(), CAND, FIRST, CONTEXT]
    steps["features"] = [*steps["explained"], FEATURES]
    steps["decided"] = [*steps["features"], SCORED]
    steps["findings"] = [*steps["decided"], FINDINGS]
    return "WITH " + ",\n".join(steps[upto]) + "\n" + select

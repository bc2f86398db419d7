"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from keysieve import catalog as C
from verification.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "pages", "labels")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def test_all_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    sql = ORACLES.get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, rows) == rows_of(names, cursor.fetchall())


def test_rows_reach_every_signature_tier_language_bucket_and_route(spark):
    values = lambda query, column: {r[0] for r in QUERIES[query](spark, SF).select(column).distinct().collect()}
    assert values("candidates", "provider") == {s.provider for s in C.SIGNATURES}
    assert values("candidates", "signature_confidence") == {s.tier for s in C.SIGNATURES}
    assert values("path_facts", "language") == {
        "python", "config", "javascript", "jvm", "tree_sitter_candidate", "documentation", "plain_text"}
    assert {"javascript", "java", "kotlin", "go", "tsx", "cpp"} <= values("path_facts", "grammar")
    assert values("code_context", "parser_name") == {
        "python-ast", "config-structural-parser", "line-token-parser", "line-context"}
    assert values("check_routes", "service") == {"passive", "google", "generic"}
    assert values("check_routes", "status") == {"skipped", "external_check_required", "unsupported"}
    assert values("review_buckets", "review_bucket") == {
        "operational_ids", "docs_placeholders", "near_miss_high_confidence", "low_priority_noise", "code_config_real_key", "docs_real_keys"}
    assert values("approval_thresholds", "threshold") >= {0.62, 0.90, 0.995}


def test_flagship_has_findings(spark):
    assert entry.entry(spark).count() > 0

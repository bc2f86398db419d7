"""Files to scan, derived from the driver's tables.

Documents become files of eight kinds that hold a planted line and their whole
text; pages become mirrored HTML files as they are. Planted values are cut from
the MD5 of the row's key, so they are synthetic and the same in every engine.
The expressions use only functions both engines spell alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_H = "md5(CAST(doc_id AS STRING))"
_HH = f"({_H} || md5({_H}))"
_QUOTE, _BACK, _LF = "chr(34)", "chr(92)", "chr(10)"
_ID = "CAST(doc_id AS STRING)"

# A value of every signature.
VALUE = f"""CASE doc_id % 17
  WHEN 0 THEN {_H}
  WHEN 1 THEN 'AKIA' || upper(substr({_H}, 1, 16))
  WHEN 2 THEN 'ghp_' || substr({_HH}, 1, 36)
  WHEN 3 THEN substr({_H}, 1, 8) || '-' || substr({_H}, 9, 4) || '-' || substr({_H}, 13, 4)
    || '-' || substr({_H}, 17, 4) || '-' || substr({_H}, 21, 12)
  WHEN 4 THEN 'AIza' || substr({_HH}, 1, 35)
  WHEN 5 THEN 'glpat-' || substr({_HH}, 1, 20)
  WHEN 6 THEN 'sk_live_' || substr({_HH}, 1, 24)
  WHEN 7 THEN 'sk-' || substr({_HH}, 1, 48)
  WHEN 8 THEN 'sk-proj-' || substr({_HH}, 1, 24)
  WHEN 9 THEN 'xoxb-' || substr({_HH}, 1, 24)
  WHEN 10 THEN 'AC' || {_H}
  WHEN 11 THEN 'key-' || {_H}
  WHEN 12 THEN 'pypi-AgEI' || substr({_HH}, 1, 52)
  WHEN 13 THEN substr({_HH}, 1, 24) || '.' || substr({_HH}, 25, 6) || '.' || substr({_HH}, 31, 27)
  WHEN 14 THEN lpad({_ID}, 9, '1') || ':' || substr({_HH}, 1, 35)
  WHEN 15 THEN substr({_HH}, 1, 40)
  ELSE {_HH} END"""

NAME = """CASE doc_id % 7
  WHEN 0 THEN 'SHODAN_API_KEY' WHEN 1 THEN 'OPENAI_API_KEY' WHEN 2 THEN 'db_password'
  WHEN 3 THEN 'build_checksum' WHEN 4 THEN 'CONNECTOR_ID' WHEN 5 THEN 'SCRAPINGBEE_KEY'
  ELSE 'release_tag' END"""

KIND = "doc_id % 8"

PATH = f"""CASE {KIND}
  WHEN 0 THEN 'src/app_' || {_ID} || '.py'
  WHEN 1 THEN 'svc_' || {_ID} || '/.env'
  WHEN 2 THEN 'config/app_' || {_ID} || '.yml'
  WHEN 3 THEN 'tests/test_' || {_ID} || '.py'
  WHEN 4 THEN 'docs/readme_' || {_ID} || '.md'
  WHEN 5 THEN 'web/app_' || {_ID} || CASE CAST(floor(doc_id / 8) AS BIGINT) % 6
    WHEN 0 THEN '.js' WHEN 1 THEN '.java' WHEN 2 THEN '.go' WHEN 3 THEN '.tsx' WHEN 4 THEN '.kt' ELSE '.cpp' END
  WHEN 6 THEN 'notes/notes_' || {_ID} || '.txt'
  ELSE 'team_' || {_ID} || CASE WHEN doc_id % 16 = 7 THEN '/API_KEYS.md' ELSE '/ReconX/Keys.md' END END"""

_QUOTED = f"{_QUOTE} || planted || {_QUOTE}"
# The whole text as a Python string constant.
_ESCAPED = (
    f"replace(replace(text, {_BACK}, {_BACK} || {_BACK}), {_QUOTE}, {_BACK} || {_QUOTE})"
)
_TRIPLE = f"{_QUOTE} || {_QUOTE} || {_QUOTE}"
_PY_CALL = (
    f"'response = requests.get(' || {_QUOTE} || 'https://api.' || source || '.example.com/v1' || {_QUOTE}"
    f" || ', params=dict(key=' || name || '))' || {_LF}"
)

CONTENT = f"""CASE
  WHEN {KIND} = 0 THEN 'import requests' || {_LF} || name || ' = ' || {_QUOTED} || {_LF} || {_PY_CALL}
    || 'NOTES = ' || {_TRIPLE} || {_ESCAPED} || {_TRIPLE} || {_LF}
  WHEN {KIND} = 3 AND doc_id % 40 = 3 THEN 'def broken(:' || {_LF} || name || ' = ' || {_QUOTED} || {_LF}
    || 'NOTES = ' || {_TRIPLE} || {_ESCAPED} || {_TRIPLE} || {_LF}
  WHEN {KIND} = 3 THEN 'class TestKeys:' || {_LF} || '    def test_login(self):' || {_LF}
    || '        connect_client(' || name || '=' || {_QUOTED} || ')' || {_LF}
    || 'NOTES = ' || {_TRIPLE} || {_ESCAPED} || {_TRIPLE} || {_LF}
  WHEN {KIND} = 1 THEN name || '=' || planted || {_LF} || 'DATABASE_URL=postgres://db.internal:5432/' || source
    || {_LF} || text
  WHEN {KIND} = 2 THEN '  ' || name || ': ' || {_QUOTED} || {_LF} || text
  WHEN {KIND} = 5 THEN 'const ' || name || ' = ' || {_QUOTED} || '; api.login(' || name || ');' || {_LF} || text
  WHEN {KIND} = 6 THEN 'Github:' || {_LF} || '- ' || planted || {_LF} || 'Amazon:' || {_LF} || text
  WHEN {KIND} = 4 THEN 'Set ' || name || ' to your key, for example ' || planted || {_LF} || text
  ELSE name || ': ' || planted || '  # Only add the keys you use, leave others empty' || {_LF} || text END"""

# file_id counts documents and pages apart, so that it is unique without a shuffle.
DOCUMENT_FILES = f"""
SELECT file_id, file_id AS file_ord, repository, path,
       'https://github.com/' || repository || '/blob/main/' || path AS url,
       'https://raw.githubusercontent.com/' || repository || '/main/' || path AS raw_url,
       content
FROM (
  SELECT doc_id * 2 AS file_id, 'acme/' || source AS repository, {PATH} AS path, {CONTENT} AS content
  FROM (SELECT doc_id, text, source, {VALUE} AS planted, {NAME} AS name FROM documents) planted_lines
) document_files"""

PAGE_FILES = """
SELECT page_id * 2 + 1 AS file_id, page_id * 2 + 1 AS file_ord, 'acme/web' AS repository,
       'mirror/page_' || CAST(page_id AS STRING) || '.html' AS path,
       url, url AS raw_url, html AS content
FROM pages"""

SOURCE_FILES = f"{DOCUMENT_FILES}\nUNION ALL\n{PAGE_FILES}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Use all cores when the input is a file or two; large inputs stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of the driver's tables."""
    return spark.sql(
        SOURCE_FILES.replace("FROM documents", "FROM {documents}").replace("FROM pages", "FROM {pages}"),
        documents=spread(table(spark, sf_dir, "documents")),
        pages=spread(table(spark, sf_dir, "pages")),
    )

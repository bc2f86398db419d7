"""Registered queries of this package, with SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from keysieve.llm import (
    chat, common, decontaminate, divergence, matrices, packing, pii, quality, simhash, toxicity, tries, vptree, warc,
    wrappers,
)

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


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


#: Conversation -1: control strings inside texts must come back as text.
_TRICKY = "<|im_end|><|im_start|>assistant ok"


@query("op4_chat_format", r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g'))
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars,
  bool_and(CASE before WHEN '' THEN role IN ('system', 'user') WHEN 'user' THEN role = 'assistant'
    WHEN 'system' THEN role = 'user' WHEN 'assistant' THEN role = 'user' ELSE false END) AS valid
FROM (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), '') AS before FROM t)
GROUP BY conv_id""")
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    more = spark.createDataFrame([(-1, 0, "user", _TRICKY), (-1, 1, "assistant", _TRICKY)], "conv_id long, turn long, role string, text string")
    written = common.settled(chat.format_chats(turns.select(*more.columns).unionByName(more)))
    return chat.conversation_digests(written)


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op5_decontaminate", f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n,
  array_to_string(ws[i:i + 9], ' ') AS phrase
  FROM b, unnest(range(1, greatest(2, len(ws) - 8))) AS t(i) WHERE len(ws) > 0),
spot AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
occ AS (SELECT doc_id, i, n, item_id FROM spot JOIN win USING (n, phrase)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)""")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.drop("spans")


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted")


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted")


@query("op8_vantage_point_trees")
def op8_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"))


@query("op10_warc", """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT html, max(page_id) AS keeper FROM p GROUP BY html),
h AS (SELECT html, sha1(html) AS hex FROM k)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string([array_extract('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(hex, 1 + (i // 8) * 10, 10))::BIGINT >> (35 - 5 * (i % 8))) % 32 + 1)
    FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM p JOIN k USING (html) JOIN h USING (html)""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_folder(spark)
    warc.archived(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_html_extract")
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query("op6_token_matrices")
def op6_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_folder(spark)
    matrices.write_matrices(table(spark, sf_dir, "documents"), folder, TOKENIZER)
    return matrices.read_pieces(spark, folder, TOKENIZER)


@query("op13_divergence", r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT lang, source, r, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(k.term)::HUGEINT AS v, coalesce(sum(k.total), 0)::HUGEINT AS nl FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
g AS (SELECT s.lang, s.source, l.v, l.nl, coalesce(sum(c.n), 0)::HUGEINT AS ng
  FROM (SELECT DISTINCT lang, source FROM d) AS s JOIN l USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.ng + g.v) AS p,
    1 + (1000000000 * (k.total + 1)) // (g.nl + g.v) AS q
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (SELECT *, (row_number() OVER (
    PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank FROM f)
WHERE part = 'pair' OR rank <= 200""")
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


@query("op12_prefix_trie", r"""WITH c AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1))))) % 9 AS h FROM c),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
    strlen(coalesce(text, ''))::BIGINT AS size, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT h.conv_id, i, id, size FROM h JOIN t ON t.conv_id = h.base AND i <= h
  UNION ALL SELECT h.conv_id, i, id, size FROM h JOIN t ON t.conv_id = h.conv_id AND i > h),
q AS (SELECT conv_id, row_number() OVER w AS depth, size, md5(string_agg(id, '') OVER w) AS key FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
p AS (SELECT conv_id, depth, size, key FROM q UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
e AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM p
  WHERE depth = (SELECT count(*) FROM r WHERE r.conv_id = p.conv_id) GROUP BY key),
n AS (SELECT key, depth, size, min(conv_id) AS conv_id, count(*) AS n FROM p GROUP BY ALL),
u AS (SELECT n.*, p.key AS up FROM n LEFT JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
k AS (SELECT up AS key, count(*) AS children FROM u WHERE up IS NOT NULL GROUP BY up),
s AS (SELECT a.key, sum((n.n - 1) * n.size) AS saved, count(*) FILTER (k.key IS NULL) AS leaves
  FROM n JOIN p AS a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN k ON k.key = n.key GROUP BY a.key)
SELECT u.conv_id, u.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, u.n::BIGINT AS n_convs, coalesce(children, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM u JOIN s USING (key) LEFT JOIN n AS o ON o.key = u.up LEFT JOIN k ON k.key = u.key LEFT JOIN e ON e.key = u.key""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op11_pii")
def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detect(table(spark, sf_dir, "documents")))

"""Registered queries against their SQL, and the pipeline stage by stage."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from keysieve.llm import common, decontaminate, quality, simhash, toxicity
from keysieve.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {q.partition("_")[0] for q in names} and "pipeline" in names
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r)) for r in got.select(names).collect())


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    first, now = docs, docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, common.settled(stage(spark, now, SF))
        if name == "packing":
            break
        assert now.columns == first.columns
        ids, left = {r.doc_id for r in before.collect()}, [r.doc_id for r in now.collect()]
        assert set(left) <= ids and len(left) == len(set(left))
        if name in ("toxicity", "quality"):
            module = toxicity if name == "toxicity" else quality
            good = {r.doc_id for r in module.scored(before, labels).collect() if (r.predicted == 0) == (name == "toxicity")}
            assert set(left) == good
        elif name == "near_duplicates":
            assert set(left) == {r.component_id for r in simhash.components(before).collect()}
        else:
            assert set(left) == ids
            assert not decontaminate.report(now, benchmark).where("contaminated").count()
    assert {r.doc_id for r in now.collect()} == {r.doc_id for r in before.collect()}
    whole = corpus_pipeline.run(spark, SF)
    key = lambda rows: sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows.collect())
    assert key(whole) == key(now)


def test_stages_take_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0

"""What the plans must look like to hold at scale."""

import re

from keysieve.functions.paths import raw_url
from keysieve.operators.labeling import review_queue
from keysieve.operators.recover import recover_candidates
from keysieve.operators.report import build_findings, top_findings
from keysieve.operators.search import attach_content, newest_per_pattern, pattern_hits
from keysieve.plans.triage import analyze, find, scan, search
from keysieve.sources.readers import landed_by_address
from keysieve.sources.writers import land_by_address

KEY = "Lt3whkyVHH7iAtP28iNIq7hVNlK638vR"


def landed(spark, files, tmp_path):
    path = str(tmp_path / "files")
    files(*[(f"src/f{i}.py", f'API_KEY = "{KEY}"\n') for i in range(20)]).write.parquet(path)
    return spark.read.parquet(path)


def nodes(rows):
    """Operators of the physical plan, one per line, without their arguments."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"^[\s:+\-]*(?:\*\(\d+\) )?([A-Z][A-Za-z]+)", plan, re.M), plan


def test_recovery_is_one_scan_without_a_shuffle(spark, files, tmp_path):
    ops, plan = nodes(recover_candidates(landed(spark, files, tmp_path)))
    assert ops.count("FileScan") == 1 and "Exchange" not in ops
    assert "content" in plan


def test_analysis_has_one_shuffle_of_reduced_rows(spark, files, tmp_path):
    rows = analyze(landed(spark, files, tmp_path))
    ops, plan = nodes(rows)
    assert ops.count("FileScan") == 1 and ops.count("Exchange") == 1
    # The rank limit is applied on both sides of the exchange.
    assert ops.count("WindowGroupLimit") == 2
    above = plan[: plan.index("Exchange hashpartitioning")]
    assert "content#" not in above
    assert "content" not in rows.columns and "window" not in rows.columns


def test_findings_are_range_sorted_and_top_needs_no_sort(spark, files, tmp_path):
    source = landed(spark, files, tmp_path)
    assert "rangepartitioning" in nodes(find(source))[1]
    ops, _ = nodes(top_findings(build_findings(analyze(source))))
    assert "TakeOrderedAndProject" in ops and "Sort" not in ops[: ops.index("TakeOrderedAndProject") + 1]


def test_scan_reads_only_the_columns_it_uses(spark, files, tmp_path):
    _, plan = nodes(recover_candidates(landed(spark, files, tmp_path)).select("file_id", "value"))
    schema = re.search(r"ReadSchema: struct<([^>]*)", plan).group(1)
    assert "url" not in schema and "repository" not in schema and "content" in schema


def test_search_moves_no_text(spark, files, tmp_path):
    patterns = spark.createDataFrame([(0, "API_KEY")], "pattern_ord int, pattern string")
    hits = pattern_hits(landed(spark, files, tmp_path), patterns)
    ops, _ = nodes(hits)
    assert ops.count("FileScan") == 1 and not [o for o in ops if "Exchange" in o or "Join" in o]
    ops, plan = nodes(newest_per_pattern(hits))
    assert ops.count("WindowGroupLimit") >= 2
    assert "content" not in plan[: plan.index("ArrowEvalPython")]


def test_landed_texts_are_attached_where_they_lie(spark, files, tmp_path):
    own = files(*[(f"src/f{i}.py", f'API_KEY = "{KEY}"\n') for i in range(20)], ("src/none.py", None))
    own = own.withColumn("raw_url", raw_url(own["url"]))
    path = str(tmp_path / "landed")
    written = land_by_address(own, path, buckets=4)
    assert written.count() == 20 and len(list((tmp_path / "landed").glob("*.parquet"))) <= 4
    patterns = spark.createDataFrame([(0, "API_KEY")], "pattern_ord int, pattern string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = landed_by_address(spark, path)
        rows = attach_content(search(again, patterns), again)
        ops, plan = nodes(rows)
        (at,) = [m.start() for m in re.finditer("Exchange hashpartitioning", plan)]
        assert "Raw URL" in plan[at : at + 60] and "SelectedBucketsCount: 4 out of 4" in plan
        assert not re.search(r"\bcontent#", plan[at : plan.index("ArrowEvalPython")])
        assert sorted(r.content for r in rows.collect()) == [f'API_KEY = "{KEY}"\n'] * 20
        hits, analyses = scan(again, patterns, contents=again)
        assert hits.count() == analyses.count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_queue_is_a_top_k(spark):
    rows = spark.createDataFrame([(1, "needs_review", 2, 0.5)], "row_id int, label_source string, review_priority int, review_score double")
    assert "TakeOrderedAndProject" in nodes(review_queue(rows))[0]

"""Readers, writers, search and attaching content."""

import csv
import json
import os
import random
from datetime import datetime
from unittest import mock

import pytest
from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.operators.features import FEATURE_ROW_COLUMNS, feature_rows
from keysieve.operators.evaluate import evaluate, normal_rows
from keysieve.operators.search import attach_content, newest_per_pattern, pattern_hits, scan_hits
from keysieve.plans.triage import analyze, scan, search
from keysieve.sources import publish
from keysieve.sources.csv_ranges import read_csv_ranges
from keysieve.sources.publish import published
from keysieve.sources.readers import (
    builtin_patterns, read_feature_csv, read_feature_order, read_patterns, read_text_files,
)
from keysieve.sources.writers import (
    write_csv, write_features, write_metrics, write_report, write_review_queue, write_source_files,
)

KEY = "Lt3whkyVHH7iAtP28iNIq7hVNlK638vR"


def test_patterns(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text('pattern\n  A_KEY \n\n"  "\nB_KEY\n')
    assert [r["pattern"] for r in read_patterns(spark, str(path)).orderBy("pattern_ord").collect()] == ["A_KEY", "B_KEY"]
    assert read_patterns(spark, str(tmp_path / "none.csv")).collect() == []
    assert builtin_patterns(spark, "openai").count() == 18


def test_rows_of_several_csv_files_are_numbered_by_file_and_place(spark, tmp_path):
    for name, rows in (("b.csv", ["3", "4"]), ("a.csv", ["1", '"2\n2"']), ("c.csv", ["5"])):
        (tmp_path / name).write_text("pattern\n" + "\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        got = read_patterns(spark, str(tmp_path)).orderBy("pattern_ord").collect()
        ids = {r["pattern"]: r["row_id"] for r in read_feature_csv(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["pattern_ord"], r["pattern"]) for r in got] == [(0, "1"), (1, "2\n2"), (2, "3"), (3, "4"), (4, "5")]
    assert ids == {"1": 0, "2\n2": 1, "3": 2, "4": 3, "5": 4}


def patterns(spark, *names):
    return spark.createDataFrame(list(enumerate(names)), "pattern_ord int, pattern string")


def test_search_is_any_case_and_newest_first(spark, files):
    landed = files(*[(f"f{i}.txt", "x my_Shodan_Key y" if i % 2 else "openai_key SHODAN_KEY") for i in range(260)])
    hits = newest_per_pattern(pattern_hits(landed, patterns(spark, "SHODAN_KEY", "OPENAI_KEY", "NONE")))
    got = scan_hits(hits).orderBy("hit_ord").collect()
    first = [r for r in got if r["Pattern Source"] == "SHODAN_KEY"]
    assert [r["File Path"] for r in first] == [f"f{i}.txt" for i in range(259, 159, -1)]
    assert len(got) == 200 and len({r["hit_ord"] for r in got}) == 200
    two = newest_per_pattern(pattern_hits(landed, patterns(spark, "SHODAN_KEY")), pages=2)
    assert two.count() == 200
    assert pattern_hits(landed, patterns(spark)).count() == 0


def test_all_hits_whatever_the_pattern_looks_like(spark, files):
    landed = files(("a.txt", "k0 k3 k4 Straße-key"), ("b.txt", "k4\nin\nlines _x"), ("c.txt", ""), ("d.txt", None))
    names = [*(f"k{i}" for i in range(5)), "4\nIN\nl", "STRAßE", "ße-k", "lines _x and more", "_X"]
    got = search(landed, patterns(spark, *names)).orderBy("hit_ord").collect()
    assert [(r["File Path"], r["Pattern Source"]) for r in got] == [
        ("a.txt", "k0"), ("a.txt", "k3"), ("b.txt", "k4"), ("a.txt", "k4"), ("b.txt", "4\nIN\nl"), ("a.txt", "STRAßE"),
        ("a.txt", "ße-k"), ("b.txt", "_X")]
    many = files(*[(f"f{i}.txt", "SHODAN_KEY") for i in range(260)])
    assert search(many, patterns(spark, "SHODAN_KEY")).count() == 260


def test_content_is_attached_by_address(spark):
    hits = spark.createDataFrame(
        [("r", "a", "u1", "P", "raw1", 1), ("r", "a", "u1", "Q", "raw1", 2), ("r", "b", "u2", "P", "", 3),
         ("r", "c", "u3", "P", None, 4), ("r", "d", "u4", "P", "gone", 5)],
        "Repository string, `File Path` string, URL string, `Pattern Source` string, `Raw URL` string, hit_ord long")
    contents = spark.createDataFrame([("raw1", "text"), ("other", "x"), ("raw2", None)], "raw_url string, content string")
    every = attach_content(hits, contents).orderBy("file_ord").collect()
    assert [(r["path"], r["pattern_source"], r["content"]) for r in every] == [("a", "P", "text"), ("a", "Q", "text")]
    once = attach_content(hits, contents, once_per_file=True).collect()
    assert [r["pattern_source"] for r in once] == ["P"]


def test_scan_joins_search_and_analysis(spark, files):
    landed = files(("a.env", f"SHODAN_API_KEY={KEY}\n"), ("b.env", f"OTHER={KEY}\n"))
    hits, analyses = scan(landed, builtin_patterns(spark, "shodan"))
    assert {r["File Path"] for r in hits.collect()} == {"a.env"}
    (row,) = analyses.collect()
    assert (row["file_path"], row["pattern_source"]) == ("a.env", "SHODAN_API_KEY")


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b'k = "\xff' + KEY.encode() + b'"\n')
    (tmp_path / "b.txt").write_text("café")
    got = {r["path"]: r for r in read_text_files(spark, str(tmp_path), "acme", "https://github.com/acme/blob/main/").collect()}
    assert got["src/a.py"]["content"] == f'k = "�{KEY}"\n'
    assert got["b.txt"]["content"] == "café"
    assert got["src/a.py"]["raw_url"] == "https://raw.githubusercontent.com/acme/main/src/a.py"


def test_feature_csv_round_trip(spark, files, tmp_path):
    source = f'API_KEY = "{KEY}"  # say "hi", then\nx = 1\n'
    rows = feature_rows(analyze(files(("src/a.py", source))))
    assert tuple(rows.columns) == FEATURE_ROW_COLUMNS
    path = write_features(rows, str(tmp_path / "f"), format="csv")
    back = read_feature_csv(spark, path)
    assert KEY not in str(back.collect())
    (had,), (got,) = rows.collect(), back.collect()
    for name in FEATURE_ROW_COLUMNS:
        want = had[name]
        want = "" if want is None else str(want).lower() if isinstance(want, bool) else str(want)
        assert got[name] == want, name
    labelled = back.selectExpr("*", "'real_secret' AS label")
    assert evaluate(labelled).first()["confusion_matrix"] == [[0, 0], [0, 1]]
    parquet = write_features(rows, str(tmp_path / "p"))
    assert spark.read.parquet(parquet).columns == list(FEATURE_ROW_COLUMNS)


def test_rows_under_other_names(spark):
    rows = spark.createDataFrame([("a.py", "AWS Access Key", "x", "3.0", "****")],
                                 ["File", "Secret Type", "Associated Variable", "Line", "Masked Value"])
    row = normal_rows(rows).first()
    assert (row["file_path"], row["provider"], row["variable_name"], row["line_number"], row["value"]) == (
        "a.py", "AWS Access Key", "x", 3, "****")
    assert (row["signature_confidence"], row["entropy"], row["language"]) == ("LOW", 0.0, "")


def test_feature_order_files(spark, tmp_path):
    def saved(data):
        path = tmp_path / "order.json"
        path.write_text(json.dumps(data, indent=1))
        return str(path)

    assert read_feature_order(spark, None) == list(C.FEATURE_ORDER)
    assert read_feature_order(spark, saved(["a", "b"])) == ["a", "b"]
    assert read_feature_order(spark, saved({"feature_order": ["c"]})) == ["c"]
    for bad in ({"x": 1}, [1, 2], "text", {"feature_order": "a"}):
        with pytest.raises(ValueError):
            read_feature_order(spark, saved(bad))


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "x string, y int")
    now = datetime(2024, 5, 6, 7, 8)
    path = write_report(rows, str(tmp_path), "findings", now)
    assert path.endswith("/20240506_0708_2_HYBRID_FINDINGS")
    assert spark.read.csv(path, header=True).collect()[0]["x"] == "a"
    assert write_report(rows.limit(0), str(tmp_path), "confirmed", now) is None
    assert write_review_queue(rows, str(tmp_path / "out.csv")).endswith("/out_review_queue")
    write_csv(rows, str(tmp_path / "plain"))


def test_metrics_json(spark, tmp_path):
    rows = spark.createDataFrame([("AWS Access Key", "CRITICAL", "1")], "provider string, signature_confidence string, label string")
    path = write_metrics(evaluate(rows), str(tmp_path / "m"))
    data = json.loads(spark.read.text(path).first()["value"])
    assert data["rows"] == 1 and data["classification_report"]["1"]["support"] == 1


def test_landed_files_prune_by_language(spark, files, tmp_path):
    path = write_source_files(files(("a.py", "x"), ("b.env", "y")), str(tmp_path / "landed"))
    python = spark.read.parquet(path).where("language = 'python'")
    assert [r["path"] for r in python.collect()] == ["a.py"]
    assert "PartitionFilters: [isnotnull(language" in python._jdf.queryExecution().executedPlan().toString()


def test_a_failed_run_leaves_the_last_report(spark, tmp_path):
    """Neither a job that dies while it writes nor one that dies between the renames loses a report."""
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    path = write_csv(rows, str(tmp_path / "report"))

    @F.udf("string")
    def fails(x):
        if x == 2:
            raise ValueError("killed")
        return "new"

    with pytest.raises(Exception, match="killed"):
        write_csv(rows.repartition(2).withColumn("y", fails("x")), path)
    assert published(spark, path) == path and sorted(os.listdir(tmp_path)) == ["report"]
    assert sorted(r.y for r in spark.read.csv(path, header=True).collect()) == ["a", "b"]

    rename = publish._Store.rename

    def killed(self, old, new):
        if ".staged-" in old:
            raise KeyboardInterrupt
        rename(self, old, new)

    with mock.patch.object(publish._Store, "rename", killed), pytest.raises(KeyboardInterrupt):
        write_csv(rows.limit(1), path)
    assert published(spark, path) == f"{path}.previous"
    assert spark.read.csv(published(spark, path), header=True).count() == 2
    assert write_csv(rows.limit(1), path) == path == published(spark, path)
    assert spark.read.csv(path, header=True).count() == 1
    (part,) = [f for f in os.listdir(path) if f.endswith(".csv")]
    os.remove(os.path.join(path, part))
    with pytest.raises(OSError, match="manifest"):
        published(spark, path)
    with pytest.raises(FileNotFoundError):
        published(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("split", ["1m", "2000"])
def test_csv_of_any_ranges_is_the_same(spark, tmp_path, split):
    rng = random.Random(6)
    cell = lambda: rng.choice(["", "plain", 'say ""hi""'.replace('""', '"'), "two\nlines", "a,b", '\n"\n', "é日\r\nx", "w" * rng.randrange(200), " lead", "back\\slash"])
    want, row = [], 0
    for name in ("b.csv", "a.csv"):
        rows = [[cell() for _ in range(3)] + [str(i)] for i in range(120)]
        with open(tmp_path / name, "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\n")
            writer.writerow(["x", "y", "z", "n"])
            writer.writerows(rows)
        want = rows + want
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = read_csv_ranges(spark, str(tmp_path)).orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.row_id for r in got] == list(range(240))
    assert [list(r)[:4] for r in got] == want
    whole = read_feature_csv(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r.row_id for r in whole] == list(range(240)) and got[0].asDict().keys() == whole[0].asDict().keys()

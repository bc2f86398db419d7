"""Files in chunks against whole files."""

import random

import pytest

from keysieve.operators.chunks import read_chunks, recover_from_chunks
from keysieve.operators.recover import recover_candidates
from keysieve.sources.readers import read_text_files
from tests.test_recovery import _corpus

NAMES = ["path", "sig_ord", "value", "start_index", "end_index", "line_number", "column_number", "window"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("large")
    rng = random.Random(4)
    texts = [r[-1] for r in _corpus(21, 60)]
    (root / "sub").mkdir()
    for name, own in (("a.txt", texts[:25]), ("sub/b.env", texts[25:50]), ("c.md", texts[50:])):
        body = "\n".join(own) + "\n"
        if name == "c.md":
            body += "x " * 3_000 + "AKIA" + "B7" * 8 + " " + "y " * 1_000 + "é AKIA" + "C8" * 8 + "\nend AKIA" + "D9" * 8 + "\n"
        (root / name).write_text(body, newline="")
    (root / "empty.txt").write_text("")
    (root / "code.py").write_text("key = 'AKIA" + "B7" * 8 + "'\n")
    return str(root)


@pytest.mark.parametrize("chars, split", [(500, "1m"), (3_000, "2000"), (1 << 20, "700")])
def test_candidates_are_the_same_for_any_chunk_and_split(spark, folder, chars, split):
    whole = read_text_files(spark, folder).where("path <> 'code.py'")
    want = recover_candidates(whole).withColumnRenamed("file_path", "path").select(*NAMES)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        chunks = read_chunks(spark, folder, chunk_chars=chars)
        got = recover_from_chunks(chunks).withColumnRenamed("file_path", "path").select(*NAMES).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert chunks.count() > 3
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))


def test_one_file_is_many_tasks(spark, tmp_path):
    with open(tmp_path / "big.txt", "w") as out:
        for i in range(60_000):
            out.write(f"line {i} of a large file\n")
        out.write("AKIA" + "B7" * 8 + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        chunks = read_chunks(spark, str(tmp_path), chunk_chars=50_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert chunks.count() >= 20
    (row,) = recover_from_chunks(chunks).collect()
    assert (row.line_number, row.column_number, row.start_index) == (60_001, 1, sum(len(f"line {i} of a large file\n") for i in range(60_000)))

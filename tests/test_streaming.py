"""Files that arrive over time."""

import random

from pyspark.sql import functions as F

from keysieve.operators.recover import first_wins, recover_candidates
from keysieve.plans.triage import analyze
from keysieve.streaming.incremental import (
    IDENTITY, first_wins_as_it_arrives, incremental_analyses, report_each_batch,
)
from tests.conftest import SOURCE_SCHEMA

KEY = "Lt3whkyVHH7iAtP28iNIq7hVNlK638vR"


def end_of(writer):
    """Run a stream over what has arrived."""
    query = writer.trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()


def test_the_first_signature_keeps_a_value_in_a_stream_too(files):
    value = "a" * 8 + "0123456789abcdef" * 2
    source = files(("a.env", f"x = key-{KEY} {value[:40]} key-{KEY}\n"))
    every = recover_candidates(source)
    once = recover_candidates(source, once_per_line=True)
    wanted = {(r.value, r.sig_ord, r.start_index) for r in first_wins(every).collect()}
    assert {(r.value, r.sig_ord, r.start_index) for r in once.collect()} == wanted
    assert every.count() > once.count() == len(wanted)


def test_repeats_are_reported_once(spark, tmp_path):
    landing, schema = str(tmp_path / "in"), SOURCE_SCHEMA + ", arrived_at timestamp"

    def land(file_id, path):
        row = (file_id, file_id, "acme", path, "u", "r", f'API_KEY = "{KEY}"\n')
        batch = spark.createDataFrame([row], SOURCE_SCHEMA).withColumn(
            "arrived_at", F.timestamp_seconds(F.lit(1_700_000_000 + file_id)))
        batch.write.mode("append").parquet(landing)

    seen = []
    land(1, "a.py")
    arriving = spark.readStream.schema(schema).parquet(landing)
    def run():
        writer = report_each_batch(incremental_analyses(arriving), lambda rows, _: seen.extend(r["File"] for r in rows.collect()))
        end_of(writer.option("checkpointLocation", str(tmp_path / "state")))

    run()
    land(2, "a.py")
    land(3, "b.py")
    run()
    assert sorted(seen) == ["a.py", "b.py"]


def run_in_batches(rows, tmp_path, handle):
    end_of(rows.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", str(tmp_path / "state")))


def test_stream_and_batch_agree_on_shuffled_arrivals(spark, tmp_path):
    rng = random.Random(5)
    rows = [
        (f"r{rng.randrange(2)}", f"f{rng.randrange(10)}.py", f"v{rng.randrange(8)}", rng.randrange(4), rng.randrange(10**15), rng.randrange(17),
         rng.randrange(10**6), [f"call {i}"], None if i % 3 else i / 7)
        for i in range(9_500)
    ]
    rows += rng.sample(rows, 500)
    rng.shuffle(rows)
    schema = "repository string, file_path string, value string, line_number int, file_ord long, sig_ord int, start_index int, calls array<string>, x double"
    landing = str(tmp_path / "in")
    for i in range(4):
        spark.createDataFrame(rows[i::4], schema).coalesce(1).write.mode("append").parquet(landing)
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
    seen, told = {}, []

    def handle(batch, number):
        for r in batch.collect():
            assert r.revises == ((key := tuple(r[c] for c in IDENTITY)) in seen)
            seen[key] = tuple(r)[:-1]
        told.append(number)

    run_in_batches(first_wins_as_it_arrives(arriving), tmp_path, handle)
    kept = first_wins(spark.createDataFrame(rows, schema)).collect()
    assert len(told) >= 4 and sorted(map(str, seen.values())) == sorted(str(tuple(r)) for r in kept)


def test_copies_and_segments_end_as_in_a_batch(spark, files, tmp_path):
    """A later arrival of an earlier file takes over, and one line may lie in several segments."""
    value = "0123456789abcdef" * 4
    long_line = f"k = {value} " + "x " * 6_000 + f"key-{KEY} {value}"
    rows = files(("a.env", long_line), ("a.env", long_line), ("b.env", f"A={KEY}\n"), ("b.env", f"A={KEY}\n"))
    landing = str(tmp_path / "in")
    for file_id in (4, 2, 1, 3):
        rows.where(f"file_id = {file_id}").coalesce(1).write.mode("append").parquet(landing)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(landing)
    last = {}

    def handle(batch, _):
        for r in batch.collect():
            last[r.repository, r.file_path, r.value, r.line_number] = (r.file_id, r.sig_ord, r.start_index, r.confidence)

    run_in_batches(incremental_analyses(arriving), tmp_path, handle)
    want = {(r.repository, r.file_path, r.value, r.line_number): (r.file_id, r.sig_ord, r.start_index, r.confidence) for r in analyze(rows).collect()}
    assert last == want and {v[0] for v in last.values()} == {1, 3}

"""Archives read back, are the same each time, and hold equal payloads once."""

import base64
import hashlib

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from keysieve.llm import common, warc

PAGES = "page_id long, url string, html string, digest string, shard int"
ROWS = [
    (3, "http://a.test/%41 b\r\nX: y", "<p>one</p>"), (1, "http://a.test/1", "<p>one</p>"), (7, None, "<p>one</p>"), (7, None, "<p>one</p>"),
    (2, "http://ü.test/", "é" * 70_000), (4, "", None), (5, "http://b.test", ""), (9, "http://c.test", "WARC/1.1\r\n\r\nnested"),
    (None, "http://d.test", "<p>one</p>"), (-6, "http://e.test", "low"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)


def expected(rows, least=0):
    keeper = {}
    for page, _, html in rows:
        if page is not None:
            keeper[html or ""] = max(keeper.get(html or "", page), page)
    out = []
    for page, url, html in rows:
        payload = (html or "").encode()
        revisit = page is not None and page < keeper[html or ""] and len(payload) >= least
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, url, "revisit" if revisit else "response", len(payload), digest, keeper[html or ""] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard, roll, least", [(warc.SHARD_BYTES, warc.ROLL_BYTES, 0), (600, 300, 0), (1, 1, 11)])
def test_round_trip_and_same_bytes(spark, shard, roll, least):
    found = []
    for rows in (frame(spark, ROWS), frame(spark, ROWS[::-1]).repartition(5)):
        folder = common.shared_folder(spark)
        found.append(warc.write_archives(rows, folder, shard, roll, least))
        got = warc.read_archives(spark, folder, with_payload=True).collect()
        assert sorted(((r.page_id, r.url, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in got), key=str) == expected(ROWS, least)
        assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} >= {h or "" for _, _, h in ROWS}
        store, base = fs.FileSystem.from_uri(folder)
        names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(f"{base}/archive")) if not f.base_name.startswith("."))
        assert names == [r["final"].removeprefix("archive/") for r in found[-1]]
        assert store.get_file_info(f"{base}/_temporary").type == fs.FileType.NotFound
    assert found[0] == found[1]


def test_shards_stay_even_with_far_hot_and_missing_ids(spark, monkeypatch):
    ids = [*range(400), 1 << 62, -(1 << 62), *[77] * 300, *[None] * 300]
    sums = spark.createDataFrame([(i, str(k), 1000) for k, i in enumerate(ids)], "page_id long, digest string, size long").withColumn("url", F.lit("u"))
    monkeypatch.setattr(warc, "ID_BINS", 32)
    ranges = warc._Ranges(sums, 20_000)
    sizes = [r["count"] for r in sums.groupBy(ranges.column().alias("shard")).count().collect()]
    assert sum(sizes) == len(ids) and 40 <= len(sizes) <= ranges.count <= 80 and max(sizes) <= 60
    rows = [(i, "http://a.test", f"<p>{i} {k % 9}</p>") for k, i in enumerate(ids)]
    folder = common.shared_folder(spark)
    assert warc.archived(frame(spark, rows), folder, 4000, 2000).agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read_archives(spark, folder).collect()
    assert sorted(((r.page_id, r.url, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in got), key=str) == expected(rows)


def test_an_unfinished_archive_is_refused(spark):
    folder = common.shared_folder(spark)
    warc.archived(frame(spark, ROWS), folder)
    store, base = fs.FileSystem.from_uri(folder)
    store.move(f"{base}/manifest.json", f"{base}/manifest.gone")
    with pytest.raises(FileNotFoundError):
        warc.read_archives(spark, folder)


def test_no_pages(spark):
    folder = common.shared_folder(spark)
    assert warc.write_archives(frame(spark, []), folder) == []
    assert warc.read_archives(spark, folder).count() == 0


def test_damage_is_noticed():
    record = warc._record("response", [("WARC-Record-ID", "<urn:page:1:X>")], b"abc")
    import gzip

    assert [b for _, b in warc.records_of(record)] == [b"abc"]
    with pytest.raises(ValueError):
        list(warc.records_of(gzip.compress(gzip.decompress(record).replace(b"abc", b"abd"))))

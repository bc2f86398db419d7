"""Web archives: a deterministic sharded writer and its reader.

Page ids are cut into ranges of about equal payload, found by splitting heavy ranges until
none is; each range is one shard, sorted, and one task. A task writes its shard as WARC
files, one gzip member to a record, and starts a new file once a compressed size is reached.
Headers and digests are made anew from the payloads. Files are written under temporary
names; tasks of a second job rename those that finished tasks name (a name already given
stays), a third writes the list of files, and the driver then puts the totals into
``manifest.json``, without which nothing is read. So a lost or repeated task leaves nothing
in the archive, and no row per file or page reaches the driver. Same input, same bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.llm import common as K

#: Bins of one round that splits heavy id ranges, if few of them are heavy.
ID_BINS = 4096
#: Shards at most, so that their limits stay small; beyond it they grow with the input.
MAX_SHARDS = 1 << 16
SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
#: Equal payloads shorter than this are all written in full.
LEAST_SHARED = 0
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "temporary string, final string, records long, bytes long, sha256 string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id, digest: str) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{digest}"


def _record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    raw = b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def _page_record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    digest = digest_of(payload)
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    # A header line can't hold line ends or blanks at its ends; percent signs keep what is encoded apart.
    target = None if url is None else "".join(f"%{b:02X}" if b <= 32 or b in (37, 127) else chr(b) for b in url.encode()).encode("latin-1")
    fields = [
        ("WARC-Record-ID", f"<{record_uri(page_id, digest)}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", None if target is None else target.decode("utf-8")),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{record_uri(refers_to, digest)}>")]
    return _record("revisit" if revisit else "response", fields, http if revisit else http + payload)


class _Roller:
    """Files of one shard under temporary names; closed files become manifest rows."""

    def __init__(self, folder: str, shard: int, roll: int):
        self._fs, self._base = fs.FileSystem.from_uri(folder)
        self._shard, self._roll, self._next, self._out = shard, roll, 0, None
        self.closed: list[tuple] = []

    def write(self, record: bytes) -> None:
        if self._out is None:
            name = f"{self._shard:06d}-{self._next:05d}"
            self._next += 1
            self._name = f"_temporary/{name}-{uuid.uuid4().hex}.warc.gz", f"archive/{name}.warc.gz"
            self._out = self._fs.open_output_stream(f"{self._base}/{self._name[0]}", compression=None)
            self._records, self._size, self._sum = 0, 0, hashlib.sha256()
            info = _record("warcinfo", [
                ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", f"{name}.warc.gz"),
                ("Content-Type", "application/warc-fields"),
            ], b"format: WARC File Format 1.1\r\n")
            self._put(info)
        self._put(record)
        self._records += 1
        if self._size >= self._roll:
            self.close()

    def _put(self, data: bytes) -> None:
        self._out.write(data)
        self._size += len(data)
        self._sum.update(data)

    def close(self) -> None:
        if self._out is not None:
            self._out.close()
            self.closed.append((*self._name, self._records, self._size, self._sum.hexdigest()))
            self._out = None


def _revisits(sums: DataFrame, least: int) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload a page with a larger id also has."""
    keepers = (
        sums.where(F.col("size") >= least).groupBy("digest")
        .agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least_id"))
        .where("least_id < refers_to").drop("least_id")
    )
    return sums.join(keepers, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


class _Ranges:
    """Id ranges of about equal payload: the first id of each, its first shard and how many it has."""

    def __init__(self, sums: DataFrame, shard_bytes: int):
        ids = sums.where("page_id IS NOT NULL").select(F.col("page_id").cast("long").alias("id"), (F.col("size") + 256).alias("size"))
        low, high, total = ids.agg(F.min("id"), F.max("id"), F.sum("size")).first()
        self.target = max(shard_bytes, -(-(total or 0) // MAX_SHARDS))
        leaves, heavy = [], [(low, high)] if total else []
        while heavy:
            found = self._split(ids, heavy)
            leaves += [x for x in found if x[2] <= self.target or x[0] == x[1]]
            heavy = sorted(x[:2] for x in found if x[2] > self.target and x[0] < x[1])
        self.first, self.shard, self.shards = [], [], []
        before, last = 0, None
        for start, end, size, n in sorted(leaves):
            hot = size > self.target
            # An id of more rows than a shard takes has shards of its own.
            now = (start,) if hot else before // self.target
            if now != last:
                self.first.append(start)
                self.shard.append(self.shard[-1] + self.shards[-1] if self.shard else 0)
                self.shards.append(min(n, -(-size // self.target)) if hot else 1)
            before, last = before + (0 if hot else size), now
        nameless = sums.where("page_id IS NULL").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("size") + 256), F.lit(0))).first()
        self.count = max(self.shard[-1] + self.shards[-1] if self.shard else 1, min(nameless[0], nameless[1] // self.target))

    @staticmethod
    def _split(ids: DataFrame, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(first id, last id, bytes, rows) of the parts of all ``ranges``, which are sorted, that hold ids."""
        parts = max(16, ID_BINS // len(ranges))
        start = np.array([a for a, _ in ranges], np.int64)
        end = np.array([b for _, b in ranges], np.int64)
        widths = [-(-(b - a + 1) // parts) for a, b in ranges]
        width = np.array(widths, np.uint64)

        @F.pandas_udf("long")
        def part(own: pd.Series) -> pd.Series:
            x = own.to_numpy(np.int64)
            at = np.searchsorted(start, x, "right") - 1
            inside = (at >= 0) & (x <= end[at])
            step = (x.view(np.uint64) - start[at].view(np.uint64)) // width[at]
            return pd.Series(np.where(inside, at * parts + step.astype(np.int64), -1))

        found = ids.groupBy(part("id").alias("part")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).where("part >= 0").toArrow()
        out = []
        for p, size, n in zip(*(found[c].to_pylist() for c in ("part", "size", "n"))):
            at, step = divmod(p, parts)
            a = ranges[at][0] + step * widths[at]
            out.append((a, min(a + widths[at] - 1, ranges[at][1]), size, n))
        return out

    def column(self):
        """Shard of a row by ``page_id`` and ``digest``; rows without an id spread over all."""
        first, shard, shards = (np.array(x, np.int64) for x in (self.first, self.shard, self.shards))

        @F.pandas_udf("long")
        def of(own: pd.Series, digest: pd.Series) -> pd.Series:
            at = np.maximum(np.searchsorted(first, own.to_numpy(np.int64), "right") - 1, 0)
            return pd.Series(shard[at] + digest.to_numpy(np.int64) % shards[at])

        known = of(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.xxhash64("digest")) if self.first else F.lit(0).cast("long")
        return F.when(F.col("page_id").isNotNull(), known).otherwise(F.pmod(F.xxhash64("digest", "url"), F.lit(self.count)))


def archived(
    pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least_shared: int = LEAST_SHARED
) -> DataFrame:
    """Write ``pages`` (page_id whole number, url, html) below ``folder``; (final, records, bytes, sha256) of its files.

    A null html is an empty payload. Of equal payloads the one with the largest id is the
    response, the smaller ids revisit it; rows that repeat the largest id are responses too,
    and so are rows with a null id. No rows give an empty archive.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload")).withColumn("digest", F.sha1("payload"))
    id_type = pages.schema["page_id"].dataType.simpleString()
    sums = K.settled(rows.select("page_id", "digest", F.octet_length("payload").cast("long").alias("size")))
    notes = _revisits(sums, least_shared).select(
        "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), "digest", "refers_to", F.lit(0).alias("kind")
    )
    both = notes.unionByName(rows.withColumns({"refers_to": F.lit(None).cast(id_type), "kind": F.lit(1)}))
    ranges = _Ranges(sums, shard_bytes)
    dealt = (
        both.withColumn("shard", ranges.column()).repartitionById(ranges.count, F.col("shard").cast("int"))
        .sortWithinPartitions("shard", "page_id", "kind", "digest", "url")
    )
    store, base = fs.FileSystem.from_uri(folder)
    for part in ("_temporary", "archive"):
        store.create_dir(f"{base}/{part}", recursive=True)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roller, shard, noted, refers = None, None, None, {}
        for frame in frames:
            columns = [frame[c].array for c in ("shard", "url", "payload", "digest", "kind")]
            ids = [None if pd.isna(x) else int(x) for x in frame["page_id"]]
            targets = [None if pd.isna(x) else int(x) for x in frame["refers_to"]]
            for own, url, payload, digest, kind, page, target in zip(*columns, ids, targets):
                if own != shard:
                    if roller:
                        roller.close()
                        yield from _manifest_rows(roller)
                    roller, shard = _Roller(folder, int(own), roll_bytes), own
                if page != noted:
                    noted, refers = page, {}
                if kind == 0:
                    refers[digest] = target
                else:
                    link = url if isinstance(url, str) else None
                    roller.write(_page_record(page, link, K.encoded([payload])[0], refers.get(digest)))
                    yield from _manifest_rows(roller)
        if roller:
            roller.close()
            yield from _manifest_rows(roller)

    def name(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        for frame in frames:
            for old, new in zip(frame["temporary"], frame["final"]):
                if store.get_file_info(f"{base}/{old}").type == fs.FileType.File:
                    store.move(f"{base}/{old}", f"{base}/{new}")
                elif store.get_file_info(f"{base}/{new}").type != fs.FileType.File:
                    raise FileNotFoundError(f"{base}/{old}")
            yield frame.drop(columns="temporary")

    # Nullable ids travel as text, so that no large one turns into a float.
    sent = dealt.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    written = K.settled(sent.mapInPandas(write, _MANIFEST))
    files = K.settled(written.mapInPandas(name, _MANIFEST.partition(", ")[2]))
    files.write.json(f"{folder}/manifest")
    totals = files.agg(F.count(F.lit(1)).alias("files"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("records", "bytes"))).first()
    with store.open_output_stream(f"{base}/_temporary/manifest.json") as out:
        out.write((json.dumps(totals.asDict()) + "\n").encode())
    store.move(f"{base}/_temporary/manifest.json", f"{base}/manifest.json")
    store.delete_dir(f"{base}/_temporary")
    return files


def write_archives(
    pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least_shared: int = LEAST_SHARED
) -> list[dict]:
    """``archived``, whose list of files comes back sorted, for archives of few files."""
    return [r.asDict() for r in archived(pages, folder, shard_bytes, roll_bytes, least_shared).orderBy("final").collect()]


def _manifest_rows(roller: _Roller) -> Iterator[pd.DataFrame]:
    if roller.closed:
        yield pd.DataFrame(roller.closed, columns=["temporary", "final", "records", "bytes", "sha256"])
        roller.closed = []


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of one archive file."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data))
    while line := stream.readline():
        if line.rstrip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).rstrip(b"\r\n"):
            name, _, value = line.decode().partition(":")
            fields[name] = value.strip()
        block = stream.read(int(fields["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{digest_of(block)}":
            raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
        yield fields, block


def _page_of(uri: str | None) -> str | None:
    return (uri[1:-1].split(":")[2] or None) if uri else None


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False, page_type: str = "long") -> DataFrame:
    """Page records of the committed files, each digest checked against its block and payload.

    A file is read by one task as one row; ``ROLL_BYTES`` bounds its size. An archive
    without ``manifest.json`` was not finished and is refused.
    """
    store, base = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{base}/manifest.json").type != fs.FileType.File:
        raise FileNotFoundError(f"{folder}/manifest.json")
    schema = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                rows = []
                for fields, block in records_of(bytes(data)):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    payload, digest = block.partition(b"\r\n\r\n")[2], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and digest_of(payload) != digest:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
                    url = fields.get("WARC-Target-URI")
                    rows.append((
                        _page_of(fields["WARC-Record-ID"]), None if url is None else _decoded(url), fields["WARC-Type"],
                        int(fields["X-Payload-Length"]), digest, _page_of(fields.get("WARC-Refers-To")),
                        payload if with_payload and fields["WARC-Type"] == "response" else None,
                    ))
                yield pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    rows = files.load(f"{folder}/archive").select("content").mapInPandas(parse, schema)
    rows = rows.withColumns({c: F.col(c).cast(page_type) for c in ("page_id", "refers_to")})
    return rows if with_payload else rows.drop("payload")


def _decoded(url: str) -> str:
    out, i = bytearray(), 0
    raw = url.encode()
    while i < len(raw):
        if raw[i] == 37:
            out.append(int(raw[i + 1 : i + 3], 16))
            i += 2
        else:
            out.append(raw[i])
        i += 1
    return out.decode()


cloudpickle.register_pickle_by_value(sys.modules[__name__])

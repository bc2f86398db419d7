"""Shared folder, bounded blocks of text and word hashes for the operators of this package."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at a time; arrays take some 50 bytes for each.
BLOCK_BYTES = 1 << 20
#: Texts that go to a Python worker at a time.
BATCH_ROWS = 1_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session may leave the setting out; it then gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        named = tempfile.mkdtemp(prefix="keysieve-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}"


def settled(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` written to the shared folder and read back: no lineage, safe from lost executors."""
    spark = rows.sparkSession
    path = path or shared_folder(spark)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete settled tables that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def in_batches(texts: DataFrame) -> DataFrame:
    """``texts`` as they are; from now on the session sends at most ``BATCH_ROWS`` rows to a worker at a time."""
    conf, name = texts.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return texts


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, at most ``BATCH_ROWS`` rows go to a worker at a time; for jobs that run inside."""
    conf, name = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        conf.set(name, before)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """While it lasts, each job's shuffle files go when the job ends; for jobs whose results are settled."""
    conf, name = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        yield
    finally:
        conf.set(name, before)


#: Size of a map of ids: a fixed number of bits, whatever it maps.
MAP_BITS = 22


def fresh(name: str, rows: DataFrame) -> str:
    """``name``, longer by underscores until no column of ``rows`` has it."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def may_hold(ids: DataFrame, column: str = "doc_id"):
    """Condition that is true for every row whose ``column`` is in ``ids``, and for few others while those are few.

    The ids set bits of a map of fixed size, which goes to the tasks; nulls are in no map.
    """
    bucket = F.pmod(F.xxhash64(column), F.lit(1 << MAP_BITS))
    bits = np.zeros(1 << MAP_BITS, bool)
    bits[ids.where(F.col(column).isNotNull()).select(bucket.alias("bucket")).distinct().toArrow()["bucket"].to_numpy()] = True
    shared = ids.sparkSession.sparkContext.broadcast(np.packbits(bits))

    @F.pandas_udf("boolean")
    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            at = batch.to_numpy(np.int64)
            yield pd.Series((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

    return F.col(column).isNotNull() & marked(bucket)


def encoded(texts: Iterable[str | None]) -> list[bytes]:
    """UTF-8 bytes; null is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts have about ``limit`` bytes together; a longer text stands alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that any of their bits can pick a bucket."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x5851F42D4C957F2D


class _Powers:
    """Powers of the base and of its inverse; a copy sent to another process starts empty."""

    def __init__(self) -> None:
        self._up = self._down = np.zeros(0, np.uint64)

    def __reduce__(self):
        return _Powers, ()

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 2))
            self._up = np.full(size, _BASE, np.uint64).cumprod()
            self._down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64).cumprod()
        return self._up, self._down


POWERS = _Powers()


class SpanHashes:
    """Hashes of any byte spans of one buffer, from its running polynomial."""

    def __init__(self, buffer: np.ndarray):
        up, self._down = POWERS.upto(len(buffer) + 1)
        self._run = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(_BYTE[buffer] * up[: len(buffer)], out=self._run[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._run[ends] - self._run[starts]) * self._down[starts])


def joined(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of the translated texts with a blank around each, and the texts' starts in it."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.concatenate([[1], 1 + np.cumsum(sizes)])[:-1]
    return np.frombuffer((b" " + b" ".join(texts) + b" ").translate(table), np.uint8), starts


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the true runs of a mask whose first and last items are false."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edge[::2], edge[1::2]


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first weight is the intercept."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


# Functions travel to the executors whole, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

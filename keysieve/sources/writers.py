"""Writers for reports, feature tables, labelled rows, queues and metrics."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve import catalog as C
from keysieve.functions.lineage import stored
from keysieve.sources.publish import save
from keysieve.sources.readers import landed_by_address


def write_csv(rows: DataFrame, path: str) -> str:
    """CSV that the feature reader reads back unchanged; an earlier one stays until this is whole."""
    return save(rows.write.option("header", True).option("escape", '"'), rows.sparkSession, path, "csv")


def write_report(rows: DataFrame, directory: str, kind: str, now: datetime | None = None) -> str | None:
    """Timestamped CSV report; no rows, no file.

    ``kind`` is ``raw_hits``, ``findings`` or ``confirmed``.
    """
    rows = stored(rows)
    if rows.isEmpty():
        return None
    stamp = (now or datetime.now()).strftime("%Y%m%d_%H%M")
    return write_csv(rows, f"{directory.rstrip('/')}/{stamp}_{C.REPORT_SUFFIXES[kind]}")


def write_features(feature_rows: DataFrame, path: str, format: str = "parquet") -> str:
    """All candidates' feature rows; Parquet to work on, CSV to exchange."""
    if format == "csv":
        return write_csv(feature_rows, path)
    return save(feature_rows.write, feature_rows.sparkSession, path, format)


def write_labelled(rows: DataFrame, path: str) -> str:
    return write_csv(rows, path)


def write_review_queue(queue: DataFrame, labelled_path: str) -> str:
    """Queue beside the labelled table, named after it."""
    stem = labelled_path.rstrip("/")
    folder, _, name = stem.rpartition("/")
    name = name.rsplit(".", 1)[0] if "." in name[1:] else name
    return write_csv(queue, f"{folder}/{name}_review_queue" if folder else f"{name}_review_queue")


def write_metrics(metrics: DataFrame, path: str) -> str:
    """One JSON document per metrics row."""
    texts = metrics.select(F.to_json(F.struct(*metrics.columns)).alias("value"))
    return save(texts.write, metrics.sparkSession, path, "text")


def write_source_files(files: DataFrame, path: str) -> str:
    """Land files split by language, so that one language can be read alone."""
    from keysieve.functions.paths import language

    named = files.withColumn("language", language(F.col("path")))
    return save(named.write.partitionBy("language"), files.sparkSession, path, "parquet")


def land_by_address(files: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """Land files in buckets of their ``raw_url``, a Parquet file for each bucket, and read them back.

    Texts are shuffled here, once; joins on ``raw_url`` then read them where they lie.
    Files without an address or content can't be attached to anything and are left
    out. ``buckets`` is the number of tasks that such a join has, by default the
    session's number of shuffle partitions.
    """
    spark = files.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    usable = files.where((F.col("raw_url") != "") & F.col("content").isNotNull())
    (
        usable.repartition(buckets, "raw_url").write.mode("overwrite").bucketBy(buckets, "raw_url")
        .option("path", path).format("parquet").saveAsTable(f"landed_{uuid.uuid4().hex}")
    )
    about = json.dumps({"buckets": buckets, "schema": files.schema.jsonValue()})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_buckets")
    return landed_by_address(spark, path)

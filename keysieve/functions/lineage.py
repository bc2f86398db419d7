"""Write an intermediate table once where several jobs read it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` as a Parquet table in the shared checkpoint folder, so that each reader takes its columns only."""
    spark = rows.sparkSession
    path = new_path(spark)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def new_path(spark: SparkSession) -> str:
    """A path under the shared checkpoint folder that nothing has."""
    return f"{_shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def _shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder all executors share.")
        named = tempfile.mkdtemp(prefix="keysieve-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def checkpointed(rows: DataFrame) -> DataFrame:
    """A copy of ``rows`` in the shared checkpoint folder, safe from lost executors.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where
    none is named, a local session gets a temporary one; a cluster must name it,
    since no folder of one machine outlives that machine.
    """
    context = rows.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(_shared_folder(rows.sparkSession))
    return rows.checkpoint()

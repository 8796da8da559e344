"""Tables written between the rounds of an iteration, to cut its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fresh(spark: SparkSession) -> str:
    """A new path in ``spark.checkpoint.dir``; a local session may lack that folder and gets one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="brineloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/round-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back."""
    path = _fresh(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_as(df: DataFrame, kind: str, **options) -> str:
    """Write in another format to the shared folder; returns the path."""
    path = _fresh(df.sparkSession)
    df.write.options(**options).format(kind).save(path)
    return path

"""The folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where it is unset and Spark is one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="corpusloom-"))
    return _local[0]


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: what asks for it more than once makes it once."""
    path = f"{shared_folder(df.sparkSession)}/corpusloom/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)

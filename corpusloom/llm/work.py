"""Where operators keep intermediate tables, and how they move packed rows between tasks."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a text table that a Python task looks at together.
ROWS = 1000

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where it is unset, a temporary folder serves a Spark that runs in one process on one machine (tests); elsewhere
    that is an error, since executors don't see each other's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="corpusloom-"))
    return _local[0]


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, its lineage cut, safe against lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, from which bucket counts follow."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of text for each task of a deal, which holds what comes of its share in memory: some times as much.
SHARE = 8 << 20


def tasks(docs: DataFrame, text: str = "text") -> int:
    """Tasks of a deal of texts: the session's shuffle width, and more where a task's share would be larger than SHARE."""
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long"))).first()[0]
    return max(partitions(docs.sparkSession), -(-(size or 0) // SHARE))


def dealt(df: DataFrame, n: int, *order: str) -> DataFrame:
    """df with the rows of each of n buckets one after another in a task of its own, sorted by `order`."""
    return df.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket", *order)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of one bucket after another; the bucket is the first column."""
    have, rows = None, []
    for batch in batches:
        ids = batch.column(0).to_numpy()
        cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(ids)]):
            if a == b:
                continue
            if rows and ids[a] != have:
                yield rows
                rows = []
            have = ids[a]
            rows.append(batch.slice(a, b - a))
    if rows:
        yield rows


#: What a worker keeps between slices of a task and forgets when the task ends.
_kept: list[Callable[[], None]] = []


def forgotten_after_task(forget: Callable[[], None]) -> None:
    """Registers a function that empties something that a module keeps in the worker."""
    _kept.append(forget)


def release() -> None:
    """Empties what is registered and gives free memory back; idle workers stay, and each would keep its share."""
    for forget in _kept:
        forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over slices of at most ROWS rows; when the task ends, its worker, which stays, gives free memory back."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS))
        finally:
            release()

    return inner

"""Tables kept in buckets of keys: a change reads and writes the buckets that it touches, and readers see it whole or not at all.

A bucket's versions take turns in PLACES places. A change writes the buckets that it touches in their next place, beside
the one that readers use, over a version that no snapshot of late names. Then an entry of the log names the live place
of every bucket under the table's next version. So folders stay as many as places times buckets, and a reader may go on
with a snapshot while a bucket is written PLACES - 1 times. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, PLACES = 64, 8
_ENTRY = "version long, buckets int, bucket int, place int"


@dataclass
class Snapshot:
    """The newest version of a table, the number of its buckets, and the live place of each that isn't empty."""

    version: int = -1
    buckets: int = BUCKETS
    live: dict[int, int] = field(default_factory=dict)


def snapshot(spark: SparkSession, table: str) -> Snapshot:
    """What the log says; the state before the first version if there is no log."""
    try:
        entries = spark.read.schema(_ENTRY).parquet(f"{table}/log").collect()  # PLACES times the buckets at most
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return Snapshot()
        raise
    version = max((e.version for e in entries), default=-1)
    newest = [e for e in entries if e.version == version]
    return Snapshot(version, newest[0].buckets, {e.bucket: e.place for e in newest}) if newest else Snapshot()


def _read(spark: SparkSession, table: str, live: dict[int, int]) -> DataFrame | None:
    if not live:
        return None
    folders = [f"{table}/data/place={p}/bucket={b}" for b, p in live.items()]
    return spark.read.option("basePath", f"{table}/data").option("mergeSchema", "true").parquet(*folders).drop("place", "bucket")


def read_table(spark: SparkSession, table: str) -> DataFrame | None:
    """The rows of the newest version; None before the first. Only live folders are listed."""
    return _read(spark, table, snapshot(spark, table).live)


def change(table: str, rows: DataFrame, keys: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
    """Applies rows to a table: merge gives the new content of the touched buckets from their old rows (None: no table yet or none there) and the new ones.

    merge keeps each row's keys, and takes away no last row of a bucket. `buckets` counts for a new table only.
    """
    spark = rows.sparkSession
    was = snapshot(spark, table)
    n = was.buckets if was.version >= 0 else buckets
    bucket = F.pmod(F.hash(*keys), F.lit(n)).alias("bucket")
    rows = rows.persist()
    touched = sorted(r.bucket for r in rows.select(bucket).distinct().collect())  # as many as buckets at most
    if touched:
        live = was.live | {b: (was.live.get(b, -1) + 1) % PLACES for b in touched}
        new = merge(_read(spark, table, {b: was.live[b] for b in touched if b in was.live}), rows)
        places = spark.createDataFrame([(b, live[b]) for b in touched], "bucket int, place int")
        new.withColumn("bucket", bucket).join(F.broadcast(places), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("place", "bucket").parquet(f"{table}/data")
        entry = spark.createDataFrame([(was.version + 1, n, b, p) for b, p in live.items()], _ENTRY)
        entry.coalesce(1).write.mode("overwrite").parquet(f"{table}/log/at={(was.version + 1) % PLACES}")
    rows.unpersist()

"""The nearest vectors of many queries by tiles: one matrix product for a tile of queries and a tile of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of vectors up to which one side is broadcast, and of a tile where neither is.
BROADCAST_BYTES, TILE_BYTES = 1 << 25, 1 << 24


def vector_bytes(rows: DataFrame, vector: str = "vector") -> int:
    """Bytes of a table's vectors as doubles."""
    return 8 * (rows.agg(F.sum(F.size(vector).cast("long"))).first()[0] or 0)


def _best(asked: pd.DataFrame, rows: pd.DataFrame, k: int, digits: int, keys: list[str], kept: list[str], apart: tuple[str, str] | None) -> pd.DataFrame:
    """The k best rows (in the order in which ties go) for each query, among vectors of its length."""
    out = [pd.DataFrame({**{c: asked[c].iloc[:0] for c in keys}, **{c: rows[c].iloc[:0] for c in kept}, "score": pd.Series([], dtype=float)})]
    lengths = rows["vector"].str.len()
    for d, queries in asked.groupby(asked["vector"].str.len()):
        own = rows[lengths == d]
        if not len(own):
            continue
        q, v = (np.stack(x["vector"].to_numpy()).astype(np.float64) for x in (queries, own))
        score = np.round((q @ v.T) / np.maximum(np.sqrt((q**2).sum(axis=1))[:, None] * np.sqrt((v**2).sum(axis=1))[None], 1e-9), digits)
        if apart:
            score[queries[apart[0]].to_numpy()[:, None] == own[apart[1]].to_numpy()[None]] = -np.inf
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(score, order, axis=1)
        found = best > -np.inf
        which = np.repeat(np.arange(len(queries)), found.sum(axis=1))
        parts = [queries[keys].iloc[which].reset_index(drop=True), own[kept].iloc[order[found]].reset_index(drop=True)]
        out.append(pd.concat(parts, axis=1).assign(score=best[found]))
    return pd.concat(out, ignore_index=True)


def nearest_rows(queries: DataFrame, vectors: DataFrame, k: int, ties: list[str], digits: int = 9, apart: tuple[str, str] | None = None) -> DataFrame:
    """The k rows of vectors with the highest cosine for each row of queries, exactly: the columns of both but for `vector`, score and place.

    The columns of queries tell its rows apart, and their names differ from those of vectors; ties of scores (rounded)
    go by the columns `ties` of vectors. Null vectors and those that hold nulls take no part; only equal lengths are compared. apart: a column
    of each side that must differ. A side whose vectors take BROADCAST_BYTES at most is broadcast; otherwise tiles of
    both meet, each TILE_BYTES at most, and their best are merged.
    """
    keys, kept = [c for c in queries.columns if c != "vector"], [c for c in vectors.columns if c != "vector"]
    whole = lambda df: df.withColumn("vector", F.col("vector").cast("array<double>")).where(F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False)) & (F.size("vector") > 0))
    asked, rows = whole(queries), whole(vectors)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*asked.schema, *rows.schema] if f.name != "vector") + ", score double"
    spark = queries.sparkSession
    q_bytes, v_bytes = vector_bytes(asked), vector_bytes(rows)

    def by_ties(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.sort_values(ties, kind="stable")

    def mapped(make: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), 1024):
                    yield make(frame.iloc[at : at + 1024])

        return run

    if v_bytes <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast(by_ties(rows.toArrow().to_pandas()))
        found = asked.mapInPandas(mapped(lambda some: _best(some, shared.value, k, digits, keys, kept, apart)), schema)
    elif q_bytes <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast(asked.toArrow().to_pandas())
        found = rows.mapInPandas(mapped(lambda some: _best(shared.value, by_ties(some), k, digits, keys, kept, apart)), schema)
    else:
        q_tiles, v_tiles = (max(1, -(-n // TILE_BYTES)) for n in (q_bytes, v_bytes))
        tile = lambda df, n: F.pmod(F.xxhash64(*[c for c in df.columns if c != "vector"]), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = asked.withColumn("_q", tile(asked, q_tiles)).withColumn("_v", every(v_tiles))
        right = rows.withColumn("_v", tile(rows, v_tiles)).withColumn("_q", every(q_tiles))
        found = left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInPandas(lambda a, b: _best(a, by_ties(b), k, digits, keys, kept, apart), schema)
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), *ties))
    return found.withColumn("place", place).where(F.col("place") <= k)

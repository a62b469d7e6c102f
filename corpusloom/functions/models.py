"""Hooks for models: encoders, pair scorers and enrichers are functions that the caller passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import ArrayType, DoubleType, FloatType

DIM = 64


def hashed_ngrams(texts: list[str], dim: int = DIM) -> np.ndarray:
    """A vector for each text from its hashed character trigrams: no model, the same everywhere."""
    out = np.zeros((len(texts), dim), dtype=np.float32)
    for i, t in enumerate(texts):
        t = f" {t.lower()} "
        for j in range(len(t) - 2):
            h = xxhash.xxh64_intdigest(t[j : j + 3])
            out[i, h % dim] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(out[i])
        if n:
            out[i] /= n
    return out


def with_embeddings(df: DataFrame, column: str, encode: Callable[[list[str]], np.ndarray] = hashed_ngrams, to: str = "vector") -> DataFrame:
    """df with a vector for each text; nulls stay null. Batches keep their order."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            some = s.dropna()
            found = encode(some.tolist()) if len(some) else []
            yield pd.Series(list(found), index=some.index, dtype="object").reindex(s.index).map(lambda v: None if v is None or np.isscalar(v) else v)

    return df.withColumn(to, run(column))


def pair_score(score: Callable[[list[str], list[str]], list[float]]):
    """A column function (query, text) to score for reranking; what fails scores null."""

    @F.pandas_udf(DoubleType())
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        try:
            return pd.Series(score(q.tolist(), t.tolist()), dtype="float64")
        except Exception:  # noqa: BLE001 - a failing scorer means the old order, by contract
            return pd.Series([None] * len(q), dtype="float64")

    return run


def enriched(df: DataFrame, enrich: Callable[[dict], dict], schema: str) -> DataFrame:
    """Rows with what `enrich` makes of each; a row that fails has status failed and the error, and nulls elsewhere."""
    names = T.StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                try:
                    rows.append(row | enrich(row) | {"status": "ok", "error": None})
                except Exception as e:  # noqa: BLE001 - one bad row must not stop the others
                    rows.append(row | {"status": "failed", "error": str(e)})
            yield pd.DataFrame([[row.get(c) for c in names] for row in rows], columns=names, dtype=object)

    return df.mapInPandas(run, schema)

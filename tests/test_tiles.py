"""Nearest rows by tiles are those of all pairs, whichever side is broadcast or none."""

import math

import numpy as np
import pytest

from corpusloom.operators import retrieval as rt
from corpusloom.operators import tables, tiles


def frames(spark):
    rng = np.random.default_rng(1)
    v = [(i, f"n{i % 7}", rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(150)] + [(200, "n", [1.0, 2.0]), (201, "n", None), (202, "n", [1.0, None, 0.0, 0.0]), (203, "n", [0.0] * 4), (204, "n", [])]
    q = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(0, 40)] + [(200, [2.0, 1.0]), (300, None), (301, [0.0] * 4)]
    return spark.createDataFrame(q, "query_id long, vector array<double>"), spark.createDataFrame(v, "id long, name string, vector array<double>"), q, v


def plain(q, v, k, apart):
    out = []
    for a, x in q:
        if not x:
            continue
        scored = []
        for b, name, y in v:
            if not y or None in y or len(x) != len(y) or apart and a == b:
                continue
            dot = sum(s * t for s, t in zip(x, y))
            scored.append((-round(dot / max(math.hypot(*x) * math.hypot(*y), 1e-9), 6), name, b))
        out += [(a, b, name, -s, place) for place, (s, name, b) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("limit, tile", [(1 << 25, 1 << 24), (1 << 11, 1 << 24), (0, 300), (0, 1 << 24)])
@pytest.mark.parametrize("apart", [None, ("query_id", "id")])
def test_paths(spark, monkeypatch, limit, tile, apart):
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(tiles, "TILE_BYTES", tile)
    queries, vectors, q, v = frames(spark)
    got = tiles.nearest_rows(queries, vectors, 5, ["name", "id"], 6, apart)
    assert sorted((r.query_id, r.id, r.name, r.score + 0.0, r.place) for r in got.collect()) == plain(q, v, 5, apart)
    assert tiles.nearest_rows(queries.limit(0), vectors, 5, ["id"]).count() == 0 == tiles.nearest_rows(queries, vectors.limit(0), 5, ["id"]).count()


def test_dense_beyond_the_limit(spark, monkeypatch):
    queries, vectors, _, _ = frames(spark)
    four = queries.where("size(vector) = 4")
    few = sorted(map(tuple, rt.dense_topk(four, vectors, 6, apart=True).select("query_id", "id", "score", "rank").collect()))
    for m in (rt, tiles):
        monkeypatch.setattr(m, "BROADCAST_BYTES", 0)
    assert "CartesianProduct" not in (plan := rt.dense_topk(four, vectors, 6, apart=True)._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    assert sorted(map(tuple, rt.dense_topk(four, vectors, 6, apart=True).select("query_id", "id", "score", "rank").collect())) == few


def test_small_by_bytes(spark, monkeypatch):
    df = spark.range(10).selectExpr("id", "repeat('x', 100) AS s", "array_repeat(1.0D, 50) AS v")
    assert tables.is_small(df) and not tables.is_small(df, 9)
    monkeypatch.setattr(tables, "SMALL_BYTES", 1000)
    assert not tables.is_small(df)

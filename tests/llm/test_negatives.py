"""Hard negatives against all pairs in Python."""

import collections
import itertools
import math

import numpy as np
import pytest

from corpusloom.llm import negatives


def plain(rows, every=100):
    """rows: (vec_id, embedding, label)."""
    best = {}
    for i, x, label in rows:
        if i is None or label is None or not x or any(c is None or not math.isfinite(c) or abs(c) >= 16384 for c in x):
            continue
        r = (label, tuple(math.floor(256 * c) for c in x))
        best[i] = min(best.get(i, r), r)
    best = {i: ((math.fmod(label + 1, 10) if i % 7 == 0 else label), v) for i, (label, v) in best.items()}
    out = []
    for a, (label, v) in best.items():
        if a % every:
            continue
        others = sorted((-sum(p * q for p, q in zip(v, w)), i, m == label) for i, (m, w) in best.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in others if x[2]][:5]:
            fit = [x for x in others if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(fit, 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "page", 1) for r in rows], "vec_id long, embedding array<double>, label int, page string, d int").repartition(3)


def test_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).round(1).tolist(), int(rng.integers(0, 4))) for i in range(1500)]
    rows += [(2000 + i, [0.5, 0.5, 0.5, 0.25, 0.0], i % 2) for i in range(900)]  # one vector, in a third of all rows
    rows += [(4000 + i, rng.normal(size=2).tolist(), int(rng.integers(-12, 12))) for i in range(300)]  # another length, labels of any sign
    rows += [(5000 + i, [float(i)], 3) for i in range(120)] + [(-100, [2.0], 3), (-7, [1.0], 2)]
    rows += [(6000, None, 1), (6100, [None, 1.0], 1), (6200, [math.nan] * 5, 1), (6300, [math.inf] * 5, 1), (6400, [1.0] * 5, None), (None, [1.0] * 5, 1), (6500, [], 1), (6600, [0.0] * 5, 2), (6700, [1e300] * 5, 2)]
    rows += rows[:40] + [(100, [9.0] * 5, 3), (100, [0.1] * 5, 1)]  # repeated rows, and ids with several vectors
    got = rows_of(negatives.hard_negatives(frame(spark, rows)))
    assert got == plain(rows) and len(got) > 500
    few = [(100, [1.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2)]
    assert rows_of(negatives.hard_negatives(frame(spark, few))) == plain(few) != []
    assert negatives.hard_negatives(frame(spark, few[:0] or [(1, None, 1)])).count() == 0
    assert negatives.hard_negatives(frame(spark, few).limit(0)).count() == 0


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(0, 16383, 300) + 0.25).tolist(), i % 3) for i in range(150)]
    assert rows_of(negatives.hard_negatives(frame(spark, rows))) == plain(rows) != []


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (5, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in negatives.hilbert(cells, bits)]
    assert len(set(keys)) == len(keys)
    path = cells[sorted(range(len(keys)), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_choose_blocks(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(-99, 99, size=(200, 8))
    a = rng.integers(-99, 99, size=(50, 8))
    least, most = negatives.bounds(a, v.min(axis=0)[None], v.max(axis=0)[None])
    assert (least <= (a @ v.T).min(axis=1, keepdims=True)).all() and (most >= (a @ v.T).max(axis=1, keepdims=True)).all()
    # tight clusters: each anchor reads few of the blocks for its positives
    centres = rng.normal(size=(12, 16)) * 20
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.1).tolist(), i % 2) for i in range(36000)]
    index = negatives.Blocks(frame(spark, rows), 100)
    anchors = index.anchors(100, 5)
    read = collections.Counter()
    for r in anchors.mapInArrow(negatives._to_pages(index.zones, True, False), f"page long, {negatives._ANCHOR}").groupBy("page").count().collect():
        read[r.page] += r["count"]
    low, high = (np.stack([np.frombuffer(bytes(r[c]), dtype=np.int32) for r in index.blocks.sort("block").collect()]) for c in ("low", "high"))
    asked = anchors.collect()
    vectors = np.stack([np.frombuffer(bytes(r.v), dtype=np.int32) for r in asked])
    _, most = negatives.bounds(vectors, low, high)
    share = (most >= np.array([r.lows[0] for r in asked])[:, None]).mean()
    assert share < 0.4 and sum(read.values()) >= len(asked)

"""Small tests for the findings of the fourth round on training-data operators."""

import random

import pyarrow as pa
import pytest
import zstandard

from corpusloom.llm import suffixes
from test_suffixes import brute, corpus


def asked(rows, least=100):
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["doc_id", "text"])
    return [r for b in suffixes._compared(1, least)(suffixes._occurrences(least, 1)(iter([batch]))) for r in b.to_pylist()]


def stretches(found):
    return [n for r in found if r["kind"] in (suffixes.ASKED, suffixes.CROWD) for n in suffixes._unblob([r["data"]], *suffixes._WANT)[2].tolist()]


def test_f1_stretches_that_share_only_their_anchor_are_not_asked_for():
    rng = random.Random(1)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = noise(60)
    assert stretches(asked([(i, noise(120) + common + noise(120)) for i in range(50)])) == []
    longer = noise(130)
    some = stretches(asked([(i, noise(120) + longer + noise(120)) for i in range(50)]))
    assert some and max(some) < 100 - suffixes.ANCHOR + 1  # parts of stretches


@pytest.mark.parametrize("least", [28, 41, 100, 274])
@pytest.mark.parametrize("crowded", [1, 3, 2000])
def test_f1_no_window_is_lost(monkeypatch, least, crowded):
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    monkeypatch.setattr(suffixes, "SLICE", 700)
    monkeypatch.setattr(suffixes, "PIECE", 300)
    rows = [(d, t) for d, t in corpus(least) if t is not None]
    found = asked(rows, least)
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    wanted = [(0, r["kind"], None, r["data"]) for r in found if r["kind"] in (suffixes.ASKED, suffixes.CROWD)]
    texts = [(0, suffixes.TEXT, d, zstandard.compress(t.encode())) for d, t in rows]
    pack = lambda x: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*x), kinds)], ["bucket", "kind", "doc_id", "data"])
    more = [r for b in suffixes._expanded(least, 1)(suffixes._cut_out(least, 1)(iter([pack(wanted + texts)]))) for r in b.to_pylist()]
    runs = [(0, suffixes.REMOVED, None, r["data"]) for r in [*found, *more] if r["kind"] == suffixes.REMOVED]
    got = {r["doc_id"]: r["kept"] for b in suffixes._removed(least, False)(iter([pack(runs + texts)])) for r in b.to_pylist()}
    assert got == brute(rows, least)

"""Repeated bytes against a set of all windows."""

import random

import numpy as np
import pytest

from corpusloom.llm import suffixes

SCHEMA = "doc_id long, text string, bucket int, kind string"


def brute(rows, least):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            w = b[i : i + least]
            if w in seen:
                gone[i : i + least] = b"\1" * least
            seen.add(w)
        out[doc] = bytes(c for c, g in zip(b, gone) if not g)
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    shared = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(6)]
    texts = [None, "", "x" * 99, "x" * 100, "y" * 350, "z" * 1000]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), " ".join(word() for _ in range(rng.randint(0, 30)))]
        texts.append(rng.choice(["", " ", "\n"]).join(parts))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,crowded", [(1, 2000), (2, 2000), (3, 3)])
def test_removed_bytes_are_those_of_all_windows(spark, monkeypatch, seed, crowded):
    rows = corpus(seed)
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    got = {r.doc_id: bytes(r.kept) for r in suffixes.repeated_spans(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)).collect()}
    assert got == brute(rows, 100)


@pytest.mark.parametrize("seed", range(5))
def test_crowded_anchors_in_process(seed):
    """The same stages without Spark, with every anchor dealt by single windows."""
    import pyarrow as pa
    import zstandard

    rows = [(d, t) for d, t in corpus(seed) if t is not None]
    old, suffixes.CROWDED = suffixes.CROWDED, 1
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows])], ["doc_id", "text"])
        found = [r for b in suffixes._compared(1)(suffixes._occurrences(100, 1)(iter([batch]))) for r in b.to_pylist()]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        asked = [(0, r["kind"], None, r["data"]) for r in found if r["kind"] in (suffixes.ASKED, suffixes.CROWD)]
        texts = [(0, suffixes.TEXT, d, zstandard.compress(t.encode())) for d, t in rows]
        pack = lambda x: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*x), kinds)], ["bucket", "kind", "doc_id", "data"])
        more = [r for b in suffixes._expanded(100, 1)(suffixes._cut_out(100, 1)(iter([pack(asked + texts)]))) for r in b.to_pylist()]
        runs = [(0, suffixes.REMOVED, None, r["data"]) for r in [*found, *more] if r["kind"] == suffixes.REMOVED]
        got = {r["doc_id"]: r["kept"] for b in suffixes._removed(100, False)(iter([pack(runs + texts)])) for r in b.to_pylist()}
    finally:
        suffixes.CROWDED = old
    assert got == brute(rows, 100)


def test_expansion_finds_shared_windows():
    rng = np.random.default_rng(5)
    for _ in range(20):
        text = np.concatenate([np.concatenate((rng.integers(1, 3, rng.integers(1, 60)), [0])) for _ in range(10)]).astype(np.uint8)
        order, together = suffixes.common_windows(text, 12)
        raw, groups = text.tobytes(), {}
        for i in range(len(raw) - 11):
            if b"\0" not in raw[i : i + 12]:
                groups.setdefault(raw[i : i + 12], []).append(i)
        got: list[list[int]] = []
        for place, joined in zip(order.tolist(), together.tolist()):
            got[-1].append(place) if joined else got.append([place])
        assert sorted(map(sorted, got)) == sorted(groups.values())


def test_order_is_that_of_all_suffixes():
    rng = np.random.default_rng(6)
    for top in (2, 3, 200):
        text = np.concatenate([np.concatenate((rng.integers(1, top + 1, rng.integers(1, 80)), [0])) for _ in range(8)] * 2).astype(np.uint8)
        raw = text.tobytes()
        assert suffixes.suffix_order(text).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_clashing_names_pass_through(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(300))
    df = spark.createDataFrame([(1, text, 1, True, "a", "b"), (2, text + "x", 2, False, "c", "d")], "doc_id long, text string, _left int, _changed boolean, id string, row string")
    got = sorted(tuple(r) for r in suffixes.without_repeats(df).collect())
    assert [r[2:] for r in got] == [(1, True, "a", "b"), (2, False, "c", "d")]
    assert got[1][1] == "x"


def test_very_long_text(spark, monkeypatch):
    rng = random.Random(4)
    body = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    rows = [(1, body + "é" * 50), (2, "q" * 10 + body[100_000:100_300] + "r" + body[5:104]), (3, body)]
    got = {r.doc_id: bytes(r.kept) for r in suffixes.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 100)


def test_without_repeats_keeps_columns(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(300)) + "é" * 60
    df = spark.createDataFrame([(1, text, len(text), "a"), (2, "head " + text, len(text) + 5, "b"), (3, None, None, "c"), (None, text, 1, "d")], "doc_id long, text string, n_chars long, kind string")
    out = {r.doc_id: r for r in suffixes.without_repeats(df).collect()}
    assert out[1].text == brute([(1, text)], 100)[1].decode("utf-8", "ignore")
    assert out[2].text == "head " and out[2].n_chars == 5
    assert out[3].text is None and out[None].text == text


def test_empty_table(spark):
    assert suffixes.repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_deal_has_as_many_tasks_as_its_bytes_need(spark, monkeypatch):
    from corpusloom.llm import work

    docs = spark.createDataFrame([(i, "é" * 500) for i in range(90)] + [(90, None)], "doc_id long, text string")
    assert work.tasks(docs) == work.partitions(spark)
    monkeypatch.setattr(work, "SHARE", 1000)
    assert work.tasks(docs) == 90 and work.tasks(docs.limit(0)) == work.partitions(spark)
    some = suffixes.repeated_spans(docs.limit(5)).select("doc_id", "n_bytes", "starts", "ends")
    assert sorted((r.doc_id, r.starts, r.ends) for r in some.collect())[1:] == [(i, [0], [1000]) for i in range(1, 5)]

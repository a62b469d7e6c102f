"""Near-duplicate groups against all pairs compared one by one."""

import random
import re

import numpy as np
import pytest

from corpusloom.llm import minhash

SCHEMA = "doc_id long, text string, bucket string, a long, component string"


def brute(rows, words, percent):
    sets = []
    for doc, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for (d, _), s in zip(rows, sets)}


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Ünïcode", "ÀB", "zz"]
    texts = [None, "", "  \n", "one", "ONE", "two words", "two  Words\n", "a b c", "a b c d", "A\tb\x0bc D"]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            texts.append("\n".join(own))
    rng.shuffle(texts)
    return [(100 - i if i % 2 else i + 200, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("words", [4, 5])
def test_groups_are_those_of_all_pairs(spark, words):
    rows = corpus(words)
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, words, 80).collect()}
    assert got == brute(rows, words, 80)


def test_nulls_empty_tables_and_repeated_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "one two three four five six"
    df = spark.createDataFrame([(None, text, "", 1, ""), (3, text, "", 1, ""), (3, text, "", 1, ""), (2, text, "", 1, "")], SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, None, True), (2, 2, True), (3, 2, False), (3, 2, False)]


def test_long_chain_of_links(spark):
    words = [f"t{i}" for i in range(120)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, 5, 80).collect()}
    assert got == brute(rows, 5, 80)
    assert {c for _, c, _ in got.values()} == {0}


def test_deduplicated_keeps_columns_and_one_of_each_group(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(5, text, "b", 1, "c"), (4, text.upper(), "b", 2, "c"), (6, None, None, None, None), (None, text, "n", 1, "c")], SCHEMA)
    out = minhash.deduplicated(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 4, 6]


def test_different_texts_under_one_id_stay(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (2, a)], "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.deduplicated(df).collect()) == [(1, a), (1, b)]


def test_a_percent_that_the_bands_would_miss_is_refused():
    with pytest.raises(ValueError):
        minhash.near_duplicates(None, percent=50)


def edited_family(n, rng, length=150):
    """Edited copies of one text and of a variant of it, each with words of its own; most miss a tenth of the shingles and more."""
    base = [f"b{i}" for i in range(length)]
    other = [w if i % 25 else f"v{i}" for i, w in enumerate(base)]
    out = []
    for k in range(n):
        own = list(base if k % 3 else other)
        for e in range(rng.randint(0, 6)):
            own[rng.randrange(length)] = f"own{k}x{e}"
        out.append(" ".join(own))
    return out


def test_a_family_of_2000_edited_copies(spark):
    texts = edited_family(2000, random.Random(8))
    rows = [(7 * k % 2003, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5, 80).collect()}
    ids = np.array([d for d, _ in rows])
    numbers, holds = {}, []
    for _, t in rows:
        w = t.split()
        holds.append(np.unique([numbers.setdefault(x, len(numbers)) for x in zip(*(w[i:] for i in range(5)))]))
    table = np.zeros((len(rows), len(numbers)), dtype=np.float32)
    for i, x in enumerate(holds):
        table[i, x] = 1
    both, size = table @ table.T, table.sum(axis=1)
    link = 100 * both >= 80 * (size[:, None] + size[None] - both)
    label = ids.copy()
    while (new := np.where(link, label[None], 1 << 40).min(axis=1)).tolist() != label.tolist():
        label = new
    assert got == dict(zip(ids.tolist(), label.tolist()))
    assert 50 < len(set(label.tolist())) < 1900


def thue_morse(k):
    word = b"a"
    for _ in range(k):
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    return word.decode(), word.translate(bytes.maketrans(b"ab", b"ba")).decode()


def test_words_on_which_polynomial_hashes_collide_are_told_apart(spark):
    rows = [(i, w) for i, w in enumerate([*thue_morse(10), *thue_morse(11)])]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}


def test_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CUT", 1000)
    rng = random.Random(3)
    long = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(long)), (2, "  ".join(long[:190_000])), (3, " ".join(long[:120_000])), (4, "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 5, 80).collect()}
    assert {d: x[:2] for d, x in brute(rows, 5, 80).items()} == got

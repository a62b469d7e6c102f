"""Collocations against plain counts in Python."""

import collections
import random
import re

import pyarrow as pa
import pytest

from corpusloom.llm import collocations


def plain(rows, least, share, top):
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = tuple(re.findall("[^\x20\x09]+", piece))
            total[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(w[i : i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        long = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in long.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in long.items()):
                continue
            score, _, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, k) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, left, right, total[lang], s) for i, (s, a, p, left, right) in enumerate(found[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def text(rng, words, n):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "?"]) for _ in range(n))


@pytest.mark.parametrize("at_once", [64, 6 << 20])
def test_phrases(spark, monkeypatch, at_once):
    rng = random.Random(5)
    words = ["a", "B", "the", "The", "é", "É", "a\x01", "!x", "…", "the-end", "日本"]
    rows = [(text(rng, words, rng.randint(0, 60)), rng.choice(["en", "de", None, "und", ""])) for _ in range(150)]
    rows += [(None, "en"), ("", "en"), (" \t.", "fr"), ("a b", None), ("solo", "it"), ("x y z. " * 40, "en")] + [("New York City , new york city", "en")] * 6
    big = ("of the " * 5000 + text(rng, words, 3000), "long")  # one text much longer than the others
    rows.append(big)
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "text string, lang string, n int, phrase string").repartition(3)
    if at_once < 1000:  # workers are forked with the module's own value, so the pieces are looked at here
        monkeypatch.setattr(collocations, "AT_ONCE", at_once)
        texts = [r[0] or "" for r in rows]
        got = list(collocations._by_lang(iter([pa.RecordBatch.from_arrays([pa.array([str(r[1]) for r in rows]), pa.array(texts)], ["lang", "text"])])))
        assert sum(len(t) for _, t in got) == len(rows) and max(sum(len(x.encode()) for x in t.to_pylist()) for _, t in got if len(t) > 1) <= at_once
        return
    for least, share, top in ((10, 50, 2000), (3, 90, 7)):
        assert rows_of(collocations.collocations(df, least, share, top)) == plain(rows, least, share, top)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_a_phrase_over_many_parts(spark):
    """One word begins and ends nearly every phrase, so that its count crosses all parts of both streams."""
    rows = [(" . ".join(f"the w{i} the" for i in range(400)), "en")] * 3
    df = spark.createDataFrame(rows, "text string, lang string")
    assert rows_of(collocations.collocations(df, 3, 100, 900)) == plain(rows, 3, 100, 900)


def test_words_of_any_number_are_told_apart():
    dictionary = pa.array([str(i).encode() for i in range(5)], pa.binary())
    import numpy as np

    class Many:  # a dictionary so large that triples don't fit one integer
        def __len__(self):
            return 1 << 21

        def take(self, at):
            return dictionary.take(at)

    ids = np.array([0, 1, 2, 0, 1, 2, 4])
    parts, counts = collocations._grouped(Many(), ids[:-2], ids[1:-1], ids[2:])
    got = {tuple(int(x.as_py()) for x in p): c for p, c in zip(zip(*parts), counts.tolist())}
    assert got == {(0, 1, 2): 2, (1, 2, 0): 1, (2, 0, 1): 1, (1, 2, 4): 1}

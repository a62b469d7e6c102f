"""Ids against the reference tokenizer, and exact round trips."""

import random

import public_tokenizers
import pytest
import tiktoken

from corpusloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tools():
    with open(PATH, "rb") as f:
        codec = bpe.Codec(f.read())
    return codec, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def texts():
    rng = random.Random(4)
    signs = [*" \n\t\r\x0b'　 \x1c\x85stmdrevlaAZé1٣½²_!.,-漢字😀़́"] + ["'s", "'ll", "'re", "'ve", " '", "a'", "  ", "<|endoftext|>", "'t'm"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", "'", "a" * 3000, " " * 700, "'" * 300, "ab " * 500]


def test_ids_and_decoding(tools):
    codec, other = tools
    every = texts()
    ids, first = codec.encode(every)
    for i, t in enumerate(every):
        own = ids[first[i] : first[i + 1]]
        assert own.tolist() == other.encode_ordinary(t)
        assert codec.decode(own) == t.encode()


def test_scan_equals_the_automaton_step_by_step():
    import numpy as np

    to = bpe._automaton()
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 1000):
        kind = rng.integers(0, 8, n).astype(np.uint8)
        state, s = [], bpe.FRESH
        for c in kind:
            state.append(s)
            s = to[c, s]
        assert bpe.scan(kind).tolist() == state


def test_operator(spark, tools):
    codec, other = tools
    rows = [(1, "Hello world's  end", "x"), (2, None, "x"), (3, "", None), (None, "né", "x"), (1, "Hello world's  end", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(df, PATH).collect()
    assert sorted((r.doc_id or -1, r.ids) for r in out) == sorted((d or -1, other.encode_ordinary(t or "")) for d, t, _ in rows)
    for r in out:
        assert len(r.offsets) == len(r.ids)
    back = sorted((r.doc_id or -1, r.text) for r in bpe.decode(bpe.encode(df, PATH), PATH).collect())
    assert back == sorted((d or -1, t or "") for d, t, _ in rows)
    assert bpe.digests(df.limit(0), PATH).count() == 0 and bpe.encode(df.limit(0), PATH).count() == 0
    own = spark.createDataFrame([(4, "some text", 1, "x", "y")], "doc_id long, text string, n_tokens int, ids_sha256 string, decoded_sha256 string")
    assert [r.n_tokens for r in bpe.digests(own, PATH).collect()] == [len(other.encode_ordinary("some text"))]


def test_cache_is_bounded_by_bytes_and_long_texts_are_whole(tools):
    with open(PATH, "rb") as f:
        codec = bpe.Codec(f.read(), most=200_000)
    rng = random.Random(5)
    sizes = []
    for _ in range(20):
        every = ["".join(rng.choice("abcdefghij") for _ in range(rng.choice([8, 500]))) + " " for _ in range(200)]
        ids, first = codec.encode(every)
        assert codec.decode(ids).decode() == "".join(every)
        sizes.append(codec.size)
    assert max(sizes) < 600_000
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300_000))
    ids, _ = codec.encode([long])
    assert ids.tolist() == tools[1].encode_ordinary(long)

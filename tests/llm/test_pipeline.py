"""Each stage of the pipeline on what the one before kept, against brute force."""

import collections
import hashlib
import random

import pytest
import tiktoken
from test_near_dup import brute as groups
from test_others import fair
from test_suffixes import brute as unrepeated

import corpus_pipeline
from corpusloom.llm import bpe

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    passage = " ".join(rng.choices(vocab, k=60))
    docs, labels = [(900, None), (901, ""), (902, "   ")], []
    for i in range(240):
        words = rng.choices(vocab, k=rng.randint(20, 120))
        bad = i % 6 == 0
        if bad:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "foul,", "Nasty"]))
        text = " ".join(words)
        if i % 10 == 3:
            text = f"{text} {passage} {rng.choice(vocab)}"
        if i % 8 == 5 and i > 8 and not bad:
            text = docs[-1][1] + " extra"
            bad = labels[-1][2] == 1
        docs.append((i, text))
        labels.append((i, 1, int(bad)))
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(d, t, "en", rng.choice(["a", "b", "c"]), None if t is None else len(t)) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "suffix_dedup", "mixing", "bpe"]
    before = {r.doc_id: r for r in docs.collect()}

    docs = stages["toxicity"](spark, docs, sf_dir).cache()
    assert docs.columns == COLUMNS
    kept = {r.doc_id: r for r in docs.collect()}
    assert set(kept) == set(before) - toxic and all(kept[d] == before[d] for d in kept)

    want = {d for d, (n, c, keep) in groups([(d, r.text) for d, r in kept.items()], 5, 80).items() if keep}
    docs = stages["near_dedup"](spark, docs, sf_dir).cache()
    unique = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == COLUMNS and set(unique) == want and len(want) < len(kept)

    docs = stages["suffix_dedup"](spark, docs, sf_dir).cache()
    left = {r.doc_id: r.text for r in docs.collect()}
    expected = unrepeated([(d, r.text) for d, r in unique.items()], 100)
    assert docs.columns == COLUMNS
    assert {d: t or "" for d, t in left.items()} == {d: b.decode("utf-8", "ignore") for d, b in expected.items()}
    assert any(left[d] != unique[d].text for d in left)

    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").split())
    docs = stages["mixing"](spark, docs, sf_dir).cache()
    assert docs.columns == COLUMNS
    taken = collections.Counter()
    for r in docs.collect():
        taken[r.source] += len((r.text or "").split())
    for s, target in fair(dict(sizes), [1, 2, 3], 3).items():
        assert abs(taken[s] - target) < 1

    with open(__import__("public_tokenizers").path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.Codec(f.read()).ranks
    other = tiktoken.Encoding("own", pat_str=__import__("public_tokenizers").PATTERN, mergeable_ranks=ranks, special_tokens={})
    mixed = docs.collect()
    out = stages["bpe"](spark, docs, sf_dir).collect()
    want = sorted((r.doc_id, len(other.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in mixed)
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in out) == want


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

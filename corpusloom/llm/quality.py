"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model on text statistics and hashed words gives each document's own evidence. The share of good documents of
a host and of a path has a beta prior at the share of the level above (path to host, host to the whole corpus) and
counts as binomial evidence: training labels in full, what the model expects of all documents at a small weight.
Sparse sites stay near the level above; how near, is estimated from the spread between the groups. Evidence and the
path's posterior add up in log-odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import prefix_sums, span_hashes
from .toxicity import held_out
from .work import tidy, written

#: At most so many labelled training rows fit the logistic model, those with the smallest hashes.
SAMPLE = 20_000
#: Places for hashed words, and how much a document that only the model has judged weighs against a labelled one.
WORDS, SOFT = 128, 0.1
#: Statistics of a text besides its words.
STATISTICS = 12

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CLASS = np.zeros((6, 256), dtype=bool)
_CLASS[0, 65:91] = True
_CLASS[1, 48:58] = True
_CLASS[2, [ord(c) for c in "#*$%&<>{}[]=+_~^\\/@"]] = True
_CLASS[3, [ord(c) for c in "!?"]] = True
_CLASS[4, ord("|")] = True
_CLASS[5, [ord(c) for c in ".,;:"]] = True


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row for each text: sizes, shares of kinds of bytes, repetition of words and of word pairs, then the shares of its words by hash."""
    out = np.zeros((len(texts), STATISTICS + WORDS))
    for i, t in enumerate(texts):
        data = np.frombuffer(t, dtype=np.uint8)
        inside = ~_SPACE[data]
        turn = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        start, end = turn[0::2], turn[1::2]
        n = len(start)
        if n == 0:
            out[i, 11] = 1
            continue
        counts = np.bincount(data, minlength=256)
        chars = max(1, int((end - start).sum()))
        h = span_hashes(prefix_sums(data), start, end)
        pairs = h[1:] * np.uint64(3) + h[:-1]
        lines = [x for x in t.split(b"\n") if x.strip()]
        out[i, :6] = _CLASS @ counts / chars
        out[i, 6:11] = np.log1p(n), chars / n, 1 - len(np.unique(h)) / n, 1 - len(np.unique(pairs)) / max(1, n - 1), 1 - len(set(lines)) / max(1, len(lines))
        out[i, STATISTICS:] = np.bincount((h >> np.uint64(40)).astype(np.int64) % WORDS, minlength=WORDS) / n
    return out


def _expand(x: np.ndarray) -> np.ndarray:
    """Statistics, their square roots, roots of the words' shares and a one."""
    own, words = x[:, :STATISTICS], x[:, STATISTICS:]
    return np.concatenate((own, np.sqrt(np.maximum(own, 0)), np.sqrt(words), np.ones((len(x), 1))), axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, pull: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.full(len(w), pull)
        ridge[-1] = 1e-3
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, x.T @ (p - y) + ridge * w)
        w -= step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-7:
            break
    return w


def _measuring(column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics([t.as_py() or b"" for t in batch.column(column).cast(pa.binary())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    return run


def _trained(labels: DataFrame) -> DataFrame:
    """doc_id, quality (0 or 1) of the labels that may be learned from: not held out, the lowest where rows share a doc_id."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    own = own.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return own.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("quality"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and spreads of the logistic model from at most `sample` labelled rows that aren't held out.

    Of rows that share a doc_id, the lowest label counts; null labels are skipped. Without labels of both kinds the
    model gives every document the same evidence.
    """
    spark = docs.sparkSession
    picked = {r.doc_id: r.quality for r in _trained(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    ids = spark.createDataFrame([(k,) for k in picked], "doc_id long")
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(ids), "doc_id").mapInArrow(tidy(_measuring(1)), "doc_id long, x array<double>").collect()
    y = np.array([picked[r.doc_id] for r in rows], dtype=float)
    size = 2 * STATISTICS + WORDS
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(size + 1), np.zeros(size), np.ones(size)
    x = _expand(np.array([r.x for r in rows]))
    mean, spread = x[:, :-1].mean(axis=0), x[:, :-1].std(axis=0) + 1e-6
    x[:, :-1] = np.clip((x[:, :-1] - mean) / spread, -8, 8)
    return _logistic(x, y), mean, spread


def _judging(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, mean, spread = shared.value
        for batch in batches:
            x = _expand(statistics([t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]))
            x[:, :-1] = np.clip((x[:, :-1] - mean) / spread, -8, 8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.clip(x @ w, -30, 30), pa.float64())], ["doc_id", "host", "path", "evidence"])

    return run


def _odds(p):
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: float) -> float:
    """Pseudo-documents of the level above, by moments: the less the groups' shares differ beyond chance, the more."""
    r = groups.where("n > 1").agg(F.avg((F.col("s") / F.col("n") - F.lit(mean)) ** 2).alias("v"), F.avg(F.lit(mean * (1 - mean)) / F.col("n")).alias("c"), F.count("*").alias("k")).first()
    if not r.k:
        return 100.0
    beyond = r.v - r.c
    return float(min(1e6, max(1.0, mean * (1 - mean) / beyond - 1))) if beyond > 0 else 1e6


def scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, evidence, host_rate, path_rate, score (0 to 1, higher is better) and kept (score of 0.5 or more).

    docs has doc_id, text and the two columns named as host and path (a path lies within its host; null is one of its
    own); labels has doc_id and quality. Null and empty texts are judged by their missing words. Repeated rows are
    judged one by one; a repeated doc_id counts in its site as often as it stands there. Held-out labels are never
    read; all others count in the sites' posteriors. An empty table gives an empty result.
    """
    sc = docs.sparkSession.sparkContext
    model = fit(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("\0")).alias("path"))
    own = written(rows.mapInArrow(tidy(_judging(sc.broadcast(model))), "doc_id long, host string, path string, evidence double"))
    p = 1 / (1 + F.exp(-F.col("evidence")))
    known = F.col("quality").isNotNull()
    # a label counts as one document; an expectation as SOFT of one
    counted = own.join(_trained(labels), "doc_id", "left").select("host", "path", F.when(known, 1.0).otherwise(SOFT).alias("n"), F.when(known, F.col("quality")).otherwise(SOFT * p).alias("s"))
    paths = written(counted.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = total.s / total.n if total.n else 0.5
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    k, m = _strength(hosts, mean), _strength(paths, mean)
    hosts = hosts.select("host", ((F.col("s") + k * mean) / (F.col("n") + k)).alias("host_rate"))
    rates = paths.join(hosts, "host").select("host", "path", "host_rate", ((F.col("s") + m * F.col("host_rate")) / (F.col("n") + m)).alias("path_rate"))
    both = own.join(written(rates), ["host", "path"], "left")
    odds = F.col("evidence") + _odds(F.col("path_rate")) - _odds(F.lit(mean))
    score = 1 / (1 + F.exp(-odds))
    return both.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "evidence", "host_rate", "path_rate", score.alias("score"), (score >= 0.5).alias("kept"))

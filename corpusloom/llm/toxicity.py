"""Toxic passages as maximum-scoring segments of token log-odds.

Token counts over the whole corpus are the Dirichlet prior of the counts in toxic and in clean training documents;
the log-odds score tokens, a linear-time scan finds every maximal segment of positive score, and Karlin-Altschul
statistics say how significant a segment is in a text of its length. The significances add up to a document's
evidence, which a logistic curve turns into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import prefix_sums, span_hashes
from .work import tidy, written

#: Weight of the prior in tokens, least z-score and log-odds of a token that counts (a language or a subject that is
#: more common among toxic documents moves its words less), and what every other token costs.
PRIOR, LEAST_Z, LEAST_ODDS, COST = 1000.0, 3.5, 1.5, 0.05
#: At most so many labelled training rows are used, those with the smallest hashes.
SAMPLE = 20_000

#: ASCII letters in lower case; other bytes above 127 as they are; everything else ends a token.
_FOLD = np.zeros(256, dtype=np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end (bytes in the joined texts) of each token, and each text's first token (one more)."""
    data = _FOLD[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    inside = data > 0
    turn = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = turn[0::2], turn[1::2]
    h = span_hashes(prefix_sums(data), start, end)
    edge = np.cumsum([0] + [len(t) + 1 for t in texts])
    return h.view(np.int64), start, end, np.searchsorted(start, edge)


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of the tokens with a positive score
    values: np.ndarray  # their scores; every other token costs COST
    rate: float  # lambda of the extreme-value law
    size: float  # log K
    least: float  # rate times the smallest positive token score
    slope: float
    shift: float

    def score(self, which: np.ndarray) -> np.ndarray:
        at = _places(self.keys, which)
        return np.where(at < len(self.keys), np.append(self.values, -COST)[at], -COST)


def _places(keys: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Where each hash stands in the sorted keys; their number for one that isn't among them."""
    if len(keys) == 0:
        return np.zeros(len(which), dtype=np.int64)
    at = np.searchsorted(keys, which)
    return np.where(keys[np.minimum(at, len(keys) - 1)] == which, at, len(keys))


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence (start, end, score), by Ruzzo and Tompa's linear scan over positive scores.

    Each candidate keeps a link to the nearest earlier one that begins at a smaller sum; searches follow the links, so
    that no candidate is passed twice.
    """
    spots = np.flatnonzero(score > 0)
    if len(spots) == 0:
        return []
    total = np.cumsum(score)
    found: list[tuple] = []  # start, end, sum before, sum with, link
    for i, own, after in zip(spots.tolist(), score[spots].tolist(), total[spots].tolist()):
        start, before, j = i, after - own, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                break
            start, _, before, _, link = found[j]
            del found[j:]
            j = link
        found.append((start, i + 1, before, after, j))
    return [(a, b, r - q) for a, b, q, r, _ in found]


def significances(score: np.ndarray, model: Model) -> list[tuple[float, int, int]]:
    """Significance, start and end of each segment: rate * s - log(K n) for a score of s in n tokens, minus the log of the number of such segments that chance gives."""
    edge = model.size + np.log(max(1, len(score)))
    return [(model.rate * s - edge, a, b) for a, b, s in maximal_segments(score)]


def evidence(score: np.ndarray, model: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """Summed significance of the segments that are significant (or of the best one), and those segments."""
    marks = significances(score, model)
    return combined([e for e, _, _ in marks], model.least), [(a, b, e) for e, a, b in marks if e > 0]


def combined(marks: list[float], least: float) -> float:
    """One document's evidence from its segments' significances; a text without any has a fixed one."""
    good = [e for e in marks if e > 0]
    return sum(good) if good else max([-least, *marks])


def _pieces(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, list[bytes]]]:
    have: list[bytes] = []
    size = at = 0
    for i, x in enumerate(column.cast(pa.binary())):
        have.append(x.as_py() or b"")
        size += len(have[-1])
        if size >= most:
            yield at, i + 1, have
            have, size, at = [], 0, i + 1
    if have:
        yield at, at + len(have), have


def _counting(shared):
    """Toxic and clean labelled documents that hold each token, summed over each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: dict[int, int] = shared.value
        for batch in batches:
            kind = [labels[x] for x in batch.column(0).to_pylist()]
            held: list[list[np.ndarray]] = [[], []]  # clean, toxic
            for a, b, texts in _pieces(batch.column(1)):
                which, _, _, first = tokens(texts)
                for i in range(a, b):
                    # once for each document: a word that one text repeats is no evidence
                    held[kind[i]].append(np.unique(which[first[i - a] : first[i - a + 1]]))
            clean, toxic = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in held)
            keys, place = np.unique(np.concatenate((clean, toxic)), return_inverse=True)
            counts = [np.bincount(x, minlength=len(keys)) for x in (place[len(clean) :], place[: len(clean)])]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, *counts)], ["token", "toxic", "clean"])

    return run


def _occurring(shared):
    """How often each of the sorted tokens occurs; one more row, with place -1, counts all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: np.ndarray = shared.value
        counts, total = np.zeros(len(keys) + 1, dtype=np.int64), 0
        for batch in batches:
            for _, _, texts in _pieces(batch.column(1)):
                which, _, _, _ = tokens(texts)
                counts += np.bincount(_places(keys, which), minlength=len(keys) + 1)
                total += len(which)
        own = np.flatnonzero(counts[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1), pa.int64()), pa.array(np.append(counts[own], total), pa.int64())], ["place", "n"])

    return run


def significance(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Signed root of the likelihood ratio between one rate for both kinds and one for each."""
    both = toxic + clean
    share = n_toxic / max(1.0, n_toxic + n_clean)
    part = lambda seen, due: seen * np.log(np.maximum(seen, 1e-9) / np.maximum(due, 1e-9))
    z = np.sqrt(np.maximum(0.0, 2 * (part(toxic, both * share) + part(clean, both * (1 - share)))))
    return np.where(toxic >= both * share, z, -z)


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, every: np.ndarray, total: float) -> np.ndarray:
    """Log-odds of tokens with their shares of the corpus as Dirichlet prior."""
    alpha = 0.1 + PRIOR * every / max(1.0, total)
    x, y = toxic + alpha, clean + alpha
    n, m = n_toxic + PRIOR, n_clean + PRIOR
    return np.log(x / (n - x)) - np.log(y / (m - y))


def _rate(score: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of sum(p * exp(rate * score)) = 1 for the clean token frequencies p."""
    p = weight / max(weight.sum(), 1.0)
    low, high = 0.0, 1e-3
    f = lambda r: float((p * np.exp(np.minimum(r * score, 50.0))).sum())
    if not (score > 0).any():
        return 1.0
    while f(high) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 1 else (low, mid)
    return max(low, 1e-3)


def _segments_of(shared):
    """Number of tokens, best segment score and evidence of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            rows = []
            for _, _, texts in _pieces(batch.column(1)):
                which, _, _, first = tokens(texts)
                s = model.score(which)
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    best = max((x[2] for x in maximal_segments(s[a:b])), default=0.0)
                    rows.append((b - a, best, evidence(s[a:b], model)[0]))
            n, best, found = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(found, pa.float64())], ["doc_id", "n", "best", "evidence"])

    return run


_SEEN = "doc_id long, n long, best double, evidence double"


def _curve(x):
    """Evidence on the scale of the logistic curve: beyond 20 more of it says no more."""
    return np.clip(x, -20.0, 20.0) / 10


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a one-dimensional logistic curve, with a small pull to (1, 0); Newton steps are halved till they gain."""
    a = np.stack([_curve(x), np.ones_like(x)], axis=1)
    pull = np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        t = a @ w
        return float((np.logaddexp(0, t) - y * t).sum() + 0.5 * ((w - pull) ** 2).sum())

    w = pull.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a @ w)))
        grad = a.T @ (p - y) + (w - pull)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.eye(2), grad)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def _clean_docs(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")


def held_out(doc_id):
    """Whether crc32 of the id as text leaves no rest by 5; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from labels (doc_id, toxic) of documents that aren't held out, at most `sample` of them.

    Tokens are told apart by 64-bit hashes, and counts of the corpus cover all documents. Null labels and labels of no
    document are skipped; of rows that share a doc_id, toxic wins. With no labels of one kind no token scores, and every document gets the share of toxic labels
    (one half without labels).
    """
    spark = docs.sparkSession
    docs = _clean_docs(docs)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = {r.doc_id: int(r.toxic > 0) for r in own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    sc = spark.sparkContext
    ids = F.broadcast(spark.createDataFrame([(k,) for k in picked], "doc_id long"))
    own = written(docs.join(ids, "doc_id"))  # the sample's texts, which three passes read
    counts = written(own.mapInArrow(tidy(_counting(sc.broadcast(picked))), "token long, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    n_toxic, n_clean = (float(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    # only tokens of three toxic documents can score; of these, only the significant ones are counted in the corpus
    found = counts.where("toxic >= 3").toArrow()
    keys, toxic, clean = (found.column(c).to_numpy() for c in ("token", "toxic", "clean"))
    good = np.flatnonzero(significance(toxic, clean, n_toxic, n_clean) >= LEAST_Z)
    good = good[np.argsort(keys[good])]
    keys, toxic, clean = keys[good], toxic[good], clean[good]
    rows = docs.mapInArrow(tidy(_occurring(sc.broadcast(keys))), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    seen_in = {r.place: r.n for r in rows}
    every = np.array([seen_in.get(i, 0) for i in range(len(keys))], dtype=float)
    odds = log_odds(toxic, clean, n_toxic, n_clean, every, float(seen_in.get(-1, 0)))
    good = odds >= LEAST_ODDS
    keys, score, clean_of = keys[good], odds[good], clean[good]
    rate = _rate(np.append(score, -COST), np.append(clean_of, n_clean - clean_of.sum()))
    model = Model(keys, score, rate, 0.0, 0.0, 0.0, 0.0)
    seen = own.mapInArrow(tidy(_segments_of(sc.broadcast(model))), _SEEN).collect()  # a few numbers for each row of the sample
    y = np.array([picked[r.doc_id] for r in seen], dtype=float)
    n = np.array([max(1, r.n) for r in seen], dtype=float)
    best = np.array([r.best for r in seen])
    tame = y == 0
    # K from how many clean documents reach the least positive score: count = K * sum(n) * exp(-rate * score)
    least = rate * float(score.min()) if len(score) else 1.0
    size = float(np.log((best[tame] > 0).sum() + 0.5) - np.log(max(1.0, n[tame].sum())) + least)
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or not 0 < share < 1:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(keys, score, rate, size, least, 1e-9, float(np.log(share / (1 - share))))
    model = Model(keys, score, rate, size, least, 0.0, 0.0)
    seen = own.mapInArrow(tidy(_segments_of(sc.broadcast(model))), _SEEN).collect()
    x, y = np.array([r.evidence for r in seen]), np.array([picked[r.doc_id] for r in seen], dtype=float)
    return Model(keys, score, rate, size, least, *_logistic(x, y))


def _scoring(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            score, passages = [], []
            for _, _, texts in _pieces(batch.column(1)):
                which, start, end, first = tokens(texts)
                s = model.score(which)
                base = np.cumsum([0] + [len(t) + 1 for t in texts])
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    x, found = evidence(s[a:b], model)
                    score.append(float(1 / (1 + np.exp(-(model.slope * _curve(x) + model.shift)))))
                    passages.append([{"start": int(start[a + p] - base[i]), "end": int(end[a + q - 1] - base[i]), "evidence": float(e)} for p, q, e in found])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    return run


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and passages (byte ranges with their evidence) of every whole text.

    docs has doc_id and text; labels has doc_id and toxic; other columns are never read. Null and empty texts have no
    passage and get the score of no evidence. Repeated rows are scored one by one.
    """
    model = fit(docs, labels, sample)
    out = _clean_docs(docs).mapInArrow(tidy(_scoring(docs.sparkSession.sparkContext.broadcast(model))), "doc_id long, score double, passages array<struct<start:long,end:long,evidence:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without the documents whose score is 0.5 or more; columns as they were. Rows without text stay."""
    model = fit(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scoring(shared)
        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(names.index("doc_id")), batch.column(names.index("text"))], ["doc_id", "text"])
            for out in score(iter([own])):
                yield batch.filter(pa.array([x < 0.5 for x in out.column(1).to_pylist()]))

    return docs.mapInArrow(tidy(run), docs.schema)

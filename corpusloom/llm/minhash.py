"""Near-duplicate documents by min-max hashing.

Every permutation of the shingle hashes gives two signature values, its minimum and its maximum, so that a
signature takes half as many hash evaluations. Bands of values name buckets; whoever shares a bucket with its head
is compared on full sets, and what stays apart asks the next head, round by round. Documents with the same set are
one class and are compared once.
"""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix
from .suffixes import BLOB, _batch, _dealt, _spread, _unblob
from .work import by_bucket, dealt, forgotten_after_task, tasks, tidy, written

BANDS, ROWS = 30, 5
#: Fewer equal bytes of the 150 than this put a pair over six standard deviations under a similarity of 0.8.
LEAST_EQUAL = 88
#: Rounds of comparisons with heads go on while at least one of so many comparisons links.
WORTH = 20
#: Ids up to which a table of them is broadcast (8 bytes each) to pick texts; more are joined by shuffle.
BROADCAST_IDS = 200_000

_SEED = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MUL, _XOR = _SEED[0::2] | np.uint64(1), _SEED[1::2]
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
#: Bytes of a text that are split at once, and bytes of words whose digests a worker keeps.
CUT, KEPT_WORDS = 1 << 20, 16 << 20


class _Words(dict):
    """The number of each word's xxh3-128 digest; digests are made once for each word and forgotten all together."""

    def __init__(self) -> None:
        self.lanes = np.empty((1024, 2), dtype=np.uint64)
        self.fresh: list[bytes] = []
        self.size = 0

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(xxhash.xxh3_128_digest(word))
        self.size += len(word) + 100
        number = self[word] = len(self)
        return number

    def digests(self, text: bytes) -> np.ndarray:
        """Two 64-bit values for each word of the text, compared without the case of A-Z."""
        found, at = [], 0
        while at < len(text):
            if self.size > KEPT_WORDS:
                self.forget()
            end = _BLANK.search(text, at + CUT)
            end = end.end() if end else len(text)
            split = text[at:end].lower().split()  # bytes are split at blanks and \x09 to \x0d, and only A-Z are lowered
            at, have = end, len(self)
            which = np.fromiter(map(self.__getitem__, split), dtype=np.int64, count=len(split))
            if self.fresh:
                if len(self) > len(self.lanes):
                    self.lanes = np.concatenate((self.lanes, np.empty((max(len(self.lanes), len(self)), 2), dtype=np.uint64)))
                self.lanes[have : len(self)] = np.frombuffer(b"".join(self.fresh), dtype="<u8").reshape(-1, 2)
                self.fresh.clear()
            found.append(self.lanes[which])
        return np.concatenate(found) if found else np.empty((0, 2), dtype=np.uint64)


    def forget(self) -> None:
        self.clear()
        self.__init__()


_words = _Words()
forgotten_after_task(_words.forget)


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, one text after another: 64-bit hashes (sorted in each text), 64 further bits of each, and where each text's begin (one more than texts).

    A shingle's two hashes are chained from the two halves of its words' digests and from its number of words.
    """
    digests = [_words.digests(t) for t in texts]
    count = np.array([len(d) for d in digests], dtype=np.int64)
    made = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    bounds = np.concatenate(([0], np.cumsum(made)))
    if bounds[-1] == 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    lanes = np.concatenate(digests)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    owner = np.repeat(np.arange(len(texts)), made)
    head = first[owner] + np.arange(bounds[-1]) - bounds[owner]
    length = np.minimum(words, count[owner])
    short = length < words
    sides = []
    for side in (0, 1):
        own = np.ascontiguousarray(lanes[:, side])
        h = length.astype(np.uint64)
        for j in range(words):
            new = mix((h ^ own[np.minimum(head + j, len(own) - 1)]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j + 1))
            h = np.where(short & (length <= j), h, new) if short.any() else new
        sides.append(h)
    low, high = sides
    order = np.arange(len(low))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            order[a:b] = a + np.argsort(low[a:b])
    low, high = low[order], high[order]
    fresh = np.ones(len(low), dtype=bool)
    fresh[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (owner[1:] != owner[:-1])
    total = np.concatenate(([0], np.cumsum(fresh)))
    return low[fresh], high[fresh], total[bounds]


def in_common(x: tuple, y: tuple) -> int:
    """How many shingles two sets (as shingles() gives them for one text each) have in common."""
    if len(x[0]) == 0 or len(y[0]) == 0:
        return 0
    at = np.minimum(np.searchsorted(x[0], y[0]), len(x[0]) - 1)
    return int(((x[0][at] == y[0]) & (x[1][at] == y[1])).sum())


def signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of signature values for each text that has shingles: minimum and maximum under each permutation."""
    at = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(at), BANDS * ROWS), dtype=np.uint64)
    if len(at) == 0:
        return out
    for p in range(len(_MUL)):
        v = (h ^ _XOR[p]) * _MUL[p]
        out[:, 2 * p] = np.minimum.reduceat(v, at)
        out[:, 2 * p + 1] = np.maximum.reduceat(v, at)
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    key = np.zeros((len(sig), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        # the values of a band come from different permutations
        key = mix((key ^ sig[:, r * BANDS : (r + 1) * BANDS]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1))
    return mix(key + np.arange(BANDS, dtype=np.uint64))


def _pieces(texts: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of rows with about so many bytes of text; nulls are empty."""
    have: list[bytes] = []
    size = at = 0
    for i, x in enumerate(texts.cast(pa.binary())):
        have.append(x.as_py() or b"")
        size += len(have[-1])
        if size >= most:
            yield at, i + 1, have
            have, size, at = [], 0, i + 1
    if have:
        yield at, at + len(have), have


SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary"


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _pieces(batch.column(1)):
                h, more, bounds = shingles(texts, words)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                sig = signatures(h, bounds)
                bands = _bands(sig).view(np.int64)
                # a cryptographic digest of the whole set names its class
                key = [hashlib.blake2b(h[i:j].tobytes() + more[i:j].tobytes(), digest_size=16).digest() for i, j in zip(bounds[:-1], bounds[1:])]
                k = np.frombuffer(b"".join(key), dtype="<i8").reshape(-1, 2)
                each: list = [None] * len(texts)
                low: list = [None] * len(texts)
                small = (sig & np.uint64(255)).astype(np.uint8)
                for j, i in enumerate(some.tolist()):
                    each[i], low[i] = bands[j], small[j].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(np.ascontiguousarray(k[:, 0])), pa.array(np.ascontiguousarray(k[:, 1])), pa.array(each, pa.list_(pa.int64())), pa.array(low, pa.binary())],
                    ["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"],
                )

    return run


def _linked(words: int, percent: int):
    """Keeps the pairs whose full sets are near enough; the sets of the last few heads are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, tuple] = OrderedDict()
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for i in range(batch.num_rows):
                if a[i] not in kept:
                    kept[a[i]] = shingles([batch.column(2)[i].as_py().encode()], words)
                    while len(kept) > 32:
                        kept.popitem(last=False)
                kept.move_to_end(a[i])
                x, y = kept[a[i]], shingles([batch.column(3)[i].as_py().encode()], words)
                both = in_common(x, y)
                good.append(100 * both >= percent * (len(x[0]) + len(y[0]) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the written pairs (a, b), those that the full texts confirm."""
    texts = docs.select("doc_id", "text")
    if 2 * pairs.count() <= BROADCAST_IDS:  # else every text moves
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
    return written(both.select("a", "b", "x", "y").mapInArrow(tidy(_linked(words, percent)), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Large-star and small-star steps alternate until every node points to one that points nowhere; each step is a
    grouped minimum and a join, so that no task gathers the neighbours of a node.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        edges = written(small)
        ends = edges.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
        if ends.where("n > 1").isEmpty() and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _alike(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Drops pairs whose sketches differ in too many places to be near."""
    s = signed.select("doc_id", "sketch")
    both = pairs.join(s.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x")), "a").join(s.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                equal = (x == y).sum(axis=1)
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(equal, pa.int32())], ["a", "b", "equal"])
                yield out.filter(pa.array(equal >= LEAST_EQUAL))

    return both.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long, equal int")


#: A shingle that at most so many documents have is rare: the pairs that share it are counted one by one. The others
#: are counted in so many classes.
RARE, CLASSES = 20, 32
#: Kinds of packed rows: shingles dealt by hash, counts dealt by document.
_SHINGLES, _COUNTS = 0, 1
#: In place of a second document, where a row tells how many frequent shingles of a class one has.
_NONE = np.iinfo(np.int64).min


def _class_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(59)).astype(np.int64)


def _counted(a: np.ndarray, b: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """Packed counts of equal (a, b), dealt by a."""
    pairs, n = np.unique(np.stack((a, b), axis=1), axis=0, return_counts=True)
    return list(_dealt(_spread(pairs[:, 0], buckets), _COUNTS, pairs[:, 0], pairs[:, 1], n))


def _owned(words: int, buckets: int, flush: int = 1 << 18):
    """Shingle hashes of each document with its number and component, dealt by hash.

    Of a shingle that more than RARE documents share within what is sent at once, only RARE + 1 rows travel, enough to
    tell that it is frequent; the other documents' counts go straight to their documents.
    """

    def sent(parts: list[tuple]) -> pa.RecordBatch:
        h, doc, component = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h, kind="stable")
        h, doc, component = h[order], doc[order], component[order]
        head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        beyond = np.arange(len(h)) - np.repeat(head, np.diff(np.concatenate((head, [len(h)])))) > RARE
        rows = list(_dealt(_spread(h[~beyond].view(np.int64), buckets), _SHINGLES, h[~beyond], doc[~beyond], component[~beyond]))
        return _batch(rows + _counted(doc[beyond], _NONE + _class_of(h[beyond]), buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        have = 0
        for batch in batches:
            for a, b, texts in _pieces(batch.column(1)):
                h, _, bounds = shingles(texts, words)
                parts.append((h, *(np.repeat(batch.column(i).slice(a, b - a).to_numpy(), np.diff(bounds)) for i in (0, 2))))
                have += len(h)
                if have >= flush:
                    yield sent(parts)
                    parts, have = [], 0
        if have:
            yield sent(parts)

    return run


def _rare(buckets: int):
    """How many frequent shingles of each class each document has, and how many rare ones two documents of different components share, dealt by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bucket(batches):
            h, doc, component = _unblob([x for r in rows for x in r.column(2).to_pylist()], "<u8", "<i8", "<i8")
            del rows
            order = np.lexsort((doc, h))
            h, doc, component = h[order], doc[order], component[order]
            head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, dtype=np.int64)
            df = np.diff(np.concatenate((head, [len(h)])))
            few = np.repeat(df <= RARE, df)
            first, second = [doc[~few]], [_NONE + _class_of(h[~few])]
            h, doc, component = h[few], doc[few], component[few]
            for step in range(1, RARE):  # each with the one so many places on, if they have the shingle in common
                both = (h[step:] == h[:-step]) & (component[step:] != component[:-step])
                first.append(doc[:-step][both])
                second.append(doc[step:][both])
            yield _batch(_counted(np.concatenate(first), np.concatenate(second), buckets))

    return run


_SUMMED = "a long, b long, n long, classes array<int>"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with the counts of the classes for each document (b is null), and one (a, b, n) for each pair."""
    names = ["a", "b", "n", "classes"]
    for rows in by_bucket(batches):
        a, b, n = _unblob([x for r in rows for x in r.column(2).to_pylist()], "<i8", "<i8", "<i8")
        del rows
        own = b < _NONE + CLASSES
        docs, row = np.unique(a[own], return_inverse=True)
        counts = np.zeros((len(docs), CLASSES), dtype=np.int32)
        np.add.at(counts, (row, b[own] - _NONE), n[own])
        nothing = pa.nulls(len(docs), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), nothing, pa.array(counts.sum(axis=1), pa.int64()), pa.array(list(counts), pa.list_(pa.int32()))], names)
        order = np.lexsort((b[~own], a[~own]))
        a, b, n = a[~own][order], b[~own][order], n[~own][order]
        head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.empty(0, dtype=np.int64)
        if len(head):
            yield pa.RecordBatch.from_arrays([pa.array(a[head], pa.int64()), pa.array(b[head], pa.int64()), pa.array(np.add.reduceat(n, head), pa.int64()), pa.nulls(len(head), pa.list_(pa.int32()))], names)


def _partners(named: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs across the components of buckets that hold several, less those that can't be near.

    Two documents of sizes n and s need p * (n + s) shingles in common, where p = percent / (100 + percent). They have
    at most c + the sum over classes of min(v, w) in common, with c rare shingles in common and v, w frequent ones in a
    class. Pairs with a rare shingle in common come from an index of the rare shingles, each of which has few
    documents. For pairs without one, c is 0: the members outside a bucket's largest component ask for them in bins of
    size, and the classes leave little beyond the links themselves: in a family of edited copies the edits of two
    members miss frequent shingles of different classes.
    """
    buckets = tasks(docs)
    members = written(named.select("doc_id", "component").distinct())
    small = members.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(members) if small else members, "doc_id").select("doc_id", "text", "component")
    owned = written(texts.mapInArrow(tidy(_owned(words, buckets)), BLOB))
    rare = dealt(owned.where(F.col("kind") == _SHINGLES), buckets).mapInArrow(tidy(_rare(buckets)), BLOB)
    counted = written(dealt(rare.unionByName(owned.where(F.col("kind") == _COUNTS)), buckets).mapInArrow(tidy(_summed), _SUMMED))
    frequent = counted.where("b is null").select(F.col("a").alias("doc_id"), F.col("n").alias("v"), "classes")
    share = percent / (100.0 + percent)
    sizes = members.join(reps.select("doc_id", F.col("n_shingles").alias("size")).distinct(), "doc_id").join(frequent, "doc_id", "left")
    v = F.coalesce("v", F.lit(0))
    classes = F.coalesce("classes", F.array_repeat(F.lit(0), CLASSES))
    sizes = written(sizes.select("doc_id", "size", classes.alias("classes"), F.floor(v / share - F.col("size") + 1e-6).alias("most"), F.ceil(F.col("size") * (percent / 100.0) - 1e-6).alias("fewest")))
    common = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: F.least(i, j)), F.lit(0), lambda n, k: n + k)
    end = lambda c: sizes.select(F.col("doc_id").alias(c), F.col("size").alias(f"size_{c}"), F.col("classes").alias(f"classes_{c}"))
    shared = counted.where("b is not null").join(end("a"), "a").join(end("b"), "b")
    shared = shared.where(common("classes_a", "classes_b") + F.col("n") >= share * (F.col("size_a") + F.col("size_b")) - 1e-6).select("a", "b")
    rows = named.join(sizes.where("most >= fewest"), "doc_id")  # others have no partner without a rare shingle in common
    held = named.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
    bin_of = lambda c: F.floor(F.log(c) / F.log(F.lit(1.02))).cast("int")
    asking = rows.join(held, "bucket").where("component <> main").withColumn("bin", F.explode(F.sequence(bin_of(F.col("fewest")), bin_of(F.least(F.col("most"), F.floor(F.col("size") * (100.0 / percent) + 1e-6))))))
    asked = rows.select("bucket", bin_of(F.col("size")).alias("bin"), F.col("doc_id").alias("other"), F.col("component").alias("theirs"), F.col("size").alias("s"), F.col("most").alias("m"), F.col("classes").alias("held"))
    near = (F.col("component") != F.col("theirs")) & (F.col("s") <= F.col("most")) & (F.col("size") <= F.col("m")) & (common("classes", "held") >= share * (F.col("size") + F.col("s")) - 1e-6)
    both = asking.join(asked, ["bucket", "bin"]).where(near)
    return both.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).unionByName(shared).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of near-duplicate documents: doc_id, n_shingles, component_id, kept.

    docs has doc_id and text; other columns are ignored, whatever their names. A document's set holds the distinct
    shingles of `words` words, compared without the case of A-Z; fewer words make one shingle. Null, empty and blank
    texts have no shingles and link with nothing. Two documents link if 100 * common >= percent * union. Rows with
    one doc_id each get a row. A row without doc_id links with nothing: its component_id is null, and it is kept.
    An empty table gives an empty result.

    The banding finds a pair at exactly 0.8 with a probability of 1 - 7e-6, and nearer ones almost surely.
    First each class is compared with the head (smallest id) of a bucket, the nearest head it has; those that a head
    doesn't link ask the next head of the bucket, as long as such rounds link many. Then comes what is left across
    components: other heads, and members of buckets that still hold several components.
    They are made for a percent of 80 and more; a smaller one is refused.
    """
    if percent < 80:
        raise ValueError("bands and the sketch filter are made for percent >= 80: below, they would miss links")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(docs.mapInArrow(tidy(_sign(words)), SIGNED))
    keys = ["n_shingles", "k1", "k2"]
    member = signed.select("doc_id", *keys)
    # of each class, the row with the smallest id
    reps = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*keys).agg(F.min(F.struct("doc_id", "sketch", "bands")).alias("x"))
    reps = written(reps.select("x.doc_id", *keys, "x.sketch", "x.bands"))
    classes = reps.select(F.col("doc_id").alias("rep"), *keys)
    band = written(reps.select("doc_id", F.explode("bands").alias("bucket")))
    several = band.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    crowded = written(band.join(several, "bucket").distinct())  # members of buckets with several
    rest, alike, best, links = crowded, None, None, None
    while True:
        head = rest.groupBy("bucket").agg(F.min("doc_id").alias("a"))
        pairs = rest.join(head, "bucket").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
        near = written(_alike(pairs if alike is None else pairs.join(alike, ["a", "b"], "left_anti"), reps))
        nearest = written(near.groupBy("b").agg(F.max(F.struct("equal", -F.col("a"))).alias("x")).select((-F.col("x.col2")).alias("a"), "b"))
        linked = _confirmed(nearest, docs, words, percent)
        near = near.select("a", "b")
        alike, best, links = (new if old is None else old.unionByName(new) for old, new in ((alike, near), (best, nearest), (links, linked)))
        if linked.count() * WORTH < nearest.count() or linked.isEmpty():
            break
        # on with those that were no head of their bucket and that none has linked
        rest = written(rest.join(head, "bucket").where("doc_id <> a").select("bucket", "doc_id").join(linked.select(F.col("b").alias("doc_id")), "doc_id", "left_anti"))
    found = written(components(links))
    others = _across(alike.join(best, ["a", "b"], "left_anti"), found)
    named = crowded.join(found, F.col("doc_id") == F.col("node"), "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    named = written(named.join(mixed, "bucket", "left_semi"))
    cross = _alike(_partners(named, reps, docs, words, percent).join(alike, ["a", "b"], "left_anti"), reps)
    late = _confirmed(written(others.select("a", "b").unionByName(cross.select("a", "b")).distinct()), docs, words, percent)
    name = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    if not late.isEmpty():  # links between components
        between = late.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        above = written(components(between)).select(F.col("node").alias("component"), F.col("component").alias("above"))
        singles = above.join(found.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("above").alias("component"))
        found = written(found.join(above, "component", "left").select("node", F.coalesce("above", "component").alias("component")).union(singles))
    of_class = written(classes.join(found, F.col("rep") == F.col("node"), "left").select(*keys, F.coalesce("component", "rep").alias("component_id")))
    out = member.join(of_class, keys, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Of the pairs, those whose ends aren't in one component yet."""
    named = pairs.join(found.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(found.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    return named.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each near-duplicate group, the one with the smallest doc_id; columns as they were.

    Rows without doc_id stay. Of rows with one doc_id and equal text, one stays; other texts under a doc_id that stays do too.
    """
    groups = near_duplicates(docs, words, percent).where("kept").select("doc_id").where("doc_id is not null").distinct()
    kept = docs.join(groups, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null"))

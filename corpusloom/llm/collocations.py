"""Phrase collocations from count streams in prefix and in suffix order.

Words, pairs and triples are counted one length after another; a longer phrase is only counted where the shorter ones
in it were often enough, since it can't be more frequent than they are. The frequent phrases of all lengths then form
one stream in the order of their words and one in the order of their words from the last: in the first, a phrase comes
right behind those that it begins with, in the second, behind those that it ends with. One pass over each in lockstep
gives all left and right counts, and which longer phrase contains a shorter one; nothing is looked up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hashing import mix, prefix_sums, span_hashes
from .work import partitions, release, written

#: Bytes of text that a task counts at once, rows that it hands on at once, and bits of the filter that passes what may be
#: frequent (8 MB).
AT_ONCE, ROWS_OUT, FILTER_BITS = 6 << 20, 1 << 15, 1 << 26

#: What a byte is: part of a word, blank, or end of a piece. A-Z become a-z.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(b"\x20\x09")] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_COUNTS = "lang string, phrase string, n long"


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings without nulls, and where each begins and ends in them."""
    if not len(values):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int32)
    ends = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, for each word in order its number among these, and the piece that it stands in."""
    data, ends = _bytes(texts)
    kind = _KIND[data]
    inside = kind == 0
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[ends] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(begins)
    pieces = np.cumsum((kind == 2) | edge[:-1], dtype=np.int32)[starts]
    upto = np.cumsum(inside, dtype=np.int32)
    bounds = np.append(upto[starts] - 1, upto[-1] if len(upto) else 0).astype(np.int32)
    letters = _LOWER[data[inside]]
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), pieces


def _hashes(lang: str, values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word in its language."""
    data, ends = _bytes(values)
    own = np.frombuffer(lang.encode(), dtype=np.uint8)
    of_lang = span_hashes(prefix_sums(own), np.array([0]), np.array([len(own)]))
    return mix(span_hashes(prefix_sums(data), ends[:-1], ends[1:]) ^ of_lang)


def _paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(FILTER_BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """lang and texts, AT_ONCE bytes of all languages together; a longer text comes alone."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out() -> Iterator[tuple[str, pa.Array]]:
        table = pa.Table.from_batches(held).combine_chunks()
        for lang in table["lang"].unique().to_pylist():
            yield lang, pc.filter(table["text"], pc.equal(table["lang"], lang)).combine_chunks()

    for batch in batches:
        lengths = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = lengths[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(lengths, before + AT_ONCE - size, side="right")))
            held.append(batch.slice(at, upto - at))
            size += int(lengths[upto - 1] - before)
            at = upto
            if size >= AT_ONCE or at < batch.num_rows:
                yield from out()
                held.clear()
                size = 0
    if held:
        yield from out()


def _grouped(dictionary: pa.Array, *places: np.ndarray) -> tuple[list[pa.Array], np.ndarray]:
    """The distinct phrases of words at the same index of places, a list for each place, and how often each occurs."""
    n = max(1, len(dictionary))
    if n ** len(places) < 1 << 62:
        key = places[0]
        for p in places[1:]:
            key = key * n + p
        found, counts = np.unique(key, return_counts=True)
        parts = [found // n**i % n for i in range(len(places))][::-1]
    else:  # pairs get numbers of their own first
        pairs, number = np.unique(places[0] * n + places[1], return_inverse=True)
        found, counts = np.unique(number * n + places[2], return_counts=True)
        parts = [pairs[found // n] // n, pairs[found // n] % n, found % n]
    return [dictionary.take(pa.array(p)) for p in parts], counts


def _counting(size: int, frequent: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts phrases of `size` words whose words (in triples, pairs) may all be frequent; of single words all, and their number under ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(frequent.value, dtype=np.uint8) if frequent else None
        try:
            for lang, texts in _by_lang(batches):
                dictionary, ids, pieces = words(texts)
                if size == 1:
                    parts, counts = _grouped(dictionary, ids)
                    parts = [pa.concat_arrays([parts[0], pa.array([b""], pa.binary())])]
                    counts = np.append(counts, len(ids))
                else:
                    hashes = _hashes(lang, dictionary)
                    here = pieces[1:] == pieces[:-1]
                    if size == 2:
                        may = _passes(bits, hashes)[ids]
                        at = np.flatnonzero(here & may[1:] & may[:-1])
                    else:
                        h = hashes[ids]
                        here &= _passes(bits, _paired(h[:-1], h[1:]))
                        at = np.flatnonzero(here[1:] & here[:-1])
                    parts, counts = _grouped(dictionary, *(ids[at + i] for i in range(size)))
                for at in range(0, len(counts), ROWS_OUT):
                    some = [p.slice(at, ROWS_OUT) for p in parts]
                    phrase = (pc.binary_join_element_wise(*some, pa.scalar(b" ", pa.binary())) if size > 1 else some[0]).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(phrase)), phrase, pa.array(counts[at : at + ROWS_OUT], pa.int64())], ["lang", "phrase", "n"])
        finally:
            release()

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter's words of 64 bits with the bits of each phrase set."""
    try:
        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                own = pc.split_pattern(pc.filter(batch.column("phrase"), pc.equal(batch.column("lang"), lang)), " ")
                size = len(own[0])
                hashes = _hashes(lang, own.flatten().cast(pa.binary()))
                at = np.sort((hashes if size == 1 else _paired(hashes[0::2], hashes[1::2])) & np.uint64(FILTER_BITS - 1))
                place = (at >> np.uint64(6)).astype(np.int64)
                first = np.flatnonzero(np.diff(place, prepend=-1))
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(place[first]), pa.array(bits.view(np.int64))], ["w", "b"])
    finally:
        release()


def _filter_of(frequent: DataFrame) -> Broadcast:
    """A bit array of FILTER_BITS, whatever the number of phrases: it lets all of them through, and few others while it is sparse."""
    found = frequent.select("lang", "phrase").mapInArrow(_marked, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bits[found["w"].to_numpy()] = found["b"].to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(bits.tobytes())


def counted(docs: DataFrame, least: int) -> DataFrame:
    """lang, phrase and n of all phrases of one to three words that occur `least` times in their language; under '' all its words."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = lambda size, seen: texts.mapInArrow(_counting(size, seen), _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    one = written(total(1, None).where((F.col("n") >= least) | (F.col("phrase") == "")))
    two = written(total(2, _filter_of(one.where("phrase <> ''"))).where(F.col("n") >= least))
    three = total(3, _filter_of(two)).where(F.col("n") >= least)
    return written(one.unionByName(two).unionByName(three))


_LOCKSTEP = "part int, lang string, k1 string, k2 string, k3 string, n long, h1 long, h2 long, longer long"


def _lockstep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gives each phrase the counts of those it comes behind: h1 of its first key alone, h2 of its first two.

    For the phrases behind a pair there is one more row for the pair, with the largest count as `longer`, and at the end
    of a part one without lang that says which counts were last. What the part before has said last is null here.
    """
    part = TaskContext.get().partitionId()
    last: list[int | None] = [None, None]
    strings = lambda x: [None] * x
    for batch in batches:
        k = [batch.column(c) for c in ("k1", "k2", "k3")]
        n = batch.column("n").to_numpy()
        level = 1 + sum((pc.not_equal(c, "").to_numpy(zero_copy_only=False).astype(np.int8) for c in k[1:]), np.zeros(len(n), dtype=np.int8))
        heads = []
        for i in (0, 1):
            at = np.maximum.accumulate(np.where(level == i + 1, np.arange(len(n)), -1))
            known = (at >= 0) | (last[i] is not None)
            heads.append(pa.array(np.where(at >= 0, n[at], last[i] or 0), pa.int64(), mask=~known))
            last[i] = int(n[at[-1]]) if at[-1] >= 0 else last[i]
        long = pa.array(level > 1)
        none = pa.nulls(len(n), pa.int64())
        rows = [pa.array(np.full(len(n), part, dtype=np.int32)), batch.column("lang"), *k, batch.column("n"), *heads, none]
        yield pa.RecordBatch.from_arrays([c.filter(long) for c in rows], names=["part", "lang", "k1", "k2", "k3", "n", "h1", "h2", "longer"])
        group = np.cumsum(level < 3)
        third = np.flatnonzero(level == 3)
        if len(third):
            first = np.flatnonzero(np.diff(group[third], prepend=-1))
            at = pa.array(third[first])
            none = pa.nulls(len(first), pa.int64())
            rows = [pa.array(np.full(len(first), part, dtype=np.int32)), *(c.take(at) for c in (batch.column("lang"), k[0], k[1])), pa.array([""] * len(first)), none, none, none, pa.array(np.maximum.reduceat(n[third], first), pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, names=["part", "lang", "k1", "k2", "k3", "n", "h1", "h2", "longer"])
    if last != [None, None]:
        one = [[part], *[strings(1)] * 4, [None], [last[0]], [last[1]], [None]]
        kinds = [pa.int32(), *[pa.string()] * 4, *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(one, kinds)], names=["part", "lang", "k1", "k2", "k3", "n", "h1", "h2", "longer"])


def _stream(phrases: DataFrame, keys: list[Column]) -> DataFrame:
    """The lockstep pass over phrases in the order of keys: ranges of it in parts, each with the counts that the parts before end with."""
    n = partitions(phrases.sparkSession)
    sorted_ = phrases.select("lang", *(F.coalesce(k, F.lit("")).alias(f"k{i}") for i, k in enumerate(keys, 1)), "n")
    sorted_ = sorted_.repartitionByRange(n, "lang", "k1", "k2", "k3").sortWithinPartitions("lang", "k1", "k2", "k3")
    rows = written(sorted_.mapInArrow(_lockstep, _LOCKSTEP))
    # one row for each part
    ends = rows.where("lang IS NULL").select("part", "h1", "h2")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("part")).join(ends, "part", "left")
    begin = parts.select("part", *(F.last(h, ignorenulls=True).over(before).alias(f"b{h}") for h in ("h1", "h2")))
    return rows.where("lang IS NOT NULL").join(F.broadcast(begin), "part").select("lang", "k1", "k2", "k3", "n", *(F.when(F.col("n").isNotNull(), F.coalesce(h, f"b{h}")).alias(h) for h in ("h1", "h2")), "longer")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    docs has text and lang; other columns are ignored. Null texts are empty, a null lang is "und". Pieces lie between
    `.,;:!?` and line ends, words between spaces and tabs; A-Z are lower-cased. Phrases of two and three words that occur
    `least` times are scored by their lowest cut, floor(1000000 * a * a / (l * r)) in exact integers; those in a longer one
    that occurs in `share` percent of their places are dropped. All texts are read whole; rows that repeat count again.
    Ties go by a and then by the phrase's bytes. Languages without a phrase that is frequent enough don't appear; an
    empty table gives an empty result.
    """
    all_ = counted(docs, least)
    phrases = all_.where("phrase <> ''").withColumn("w", F.split("phrase", " "))
    at = lambda i: F.get("w", F.lit(i))
    back = lambda i: F.get("w", F.size("w") - i)
    name = lambda *k: F.array_join(F.filter(F.array(*k), lambda x: x != ""), " ").alias("phrase")
    nothing = F.lit(None).cast("long")
    triple = F.col("k3") != ""
    left = _stream(phrases, [at(0), at(1), at(2)]).select("lang", name("k1", "k2", "k3"), "n", F.col("h1").alias("l1"), F.when(triple, F.col("h2")).alias("l2"), nothing.alias("r1"), nothing.alias("r2"), "longer")
    right = _stream(phrases, [back(1), back(2), back(3)]).select("lang", name("k3", "k2", "k1"), "n", nothing.alias("l1"), nothing.alias("l2"), F.when(triple, F.col("h2")).otherwise(F.col("h1")).alias("r1"), F.when(triple, F.col("h1")).alias("r2"), "longer")
    both = left.unionByName(right).groupBy("lang", "phrase").agg(F.max("n").alias("a"), *(F.max(c).alias(c) for c in ("l1", "l2", "r1", "r2", "longer")))
    wide = lambda c: f"cast({c} AS decimal(15, 0))"
    cut = lambda i: F.expr(f"(cast(1000000 AS decimal(7, 0)) * ({wide('a')} * {wide('a')})) div ({wide(f'l{i}')} * {wide(f'r{i}')})")
    both = both.where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    both = both.withColumn("s1", cut(1)).withColumn("s2", cut(2)).withColumn("second", F.coalesce(F.col("s2") < F.col("s1"), F.lit(False)))
    pick = lambda one, two: F.when(F.col("second"), F.col(two)).otherwise(F.col(one))
    scored = both.select("lang", "phrase", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the first of each share of a language's phrases, then of these the first
    part = F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession)))
    some = scored.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = all_.where("phrase = ''").select("lang", F.col("n").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

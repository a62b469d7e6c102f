"""URL filters by a cascade of Bloom filters, in DataFrame functions only.

A cascade answers whether a key is listed, exactly for every key of the corpus: its first level encodes the listed keys,
the second those other keys of the corpus that the first one lets through by chance, the third the listed keys that the
second one lets through, and so on until a level lets none through. A key is listed if the first level that doesn't
hold it has an even number. Pages need no join with the lists; each level is one row of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import written

#: Bits of a level at most (8 MB). A list that needs more is joined instead.
MOST_BITS = 1 << 26
#: Words of 64 bits in one chunk of a level.
CHUNK = 1 << 10

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """host (A-Z in lower case) and path of a URL; both empty for null and where there is no `://`."""
    part = lambda i: F.coalesce(F.regexp_extract(url, _URL, i), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


@dataclass
class Level:
    """One Bloom filter: number of bits (a power of two), places of a key, and a table of one row with the words."""

    number: int
    bits: int
    places: int
    words: DataFrame | None = None

    def positions(self, key: Column) -> Column:
        """Where a key's bits stand; each level hashes anew, so that what collides in one doesn't in the next."""
        first, step = (F.pmod(F.xxhash64(F.lit(2 * self.number + i), key), F.lit(self.bits)) for i in (0, 1))
        return F.transform(F.sequence(F.lit(0), F.lit(self.places - 1)), lambda i: F.pmod(first + i * step, F.lit(self.bits)))

    def beside(self, df: DataFrame) -> DataFrame:
        """df with the level's words as a column, the same in each row, for `holds`."""
        return df.withColumn(f"_level{self.number}", self.words.scalar())

    def holds(self, key: Column) -> Column:
        words = F.col(f"_level{self.number}")
        chunk = lambda p: F.get(words, F.shiftright(p, (64 * CHUNK).bit_length() - 1).cast("int"))
        word = lambda p: F.get(chunk(p), F.pmod(F.shiftright(p, 6), F.lit(CHUNK)).cast("int"))
        return F.forall(self.positions(key), lambda p: F.getbit(word(p), F.pmod(p, F.lit(64))) == 1)


def _filled(level: Level, keys: DataFrame) -> Level:
    """The level with the bits of keys set: bits meet in words, words in chunks, chunks in one row."""
    chunks = max(1, level.bits // (64 * CHUNK))
    place = F.explode(level.positions(F.col("key"))).alias("p")
    bit = keys.select(place).select(F.floor(F.col("p") / 64).alias("w"), F.expr("shiftleft(1L, cast(pmod(p, 64) as int))").alias("b"))
    zero = keys.sparkSession.range(chunks * CHUNK).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    words = bit.unionByName(zero).groupBy("w").agg(F.bit_or("b").alias("b"))
    ordered = lambda key, value: F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value])
    chunk = words.groupBy(F.floor(F.col("w") / CHUNK).alias("c")).agg(ordered("w", "b").alias("words"))
    return Level(level.number, level.bits, level.places, written(chunk.agg(ordered("c", "words").alias("words")).coalesce(1)))


@dataclass
class Cascade:
    levels: list[Level]

    def asked(self, df: DataFrame, name: str, answer: Callable[[Callable[[Column], Column]], Column]) -> DataFrame:
        """df with a column that `answer` makes from a test of keys."""
        out = df
        for level in self.levels:
            out = level.beside(out)
        return out.withColumn(name, answer(self.holds)).drop(*(f"_level{x.number}" for x in self.levels))

    def holds(self, key: Column) -> Column:
        """Whether key is listed: right for every key that the cascade was built over. Null isn't listed."""
        if not self.levels:
            return F.lit(False)
        out = F.when(key.isNull(), False)
        for level in self.levels:
            out = out.when(~level.holds(key), level.number % 2 == 1)
        return out.otherwise(len(self.levels) % 2 == 1)


def cascade(keys: DataFrame) -> Cascade | None:
    """The cascade over keys (key, listed boolean; each key once); None where a level would exceed MOST_BITS.

    A level has so many bits for each of its keys that about as many others pass as it encodes; each level is built
    from what the one before let through, by scans only. Without listed keys there are no levels.
    """
    inside, outside = (keys.where(F.col("listed") == flag).select("key") for flag in (True, False))
    n = keys.agg(F.coalesce(F.sum(F.col("listed").cast("long")), F.lit(0)), F.count("*")).first()
    n_in, n_out = n[0], n[1] - n[0]
    levels: list[Level] = []
    while n_in:
        each = 3 + ceil(1.44 * log2(max(2.0, n_out / n_in)))
        bits = max(64 * CHUNK, 1 << ceil(log2(n_in * each)))
        if bits > MOST_BITS:
            return None
        level = _filled(Level(len(levels), bits, max(1, min(12, round(0.69 * min(each, bits / n_in))))), inside)
        levels.append(level)
        inside, outside = written(level.beside(outside).where(level.holds(F.col("key"))).select("key")), inside
        n_in, n_out = inside.count(), n_in
    return Cascade(levels)


def _universe(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """key, listed for every distinct key of the corpus; keys repeat freely, equal ones meet before the shuffle."""
    both = keys.select("key", F.lit(False).alias("listed"), F.lit(True).alias("here")).unionByName(listed.select("key", F.lit(True).alias("listed"), F.lit(False).alias("here")))
    return written(both.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("listed").alias("listed"), F.max("here").alias("here")).where("here").select("key", "listed"))


def _fitting(rules: list[tuple[str, str, str]]) -> list[Column]:
    """For each shape of a rule (labels of the host, characters of the path) what of a URL could be such a rule; null where it is too short."""
    host, path = F.col("host"), F.col("path")
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    shapes = sorted({(h.count("."), len(p)) for _, h, p in rules})
    return [F.when((dots >= d) & (F.length(path) >= p), F.concat(F.substring_index(host, ".", -d - 1), F.substring(path, 1, p))) for d, p in shapes]


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """page_id, url, host, path, rule and verdict of each page.

    rules are (verdict, host, path): one fits its host and all hosts under it where the URL's path starts with its own.
    The longest that fits (host and path together; of two equally long ones the later in code-point order) gives the
    verdict, "allow" before "block" where both are listed under one name. Elsewhere pages whose host and path together
    are a key of `listed` are blocked, and all others allowed. Rules without a host fit nothing.

    pages has page_id and url; other columns are ignored, as are those of `listed` other than key. Null URLs and those
    without `://` have an empty host and path. Null and repeated keys are listed once or not at all. Repeated pages are
    judged one by one; an empty table gives an empty result, and an empty list blocks nothing.

    Both lists are asked through cascades over all keys that occur in pages. A list that would need a level of more
    than MOST_BITS is joined with the pages' keys instead.
    """
    rules = [(v, h.lower(), p) for v, h, p in rules if h]
    host, path = url_parts(F.col("url").cast("string"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    spark = pages.sparkSession
    if rules:
        could = [F.concat(F.lit(mark), x) for x in _fitting(rules) for mark in ("allow ", "block ")]
        named = spark.createDataFrame([(f"{v} {h}{p}",) for v, h, p in rules], "key string")
        found = cascade(_universe(rows.select(F.explode(F.array(*could)).alias("key")), named))
        if found is None:
            raise ValueError(f"the rules are a short list, and don't fit {MOST_BITS} bits")
        rows = found.asked(rows, "fit", lambda holds: F.filter(F.array(*could), holds))
        best = F.array_max(F.transform("fit", lambda x: F.struct(F.length(F.substring(x, 7, 1 << 30)).alias("n"), F.substring(x, 7, 1 << 30).alias("rule"), F.startswith(x, F.lit("allow")).alias("allow"))))
        rows = rows.withColumn("best", best).drop("fit")
    else:
        rows = rows.withColumn("best", F.lit(None).cast("struct<n:int,rule:string,allow:boolean>"))
    key = F.concat("host", "path")
    keys = _universe(rows.select(key.alias("key")), listed.select(F.col("key").cast("string").alias("key")))
    urls = cascade(keys)
    if urls is None:
        rows = rows.join(keys.where("listed").select(F.col("key").alias("_key")), key == F.col("_key"), "left").withColumn("on_list", F.col("_key").isNotNull())
    else:
        rows = urls.asked(rows, "on_list", lambda holds: holds(key))
    verdict = F.when(F.coalesce(F.col("best.allow"), ~F.col("on_list")), "allow").otherwise("block")
    return rows.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))

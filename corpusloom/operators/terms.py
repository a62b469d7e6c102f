"""Terminology: vocabularies, linking in three tiers, expansion, and the choice of what to ask next."""

from __future__ import annotations

from math import acos, ceil, log, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import alias_record_id
from ..functions.text import code_category, cosine
from .tables import is_small, small
from .tiles import nearest_rows

def load_vocabulary(rows: DataFrame, order: str) -> DataFrame:
    """code and name without nulls and blanks; the first row (by `order`) of each code."""
    clean = rows.na.drop(subset=["code", "name"]).select(F.trim("code").alias("code"), F.trim("name").alias("name"), F.col(order).alias("_o")).where("code <> '' and name <> ''")
    return clean.withColumn("_n", F.row_number().over(W.partitionBy("code").orderBy("_o"))).where("_n = 1").select("code", "name")


def build_alias_records(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.select(alias_record_id(F.col("code"), F.col("name")).alias("id"), F.col("code").alias("concept_id"), F.col("name").alias("preferred_term"), F.col("name").alias("alias"), code_category(F.col("code")).alias("category"))


def merge_vocabularies(layers: list[DataFrame]) -> DataFrame:
    """Union of layers, each alias from the first layer that has it."""
    rows = None
    for i, layer in enumerate(layers):
        own = layer.withColumn("layer", F.lit(i))
        rows = own if rows is None else rows.unionByName(own)
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("alias").orderBy("layer", "concept_id"))).where("_n = 1").drop("_n")


def vocabulary_counts(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.groupBy("category").agg(F.count("*").alias("aliases"), F.countDistinct("concept_id").alias("concepts"))


def link_exact(mentions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Mentions (mention_id, text) with the concept of an equal alias; ties to the smallest concept id."""
    best = vocabulary.groupBy("alias").agg(F.min("concept_id").alias("concept_id"), F.min_by("preferred_term", "concept_id").alias("preferred_term"))
    return mentions.join(small(best), mentions["text"] == best["alias"]).select("mention_id", "text", "concept_id", "preferred_term", F.lit(1.0).alias("score"))


#: Bits of a block key and the chance of missing a pair at the threshold.
BITS, MISSED = 12, 0.001


def _blocks(threshold: float):
    """Block keys of vectors: signs of random projections, in as many tables as a pair at the threshold needs to meet."""
    meet = (1 - acos(min(1.0, threshold)) / pi) ** BITS
    tables = max(1, ceil(log(MISSED) / log(1 - meet))) if meet < 1 else 1

    @F.pandas_udf("array<long>")
    def keys(vectors: pd.Series) -> pd.Series:
        out: list[list[int] | None] = []
        for v in vectors:
            if v is None:
                out.append(None)
                continue
            planes = np.random.default_rng(len(v)).standard_normal((tables * BITS, len(v)))
            bits = (planes @ np.asarray(v, dtype=np.float64) > 0).reshape(tables, BITS)
            out.append((bits @ (1 << np.arange(BITS)) + (np.arange(tables) << BITS)).tolist())
        return pd.Series(out)

    return keys


def link_nearest(mentions: DataFrame, vocabulary: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Mentions (mention_id, text, vector) with the concept of the nearest alias, if near enough.

    If one side is small, it is broadcast and multiplied with the other. Two large sides meet in blocks of random
    projections: a pair at the threshold is missed with a chance of MISSED, nearer ones more rarely.
    """
    asked = mentions.select("mention_id", "text", "vector")
    if is_small(vocabulary.select("vector")) or is_small(asked):
        best = nearest_rows(asked, vocabulary.select("concept_id", "preferred_term", "vector"), 1, ["concept_id"], digits=12)
        return best.where(F.col("score") >= threshold).select("mention_id", "text", "concept_id", "preferred_term", "score")
    v = vocabulary.select("concept_id", "preferred_term", F.col("vector").alias("_v"))
    pairs = blocked_pairs(mentions, v, threshold)
    pairs = pairs.withColumn("score", F.round(cosine(F.col("vector"), F.col("_v")), 12)).where(F.col("score") >= threshold)
    best = pairs.groupBy("mention_id", "text").agg(F.max(F.struct("score")).alias("_s"), F.min_by(F.struct("concept_id", "preferred_term"), F.struct(-F.col("score"), F.col("concept_id"))).alias("_b"))
    return best.select("mention_id", "text", "_b.concept_id", "_b.preferred_term", F.col("_s.score").alias("score"))


def blocked_pairs(mentions: DataFrame, vocabulary: DataFrame, threshold: float) -> DataFrame:
    """Pairs of mentions (vector) and vocabulary (_v) that share a block; a pair may come more than once."""
    keys = _blocks(threshold)
    m = mentions.withColumn("_block", F.explode(keys(F.col("vector").cast("array<double>"))))
    return m.join(vocabulary.withColumn("_block", F.explode(keys(F.col("_v").cast("array<double>")))), "_block").drop("_block")


def link_entities(mentions: DataFrame, vocabulary: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Exact links, else nearest ones, else none (score 0)."""
    exact = link_exact(mentions, vocabulary).withColumn("tier", F.lit(1))
    rest = mentions.join(exact.select("mention_id"), "mention_id", "left_anti")
    near = link_nearest(rest, vocabulary, threshold).withColumn("tier", F.lit(2))
    none = rest.join(near.select("mention_id"), "mention_id", "left_anti").select("mention_id", "text", F.lit(None).cast("string").alias("concept_id"), F.lit(None).cast("string").alias("preferred_term"), F.lit(0.0).alias("score"), F.lit(3).alias("tier"))
    return exact.unionByName(near).unionByName(none)


def link_stats(linked: DataFrame) -> DataFrame:
    return linked.groupBy("tier").agg(F.count("*").alias("mentions"), F.countDistinct("concept_id").alias("concepts"))


def expand_aliases(concepts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """For each dimension, one bag of the aliases (2 characters or more) of its concepts, distinct and in order."""
    found = concepts.join(small(vocabulary.select("concept_id", "alias")), "concept_id").where(F.length("alias") >= 2)
    return found.groupBy("dimension").agg(F.array_join(F.array_sort(F.collect_set("alias")), " ").alias("bag"))


def alias_topk(queries: DataFrame, vocabulary: DataFrame, k: int, category: str | None = None) -> DataFrame:
    """The k best preferred terms of each query; of a term's aliases the best score counts, ties to the shorter, then the smaller id."""
    rows = vocabulary if category is None else vocabulary.where(F.col("category") == category)
    aliases = rows.select("concept_id", "preferred_term", "alias", F.length("alias").alias("_chars"), "vector")
    pool = nearest_rows(queries.select("query_id", "vector"), aliases, max(5 * k, 20), ["_chars", "concept_id", "alias"], digits=6).withColumnRenamed("place", "_n").drop("_chars")
    one = pool.withColumn("_t", F.row_number().over(W.partitionBy("query_id", "preferred_term").orderBy("_n"))).where("_t = 1")
    return one.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("_n"))).where(F.col("rank") <= k).drop("_n", "_t")


def tfidf_keywords(docs: DataFrame, k: int = 30, sizes: tuple[int, int] = (2, 4), features: int = 500) -> DataFrame:
    """Best character n-grams of words by mean TF-IDF over documents (doc_id, text): smoothed idf, unit length.

    Words are padded with a blank on both sides; the most frequent n-grams are the features; results have 2 to 12
    characters once trimmed.
    """
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))).alias("w")).select("doc_id", F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    # a lambda of two arguments would get the place as the second
    cut = lambda n: lambda i: F.substring("w", i, F.lit(n))
    none = F.array().cast("array<string>")
    grams = F.flatten(F.array(*[F.when(F.length("w") >= n, F.transform(F.sequence(F.lit(1), F.length("w") - n + 1), cut(n))).otherwise(none) for n in range(sizes[0], sizes[1] + 1)]))
    tf = words.select("doc_id", F.explode(grams).alias("g")).groupBy("doc_id", "g").agg(F.count("*").alias("tf"))
    top = tf.groupBy("g").agg(F.sum("tf").alias("_all"), F.count("*").alias("df")).orderBy(F.desc("_all"), "g").limit(features)
    n = docs.count()
    part = tf.join(F.broadcast(top), "g").withColumn("x", F.col("tf") * (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1))
    unit = part.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy("doc_id"))))
    mean = unit.groupBy("g").agg((F.sum("x") / F.lit(max(n, 1))).alias("score"))
    return mean.where(F.length(F.trim("g")).between(2, 12)).orderBy(F.desc("score"), "g").limit(k)


def term_share(terms: DataFrame, candidates: DataFrame) -> DataFrame:
    """Share of a query's candidates whose text holds the term, and the binary entropy of that share."""
    both = terms.join(candidates.select("query_id", "candidate_text"), "query_id")
    p = both.groupBy("query_id", "term").agg(F.avg(F.contains(F.col("candidate_text"), F.col("term")).cast("double")).alias("p"))
    h = lambda q: -q * F.log2(q)
    gain = F.when((F.col("p") > 0) & (F.col("p") < 1), h(F.col("p")) + h(1 - F.col("p"))).otherwise(0.0)
    return p.withColumn("gain", gain)


def ordered_terms(linked: DataFrame, *keys: str) -> DataFrame:
    """Terms in the order of output: by keys, linked ones first, then by text."""
    return linked.orderBy(*keys, F.col("linked").desc(), "text")


def placed_terms(terms: DataFrame, prefix: int = 2) -> DataFrame:
    """Every term (linked, text; text tells them apart) with its place in that order, from 1.

    Terms that begin alike are numbered among themselves, after as many as all beginnings before theirs have; so no task
    sees more than the terms of one beginning.
    """
    begin = F.substring("text", 1, prefix)
    rows = terms.withColumn("_begin", begin)
    own = F.row_number().over(W.partitionBy("linked", "_begin").orderBy("text"))
    sizes = rows.groupBy("linked", "_begin").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(F.desc("linked"), "_begin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("linked").alias("_l"), F.col("_begin").alias("_b"), before.alias("_before"))
    both = rows.withColumn("_own", own).join(offsets, F.col("linked").eqNullSafe(F.col("_l")) & F.col("_begin").eqNullSafe(F.col("_b")))
    return both.withColumn("place", F.col("_before") + F.col("_own")).drop("_begin", "_own", "_l", "_b", "_before")


def consume_evidence(items: DataFrame, findings: DataFrame) -> DataFrame:
    """Items as confirmed, denied or remaining by the findings (session_id, finding, positive); positive wins."""
    f = findings.groupBy("session_id", "finding").agg(F.max("positive").alias("positive"))
    by = lambda c, mark: f.select("session_id", F.col("finding").alias(c), F.col("positive").alias(mark))
    both = items.join(by("text", "_t"), ["session_id", "text"], "left").join(by("preferred_term", "_p"), ["session_id", "preferred_term"], "left")
    yes = F.coalesce(F.col("_t"), F.lit(False)) | F.coalesce(F.col("_p"), F.lit(False))
    seen = F.col("_t").isNotNull() | F.col("_p").isNotNull()
    return both.withColumn("status", F.when(yes, "confirmed").when(seen, "denied").otherwise("remaining")).drop("_t", "_p")


def drop_asked(items: DataFrame, asked: DataFrame, near: float = 0.3) -> DataFrame:
    """Items that weren't asked: linked ones by their term, others by the distance of their vectors."""
    keys = ["session_id", "preferred_term"]
    linked = items.where("linked").join(asked.select(*keys).distinct(), keys, "left_anti")
    loose = items.where("not linked or linked is null").alias("i")
    old = asked.select("session_id", F.col("vector").alias("v")).alias("a")
    return linked.unionByName(loose.join(old, (F.col("i.session_id") == F.col("a.session_id")) & (1 - cosine(F.col("i.vector"), F.col("a.v")) < near), "left_anti").select("i.*"))


def select_questions(candidates: DataFrame, k: int, quota: int = 2, threshold: float = 0.15) -> DataFrame:
    """Up to k questions a session: dimension items first (`quota` at most), then items by gain.

    candidates: session_id, round, item, kind ('dimension' or 'item'), gain, askable. What can't be asked is recorded
    as unaskable and takes no place; in later rounds nothing is asked if the best gain is under the threshold.
    """
    session = W.partitionBy("session_id")
    best = F.max(F.when(F.col("askable"), F.col("gain"))).over(session)
    stop = (F.col("round") > 1) & (F.coalesce(best, F.lit(0.0)) < threshold)
    kind = W.partitionBy("session_id", "kind", "askable").orderBy(F.desc("gain"), "item")
    rows = candidates.withColumn("_stop", stop).withColumn("_k", F.row_number().over(kind))
    good = F.col("askable") & ~F.col("_stop") & ((F.col("kind") != "dimension") | (F.col("_k") <= quota))
    rows = rows.withColumn("_good", good)
    place = F.row_number().over(W.partitionBy("session_id", "_good").orderBy((F.col("kind") != "dimension").cast("int"), F.desc("gain"), "item"))
    rows = rows.withColumn("_place", place)
    status = F.when(~F.col("askable"), "unaskable").when(F.col("_good") & (F.col("_place") <= k), "ask").otherwise("skip")
    return rows.withColumn("status", status).drop("_stop", "_k", "_good", "_place")


def append_terms(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing and the new records whose term isn't known; records without a term are always kept."""
    rows = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    n = F.row_number().over(W.partitionBy("session_id", "preferred_term").orderBy("_new", "position"))
    return rows.withColumn("_n", n).where((F.col("_new") == 0) | F.col("preferred_term").isNull() | (F.col("_n") == 1)).drop("_n", "_new")


def sparse_queries(complaint: Column, scalars: list[Column], lists: list[Column], least: int = 2) -> Column:
    """Trimmed texts of at least `least` characters in order, each once."""
    empty = F.array().cast("array<string>")
    every = F.concat(F.array(complaint, *scalars), *[F.coalesce(x, empty) for x in lists])
    return unique_ordered(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: F.length(x) >= least))


def drop_negated(c: Column) -> Column:
    """Whether a finding is no negative one."""
    return ~F.rlike(c, F.lit(r"\(-\)|正常|阴性|未见|无异常"))


def unique_ordered(c: Column) -> Column:
    """Values in order, each once."""
    return F.array_distinct(c)


def valid_slots(chosen: Column, empty: Column, quota: int) -> Column:
    return F.slice(F.array_intersect(chosen, empty), 1, quota)


def empty_slots(state: Column, scalars: list[str], lists: list[str]) -> Column:
    """Names of a struct's slots that are null or empty."""
    marks = [F.when(state[s].isNull() | (state[s] == ""), F.lit(s)) for s in scalars] + [F.when(state[s].isNull() | (F.size(state[s]) == 0), F.lit(s)) for s in lists]
    return F.array_compact(F.array(*marks))

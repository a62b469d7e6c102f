"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key over its quality weight; within a source, the smallest keys come first until
the token budget is used. Keys fall into cells of equal probability, so that the running sums need the documents of
one cell only, however large the source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import written

#: Cells of a source: the one at which the budget ends is put in order, the others are summed.
CELLS = 4096


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A document's weight: the share of its characters that are no digits or symbols, from 0.1 to 1.1."""
    n = F.length(text)
    plain = F.length(F.regexp_replace(text, "[0-9#*$%&|<>{}]", ""))
    return F.lit(0.1) + F.coalesce(plain / F.when(n > 0, n), F.lit(1.0))


def fingerprint(text: Column) -> Column:
    """64 bits that tell the texts of one doc_id apart."""
    return F.xxhash64(text.cast("string"))


def _uniform(salt: str) -> Column:
    """A number in (0, 1) from the document's id alone, the same in every run."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long")
    return (bits + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: list[int], most: int = 3) -> DataFrame:
    """source, source_size, target of a table with one row (source, source_size) for each source.

    The share of a source follows its weight; weights go to the sources by code point, null last, and repeat. A target
    stops at `most` times its source's size, and the excess is shared by weight again: the level at which the total
    is used up, found by one pass over the sources in the order in which they reach their limits.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    # one row for each source from here on, after grouping
    ordered = sizes.withColumn("_n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ordered = ordered.withColumn("_w", F.element_at(cycle, ((F.col("_n") - 1) % len(weights) + 1).cast("int"))).withColumn("_limit", F.col("source_size") * F.lit(float(most)))
    by = W.orderBy(F.col("_limit") / F.col("_w"), "_n")
    every = W.partitionBy(F.lit(1))
    before = by.rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    left = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    level = ordered.withColumn("_level", rest / left)
    # the first source whose limit isn't reached fixes the level for it and all after it
    free = F.min(F.when(F.col("_limit") > F.col("_level") * F.col("_w"), F.struct((F.col("_limit") / F.col("_w")).alias("r"), "_n", "_level"))).over(every)
    level = level.withColumn("_free", free["_level"])
    return level.select("source", "source_size", F.least(F.col("_limit"), F.coalesce(F.col("_free") * F.col("_w"), F.col("_limit"))).alias("target"))


def mixture(docs: DataFrame, weights: list[int] | None = None, most: int = 3, salt: str = "mix") -> DataFrame:
    """Every row of docs with size, source_size, target, copies (whole ones), part and taken.

    docs has doc_id, text and source; its other columns are dropped. Each source first gives as many complete epochs
    as fit its target; what is left is sampled without replacement by quality: documents in order of their keys, as
    long as they fit, and of the one at the edge the words that still fit (part). taken is what the mix takes of a
    document in words, repeats counted; a source's taken words miss its target by less than one. Null texts have size
    0; the null source is one of its own. Keys depend on doc_id and text alone: reruns agree. Rows that share a doc_id
    and a key are put in order by their size and text (fingerprint). An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), (-F.log(_uniform(salt)) / quality(F.col("text"))).alias("_key"), fingerprint(F.col("text")).alias("fingerprint"))
    rows = rows.withColumn("_cell", F.least(F.lit(CELLS - 1), F.floor((1 - F.exp(-F.col("_key"))) * CELLS)).cast("int"))
    rows = written(rows)  # texts are measured once
    cells = rows.groupBy("source", "_cell").agg(F.sum("size").alias("_sum"))
    goal = targets(cells.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights or [1, 2, 3], most)
    goal = goal.withColumn("_epochs", F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)).cast("long"))
    goal = goal.withColumn("_left", F.round(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("long"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    running = cells.withColumn("_before", F.sum("_sum").over(W.partitionBy("source").orderBy("_cell")) - F.col("_sum")).withColumnRenamed("source", "_s")
    edge = goal.join(running, same("source", "_s"), "left").where("_before <= _left").groupBy("source", "source_size", "target", "_epochs", "_left").agg(F.max(F.struct("_cell", "_before")).alias("_edge"))
    edge = edge.select(F.col("source").alias("_s"), "source_size", "target", "_epochs", "_left", F.col("_edge._cell").alias("_last"), F.col("_edge._before").alias("_sofar"))
    placed = rows.join(edge, same("source", "_s"))
    order = W.partitionBy("_s").orderBy("_key", "doc_id", "size", "fingerprint").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.col("_sofar") + F.sum("size").over(order) - F.col("size")
    inside = placed.where("_cell = _last").withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - before)))
    others = placed.where("_cell <> _last").withColumn("part", F.when(F.col("_cell") < F.col("_last"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    return others.unionByName(inside).select("doc_id", "source", "fingerprint", "size", "source_size", "target", F.col("_epochs").alias("copies"), "part", (F.col("_epochs") * F.col("size") + F.col("part")).alias("taken"))


def mixed(docs: DataFrame, weights: list[int] | None = None, most: int = 3, salt: str = "mix") -> DataFrame:
    """docs with each row as often as the mix takes it; columns as they were, n_chars (if there) counted anew.

    Of the one document at the edge of a source's budget, the last copy is cut after the words that still fit. Rows
    without words (null, empty and blank texts) come as often as their source's complete epochs, and not in a part.
    Rows without doc_id are mixed like others. Rows that share a doc_id are told apart by source and text; rows equal
    in all three are taken alike, each as often as the mix takes the one it takes most. Other columns pass through,
    whatever their names. An empty table gives an empty result.
    """
    keys = ["doc_id", "source", "fingerprint"]
    take = mixture(docs, weights, most, salt).groupBy(*keys).agg(F.max(F.struct("copies", "part", "size")).alias("take"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("key_id"), F.col("source").cast("string").alias("key_source"), fingerprint(F.col("text")).alias("key_text"), row)
    same = [F.col(f"key_{a}").eqNullSafe(F.col(b)) for a, b in (("id", "doc_id"), ("source", "source"), ("text", "fingerprint"))]
    rows = rows.join(take, same[0] & same[1] & same[2]).select("row", "take")
    part, size = F.col("take.part"), F.col("take.size")
    cut = (part > 0) & (part < size)
    copies = F.col("take.copies") + F.when(part > 0, 1).otherwise(0)
    rows = rows.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    # each piece is a word with the blanks after it; blanks that open the text are a piece of their own
    field = lambda c: F.col("row").getField(c)
    pieces = F.split(field("text"), "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    opening = F.when(F.rlike(field("text"), F.lit("^[\\x20\\x09-\\x0D]")), 1).otherwise(0)
    short = F.array_join(F.slice(pieces, F.lit(1), (part + opening).cast("int")), "")
    last = cut & (F.col("copy") == copies)
    new = {"text": F.when(last, short).otherwise(field("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(last, F.length(short)).otherwise(field("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(new.get(c, field(c)).alias(c) for c in docs.columns))

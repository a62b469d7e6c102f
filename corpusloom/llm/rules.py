"""Quality rules with adaptive thresholds, in DataFrame functions only.

Whole texts are measured in one projection. Thresholds come from quantile sketches of the measures for each language
and source: counts in bins of equal relative width (they merge by addition, so that a language's sketch is the sum of
its sources' and the corpus' the sum of all). Documents are then joined with the thresholds of their group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import written

#: Relative width of a bin, documents that the quartiles of the level above count as, and spreads beyond the quartiles.
GAMMA, ABOVE, SPREADS = 1.02, 10.0, 4.0
#: Least spread of each measure, so that a uniform group, whose quartiles lie together, doesn't reject small deviations;
#: it is also at least one bin wide.
LEAST_SPREAD = {"word_length": 0.1, "symbols": 0.02, "dup_lines": 0.03, "repeats": 0.02}

_BLANK = "[\\x20\\x09-\\x0D]+"


def measured(docs: DataFrame) -> DataFrame:
    """docs' doc_id, lang, source with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    start = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("_lines"), F.array_remove(F.split(text, _BLANK), "").alias("_words")
    )
    n = F.size("_words")
    five = lambda i: F.xxhash64(*(F.get("_words", i + j) for j in range(5)))
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), five)).otherwise(F.array().cast("array<bigint>"))
    start = start.select(
        "doc_id", "lang", "source", n.cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), "n_symbols", F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), windows.alias("_windows")
    )
    # only texts in which a window occurs again are looked at further
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    sorted_ = F.when(again, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    start = start.withColumn("_sorted", sorted_).drop("_windows")
    at = lambda k: F.get("_sorted", k)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda k: F.coalesce(at(k - 1) == at(k), F.lit(False)) | F.coalesce(at(k + 1) == at(k), F.lit(False)))
    places = F.when(F.col("_sorted").isNotNull(), F.sort_array(F.transform(twice, lambda k: F.get("_sorted", k)["i"])))
    start = start.withColumn("_places", places).drop("_sorted")
    # windows at sorted places cover five words each, less what the one before covers already
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last"))
    covered = F.aggregate("_places", zero, lambda s, i: F.struct((s["n"] + F.least(F.lit(5), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])
    return start.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_places")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _measures() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {"word_length": F.col("word_chars") / n, "symbols": F.col("n_symbols") / n, "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "repeats": F.col("n_repeat_words") / n}


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: the counts that make up each group's sketches. Bin -2000 holds zeros."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("x")) for k, v in _measures().items()]))
    bins = F.when(F.col("m.x") > 0, F.greatest(F.lit(-1999), F.ceil(F.log(F.col("m.x")) / F.log(F.lit(GAMMA))).cast("int"))).otherwise(-2000)
    return rows.select("lang", "source", each.alias("m")).select("lang", "source", F.col("m.measure").alias("measure"), bins.alias("bin")).groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """The quartiles of merged sketches: one row for each of the keys and measure."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*keys, "measure")
    running = merged.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    value = F.when(F.col("bin") > -2000, F.pow(F.lit(GAMMA), F.col("bin")) * 2 / (GAMMA + 1)).otherwise(0.0)
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.struct("bin", value.alias("v"))))["v"]
    return running.groupBy(*keys, "measure").agg(F.struct(at(0.25).alias("low"), at(0.75).alias("high"), F.max("total").alias("n")).alias(mark))


def thresholds(rows: DataFrame) -> DataFrame:
    """lang, source and for each measure the limits `<measure>_from` and `<measure>_to`.

    The limits lie SPREADS spreads (the distance of the quartiles, LEAST_SPREAD at least) beyond the quartiles. The
    quartiles of a group are drawn to those of its language, and these to the whole corpus', as if ABOVE more documents
    had the quartiles of the level above: little in a large group, much in a small one.
    """
    sketch = written(sketches(rows))
    same = lambda a, b: a.eqNullSafe(b)
    own = _quartiles(sketch, ["lang", "source"], "own")
    lang = _quartiles(sketch, ["lang"], "of_lang").withColumnsRenamed({"lang": "_l", "measure": "_m"})
    every = _quartiles(sketch, [], "of_all").withColumnRenamed("measure", "_n")
    both = own.join(lang, same(F.col("lang"), F.col("_l")) & (F.col("measure") == F.col("_m"))).join(every, F.col("measure") == F.col("_n"))
    drawn = lambda c, above, k: (F.col(f"{c}.n") * F.col(f"{c}.{k}") + ABOVE * above) / (F.col(f"{c}.n") + ABOVE)
    both = both.select("lang", "source", "measure", F.struct(*(drawn("own", drawn("of_lang", F.col(f"of_all.{k}"), k), k).alias(k) for k in ("low", "high"))).alias("q"))
    least = F.create_map(*[F.lit(x) for pair in LEAST_SPREAD.items() for x in pair])[F.col("measure")]
    spread = SPREADS * F.greatest(F.col("q.high") - F.col("q.low"), least, (GAMMA - 1) * F.col("q.high"))
    limits = both.select("lang", "source", "measure", (F.col("q.low") - spread).alias("from_"), (F.col("q.high") + spread).alias("to_"))
    pick = lambda k, c: F.max(F.when(F.col("measure") == k, F.col(c)))
    columns = [pick("word_length", "from_").alias("word_length_from")] + [pick(k, "to_").alias(f"{k}_to") for k in LEAST_SPREAD]
    return limits.groupBy("lang", "source").agg(*columns)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the measures, base_failed and kept.

    docs has doc_id, text, lang and source; other columns are ignored. Null and empty texts have no words and fail.
    A document that passes the base rules is kept if all its measures lie within the limits of its language and
    source (nulls are groups of their own). Sketches cover every document that passes the base rules. Repeated rows
    are judged one by one. An empty table gives an empty result.
    """
    rows = written(measured(docs)).withColumn("base_failed", base_failed())
    limits = thresholds(rows.where(~F.col("base_failed"))).withColumnsRenamed({"lang": "_l", "source": "_s"})
    both = rows.join(limits, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    inside = F.col("word_length_from") <= _measures()["word_length"]
    for name, x in _measures().items():
        inside = inside & (x <= F.col(f"{name}_to"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return both.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))

"""Text functions as column expressions; a Python function only where Spark has none."""

from __future__ import annotations

import html
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Full-width forms U+FF01..U+FF5E and the ideographic space, and what they become.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode normal form C."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Character references decoded."""
    return s.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of characters in matching blocks of two strings."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def matched_share(a: str, b: str) -> float:
    """Share of characters in matching blocks of two strings, as SequenceMatcher has it, and without it where b holds a.

    Then a is the longest block, if it is found. In a b of 200 characters and more blocks are looked for by characters
    that are no more than a hundredth of it, and spread from the first of the longest runs of these: that one must stand
    in b first where a does.
    """
    at = b.find(a) if a else -1
    if at >= 0:
        whole = 2.0 * len(a) / (len(a) + len(b))
        if len(b) < 200:
            return whole
        often = {c for c, n in Counter(b).items() if n > len(b) // 100 + 1}
        run = "" if "\0" in a else max("".join(["\0" if c in often else c for c in a]).split("\0"), key=len)
        if run and b.find(run) == at + a.find(run):
            return whole
    return SequenceMatcher(None, a, b).ratio()


def half_width(c: Column) -> Column:
    """Full-width forms as half-width ones; a text without any isn't taken apart."""
    return F.when(F.rlike(c, F.lit("[\uff01-\uff5e\u3000]")), F.translate(c, FULL_WIDTH, HALF_WIDTH)).otherwise(c)


def squeezed(c: Column) -> Column:
    """White space (of any script) as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column) -> Column:
    """Composed, half-width, lower-case text with single blanks."""
    return squeezed(F.lower(half_width(nfc(c))))


def normalize_ascii(c: Column) -> Column:
    """The same without the Python step, for text known to be composed."""
    return squeezed(F.lower(half_width(c)))


def file_stem(c: Column) -> Column:
    """File name without folder and last suffix."""
    name = F.regexp_replace(c, r"^.*[/\\]", "")
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def split_heading(c: Column) -> Column:
    """Titles of a heading path; blank ones are dropped."""
    return F.filter(F.transform(F.split(c, " > "), lambda x: squeezed(x)), lambda x: x != "")


def strict_key(c: Column) -> Column:
    """Key without white space, in half width."""
    return F.regexp_replace(half_width(c), r"(?U)\s+", "")


def normalize_toc(c: Column) -> Column:
    """A contents line without bars, line breaks, leaders and page numbers; blanks inside ordinals go."""
    flat = squeezed(F.regexp_replace(c, r"[\r\n|]+", " "))
    tail = r"(?:\s*(?:[.·…]{2,}|…)\s*\(?\d*\)?|\s+\(?\d+\)?)+\s*$"
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(flat, tail, ""), r"[.·…]+\s*$", ""), r"第\s*([0-9一二三四五六七八九十百零]+)\s*([篇章节])", "第$1$2"))


def split_anchors(c: Column, anchor: str) -> Column:
    """Entries glued together, split before each anchor."""
    return F.filter(F.split(c, f"(?={anchor})"), lambda x: F.trim(x) != "")


def html_rows(c: Column) -> Column:
    """Rows of a table as arrays of raw cells."""
    rows = F.regexp_extract_all(c, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)))


def html_first_row(c: Column) -> Column:
    """The first of html_rows; empty if there is none."""
    row = F.regexp_extract(c, r"(?is)<tr\b[^>]*>(.*?)</tr>", 1)
    return F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))


def norm_light(c: Column) -> Column:
    """Cell text without tags, single blanks."""
    return squeezed(F.regexp_replace(c, r"(?s)<[^>]*>", ""))


def norm_strong(c: Column) -> Column:
    """Cell text without tags, references, dollar signs and white space."""
    return F.regexp_replace(unescape(F.regexp_replace(c, r"(?s)<[^>]*>", "")), r"(?U)[\s$]+", "")


def bare_strong(c: Column) -> Column:
    """norm_strong of text without references, without the Python step."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", ""), r"(?U)[\s$]+", "")


def caption_text(c: Column) -> Column:
    return F.array_join(c, "  ")


def question_index(c: Column) -> Column:
    """Number after the last _q of an id; null if there is none."""
    return F.regexp_extract(c, r"_q(\d+)$", 1).try_cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays; the norms' product is 1e-9 at least."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-9))


def code_category(c: Column) -> Column:
    """Codes that open with R name symptoms, others diseases."""
    return F.when(F.upper(F.substring(c, 1, 1)) == "R", "symptom").otherwise("disease")


def statement_class(c: Column) -> Column:
    """First word of a statement, if it is one of the common ones."""
    word = F.upper(F.regexp_extract(c, r"^\s*([A-Za-z]+)", 1))
    return F.when(word.isin("SELECT", "INSERT", "UPDATE", "DELETE"), word).otherwise("OTHER")


def value_type(c: Column) -> Column:
    """Type that a text value spells."""
    return (
        F.when(c.isNull(), "null").when(F.lower(c).isin("true", "false"), "bool").when(F.rlike(c, F.lit(r"^[+-]?\d+$")), "int").when(F.rlike(c, F.lit(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$")), "float").when(F.rlike(c, F.lit(r"^\s*[\[{]")), "json").otherwise("str")
    )


def iso_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def remap_index(c: Column, base: Column) -> Column:
    """Indexes of a batch as indexes of the whole."""
    return F.transform(c, lambda x: x + base)


def slot_phrase(slot: Column, value: Column, templates: dict[str, str]) -> Column:
    """A slot's value in its phrase; {} in a template is where it goes. Unknown slots give slot=value."""
    known = F.create_map(*[F.lit(x) for kv in templates.items() for x in kv]) if templates else F.create_map().cast("map<string,string>")
    return F.coalesce(F.replace(F.try_element_at(known, slot), F.lit("{}"), value), F.concat(slot, F.lit("="), value))


def merged_lists(a: Column, b: Column) -> Column:
    """Union of two lists in order; null counts as empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))


def merged_scalars(a: Column, b: Column) -> Column:
    """The new value where there is one."""
    return F.coalesce(b, a)


def history_summary(history: Column, medication: Column, family: Column) -> Column:
    """Three histories in one line, each cut to its length."""
    cut = lambda name, c, n: F.when(F.length(c) > 0, F.concat(F.lit(f"{name}:"), F.substring(c, 1, n)))
    return F.concat_ws("; ", cut("past", history, 120), cut("medication", medication, 80), cut("family", family, 80))


def error_info(failure: Column, results: Column) -> Column:
    """source, reason and step of a run that failed or found nothing; null otherwise."""
    step = F.regexp_extract(failure, r"(\d+)", 1).try_cast("int")
    failed = F.struct(F.lit("failure").alias("source"), failure.alias("reason"), step.alias("step"))
    empty = F.struct(F.lit("retrieval").alias("source"), F.lit("empty_result").alias("reason"), F.lit(None).cast("int").alias("step"))
    return F.when(F.length(failure) > 0, failed).when(F.coalesce(results, F.lit(0)) == 0, empty)


def next_step(questions: Column, rounds: Column, most: int = 8) -> Column:
    """Ask on while there are questions and rounds left."""
    return F.when((F.coalesce(questions, F.lit(0)) > 0) & (F.coalesce(rounds, F.lit(0)) < most), "followup").otherwise("diagnose")


def after_diagnosis(needs_exam: Column, exams: Column, most: int = 3) -> Column:
    return F.when(F.coalesce(needs_exam, F.lit(False)) & (F.coalesce(exams, F.lit(0)) < most), "exam").otherwise("safety")


def safety_flags(allergens: Column, pregnant: Column, lactating: Column) -> Column:
    """Banned substances and tri-state flags: null stays unknown."""
    state = lambda c, yes, no: F.when(c.isNull(), "unknown").when(c, yes).otherwise(no)
    banned = F.array_distinct(F.filter(F.transform(allergens, lambda x: F.trim(x)), lambda x: x != ""))
    return F.struct(banned.alias("banned"), state(pregnant, "pregnant", "not_pregnant").alias("pregnancy"), state(lactating, "lactating", "not_lactating").alias("lactation"))


def risk_line(severity: Column, description: Column, advice: Column) -> Column:
    return F.concat(F.lit("["), severity, F.lit("] "), description, F.when(F.length(advice) > 0, F.concat(F.lit(" 建议:"), advice)).otherwise(""))


def failure_note(reason: Column, notes: dict[str, str], other: str) -> Column:
    """The note for a reason, or the general one."""
    found = F.lit(other)
    for key, note in notes.items():
        found = F.when(reason == key, note).otherwise(found)
    return F.when(reason.isNotNull(), found)

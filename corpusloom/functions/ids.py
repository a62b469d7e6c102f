"""Deterministic ids: the same content gives the same id on every run and in every partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import file_stem, normalize_text


def source_id(file_name: Column) -> Column:
    """First 16 hex digits of the digest of the normalised stem."""
    return F.substring(F.sha2(normalize_text(file_stem(file_name)), 256), 1, 16)


def heading_path_id(titles: Column, normalized: bool = False) -> Column:
    """Digest over the digests of the titles, level by level: a separator inside a title can't shift a level.

    titles hold normalised text if `normalized`; else lower case, width and blanks are evened out here (composition
    isn't: pass composed text).
    """
    from .text import normalize_ascii

    each = F.transform(titles, lambda t: F.sha2(t if normalized else normalize_ascii(t), 256))
    return F.sha2(F.array_join(each, ":"), 256)


def chunk_id(source: Column, heading: Column, relative: Column) -> Column:
    return F.sha2(F.concat_ws(":", source, heading, relative), 256)


def content_hash(raw: Column) -> Column:
    """Digest of the content as it is."""
    return F.sha2(raw, 256)


def media_content_hash(raw: Column, statement: Column) -> Column:
    return F.sha2(F.concat(raw, F.lit("\n"), F.coalesce(statement, F.lit(""))), 256)


def media_relative(kind: Column, page: Column, block: Column) -> Column:
    return F.format_string("%s:p%d_b%d", kind, page, block)


def alias_record_id(concept: Column, alias: Column) -> Column:
    return F.concat_ws("_", concept, F.substring(F.sha2(alias, 256), 1, 16))


def group_id(page: Column, block: Column) -> Column:
    return F.format_string("p%d-b%d", page, block)

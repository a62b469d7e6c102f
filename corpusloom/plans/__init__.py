"""Queries over the provided tables, with the SQL that gives the same rows."""


def _load() -> None:
    from . import answers, content, files, layout, operations, retrieval, selection  # noqa: F401


def queries() -> dict:
    from .registry import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    from .registry import SQL

    _load()
    return dict(SQL)

"""Filters, predicates and projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def filters_to_column(filters: dict) -> Column:
    """Equality for a scalar, membership for a list, joined by AND; no filter admits all."""
    return all_of([F.col(k).isin(*v) if isinstance(v, list | tuple | set) else F.col(k) == v for k, v in filters.items()])


def document_filter(ids=None, groups=None, number_from=None, number_to=None, date_from=None, date_to=None) -> Column:
    """Optional lists of ids and groups, inclusive ranges of number and date; ``date_to`` covers its whole day."""
    parts = []
    if ids:
        parts.append(F.col("episode_id").isin(*ids))
    if groups:
        parts.append(F.col("novel_id").isin(*groups))
    if number_from is not None:
        parts.append(F.col("episode_number") >= number_from)
    if number_to is not None:
        parts.append(F.col("episode_number") <= number_to)
    if date_from is not None:
        parts.append(F.col("publication_date") >= F.lit(date_from).cast("timestamp"))
    if date_to is not None:
        parts.append(F.col("publication_date") < F.lit(date_to).cast("timestamp") + F.expr("interval 1 day"))
    return all_of(parts)


_OPERATORS = {
    "eq": lambda c, x: c == x,
    "ne": lambda c, x: c != x,
    "gt": lambda c, x: c > x,
    "gte": lambda c, x: c >= x,
    "lt": lambda c, x: c < x,
    "lte": lambda c, x: c <= x,
    "in": lambda c, x: c.isin(*x),
    "nin": lambda c, x: ~c.isin(*x),
    "contains": lambda c, x: c.contains(x),
    "regex": lambda c, x: c.rlike(x),
}


def predicate(column: str, conditions: dict) -> Column:
    """All conditions ``{operator: operand}`` on a column."""
    return all_of([_OPERATORS[op](F.col(column), x) for op, x in conditions.items()])


def custom_filters(filters: dict) -> Column:
    """A list is membership, a dict is conditions, else equality; a null field passes."""
    one = lambda k, v: predicate(k, v) if isinstance(v, dict) else filters_to_column({k: v})
    return all_of([F.col(k).isNull() | one(k, v) for k, v in filters.items()])


def paginate(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """A page of the rows, each with the ``total`` number of rows; with a total order, the same page every time."""
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def valid_documents(rows: DataFrame, text: str, least: int = 50, most: int = 10_000, chunking: bool = False) -> DataFrame:
    """Rows whose text has between ``least`` and ``most`` characters; no upper bound if texts are chunked later."""
    fits = (F.length(F.trim(text)) > 0) & (F.length(text) >= least)
    return rows.where(fits if chunking else fits & (F.length(text) <= most))


def is_email(column: str) -> Column:
    return F.col(column).rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")


def is_url(column: str) -> Column:
    return F.col(column).rlike(r"^https?://[^\s/$.?#][^\s]*$")


def truncate_text(column: str, most: int, tail: str = "...") -> Column:
    return F.when(F.length(column) <= most, F.col(column)).otherwise(F.concat(F.left(column, F.lit(most - len(tail))), F.lit(tail)))


def sanitize_text(column: str) -> Column:
    """Control characters out, white space to one space, ends stripped."""
    return F.trim(F.regexp_replace(F.regexp_replace(column, r"[\x00-\x08\x0E-\x1F\x7F]", ""), r"[ \t\n\r\x0B\f]+", " "))


def clean_filename(column: str) -> Column:
    """Characters that file systems reject become underscores; runs are one."""
    return F.regexp_replace(F.regexp_replace(column, r'[<>:"/\\|?*]', "_"), "_+", "_")


def output_fields(rows: DataFrame, keys: list[str], content: str | None = None, metadata: list[str] | None = None) -> DataFrame:
    """Key columns, with content and metadata columns only if they are asked for."""
    return rows.select(*keys, *([content] if content else []), *(metadata or []))


def score_threshold(hits: DataFrame, score: str, least: float) -> DataFrame:
    if not 0 <= least <= 1:
        raise ValueError("the threshold must lie between 0 and 1")
    return hits.where(F.col(score) >= least)

"""Projections, filters, searches and paging of result tables."""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.jobs import with_index

#: Rows that each partition may hand over for a slice of an order.
TOP_ROWS = 100_000


def rename_fields(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename the fields that exist, in order. A new name replaces a field of that name."""
    for old, new in mapping.items():
        if old in df.columns and old != new:
            df = df.drop(new).withColumnRenamed(old, new)
    return df


def apply_transformations(df: DataFrame, transformations: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """A function per field, for the fields that exist."""
    return df.withColumns({f: fn(F.col(f)) for f, fn in transformations.items() if f in df.columns})


_COMPARE = {"==": operator.eq, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def filter_rows(df: DataFrame, column: str, value: Any, op: str = "==") -> DataFrame:
    """Rows by one comparison. ``!=`` keeps missing cells, ``contains`` is a regex search.

    No row fits a column that does not exist; an unknown operator filters nothing.
    """
    if column not in df.columns:
        return df.limit(0)
    if op in _COMPARE:
        return df.filter(_COMPARE[op](F.col(column), F.lit(value)))
    if op == "!=":
        return df.filter(~F.col(column).eqNullSafe(F.lit(value)))
    if op == "contains":
        return df.filter(F.col(column).cast("string").rlike(str(value)))
    return df


def time_range(df: DataFrame, ts: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """``since <= ts < until``; either bound may be open."""
    bound = lambda v: F.lit(v).cast(df.schema[ts].dataType)
    if since is not None:
        df = df.filter(F.col(ts) >= bound(since))
    if until is not None:
        df = df.filter(F.col(ts) < bound(until))
    return df


def newest(df: DataFrame, ts: str, limit: int, *ties: str) -> DataFrame:
    """The latest rows, newest first; a top-n, not a full sort."""
    return df.orderBy(F.desc(ts), *ties).limit(limit)


def time_state(df: DataFrame, ts: str, as_of: str, state: str = "all") -> DataFrame:
    """``upcoming``, ``past`` or all rows, seen from ``as_of``."""
    now = F.lit(as_of).cast(df.schema[ts].dataType)
    if state == "upcoming":
        return df.filter(F.col(ts) > now)
    return df.filter(F.col(ts) <= now) if state == "past" else df


def keyword_search(df: DataFrame, keyword: str, columns: Sequence[str], equals: Mapping[str, Any] | None = None) -> DataFrame:
    """Rows with the keyword in one of the columns, ignoring case, and the given values; a value of ``None`` is no condition."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(keyword.lower()), F.lit(False))
    out = df.filter(hit)
    for name, value in (equals or {}).items():
        if value is not None:
            out = out.filter(F.col(name) == F.lit(value))
    return out


def any_column_search(df: DataFrame, needle: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose joined lowercase text contains the needle."""
    cells = [F.col(c).cast("string") for c in (columns or df.columns)]
    return df.filter(F.lower(F.concat_ws(" ", *cells)).contains(needle.lower()))


def equals_or_all(df: DataFrame, column: str, wanted: str, everything: str = "all") -> DataFrame:
    """An equality filter that a word switches off."""
    return df if wanted == everything else df.filter(F.col(column) == F.lit(wanted))


def page_slice(df: DataFrame, order: Sequence[str], start: int, count: int, max_results: int, max_page: int = 100) -> DataFrame:
    """What paging from ``start`` collects: pages of ``count`` (at most ``max_page``) rows up to ``max_results``.

    Pages are contiguous and only a short one ends them, so together they are one slice of the order. A slice that ends within
    ``TOP_ROWS`` is a top-n of each partition; a deeper one is cut out by position, so that no task gathers all rows before it.
    """
    if min(count, max_page) <= 0:
        return df.limit(0)
    if start + max_results <= TOP_ROWS:
        return df.orderBy(*order).offset(start).limit(max_results)
    placed = with_index(df, order, "_place")
    return placed.where(F.col("_place").between(start, start + max_results - 1)).drop("_place")


def paged_collect(df: DataFrame, order: Sequence[str], page_size: int, max_results: int, max_pages: int) -> DataFrame:
    """The first page and up to ``max_pages`` more, cut at ``max_results``."""
    return df.orderBy(*order).limit(min(max_results, page_size * (max_pages + 1)))


def skip_empty(df: DataFrame, key: str, text: str, fallback: str) -> DataFrame:
    """``key, body, error``: the text, else the fallback, else an error."""
    body = F.coalesce(F.nullif(F.col(text), F.lit("")), F.nullif(F.col(fallback), F.lit("")))
    return df.select(key, body.alias("body"), F.when(body.isNull(), "No text content found").alias("error"))


def union_all(*frames: DataFrame) -> DataFrame:
    """Frames under each other by column name; a column one lacks is NULL there."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def compare_results(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Two result sets side by side: ``key, left_value, right_value, status``."""
    a = left.select(key, F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(key, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    status = (
        F.when(F.col("_r").isNull(), "only_left").when(F.col("_l").isNull(), "only_right")
        .when(F.col("left_value").eqNullSafe(F.col("right_value")), "same").otherwise("different")
    )
    return a.join(b, key, "full").select(key, "left_value", "right_value", status.alias("status"))

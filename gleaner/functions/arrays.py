"""Array helpers that keep per-row work inside the row, so it needs no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are evaluated once per row.

    Two projections in a row are merged, and a merged expression inside a lambda runs for every element. A
    one-element ``explode`` keeps them apart, within the task.
    """
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(packed)).alias("_once")).select(*kept, *[F.col(f"_once.{n}").alias(n) for n in columns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once, however often the body mentions it.

    Array functions take their arguments by expression, so a repeated argument is computed again each time;
    a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def first_per_key(structs: Column) -> Column:
    """Of structs that begin with ``key, ord``, the one with the smallest ``ord`` for each key, by ``ord``.

    One sort puts equal keys next to each other, each is compared with its left neighbour, and a second
    sort restores the order.
    """

    def first_of_runs(ordered: Column) -> Column:
        shifted = F.concat(F.slice(ordered, 1, 0), F.array(F.lit(None)), ordered)
        marked = F.zip_with(
            ordered,
            shifted,
            lambda here, left: F.when(here.isNotNull() & (left.isNull() | (left["key"] != here["key"])), here),
        )
        return F.filter(marked, lambda s: s.isNotNull())

    return by_ord(let(F.array_sort(structs), first_of_runs))


def by_ord(structs: Column) -> Column:
    return F.array_sort(structs, lambda a, b: (a["ord"] - b["ord"]).cast("int"))


def keyed(values: Column, key) -> Column:
    """``array<string>`` to structs ``key, ord, value``."""
    return F.transform(
        values, lambda v, i: F.struct(key(v).alias("key"), i.alias("ord"), v.alias("value"))
    )


class Skipping(str):
    """A regex of the form ``(hit)|stretch``: group 1 is a hit, any other match is text in which no hit starts.

    A hit that runs on over words fails at its first start only after reading the whole run, and would read it again at
    every later start. The stretch, tried when the hit has failed, takes the run away, so each run is read once. It must
    not hold the start of a hit that would not also be one from the start of the stretch.
    """


def skipping(flags: str, hit: str, stretch: str) -> Skipping:
    return Skipping(f"{flags}({hit})|{stretch}")


def hits_of(text: Column, regex: str) -> Column:
    """All matches of a regex in text order; of a ``Skipping`` one only the hits."""
    if isinstance(regex, Skipping):
        return F.filter(F.regexp_extract_all(text, F.lit(str(regex)), F.lit(1)), lambda hit: hit != "")
    return F.regexp_extract_all(text, F.lit(regex), F.lit(0))


def matches_of(text: Column, regex: str) -> Column:
    """All matches as structs ``value, hit``, skipped stretches included."""
    whole = F.regexp_extract_all(text, F.lit(str(regex)), F.lit(0))
    if not isinstance(regex, Skipping):
        return F.transform(whole, lambda v: F.struct(v.alias("value"), F.lit(True).alias("hit")))
    hits = F.regexp_extract_all(text, F.lit(str(regex)), F.lit(1))
    return F.zip_with(whole, hits, lambda v, h: F.struct(v.alias("value"), (h != "").alias("hit")))


def extract_all(text: Column, regexes: list[str] | tuple[str, ...], needs: str | None = None) -> Column:
    """All matches of each regex, in regex order and then text order.

    ``needs`` is a cheap condition every match fulfils; texts without it skip the regexes.
    """
    hits = [hits_of(text, rx) for rx in regexes]
    found = F.concat(*hits) if len(hits) > 1 else hits[0]
    none = F.array().cast("array<string>")
    if needs is not None:
        found = F.when(text.rlike(needs), found)
    return F.coalesce(found, none)


def extract_spans(text: Column, regex: str, needs: str | None = None) -> Column:
    """All matches of a regex as structs ``value, start, stop`` (character offsets).

    The texts between the matches are what ``split`` returns, so running lengths give the offsets.
    """
    def span(acc: Column, item: Column) -> Column:
        start = acc["pos"] + item["gap"]
        stop = start + F.length(item["value"])
        hit = F.struct(item["value"].alias("value"), start.alias("start"), stop.alias("stop"))
        hits = F.when(item["hit"], F.concat(acc["hits"], F.array(hit))).otherwise(acc["hits"])
        return F.struct(stop.alias("pos"), hits.alias("hits"))

    none = F.array().cast("array<struct<value:string,start:int,stop:int>>")
    zero = F.struct(F.lit(0).alias("pos"), none.alias("hits"))

    def located(values: Column) -> Column:
        gaps = F.split(text, str(regex), -1)
        items = F.filter(
            F.zip_with(values, gaps, lambda v, g: F.struct(F.length(g).alias("gap"), v["value"].alias("value"), v["hit"].alias("hit"))),
            lambda item: item["value"].isNotNull(),
        )
        # Most texts have no match; they are not cut.
        return F.when(F.exists(values, lambda v: v["hit"]), F.aggregate(items, zero, span, lambda acc: acc["hits"]))

    found = let(matches_of(text, regex), located)
    if needs is not None:
        found = F.when(text.rlike(needs), found)
    return F.coalesce(found, none)

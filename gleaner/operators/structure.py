"""Headings, sections and embedded tables of plain texts.

A text is cut into an array of lines once, and everything stays in its row: lines are classed where they are, the places
of headings, or of lines outside tables, cut the array into slices, and only the results are exploded. Nothing is
shuffled, and the work grows with the length of a text. A null text has no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.arrays import let, once
from gleaner.functions.text import WHITE, _col

_BLANK = rf"(?U)\A[{WHITE}]*\z"
_EDGES = rf"(?U)\A[{WHITE}]+|[{WHITE}]+\z"


def strip(c: Column) -> Column:
    """Both ends without white space of any kind."""
    return F.regexp_replace(c, _EDGES, "")


def text_lines(text: Column | str) -> Column:
    """The lines of a text."""
    return F.split(_col(text), "\n", -1)


def slices_between(items: Column, cuts: Column) -> Column:
    """``array<struct<at, part>>``: the stretches of ``items`` between the 0-based places ``cuts``.

    ``at`` is the place before the stretch, -1 for the first. ``items`` should be a column or a lambda variable, as it is
    read once per stretch.
    """
    def cut(edges: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(edges) - 2),
            lambda k: F.struct(
                F.get(edges, k).alias("at"),
                F.slice(items, F.get(edges, k) + 2, F.get(edges, k + 1) - F.get(edges, k) - 1).alias("part"),
            ),
        )

    return let(F.concat(F.array(F.lit(-1)), cuts, F.array(F.size(items))), cut)


def places(items: Column, holds) -> Column:
    """0-based places of the items that fulfil ``holds``."""
    marked = F.transform(items, lambda x, i: F.when(holds(x), i))
    return F.filter(marked, lambda i: i.isNotNull())


def _all_upper(line: Column) -> Column:
    """At least one cased character and none that is lower or title case."""
    return line.rlike(r"\p{IsUppercase}") & ~line.rlike(r"[\p{IsLowercase}\p{Lt}]")


def heading_level(line: Column, raw_next: Column, is_last: Column) -> Column:
    """0 for a line that is no heading; ``line`` is stripped and not blank."""
    short_title = (
        (F.length(line) < 80)
        & ~is_last
        & raw_next.rlike(_BLANK)
        & line.rlike(r"\A\p{IsUppercase}")
        & ~F.substring(line, -1, 1).isin(list(".,:;?!"))
    )
    return (
        F.when(_all_upper(line) & (F.length(line) < 100), 1)
        .when(line.rlike(r"(?U)\A#{1,6}\s+"), F.length(F.regexp_extract(line, r"\A(#+)", 1)))
        .when(line.rlike(r"(?U)\A[0-9]+\.[0-9]*\s+[A-Z]"), 2)
        .when(short_title, 3)
        .otherwise(0)
    )


def _all_upper_short(line: Column) -> Column:
    return _all_upper(line) & (F.length(line) < 100)


def heading_array(text: Column | str) -> Column:
    """Non-blank lines with their heading level: ``array<struct<line_no, line, level>>``; marks are cut from headings."""
    def classed(lines: Column) -> Column:
        cut = F.transform(
            lines, lambda raw, i: F.struct(i.alias("line_no"), strip(raw).alias("line"), F.get(lines, i + 1).alias("raw_next")))
        levels = F.transform(
            F.filter(cut, lambda x: x["line"] != ""),
            lambda x: F.struct(
                x["line_no"].alias("line_no"), x["line"].alias("line"),
                heading_level(x["line"], F.coalesce(x["raw_next"], F.lit("")), x["line_no"] == F.size(lines) - 1).cast("int").alias("level"),
            ),
        )
        return F.transform(levels, lambda x: F.struct(x["line_no"].alias("line_no"), _title(x).alias("line"), x["level"].alias("level")))

    return let(text_lines(text), classed)


def _title(x: Column) -> Column:
    return F.when(
        (x["level"] > 0) & ~_all_upper_short(x["line"]), F.regexp_replace(x["line"], r"(?U)\A#{1,6}\s+", "")
    ).otherwise(x["line"])


def section_array(items: Column) -> Column:
    """Sections of a column made by ``heading_array``, those without content included; ``head`` is null for the first."""
    parts = slices_between(items, places(items, lambda x: x["level"] > 0))
    return F.transform(
        parts, lambda s, k: F.struct(k.alias("section_no"), F.get(items, s["at"]).alias("head"), s["part"].alias("body")))


def headings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, title, level``."""
    found = F.filter(heading_array(text), lambda x: x["level"] > 0)
    return df.select(key, F.inline(found).alias("line_no", "title", "level"))


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, section_no, title, level, start_line, end_line, content`` of sections that have content.

    Text before the first heading is section 0 with level 0 and no start line; the others are counted by
    their heading.
    """
    cut = once(df.select(key, F.col(text).alias("_text")), _lines=heading_array("_text"))
    filled = F.filter(section_array(F.col("_lines")), lambda s: F.size(s["body"]) > 0)
    return cut.select(key, F.explode(filled).alias("s")).select(
        key, "s.section_no", F.coalesce("s.head.line", F.lit("")).alias("title"), F.coalesce("s.head.level", F.lit(0)).alias("level"),
        F.col("s.head.line_no").alias("start_line"), F.element_at("s.body", -1)["line_no"].alias("end_line"),
        F.array_join("s.body.line", "\n").alias("content"),
    )


def structure_summary(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per text: ``headings, total_sections, max_heading_level, has_hierarchy``."""
    cut = once(df.select(key, F.coalesce(text, F.lit("")).alias("_text")), _lines=heading_array("_text"))
    measured = once(
        cut,
        _levels=F.filter(F.transform("_lines", lambda x: x["level"]), lambda v: v > 0),
        _filled=F.size(F.filter(section_array(F.col("_lines")), lambda s: F.size(s["body"]) > 0)),
    )
    return measured.select(
        key, F.size("_levels").cast("long").alias("headings"), F.col("_filled").cast("long").alias("total_sections"),
        F.coalesce(F.array_max("_levels"), F.lit(0)).alias("max_heading_level"),
        (F.size(F.array_distinct("_levels")) > 1).alias("has_hierarchy"),
    )


_MULTI_GAP = rf"(?U)[{WHITE}]{{2,}}[^{WHITE}]"


def _classed_lines(text: Column | str) -> Column:
    """``array<struct<line_no, raw, blank, opens, format>>`` of all lines; ``opens``: a table row or a ruler."""
    def counted(raw: Column, i: Column) -> Column:
        pipes = F.length(raw) - F.length(F.replace(raw, F.lit("|"), F.lit("")))
        tabs = F.length(raw) - F.length(F.replace(raw, F.lit("\t"), F.lit("")))
        return F.struct(i.alias("line_no"), raw.alias("raw"), pipes.alias("pipes"), tabs.alias("tabs"))

    def classed(x: Column) -> Column:
        raw = x["raw"]
        aligned = raw.rlike(_MULTI_GAP) & raw.rlike(rf"(?U)[^{WHITE}][{WHITE}]{{2,}}")
        opens = raw.rlike(rf"(?U)\A[{WHITE}\-+|]+\z") | (x["pipes"] > 1) | (x["tabs"] > 1) | aligned
        kind = F.when(x["pipes"] > 1, "pipe").when(x["tabs"] > 1, "tab").otherwise("aligned")
        return F.struct(
            x["line_no"].alias("line_no"), raw.alias("raw"), raw.rlike(_BLANK).alias("blank"), opens.alias("opens"), kind.alias("format"))

    return F.transform(F.transform(text_lines(text), counted), classed)


def tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """The tables in each text, one row each: ``key, table_no, format, lines``.

    A run of table rows, rulers and blank lines is a table if at least two of its lines are not blank. A
    run can open on a row or a ruler only, so leading blank lines are not part of it; its first line gives
    the format. ``lines`` are structs ``line_no, raw, blank``.
    """
    def run(part: Column) -> Column:
        first = F.array_position(F.transform(part, lambda x: x["opens"]), True).cast("int")
        return let(first, lambda p: F.when(p > 0, F.slice(part, p, F.size(part))))

    def is_table(lines: Column) -> Column:
        return lines.isNotNull() & (F.size(F.filter(lines, lambda x: ~x["blank"])) >= 2)

    cut = once(df.select(key, F.col(text).alias("_text")), _lines=_classed_lines("_text"))
    parts = slices_between(F.col("_lines"), places(F.col("_lines"), lambda x: ~(x["opens"] | x["blank"])))
    several = F.filter(parts, lambda s: F.size(s["part"]) >= 2)
    runs = F.filter(F.transform(several, lambda s: run(s["part"])), is_table)
    return cut.select(key, F.posexplode(runs).alias("table_no", "lines")).select(
        key, "table_no", F.get("lines.format", F.lit(0)).alias("format"), "lines")


def table_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of the tables in each text: ``key, table_no, format, line_no, raw``."""
    found = tables(df, key, text).select(key, "table_no", "format", F.explode("lines").alias("x"))
    return found.select(key, "table_no", "format", "x.line_no", "x.raw")


def table_islands(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per table run: ``key, table_no, format, start_line, end_line, n_lines``."""
    return tables(df, key, text).select(
        key, "table_no", "format", F.get("lines.line_no", F.lit(0)).alias("start_line"), F.element_at("lines.line_no", -1).alias("end_line"),
        F.size(F.filter("lines", lambda x: ~x["blank"])).cast("long").alias("n_lines"),
    )


def _filled_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, table_no, format, raws``: the lines of each table that are not blank."""
    raws = F.transform(F.filter("lines", lambda x: ~x["blank"]), lambda x: x["raw"])
    return tables(df, key, text).select(key, "table_no", "format", raws.alias("raws"))


def _cell_rows(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (arrays of cells) of tables with more than a header, one row per cell."""
    lines = rows.filter(F.size("rows") > 1).select(key, "table_no", F.posexplode("rows").alias("row_no", "cells"))
    return lines.select(key, "table_no", "row_no", F.posexplode("cells").alias("col_no", "cell"))


_MARKDOWN_RULE = rf"(?U)\A[{WHITE}]*\|[{WHITE}\-+:]+\|[{WHITE}]*\z"


def _cut_empty_ends(cells: Column) -> Column:
    """Without an empty first and an empty last cell."""

    def without_first(c: Column) -> Column:
        return F.when(F.element_at(c, 1) == "", F.slice(c, 2, F.size(c))).otherwise(c)

    def without_last(c: Column) -> Column:
        return F.when(F.try_element_at(c, F.lit(-1)) == "", F.slice(c, 1, F.size(c) - 1)).otherwise(c)

    return let(let(cells, without_first), without_last)


def split_table_cells(df: DataFrame, key: str, text: str) -> DataFrame:
    """Cells of pipe and tab tables: ``key, table_no, row_no, col_no, cell``; row 0 is the header."""
    pipe = F.col("format") == "pipe"

    def data(raws: Column) -> Column:
        """Without the rulers of a table whose second line is one."""
        ruled = pipe & F.coalesce(F.get(raws, F.lit(1)).rlike(_MARKDOWN_RULE), F.lit(False))
        return let(ruled, lambda r: F.filter(raws, lambda raw, i: (i == 0) | ~r | ~raw.rlike(_MARKDOWN_RULE)))

    def cells(raw: Column) -> Column:
        return F.when(pipe, _cut_empty_ends(F.transform(F.split(strip(raw), r"\|", -1), strip))).otherwise(
            F.transform(F.split(raw, "\t", -1), strip))

    found = _filled_lines(df, key, text).filter(F.col("format") != "aligned")
    rows = F.filter(F.transform(let(F.col("raws"), data), cells), lambda c, i: (i == 0) | (F.size(c) > 0))
    return _cell_rows(once(found.select(key, "table_no", "format", "raws"), rows=rows), key)


def _gap_starts(line: Column) -> Column:
    """0-based places where two or more white characters begin."""
    white = F.transform(F.split(line, ""), lambda c: c.rlike(rf"(?U)[{WHITE}]"))
    at = lambda w, p: F.coalesce(F.get(w, p), F.lit(False))
    return let(white, lambda w: F.filter(
        F.sequence(F.lit(0), F.size(w) - 1), lambda p: F.get(w, p) & at(w, p + 1) & ~at(w, p - 1)))


def column_breaks(raws: Column) -> Column:
    """Column breaks that the first five lines share (a break may be off by one character)."""
    def shared(breaks: Column, line: Column) -> Column:
        # An empty set of breaks is filled by the next line, as if nothing had been seen.
        return let(_gap_starts(line), lambda found: F.when(
            F.size(breaks) > 0,
            F.array_intersect(breaks, F.concat(found, F.transform(found, lambda p: p - 1), F.transform(found, lambda p: p + 1))),
        ).otherwise(found))

    return F.aggregate(F.slice(raws, 1, 5), F.array().cast("array<int>"), shared)


def aligned_table_cells(df: DataFrame, key: str, text: str) -> DataFrame:
    """Cells of space-aligned tables, in the same form: every row has one cell more than the table has breaks.

    The header is cut at all breaks. Another row is cut at those inside it; the cells between its last break and the last
    column are empty, and what follows its last break is the last cell.
    """
    def cells(line: Column, n: Column) -> Column:
        def cut(inside: Column) -> Column:
            edge = lambda j: F.when(j == 0, 0).otherwise(F.get("_breaks", j - 1))
            return F.transform(
                F.sequence(F.lit(0), F.size("_breaks")),
                lambda j: F.when(j == F.size("_breaks"), strip(F.substring(line, edge(inside) + 1, F.length(line))))
                .when(j < inside, strip(F.substring(line, edge(j) + 1, edge(j + 1) - edge(j))))
                .otherwise(""),
            )

        within = F.size(F.filter("_breaks", lambda b: b < F.length(line)))
        return let(F.when(n == 0, F.size("_breaks")).otherwise(within), cut)

    found = _filled_lines(df, key, text).filter(F.col("format") == "aligned")
    broken = once(found, _breaks=column_breaks(F.col("raws"))).filter(F.size("_breaks") > 0)
    return _cell_rows(once(broken, rows=F.transform("raws", cells)), key)

"""Column profiles, type inference, the cleaning recipe for tables, and what can be learnt from matches.

Profiles turn the columns into rows once, so that any number of columns costs one pass and one shuffle of
partial counts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.arrays import extract_all
from gleaner.functions.validate import BOOL_WORDS, is_missing_text, is_numeric_date
from gleaner.operators.patterns import DEFAULT, DEFAULT_CONFIDENCE, Pattern


def as_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, value`` rows with every cell as a string."""
    names = list(columns or df.columns)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names])
    return df.select(F.inline(cells))


def _blank_cell(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    missing = F.col(name).isNull()
    return missing | F.isnan(name) if isinstance(kind, (T.DoubleType, T.FloatType)) else missing


def table_info(df: DataFrame) -> DataFrame:
    """``rows, columns, column_names, duplicates``. Equal rows are counted where they are before they meet."""
    per_row = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return per_row.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.lit(", ".join(df.columns)).alias("column_names"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
    )


def missing_counts(df: DataFrame) -> DataFrame:
    """``rows, columns, missing_cells``."""
    missing = sum((_blank_cell(df, c).cast("int") for c in df.columns), F.lit(0))
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.coalesce(F.sum(missing), F.lit(0)).cast("long").alias("missing_cells"),
    )


def inferred_type(value: Column | str) -> Column:
    """Aggregate: the type a column of strings seems to hold."""
    c = F.col(value) if isinstance(value, str) else value
    present = ~is_missing_text(c)
    numeric = present & c.rlike(r"\A-?\d+(?:\.\d+)?\z")
    total = F.count_if(present)
    return (
        F.when(total == 0, "unknown")
        .when((F.count_if(numeric) / total > 0.9) & (F.count_if(numeric & c.contains(".")) == 0), "integer")
        .when(F.count_if(numeric) / total > 0.9, "float")
        .when(F.count_if(present & is_numeric_date(c)) / total > 0.8, "date")
        .when(F.count_if(present & ~F.lower(c).isin(BOOL_WORDS)) == 0, "boolean")
        .otherwise("string")
    )


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, inferred_type``."""
    return as_text(df, columns).groupBy("column").agg(inferred_type("value").alias("inferred_type"))


def column_profile(
    df: DataFrame,
    order: str | None = None,
    columns: Sequence[str] | None = None,
    patterns: Sequence[Pattern] | None = None,
    threshold: float = DEFAULT_CONFIDENCE,
    sample_size: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Per column: values with each pattern, the primary pattern, its share and the inferred type.

    A missing cell counts as the text ``nan`` for the share. Ties go to the pattern registered first. With
    ``order``, the first five values come along. Without ``sample_size`` every row is profiled.
    """
    chosen = list(DEFAULT.select() if patterns is None else patterns)
    source = random_sample(df, sample_size, seed) if sample_size else df
    names = list(columns or df.columns)
    text = as_text(source, names).withColumn("value", F.coalesce("value", F.lit("nan")))
    # Cells become flags where they are; only one row of counts per column and task is shuffled.
    usable = ~is_missing_text("value")
    flags = {p.name: F.when(usable, F.size(p.matches(F.col("value"))) > 0).otherwise(False) for p in chosen}
    counted = text.withColumns(flags).groupBy("column").agg(
        F.count_if(F.col("value") != "").alias("filled"),
        inferred_type("value").alias("inferred_type"),
        *[F.count_if(p.name).alias(p.name) for p in chosen],
    )
    top = F.greatest(*[F.struct(F.col(p.name).alias("n"), F.lit(-i).alias("rank"), F.lit(p.name).alias("name"))
                       for i, p in enumerate(chosen)])
    share = F.col("top.n") / F.col("filled")
    primary = (F.col("top.n") > 0) & (share >= threshold)
    profile = counted.withColumn("top", top).select(
        "column",
        F.when(primary, F.col("top.name")).alias("primary_pattern"),
        F.when(primary, share).otherwise(0.0).alias("pattern_confidence"),
        "inferred_type",
        *[F.col(p.name).alias(f"{p.name}_values") for p in chosen],
    )
    if order is None:
        return profile
    return profile.join(first_values(source, order, names), "column")


def first_values(df: DataFrame, order: str, columns: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` values of every column: one small top-n of rows, then ``column, sample_values``."""
    head = df.orderBy(order).limit(n)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("value")) for c in columns])
    rows = head.select(F.col(order).alias("_o"), F.inline(cells))
    return rows.groupBy("column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "value"))), lambda s: s["value"]), " | ").alias("sample_values")
    )


def random_sample(df: DataFrame, n: int, seed: int = 0, key: str | None = None) -> DataFrame:
    """``n`` rows (all, if there are fewer), the same ones for the same seed. A top-n, not a full sort."""
    basis = [F.col(key)] if key else [F.col(c) for c in df.columns]
    return df.withColumn("_r", F.xxhash64(F.lit(seed), *basis)).orderBy("_r").limit(n).drop("_r")


def exact_median(df: DataFrame, column: str, small: int = 50_000) -> float | None:
    """The exact median of a numeric column, without sorting or collecting it.

    Approximate percentiles (a bounded sketch) bracket the middle, one count checks the bracket, and the
    next round looks inside it. When few values are left, they are counted per value and the middle is read
    off. Each round shrinks the bracket a thousandfold and more, so a few scans do for any size.
    """
    v = F.col(column)
    inside = df.select(v).filter(v.isNotNull())
    total = inside.count()
    if total == 0:
        return None
    low_rank, high_rank = (total - 1) // 2, total // 2
    band, below, size = inside, 0, total
    while size > small:
        margin = 1 / 2000
        ends = [max((low_rank - below) / size - margin, 0.0), min((high_rank - below) / size + margin, 1.0)]
        lo, hi = band.agg(F.percentile_approx(v, ends, 10_000).alias("q")).first()["q"]
        under, within = band.agg(F.count_if(v < lo), F.count_if((v >= lo) & (v <= hi))).first()
        if lo == hi and below + under <= low_rank and high_rank < below + under + within:
            return float(lo)
        if within >= size or not (below + under <= low_rank and high_rank < below + under + within):
            break
        band, below, size = band.filter((v >= lo) & (v <= hi)), below + under, within
    # At most ``small`` values, or a column of few distinct ones that the sketch cannot split further.
    per_value = band.groupBy(v.alias("v")).agg(F.count("*").alias("n")).orderBy("v")
    found, seen = [], below
    for row in per_value.toLocalIterator():
        seen += row["n"]
        if low_rank < seen and not found:
            found.append(float(row["v"]))
        if high_rank < seen:
            return (found[0] + float(row["v"])) / 2
    return found[0]


# -- cleaning recipe --------------------------------------------------------------------------------


def clean_column_names(df: DataFrame) -> DataFrame:
    """Lowercase names with underscores; a name that is taken gets a number."""
    taken: dict[str, int] = {}
    names = []
    for name in df.columns:
        base = re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_") or "column"
        taken[base] = taken.get(base, 0) + 1
        names.append(base if taken[base] == 1 else f"{base}_{taken[base]}")
    return df.toDF(*names)


def drop_sparse_rows(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Keep rows in which at least this share of cells is there."""
    need = -(-len(df.columns) * int(round(threshold * 1000)) // 1000)
    return df.dropna(thresh=need)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def fill_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing cells replaced by the mean of their column, as doubles.

    Without a list, all numeric columns are looked at, and those without gaps keep their type and every digit.
    """
    looked_at = list(numeric_columns(df) if columns is None else columns)
    if not looked_at:
        return df
    stats = df.agg(
        *[F.avg(F.when(~_blank_cell(df, c), F.col(c))).alias(f"mean_{i}") for i, c in enumerate(looked_at)],
        *[F.count_if(_blank_cell(df, c)).alias(f"gaps_{i}") for i, c in enumerate(looked_at)],
    ).first()
    means = {c: stats[f"mean_{i}"] for i, c in enumerate(looked_at) if columns is not None or stats[f"gaps_{i}"]}
    return df.withColumns({
        c: F.when(_blank_cell(df, c), F.lit(m).cast("double")).otherwise(F.col(c).cast("double")) for c, m in means.items()
    })


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing cells replaced by the exact median of their column, as doubles."""
    filled = {}
    for c in columns:
        present = df.select(F.when(~_blank_cell(df, c), F.col(c)).cast("double").alias("v"))
        filled[c] = F.when(_blank_cell(df, c), F.lit(exact_median(present, "v"))).otherwise(F.col(c).cast("double"))
    return df.withColumns(filled)


def fill_empty(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.fillna("", list(string_columns(df) if columns is None else columns))


def cleaning_recipe(df: DataFrame) -> DataFrame:
    """Names, duplicate rows, sparse rows, numeric means, empty strings: the standard order."""
    named = clean_column_names(df)
    kept = drop_sparse_rows(named.dropDuplicates())
    return fill_empty(fill_mean(kept))


# -- what matches tell ------------------------------------------------------------------------------


def column_matches(df: DataFrame, column: str, regex: str, order: str, group: int = 0) -> DataFrame:
    """Distinct matches of a regex in one column with the row that showed them first: ``match, first_seen``."""
    hits = df.select(F.col(order).alias("_o"), F.posexplode(
        F.regexp_extract_all(F.col(column).cast("string"), F.lit(regex), F.lit(group))).alias("_p", "match"))
    first = hits.groupBy("match").agg(F.min(F.struct("_o", "_p")).alias("first"))
    return first.select("match", F.col("first._o").alias("first_seen"), F.col("first._p").alias("position"))


def _history(matches: DataFrame, value: str) -> tuple[DataFrame, Column]:
    """Distinct values (none, if the history is too short or uniform to learn from) and their number."""
    distinct = matches.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    enough = (F.coalesce(F.sum("n"), F.lit(0)) >= 10) & (F.count("*") >= 5)
    usable = distinct.agg(F.when(enough, F.count("*"))).scalar()
    return distinct.filter(usable.isNotNull()), usable


def phone_lengths(matches: DataFrame, value: str) -> DataFrame:
    """Digit counts of at least seven that a tenth of the distinct numbers share: ``digits, numbers``."""
    digits = F.length(F.regexp_replace("value", r"\P{Nd}", ""))
    distinct, total = _history(matches, value)
    counted = distinct.groupBy(digits.alias("digits")).agg(F.count("*").alias("numbers"))
    return counted.filter((F.col("numbers") >= total * 0.1) & (F.col("digits") >= 7))


def domain_whitelist(matches: DataFrame, value: str) -> DataFrame:
    """Domains that a tenth of the distinct addresses share: ``domain, emails``."""
    domain = F.lower(F.split_part("value", F.lit("@"), F.lit(2)))
    distinct, total = _history(matches, value)
    counted = distinct.groupBy(domain.alias("domain")).agg(F.count("*").alias("emails"))
    return counted.filter(F.col("emails") >= total * 0.1)


def date_formats(matches: DataFrame, value: str) -> DataFrame:
    """The most common layout, if a fifth of the distinct dates have it: ``layout, dates``."""
    day_first = F.regexp_extract("value", r"\A\d{1,2}([/.-])\d{1,2}\1\d{2,4}", 1)
    year_first = F.regexp_extract("value", r"\A\d{4}([/.-])\d{1,2}[/.-]\d{1,2}", 1)
    mixed = F.col("value").rlike(r"\A\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}")
    layout = F.when(day_first != "", F.concat(F.lit("MM"), day_first, F.lit("DD"), day_first, F.lit("YYYY"))).when(
        ~mixed & (year_first != ""), F.concat(F.lit("YYYY"), year_first, F.lit("MM"), year_first, F.lit("DD")))
    distinct, total = _history(matches, value)
    counted = distinct.groupBy(layout.alias("layout")).agg(F.count("*").alias("dates")).filter(F.col("layout").isNotNull())
    return counted.orderBy(F.desc("dates"), "layout").limit(1).filter(F.col("dates") >= total * 0.2)


def character_shares(df: DataFrame, value: str) -> DataFrame:
    """Share of values that contain each character, for characters of at least two values: ``char, share``."""
    total = df.agg(F.count("*")).scalar()
    chars = df.select(F.explode(F.array_distinct(F.filter(F.split(F.col(value), ""), lambda ch: ch != ""))).alias("char"))
    counted = chars.groupBy("char").agg(F.count("*").alias("n")).filter("n > 1")
    return counted.select("char", (F.col("n") / total).alias("share"))


# Punctuation that a position keeps literally.
_KEPT_MARKS = "@._-+"


def common_regex(df: DataFrame, value: str, order: str) -> DataFrame:
    """One regex for the positions all values share: ``regex`` (one row).

    Every position folds to a handful of flags, so values of one length never have to meet.
    """
    text = F.col(value)
    shortest = df.agg(F.min(F.length(text))).scalar()
    sample = df.agg(F.min_by(text, order)).scalar()
    chars = df.select(F.posexplode(F.split(text, "")).alias("pos", "ch")).filter(F.col("ch") != "")
    ch = F.col("ch")
    flags = chars.filter(F.col("pos") < shortest).groupBy("pos").agg(
        F.bool_and(ch.rlike(r"\p{Nd}")).alias("digit"),
        F.bool_and(ch.rlike(r"\p{Lu}")).alias("upper"),
        F.bool_and(ch.rlike(r"\p{Ll}")).alias("lower"),
        F.bool_and(ch.rlike(r"\p{L}")).alias("letter"),
        F.bool_and(ch.isin(list(_KEPT_MARKS))).alias("mark"),
    )
    here = F.substring(sample, F.col("pos") + 1, F.lit(1))
    part = (
        F.when(F.col("digit"), "\\d").when(F.col("upper"), "[A-Z]").when(F.col("lower"), "[a-z]")
        .when(F.col("letter"), "[A-Za-z]")
        .when(F.col("mark"), F.when(here.isin("@", "_"), here).otherwise(F.concat(F.lit("\\"), here)))
        .otherwise(".")
    )
    # At most one row per position of the shortest value.
    parts = flags.select("pos", part.alias("part")).agg(F.collect_list(F.struct("pos", "part")).alias("parts"))
    return parts.select(F.array_join(F.transform(F.array_sort("parts"), lambda p: p["part"]), "").alias("regex"))

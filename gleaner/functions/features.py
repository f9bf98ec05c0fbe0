"""Features of texts, numbers and mixed cells for classification, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import _col, coerce_number, word_count

# Categories per kind of data; the first one is the default.
CATEGORIES = {
    "text": ["article", "description", "title", "name", "comment", "address"],
    "person": ["customer", "employee", "contact", "user", "author"],
    "document": ["invoice", "receipt", "contract", "report", "email", "letter"],
    "contact": ["personal", "business", "support", "sales", "marketing"],
    "product": ["physical", "digital", "service", "subscription"],
}
# Default feature fields per kind of data.
FEATURE_FIELDS = {
    "text": ["text", "length"],
    "person": ["name", "role", "active"],
    "document": ["title", "content", "date"],
    "contact": ["name", "email", "phone", "department"],
    "product": ["name", "description", "price", "category"],
}


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _count(c: Column, regex_class: str) -> Column:
    """Characters of a class. Whole runs are cut out, which beats counting character by character."""
    return F.length(c) - F.length(F.regexp_replace(c, regex_class + "+", ""))


def _letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\P{L}+", ""))


def char_distribution(c: Column | str) -> Column:
    """``length, words, digit_ratio, alpha_ratio, upper_ratio`` (upper case among letters)."""
    text = _col(c)
    n, alpha = F.length(text), _letters(text)
    return F.struct(
        n.cast("double").alias("length"),
        word_count(text).cast("double").alias("words"),
        _share(_count(text, r"\p{Nd}"), n).alias("digit_ratio"),
        _share(alpha, n).alias("alpha_ratio"),
        _share(_count(text, r"\p{Lu}"), alpha).alias("upper_ratio"),
    )


def mixed_features(c: Column | str, is_number: bool = False, is_string: bool = True) -> Column:
    """Ten features of a cell; the type flags follow from the column's type."""
    text = _col(c).cast("string")
    n, alpha = F.length(text), _letters(text)
    as_double = lambda b: b.cast("double")
    return F.struct(
        n.cast("double").alias("length"),
        F.lit(float(is_number)).alias("is_number"),
        F.lit(float(is_string)).alias("is_string"),
        _share(_count(text, r"\p{Nd}"), n).alias("digit_ratio"),
        _share(alpha, n).alias("alpha_ratio"),
        _share(_count(text, r"\p{Lu}"), alpha).alias("upper_ratio"),
        _share(n - F.length(F.translate(text, ".,;:", "")), n).alias("punctuation_ratio"),
        as_double(text.contains(".") & text.rlike(r"\A[\p{Nd}.]*\z")).alias("dotted_number"),
        as_double(text.contains("@")).alias("has_at"),
        as_double(text.contains("/") | text.contains("-")).alias("has_separator"),
    )


def numeric_features(df: DataFrame, column: str, key: str) -> DataFrame:
    """``key, value_z, log_z, integer_z``: value, log and is-integer, standardised over all rows.

    Cells that are no number take the median. Global aggregates feed the projection; rows never move.
    """
    from gleaner.operators.profile import exact_median

    number = df.select(key, coerce_number(column).alias("v"))
    median = F.lit(exact_median(number, "v")).cast("double")
    raw = number.select(key, F.coalesce("v", median).alias("v")).select(
        key, "v", F.log1p(F.abs("v")).alias("l"), (F.col("v") == F.floor("v")).cast("double").alias("i")
    )
    moments = raw.agg(F.struct(
        *[f(c).alias(f"{name}_{c}") for c in ("v", "l", "i") for name, f in (("avg", F.avg), ("std", F.stddev_pop))]
    )).scalar()

    def z(c: str) -> Column:
        spread = F.when(moments[f"std_{c}"] == 0, F.lit(1.0)).otherwise(moments[f"std_{c}"])
        return (F.col(c) - moments[f"avg_{c}"]) / spread

    return raw.select(key, z("v").alias("value_z"), z("l").alias("log_z"), z("i").alias("integer_z"))


def is_title(c: Column | str) -> Column:
    """Upper case letters start words, lower case letters do not, and there is at least one."""
    text = _col(c)
    cased = r"\p{IsUppercase}\p{IsLowercase}\p{Lt}"
    return (
        text.rlike(rf"[{cased}]")
        & ~text.rlike(rf"[{cased}][\p{{IsUppercase}}\p{{Lt}}]")
        & ~text.rlike(rf"(?:\A|[^{cased}])\p{{IsLowercase}}")
    )


def infer_category(c: Column | str, kind: str = "text", lowered_title: bool = True) -> Column:
    """A weak label: the first category the text mentions, else one by its length.

    The title test looks at the lowercase text, which is never title case, so short texts are names;
    ``lowered_title=False`` tests the text as written.
    """
    categories = CATEGORIES[kind]
    if kind not in ("text", "person"):
        return F.lit(categories[0])
    text = F.lower(_col(c))
    label = F.when(F.lit(False), F.lit(""))
    for category in categories:
        label = label.when(text.contains(category), category)
    if kind == "person":
        return label.otherwise(categories[0])
    tested = text if lowered_title else _col(c)
    n = F.length(text)
    return (
        label.when((n < 50) & is_title(tested), "title").when(n < 50, "name").when(n > 500, "article").otherwise("description")
    )


def feature_type(dtype: str) -> str:
    """``numeric``, ``text`` or ``mixed`` for a column type."""
    if dtype in ("string", "varchar", "char"):
        return "text"
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean"):
        return "numeric"
    return "mixed"


def value_feature_type(value: Column | str) -> Column:
    """Aggregate over JSON literals of a schemaless field: all numbers, all strings or mixed; empty values ignored."""
    c = _col(value)
    used = c.isNotNull() & ~c.isin('""', "null", "0", "0.0", "false", "[]", "{}")
    number = c.rlike(r"\A(?:-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|true)\z")
    return (
        F.when(F.count_if(used & ~number) == 0, "numeric")
        .when(F.count_if(used & ~c.startswith('"')) == 0, "text")
        .otherwise("mixed")
    )

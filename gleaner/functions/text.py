r"""Text cleaning as ``Column`` expressions.

Python's ``\s \w \d`` are Unicode on strings, Java's are ASCII by default, so the classes are spelled out
here once. Only NFKC and the full HTML entity table need Python; both run as Arrow batches and leave plain
ASCII rows untouched.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Inside a class: white space as Python sees it (Unicode White_Space plus the four separators).
WHITE = r"\s\x1c-\x1f"
#: Inside a class: word characters as Python sees them.
WORD = r"\p{L}\p{N}_"

_SPACES = rf"(?U)[{WHITE}]+"

# Typographic characters replaced after NFKC.
TYPOGRAPHIC = {
    "‘": "'",
    "’": "'",
    "“": '"',
    "”": '"',
    "–": "-",
    "—": "--",
    " ": " ",
}
_TYPOGRAPHIC_TABLE = str.maketrans(TYPOGRAPHIC)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quote_regex(literal: str) -> str:
    """A regex matching ``literal`` itself, valid in Java."""
    return re.sub(r"([^0-9A-Za-z_\s])", r"\\\1", literal)


def quote_replacement(literal: str) -> str:
    """Replacement text for ``regexp_replace`` that stands for itself."""
    return literal.replace("\\", "\\\\").replace("$", "\\$")


def normalize_whitespace(c: Column | str) -> Column:
    """Runs of white space become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(_col(c), _SPACES, " "))


def words(c: Column | str) -> Column:
    """The white-space separated words; an empty array for a blank text."""
    return F.filter(F.split(normalize_whitespace(c), " "), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    """Number of white-space separated words, counted in place."""
    return F.regexp_count(_col(c), F.lit(rf"(?U)[^{WHITE}]+"))


def replace_typographic(c: Column | str) -> Column:
    """Curly quotes, dashes and the no-break space to ASCII, without Python."""
    out = _col(c)
    for old, new in TYPOGRAPHIC.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda s: s
        if s is None or s.isascii()
        else unicodedata.normalize("NFKC", s).translate(_TYPOGRAPHIC_TABLE),
        na_action="ignore",
    )


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: html.unescape(s) if "&" in s else s, na_action="ignore")


_NUMERIC_ENTITY = re.compile(r"&#(?:(\d+)|x([0-9a-fA-F]+));")


def _char_of(match: re.Match) -> str:
    code = int(match[1]) if match[1] else int(match[2], 16)
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else match[0]


@F.pandas_udf(T.StringType())
def _numeric_entities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: _NUMERIC_ENTITY.sub(_char_of, s) if "&#" in s else s, na_action="ignore")


def fix_unicode(c: Column | str) -> Column:
    """NFKC, then the typographic replacements."""
    return _nfkc(_col(c))


def unescape_html(c: Column | str) -> Column:
    """All HTML5 character references."""
    return _unescape(_col(c))


def decode_numeric_entities(c: Column | str) -> Column:
    """``&#N;`` and ``&#xH;`` decoded, named references left as they are."""
    return _numeric_entities(_col(c))


def strip_tags(c: Column | str) -> Column:
    """``<...>`` to a space; an empty ``<>`` is text."""
    return F.regexp_replace(_col(c), r"<[^>]+>", " ")


def remove_html(c: Column | str) -> Column:
    """Character references are decoded first, so encoded tags go as well."""
    return strip_tags(unescape_html(c))


def remove_punctuation(c: Column | str) -> Column:
    """Keep words, white space and apostrophes inside words."""
    kept = F.regexp_replace(_col(c), rf"(?U)[^{WORD}{WHITE}']", " ")
    return normalize_whitespace(F.regexp_replace(kept, rf"(?U)[{WHITE}]'|'[{WHITE}]", " "))


def remove_numbers(c: Column | str) -> Column:
    return normalize_whitespace(F.regexp_replace(_col(c), r"\p{Nd}+", ""))


def remove_special_characters(c: Column | str, keep_chars: str = "") -> Column:
    """Keep ASCII letters and digits, white space and ``keep_chars``."""
    kept = "".join("\\" + ch if not ch.isalnum() and not ch.isspace() else ch for ch in keep_chars)
    return normalize_whitespace(F.regexp_replace(_col(c), rf"(?U)[^a-zA-Z0-9{WHITE}{kept}]", ""))


def remove_stopwords(c: Column | str, stopwords: Sequence[str]) -> Column:
    """Drop words whose lowercase form is listed; the rest joined by one space.

    For lists of more than a few hundred words use :func:`gleaner.operators.words.drop_listed_words`.
    """
    listed = sorted({w for w in stopwords})
    return F.array_join(F.filter(words(c), lambda w: ~F.lower(w).isin(listed)), " ")


def replace_text(c: Column | str, replacements: Mapping[str, str], case_sensitive: bool = False) -> Column:
    """Ordered literal replacements."""
    out = _col(c)
    for old, new in replacements.items():
        if case_sensitive:
            out = F.replace(out, F.lit(old), F.lit(new))
        else:
            out = F.regexp_replace(out, "(?iu)" + quote_regex(old), quote_replacement(new))
    return out


def clean_text(
    c: Column | str,
    remove_html_tags: bool = True,
    unicode: bool = True,
    whitespace: bool = True,
    punctuation: bool = False,
    lowercase: bool = False,
) -> Column:
    """The cleaning steps in their fixed order; NULL gives an empty string."""
    out = F.coalesce(_col(c).cast("string"), F.lit(""))
    if unicode:
        out = fix_unicode(out)
    if remove_html_tags:
        out = remove_html(out)
    if punctuation:
        out = remove_punctuation(out)
    if whitespace:
        out = normalize_whitespace(out)
    if lowercase:
        out = F.lower(out)
    return out


def clean_columns(df: DataFrame, columns: Sequence[str], **options: bool) -> DataFrame:
    """:func:`clean_text` over the listed columns that exist."""
    return df.withColumns({c: clean_text(F.col(c), **options) for c in columns if c in df.columns})


def extract_number(c: Column | str) -> Column:
    """First number in a text: ``$1,299.99`` gives 1299.99, no number gives NULL."""
    digits = F.regexp_extract(_col(c), r"-?\d[\d,]*(?:\.\d+)?", 0)
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double")


def normalize_text(c: Column | str) -> Column:
    return F.lower(F.replace(_col(c), F.lit("!"), F.lit("")))


def parse_money(c: Column | str) -> Column:
    """``$999.99`` to a double; anything else to NULL."""
    return F.trim(F.replace(_col(c), F.lit("$"), F.lit(""))).try_cast("double")


def parse_bool_word(c: Column | str, true_word: str = "yes") -> Column:
    """Whether the text is the given word, ignoring case."""
    return F.lower(_col(c)) == F.lit(true_word.lower())


def coerce_number(c: Column | str) -> Column:
    """All but digits, dots and minus signs removed, then a number or NULL."""
    return F.regexp_replace(_col(c).cast("string"), r"[^\d.-]", "").try_cast("double")


def slug_url(c: Column | str) -> Column:
    """A file name for a URL: separators to underscores, at most 100 characters."""
    out = _col(c)
    for mark in ("://", "/", ":"):
        out = F.replace(out, F.lit(mark), F.lit("_"))
    return F.substring(out, 1, 100)


def resolve_href(base_url: Column | str, href: Column | str) -> Column:
    """A root-relative link on the scheme and host of its page; any other link as it is."""
    origin = F.array_join(F.slice(F.split(_col(base_url), "/"), 1, 3), "/")
    return F.when(_col(href).startswith("/"), F.concat(origin, _col(href))).otherwise(_col(href))


def duration_seconds(start: Column | str, end: Column | str) -> Column:
    micros = lambda c: F.unix_micros(_col(c).cast("timestamp"))
    return (micros(end) - micros(start)) / F.lit(1e6)


def _json_string(c: Column) -> Column:
    """A JSON string in ASCII, characters beyond it as ``\\uXXXX``."""

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escaped(ch: Column) -> Column:
        code = F.ascii(ch)
        high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
        low = F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
        return (
            F.when(ch == "\\", F.lit("\\\\"))
            .when(ch == '"', F.lit('\\"'))
            .when(ch == "\n", F.lit("\\n"))
            .when(ch == "\r", F.lit("\\r"))
            .when(ch == "\t", F.lit("\\t"))
            .when(code.between(32, 126), ch)
            .when(code < 0x10000, unit(code))
            .otherwise(F.concat(unit(high), unit(low)))
        )

    return F.concat(F.lit('"'), F.array_join(F.transform(F.split(c, ""), escaped), ""), F.lit('"'))


def sorted_json(params: Column) -> Column:
    """A ``map<string,string>`` as JSON with sorted keys, ``", "`` and ``": "`` as separators; empty gives ``''``."""
    entries = F.array_sort(F.map_entries(params))
    pairs = F.transform(entries, lambda e: F.concat(_json_string(e["key"]), F.lit(": "), _json_string(e["value"])))
    return F.when(params.isNull() | (F.size(params) == 0), F.lit("")).otherwise(
        F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    )


def cache_key(method: Column, url: Column, params: Column | None = None, data: Column | None = None) -> Column:
    """One hash per request, equal for equal parameters in any order."""
    text = [sorted_json(p) if p is not None else F.lit("") for p in (params, data)]
    return F.md5(F.concat(method, F.lit(":"), url, F.lit(":"), text[0], F.lit(":"), text[1]))

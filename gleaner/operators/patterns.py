"""Typed pattern recognition: a small registry of regexes with validators and formatters, applied natively.

Which patterns take part is decided while the plan is built, so unused regexes never enter it. Everything
happens inside the row; the result is exploded once and no shuffle is needed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import validate as V
from gleaner.functions.arrays import by_ord, extract_all, extract_spans, first_per_key, matches_of, skipping
from gleaner.functions.text import _col

Test = Callable[[Column], Column]

#: Confidence of a pattern that states none, and the share a column needs for its primary pattern.
DEFAULT_CONFIDENCE = 0.75
CONTEXT_CHARS = 20


@dataclass(frozen=True)
class Pattern:
    """One type of value: its regexes, what a match must fulfil and how it is written out."""

    name: str
    regexes: tuple[str, ...]
    confidence: float = DEFAULT_CONFIDENCE
    valid: Test | None = None
    written: Test | None = None
    sensitive: bool = False
    requires_context: bool = False
    needs: str | None = None

    def matches(self, text: Column) -> Column:
        """Distinct formatted matches, first hit first."""
        hits = extract_all(text, self.regexes, self.needs)
        if self.valid is not None:
            hits = F.filter(hits, self.valid)
        if self.written is not None:
            hits = F.transform(hits, self.written)
        return F.array_distinct(hits)

    def spans(self, text: Column) -> Column:
        """Distinct matches with offsets and context, as structs ``key, ord, start, stop, context``."""
        def numbered(n: int) -> Callable[[Column, Column], Column]:
            # Order by regex, then by place in the text.
            return lambda s, i: F.struct((i + F.lit(n * 1_000_000_000)).cast("long").alias("ord"), s.alias("span"))

        hits = F.concat(*[
            F.transform(extract_spans(text, rx, self.needs), numbered(n)) for n, rx in enumerate(self.regexes)
        ])
        if self.valid is not None:
            hits = F.filter(hits, lambda h: self.valid(h["span"]["value"]))
        written = self.written or (lambda c: c)

        def shaped(h: Column) -> Column:
            start, stop = h["span"]["start"], h["span"]["stop"]
            left = F.greatest(start - CONTEXT_CHARS, F.lit(0))
            return F.struct(
                written(h["span"]["value"]).alias("key"),
                h["ord"].alias("ord"),
                start.alias("start"),
                stop.alias("stop"),
                F.substring(text, left + 1, stop + CONTEXT_CHARS - left).alias("context"),
            )

        kept = first_per_key(F.transform(hits, lambda h: F.struct(
            written(h["span"]["value"]).alias("key"), h["ord"].alias("ord"), h["span"].alias("span"))))
        return by_ord(F.transform(kept, shaped))


# The regexes and confidences of the built-in types. ``(?U)`` gives the Unicode classes.
# Patterns that run on over words name, after the hit, the stretch in which nothing else can start.
BUILTIN: tuple[Pattern, ...] = (
    Pattern(
        "email",
        (r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",),
        0.95,
        valid=V.email_has_dotted_domain,
        needs="@",
    ),
    Pattern(
        "phone",
        (
            r"(?U)\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}",
            r"(?U)\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
            r"(?U)\b\d{8,15}\b",
        ),
        0.85,
        valid=V.has_phone_digits,
        written=V.phone_digits,
        needs=r"\p{Nd}",
    ),
    Pattern(
        "url",
        (
            # The possessive loop keeps long URLs off the stack; nothing after it needs a character back.
            r"(?U)https?://(?:[-\w.]|%[\da-fA-F]{2})++[/\w.-]*\??[/\w.-]*",
            r"(?U)www\.(?:[-\w.]|%[\da-fA-F]{2})++[/\w.-]*\??[/\w.-]*",
        ),
        0.9,
        valid=V.has_known_domain,
        needs=r"http|www\.",
    ),
    Pattern(
        "date",
        (
            r"(?U)\d{4}-\d{2}-\d{2}",
            r"(?U)\d{1,2}/\d{1,2}/\d{2,4}",
            r"(?U)\d{1,2}[-./]\d{1,2}[-./]\d{2,4}",
            r"(?U)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}",
        ),
        0.8,
        valid=V.is_numeric_date,
        written=V.iso_date,
        needs=r"\p{Nd}",
    ),
    Pattern(
        "ssn",
        (r"(?U)\d{3}[-]\d{2}[-]\d{4}", r"(?U)\b\d{9}\b"),
        0.9,
        valid=V.is_ssn,
        sensitive=True,
        needs=r"\p{Nd}",
    ),
    Pattern(
        "credit_card",
        (r"(?U)\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}", r"(?U)\d{13,16}"),
        0.9,
        valid=V.is_card_number,
        written=V.digits_only,
        sensitive=True,
        needs=r"\p{Nd}",
    ),
    Pattern(
        "ip_address",
        (r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b", r"(?U)\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
        0.95,
        valid=V.is_ip_address,
        needs=r"[\p{Nd}:]",
    ),
    Pattern(
        "address",
        (
            skipping(
                "(?U)",
                r"\d++\s[A-Za-z0-9\s,.]+(?:Avenue|Ave|Street|St|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Plaza|Plz|Square|Sq)"
                r"\W+(?:[A-Za-z]+\W+)?(?:[A-Z]{2})?\W+\d{5}(?:-\d{4})?",
                r"\d++(?:\s(?:[A-Za-z0-9\s,.]*+(?!\d)|[A-Za-z0-9\s,.]*(?<!\d)))?",
            ),
            skipping("(?U)", r"\d++\s[A-Za-z0-9\s,.]+", r"\d++"),
        ),
        0.7,
        requires_context=True,
        needs=r"\p{Nd}",
    ),
    Pattern(
        "person_name",
        (
            r"(?U)\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",
            r"(?U)\b[A-Z][a-z]+\s+[A-Z]\.\s+[A-Z][a-z]+\b",
            r"(?U)\bDr\.\s+[A-Z][a-z]+\b",
            r"(?U)\bMr\.\s+[A-Z][a-z]+\b",
            r"(?U)\bMs\.\s+[A-Z][a-z]+\b",
            r"(?U)\bMrs\.\s+[A-Z][a-z]+\b",
        ),
        0.7,
        requires_context=True,
    ),
    Pattern(
        "company_name",
        (
            skipping("(?U)", r"\b[A-Z][A-Za-z0-9\s]+(?:Inc|LLC|Ltd|Corp|Corporation|Company)\b", r"\b[A-Z][A-Za-z0-9\s]*+"),
            skipping("(?U)", r"\b[A-Z][A-Za-z0-9\s]+(?:Inc\.|LLC\.|Ltd\.|Corp\.|Corporation)\b", r"\b[A-Z][A-Za-z0-9\s]*+"),
        ),
        0.75,
        requires_context=True,
        needs="Inc|LLC|Ltd|Corp|Company",
    ),
)

# Types that come from configuration.
CONFIGURED: tuple[Pattern, ...] = (
    Pattern("product_code", (r"(?U)\b[A-Z]{2,3}-\d{4,6}\b", r"(?U)\b[A-Z]{2,3}\d{4,6}\b"), 0.8),
    Pattern("invoice_number", (r"(?U)\bINV-\d{5,9}\b", r"(?U)\bINV\d{5,9}\b"), 0.9, needs="INV"),
)

# Named selections of pattern types.
PRESETS: dict[str, tuple[str, ...]] = {
    "contact_extraction": ("email", "phone", "url", "person_name"),
    "business_document": ("invoice_number", "date", "company_name", "address"),
}


@dataclass(frozen=True)
class Registry:
    """An immutable set of patterns; every change gives a new registry."""

    patterns: Mapping[str, Pattern] = field(default_factory=lambda: {p.name: p for p in BUILTIN})

    def add(self, *patterns: Pattern) -> Registry:
        return Registry({**self.patterns, **{p.name: p for p in patterns}})

    def remove(self, name: str) -> Registry:
        return Registry({n: p for n, p in self.patterns.items() if n != name})

    def add_json(self, text: str) -> Registry:
        """Patterns from ``{name: {"patterns": [...], "confidence": c, "sensitive": b}}``."""
        new = [
            Pattern(
                name,
                tuple("(?U)" + rx for rx in config["patterns"]),
                float(config.get("confidence", DEFAULT_CONFIDENCE)),
                sensitive=bool(config.get("sensitive", False)),
            )
            for name, config in json.loads(text).items()
        ]
        return self.add(*new)

    def forbid_characters(self, name: str, characters: Iterable[str]) -> Registry:
        """Matches of ``name`` that contain one of the characters become invalid."""
        old, listed = self.patterns[name], list(characters)

        def valid(c: Column) -> Column:
            clean = F.lit(True)
            for ch in listed:
                clean = clean & ~c.contains(ch)
            return clean if old.valid is None else old.valid(c) & clean

        return self.add(replace(old, valid=valid)) if listed else self

    def add_regex(self, name: str, regex: str) -> Registry:
        old = self.patterns[name]
        if regex in old.regexes:
            return self
        return self.add(replace(old, regexes=(*old.regexes, regex), needs=None))

    def select(
        self,
        types: Sequence[str] | None = None,
        include_sensitive: bool = False,
        min_confidence: float = 0.0,
    ) -> list[Pattern]:
        return [
            p
            for p in self.patterns.values()
            if (not types or p.name in types)
            and (include_sensitive or not p.sensitive)
            and p.confidence >= min_confidence
        ]


DEFAULT = Registry()


def preset(name: str, registry: Registry = DEFAULT) -> list[Pattern]:
    """The patterns of a named selection, the configured ones included."""
    return registry.add(*CONFIGURED).select(PRESETS[name])


def recognize(df: DataFrame, key: str, text: str, patterns: Sequence[Pattern] | None = None) -> DataFrame:
    """Rows ``key, pattern, ord, match, confidence``: distinct formatted matches per text and type."""
    return df.select(F.col(key), F.inline(recognized(F.col(text), DEFAULT.select() if patterns is None else patterns)))


def recognized(text: Column, patterns: Sequence[Pattern]) -> Column:
    """The matches of all types as structs ``pattern, ord, match, confidence``."""

    def shaped(p: Pattern) -> Callable[[Column, Column], Column]:
        return lambda m, i: F.struct(
            F.lit(p.name).alias("pattern"),
            i.cast("int").alias("ord"),
            m.alias("match"),
            F.lit(p.confidence).alias("confidence"),
        )

    per_type = [F.transform(p.matches(text), shaped(p)) for p in patterns]
    return F.concat(*per_type) if len(per_type) > 1 else per_type[0]


def recognize_spans(df: DataFrame, key: str, text: str, patterns: Sequence[Pattern] | None = None) -> DataFrame:
    """As :func:`recognize`, with the offsets and the surrounding text of each first hit."""
    chosen = list(DEFAULT.select() if patterns is None else patterns)

    def shaped(p: Pattern) -> Callable[[Column], Column]:
        return lambda h: F.struct(
            F.lit(p.name).alias("pattern"),
            h["key"].alias("match"),
            h["start"].alias("start"),
            h["stop"].alias("stop"),
            F.lit(p.confidence).alias("confidence"),
            h["context"].alias("context"),
        )

    per_type = [F.transform(p.spans(F.col(text)), shaped(p)) for p in chosen]
    hits = F.concat(*per_type) if len(per_type) > 1 else per_type[0]
    return df.select(F.col(key), F.inline(hits))


def pattern_map(text: Column | str, patterns: Sequence[Pattern] | None = None) -> Column:
    """``map<type, array<match>>`` of the types that occur; empty for an empty or missing text."""
    chosen = list(DEFAULT.select() if patterns is None else patterns)
    entries = F.array(
        *[F.struct(F.lit(p.name).alias("key"), p.matches(_col(text)).alias("value")) for p in chosen]
    )
    return F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0))


def add_pattern_columns(df: DataFrame, columns: Sequence[str], patterns: Sequence[Pattern] | None = None) -> DataFrame:
    """A ``<column>_patterns`` map for each listed column that exists."""
    return df.withColumns({f"{c}_patterns": pattern_map(F.coalesce(F.col(c), F.lit("")), patterns)
                           for c in columns if c in df.columns})


def feature_columns(df: DataFrame, key: str, text: str, patterns: Sequence[Pattern] | None = None) -> DataFrame:
    """``length``, ``word_count`` and for each type ``has_<type>`` and ``<type>_count``, one row per text."""
    from gleaner.functions.text import word_count

    chosen = list(DEFAULT.select() if patterns is None else patterns)
    counted = df.select(
        F.col(key),
        F.length(text).cast("long").alias("length"),
        word_count(text).cast("long").alias("word_count"),
        *[F.size(p.matches(F.col(text))).cast("long").alias(f"{p.name}_count") for p in chosen],
    )
    return counted.withColumns({f"has_{p.name}": F.col(f"{p.name}_count") > 0 for p in chosen})


def redact(text: Column | str, patterns: Sequence[Pattern], mask: str = "[redacted]") -> Column:
    """Valid matches of the given types masked where they stand, in registry order; equal digits elsewhere stay."""
    out = _col(text)
    for p in patterns:
        valid = p.valid or (lambda match: F.lit(True))
        for rx in p.regexes:
            out = _masked(out, rx, valid, mask)
    return out


def _masked(text: Column, regex: str, valid: Test, mask: str) -> Column:
    """The texts between matches with the matches, or the mask for valid ones, put back between them."""
    def piece(gap: Column, match: Column) -> Column:
        found = match["value"]
        kept = F.when(found.isNull(), F.lit("")).when(match["hit"] & valid(found), F.lit(mask)).otherwise(found)
        return F.concat(gap, kept)

    return F.array_join(F.zip_with(F.split(text, str(regex), -1), matches_of(text, regex), piece), "")


def process_documents(
    df: DataFrame,
    key: str,
    text: str,
    fallback: str | None = None,
    carry: Sequence[str] = (),
    patterns: Sequence[Pattern] | None = None,
) -> DataFrame:
    """Pattern maps per document with its identifiers; a document without text gets an error instead."""
    body = F.when(F.col(text) != "", F.col(text))
    if fallback is not None:
        body = F.coalesce(body, F.when(F.col(fallback) != "", F.col(fallback)))
    return df.select(
        F.col(key),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in carry],
        F.when(body.isNotNull(), pattern_map(body, patterns)).alias("patterns"),
        F.when(body.isNull(), F.lit("No text content found")).alias("error"),
    )

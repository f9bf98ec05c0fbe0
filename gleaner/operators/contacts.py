"""Contacts in texts: e-mail addresses, phone numbers and postal addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.functions import validate as V
from gleaner.functions.arrays import extract_all, first_per_key, keyed, skipping
from gleaner.functions.text import _col
from gleaner.session import small_frame

# The strict e-mail pattern. Loops are possessive, so long dotted names stay off the stack.
_ATOM = r"[a-z0-9!#$%&'*+/=?^_`{|}~-]"
_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_OCTET = r"25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?"
STRICT_EMAIL = (
    rf"(?:{_ATOM}++(?:\.{_ATOM}++)*+"
    r'|"(?:[\x01-\x08\x0b\x0c\x0e-\x1f\x21\x23-\x5b\x5d-\x7f]|\\[\x01-\x09\x0b\x0c\x0e-\x7f])*+")'
    rf"@(?:(?:{_LABEL}\.(?=[a-z0-9]))++{_LABEL}"
    rf"|\[(?:(?:{_OCTET})\.){{3}}(?:{_OCTET}|[a-z0-9-]*[a-z0-9]:"
    r"(?:[\x01-\x08\x0b\x0c\x0e-\x1f\x21-\x5a\x53-\x7f]|\\[\x01-\x09\x0b\x0c\x0e-\x7f])+)\])"
)

# The standard pattern, started only where a run of name characters starts or the last match ended, so a
# long run without an @ is read once.
_EMAIL_RUN = (
    r"(?i)(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++@[a-z0-9.-]+\.[a-z]{2,}"
)

# Phone patterns in the order they are tried.
PHONES = (
    r"(?U)\b(?:\+\d{1,3}[- ]?)?\(?\d{3}\)?[- ]?\d{3}[- ]?\d{4}\b",
    r"(?U)\b\d{3}[- ]?\d{3}[- ]?\d{4}\b",
    r"(?U)\b(?:\+\d{1,3}[- ]?)?\d{5,}\b",
)

# Postal address patterns per country.
_SUFFIX = (
    "Avenue|Ave|Boulevard|Blvd|Circle|Cir|Court|Ct|Drive|Dr|Lane|Ln|Place|Pl|Plaza|Plz|"
    "Road|Rd|Square|Sq|Street|St|Way|Terrace|Ter|Trail|Trl"
)
# Places that white space alone separates are written with one white character next to a loop that takes the rest, so
# that a run of it is cut in one way only. A number whose words hold no address takes them with it: no later number
# among them could do better. (Digits of other scripts end the words; a number that goes on with them is left whole.)
_WORDS = r"[A-Za-z0-9\s,\.]"
_NO_ADDRESS = rf"\d++(?:\s(?:{_WORDS}*+(?!\d)|{_WORDS}*(?<!\d)))?"
_STATE_ZIP = r"(?:,\s*+|\s)[A-Z]{2}(?:\s*+,\s*+|\s++)\d{5}(?:-\d{4})?"
# A comma or white space, a town, a comma or white space; the words before take all of the town but its last word.
_TOWN = (
    r"(?:[,\s][A-Za-z]++(?:\s*+,\s*+|\s++)"
    r"|(?:,|(?<!\s)\s|(?<=\d\s\s)\s)(?:\s++,\s*+|\s\s++))"
)
ADDRESSES: dict[str, tuple[str, ...]] = {
    "US": (
        skipping("(?iU)", rf"\d++\s{_WORDS}+(?:{_SUFFIX})\.?(?:\s*+,|\s)[A-Za-z\s]+{_STATE_ZIP}", _NO_ADDRESS),
        skipping("(?iU)", rf"\d++\s{_WORDS}+(?:{_SUFFIX})", _NO_ADDRESS),
        rf"(?iU)P\.?O\.?\s*Box\s+\d+(?:\s*+,|\s)[A-Za-z\s]+{_STATE_ZIP}",
    ),
    "UK": (skipping("(?iU)", rf"\d++\s{_WORDS}+{_TOWN}[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s+\d[A-Z]{{2}}", _NO_ADDRESS),),
    "CA": (skipping("(?iU)", rf"\d++\s{_WORDS}+{_TOWN}[A-Z]\d[A-Z]\s+\d[A-Z]\d", _NO_ADDRESS),),
}


def email_array(text: Column | str, strict: bool = False) -> Column:
    """E-mail addresses of a text, the first spelling of each, as structs ``key, ord, value``."""
    regex = "(?i)" + STRICT_EMAIL if strict else _EMAIL_RUN
    return first_per_key(keyed(extract_all(_col(text), [regex], needs="@"), F.lower))


def phone_array(text: Column | str) -> Column:
    """Phone numbers of at least seven digits, one per digit sequence, as structs ``key, ord, value``."""
    numbers = keyed(extract_all(_col(text), PHONES, needs=r"\p{Nd}"), lambda v: F.regexp_replace(v, r"\P{Nd}", ""))
    return first_per_key(F.filter(numbers, lambda s: F.length(s["key"]) >= 7))


def address_array(text: Column | str, country: str = "US") -> Column:
    """Postal addresses with white space normalised, each once, as structs ``key, ord, value``."""
    found = extract_all(_col(text), ADDRESSES.get(country, ADDRESSES["US"]), needs=r"\p{Nd}")
    return first_per_key(keyed(F.transform(found, X.normalize_whitespace), lambda v: v))


def _rows(df: DataFrame, key: str, array: Column, name: str) -> DataFrame:
    exploded = df.select(F.col(key), F.posexplode(array).alias("pos", "hit"))
    return exploded.select(key, F.col("pos").cast("int").alias("pos"), F.col("hit.value").alias(name))


def extract_emails(df: DataFrame, key: str, text: str, strict: bool = False) -> DataFrame:
    """Rows ``key, pos, email``."""
    return _rows(df, key, email_array(text, strict), "email")


def visible_text(html: Column | str) -> Column:
    """Markup for contact search: numeric references decoded, every tag a space."""
    return F.regexp_replace(X.decode_numeric_entities(html), "<[^>]*>", " ")


def extract_emails_html(df: DataFrame, key: str, html: str, strict: bool = False) -> DataFrame:
    return extract_emails(df.select(key, visible_text(html).alias("_text")), key, "_text", strict)


def extract_phones(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows ``key, pos, phone``."""
    return _rows(df, key, phone_array(text), "phone")


def extract_phones_html(df: DataFrame, key: str, html: str) -> DataFrame:
    stripped = F.regexp_replace(F.col(html), "<[^>]*>", " ")
    return extract_phones(df.select(key, stripped.alias("_text")), key, "_text")


def extract_phones_typed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Valid +1 numbers in three written forms, with country code and region."""
    found = extract_phones(df, key, text)
    return found.filter(V.nanp_digits("phone").isNotNull()).select(
        key,
        V.format_us_phone("phone", "international").alias("number"),
        V.format_us_phone("phone", "national").alias("national"),
        V.format_us_phone("phone", "e164").alias("e164"),
        F.lit(1).alias("country_code"),
    )


def extract_addresses(df: DataFrame, key: str, text: str, country: str = "US") -> DataFrame:
    """Rows ``key, pos, address``."""
    return _rows(df, key, address_array(text, country), "address")


def address_context(df: DataFrame, key: str, text: str, country: str = "US", window: int = 100) -> DataFrame:
    """Each address with the text around its first occurrence; ``''`` if only its unnormalised form occurs."""
    found = df.select(F.col(key), F.col(text).alias("_text"), F.explode(address_array(text, country)).alias("hit"))
    at = F.position(F.col("hit.value"), F.col("_text"))
    left = F.greatest(at - window, F.lit(1))
    context = F.substring(F.col("_text"), left, at + F.length("hit.value") + window - left)
    return found.select(
        key,
        F.col("hit.value").alias("address"),
        F.when(at > 0, context).otherwise("").alias("context"),
    )


_PARTS = (
    rf"(?i)^(\d+)\s+(.+?\b(?:{_SUFFIX})\b\.?)(?:[,\s]+([a-z][a-z\s]*?))?(?:[,\s]+([a-z]{{2}}))?(?:[,\s]+(\d{{5}}(?:-\d{{4}})?))?$"
)


def address_parts(address: Column | str) -> Column:
    """``number, street, city, state, zip`` of a US address and whether number and street are there."""
    part = lambda i: F.nullif(F.regexp_extract(_col(address), _PARTS, i), F.lit(""))
    names = ["number", "street", "city", "state", "zip"]
    fields = [part(i + 1).alias(n) for i, n in enumerate(names)]
    return F.struct(*fields, (part(1).isNotNull() & part(2).isNotNull()).alias("valid"))


def email_domain(email: Column | str) -> Column:
    return F.lower(F.split_part(_col(email), F.lit("@"), F.lit(2)))


def group_by_domain(df: DataFrame, key: str, text: str) -> DataFrame:
    """E-mail addresses of each text grouped by domain: ``key, domain, emails`` (one text bounds a group)."""
    return (
        extract_emails(df, key, text)
        .groupBy(key, email_domain("email").alias("domain"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "email"))).alias("hits"))
        .select(key, "domain", F.col("hits.email").alias("emails"))
    )


def count_by_domain(emails: DataFrame) -> DataFrame:
    """Corpus view of the same: addresses and distinct addresses per domain, without collecting a group."""
    per_email = emails.groupBy(F.lower("email").alias("email")).agg(F.count("*").alias("n"))
    return per_email.groupBy(email_domain("email").alias("domain")).agg(
        F.sum("n").alias("emails"), F.count("*").alias("distinct_emails")
    )


def filter_domains(emails: DataFrame, domains: Sequence[str], exclude: bool = False, in_row: int = 64) -> DataFrame:
    """Keep (or drop) addresses whose domain ends with a listed one.

    Up to ``in_row`` domains are an expression. Longer lists: a domain ends with a listed one exactly if one
    of its suffixes is listed, so the suffixes of each distinct domain meet the list in an equi-join.
    """
    listed = sorted({d.lower() for d in domains})
    tagged = emails.filter(F.col("email").contains("@")).withColumn("domain", email_domain("email"))
    if len(listed) <= in_row:
        hit = F.lit(False)
        for d in listed:
            hit = hit | F.col("domain").endswith(d)
        return tagged.filter(~hit if exclude else hit).drop("domain")
    endings = small_frame(emails.sparkSession, [(d,) for d in listed], "suffix string")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("domain"), F.lit(1))),
        lambda i: F.substring("domain", i, F.length("domain")),
    )
    hits = (
        tagged.select("domain").distinct().select("domain", F.explode(suffixes).alias("suffix"))
        .join(endings, "suffix", "left_semi").select("domain").distinct()
    )
    return tagged.join(hits, "domain", "left_anti" if exclude else "left_semi").drop("domain")

"""Validators (boolean columns) and formatters (string columns) for extracted values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import _col

# The top-level domains a URL must mention.
URL_DOMAINS = ["com", "org", "net", "edu", "gov", "io"]
# Date layouts tried in order.
DATE_FORMATS = ["yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy", "M.d.yyyy", "d.M.yyyy"]
# Spellings of truth values.
BOOL_WORDS = ["true", "false", "yes", "no", "1", "0", "t", "f", "y", "n"]
# Cells that mean "missing".
MISSING_WORDS = ["nan", "null", "none", ""]
# Fixed value: the standard e-mail pattern.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def digits_only(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "[^0-9]", "")


def is_missing_text(c: Column | str) -> Column:
    """NULL or one of the missing-value words."""
    return _col(c).isNull() | F.lower(_col(c)).isin(MISSING_WORDS)


def is_email(c: Column | str, strict_pattern: str | None = None) -> Column:
    return _col(c).rlike(rf"(?i)\A(?:{strict_pattern or EMAIL})\z")


def email_has_dotted_domain(c: Column | str) -> Column:
    """An ``@`` with a dot somewhere in the part after it."""
    return F.split_part(_col(c), F.lit("@"), F.lit(2)).contains(".")


def has_phone_digits(c: Column | str) -> Column:
    """At least seven digits."""
    return F.length(F.regexp_replace(_col(c), r"\P{Nd}", "")) >= 7


def phone_digits(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "[^0-9+]", "")


def has_known_domain(c: Column | str) -> Column:
    return _col(c).rlike(r"(?i)\.(?:" + "|".join(URL_DOMAINS) + ")")


def is_numeric_date(c: Column | str) -> Column:
    """Six to eight digits once separators are dropped."""
    return F.regexp_replace(_col(c), r"(?U)[/\-\s,.]", "").rlike(r"\A\p{Nd}{6,8}\z")


def iso_date(c: Column | str) -> Column:
    """ISO form of the first layout that fits, then of a written month; otherwise the input unchanged."""
    text = _col(c)
    # The patterns accept one or two digit days and months, but only four digit years.
    numeric = [
        F.when(text.rlike(r"\A\d{4}-\d{1,2}-\d{1,2}\z"), F.try_to_timestamp(text, F.lit("yyyy-M-d")))
    ]
    for layout in DATE_FORMATS[1:]:
        mark = layout[1]
        shape = rf"\A\d{{1,2}}[{mark}]\d{{1,2}}[{mark}]\d{{4}}\z"
        numeric.append(F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout))))
    written = r"(?U)\A([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})"
    month = F.lower(F.substring(F.regexp_extract(text, written, 1), 1, 3))
    place = F.position(month, F.lit("jan feb mar apr may jun jul aug sep oct nov dec"))
    aligned = (F.length(month) == 3) & (place > 0)
    number = F.floor((place + 3) / 4)
    from_words = F.when(
        text.rlike(written) & aligned,
        F.concat(
            F.regexp_extract(text, written, 3),
            F.lit("-"),
            F.lpad(number.cast("string"), 2, "0"),
            F.lit("-"),
            F.lpad(F.regexp_extract(text, written, 2), 2, "0"),
        ),
    )
    return F.coalesce(F.date_format(F.coalesce(*numeric), "yyyy-MM-dd"), from_words, text)


def is_ssn(c: Column | str) -> Column:
    return F.length(digits_only(c)) == 9


def is_card_number(c: Column | str) -> Column:
    """13 to 19 digits that pass the Luhn check."""
    digits = digits_only(c)
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def is_ip_address(c: Column | str) -> Column:
    """IPv4 with octets up to 255, or at most eight colon groups."""
    text = _col(c)
    is_v4 = text.rlike(r"\A(?:\d{1,3}\.){3}\d{1,3}\z")
    octets_fit = F.forall(F.split(text, r"\."), lambda o: F.coalesce(o.try_cast("int"), F.lit(256)) <= 255)
    return F.when(is_v4, octets_fit).otherwise(text.contains(":") & (F.size(F.split(text, ":")) <= 8))


def nanp_digits(c: Column | str) -> Column:
    """The ten national digits of a valid +1 number, else NULL.

    Area and exchange codes start with 2 to 9, and neither may be an N11 service code.
    """
    text = _col(c)
    digits = digits_only(text)
    national = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).when(
        (F.length(digits) == 10) & ~F.ltrim(text).startswith("+"), digits
    )
    return F.when(national.rlike(r"\A[2-9](?!11)\d\d[2-9](?!11)\d{6}\z"), national)


def format_us_phone(c: Column | str, style: str = "international") -> Column:
    """A +1 number as ``international``, ``national`` or ``e164``; anything invalid as it came."""
    text = _col(c)
    n = nanp_digits(text)
    area, exchange, line = F.substring(n, 1, 3), F.substring(n, 4, 3), F.substring(n, 7, 4)
    shaped = {
        "national": F.concat(F.lit("("), area, F.lit(") "), exchange, F.lit("-"), line),
        "e164": F.concat(F.lit("+1"), n),
    }.get(style.lower(), F.concat(F.lit("+1 "), area, F.lit("-"), exchange, F.lit("-"), line))
    return F.coalesce(shaped, text)

"""Address and company patterns: the same matches as the patterns written plainly, in linear time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gleaner.functions.arrays import extract_all, extract_spans
from gleaner.operators import contacts, patterns

SUFFIX = (
    "Avenue|Ave|Boulevard|Blvd|Circle|Cir|Court|Ct|Drive|Dr|Lane|Ln|Place|Pl|Plaza|Plz|"
    "Road|Rd|Square|Sq|Street|St|Way|Terrace|Ter|Trail|Trl"
)
STREETS = "Avenue|Ave|Street|St|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Plaza|Plz|Square|Sq"
WORDS = r"[A-Za-z0-9\s,\.]+"
TOWN = r"(?:,\s*|\s+)[A-Za-z\s]+(?:,\s*|\s+)"
BY_NAME = {p.name: p for p in patterns.BUILTIN}
PLAIN = {
    "us_full": (rf"(?iU)\d+\s+{WORDS}(?:{SUFFIX})\.?(?:\s*,\s*|\s+)[A-Za-z\s]+(?:,\s*|\s+)[A-Z]{{2}}(?:\s*,\s*|\s+)\d{{5}}(?:-\d{{4}})?", contacts.ADDRESSES["US"][0]),
    "us_street": (rf"(?iU)\d+\s+{WORDS}(?:{SUFFIX})", contacts.ADDRESSES["US"][1]),
    "us_box": (r"(?iU)P\.?O\.?\s*Box\s+\d+(?:\s*,\s*|\s+)[A-Za-z\s]+(?:,\s*|\s+)[A-Z]{2}(?:\s*,\s*|\s+)\d{5}(?:-\d{4})?", contacts.ADDRESSES["US"][2]),
    "uk": (rf"(?iU)\d+\s+{WORDS}{TOWN}[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s+\d[A-Z]{{2}}", contacts.ADDRESSES["UK"][0]),
    "ca": (rf"(?iU)\d+\s+{WORDS}{TOWN}[A-Z]{{1}}\d{{1}}[A-Z]{{1}}\s+\d{{1}}[A-Z]{{1}}\d{{1}}", contacts.ADDRESSES["CA"][0]),
    "typed_full": (rf"(?U)\d+\s+[A-Za-z0-9\s,.]+(?:{STREETS})\W+(?:[A-Za-z]+\W+)?(?:[A-Z]{{2}})?\W+\d{{5}}(?:-\d{{4}})?", BY_NAME["address"].regexes[0]),
    "typed_street": (r"(?U)\d+\s+[A-Za-z0-9\s,.]+", BY_NAME["address"].regexes[1]),
    "company": (r"(?U)\b[A-Z][A-Za-z0-9\s]+(?:Inc|LLC|Ltd|Corp|Corporation|Company)\b", BY_NAME["company_name"].regexes[0]),
    "company_dotted": (r"(?U)\b[A-Z][A-Za-z0-9\s]+(?:Inc\.|LLC\.|Ltd\.|Corp\.|Corporation)\b", BY_NAME["company_name"].regexes[1]),
}
PIECES = {
    "u": ["12", "3 ", " ", "  ", "   ", ",", ", ", ".", "St", "Elm Ave", " Dr. ", "ab", "Oak", "NY", " IL ", "12345", " 62701", "-1234", "é", "_", "٣", "\n", "PO Box 9 ", "(", "ſt"],
    "p": ["12", " 7 ", " ", "  ", "   ", ",", ", ", " ,", "Rd", "ab ", "London", "SW1A 1AA", "n1 2bc", "K1A 0B1", "k1a  0b1", ".", "é", "-", "٣ "],
    "f": ["12 ", "3  Elm St", " Ave.", ", ", " ", "  ", " Springfield", " IL ", " NY", "12345", " 62701", "-1234", ",", " ab", "PO Box 9 ", "P.O.Box 7,"],
    "c": ["Acme ", "Big", " Tools", " Inc", "Inc.", " LLC", "Ltd.x", " Corp ", "Corporation", "Company", "é", "_", " ", ".", "7", "Incx", "\n", "a "],
}
ALPHABET = {"us_full": "f", "us_box": "f", "uk": "p", "ca": "p", "company": "c", "company_dotted": "c"}


@pytest.mark.parametrize("name", PLAIN)
def test_same_matches(spark, name):
    plain, linear = PLAIN[name]
    rng = random.Random(name)
    pieces = PIECES[ALPHABET.get(name, "u")]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(2, 16))) for _ in range(20_000)]
    text = F.col("text")
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8).select(
        "text", extract_all(text, [plain]).alias("want"), extract_all(text, [linear]).alias("got"),
        extract_spans(text, plain).alias("want_spans"), extract_spans(text, linear).alias("got_spans"),
    )
    assert rows.filter(F.size("want") > 0).count() > 50
    assert rows.filter(~(F.col("want") == F.col("got")) | ~(F.col("want_spans") == F.col("got_spans"))).head(3) == []


@pytest.mark.parametrize("text", ["12 ab ", "12 ab, 7 St. ", "Acme Big ab ", "123456789", "12 first list, ", "12   ", "7 a N1 "])
def test_linear(spark, text):
    """200 kB without an address or a company."""
    df = spark.createDataFrame([(1, text * (200_000 // len(text)))], "id int, text string")
    chosen = [rx for _, (_, rx) in PLAIN.items()]
    df.select(F.size(extract_all(F.lit("12 Elm St"), chosen)).alias("n")).collect()
    start = time.time()
    df.select(*[F.size(extract_all(F.col("text"), [rx])).alias(f"n{i}") for i, rx in enumerate(chosen)]).collect()
    assert time.time() - start < 5


def test_redaction_keeps_skipped_text(spark):
    texts = ["12 ab é 7 Elm St, and Acme Inc", "nothing 12"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    chosen = [BY_NAME["company_name"], patterns.Pattern("street", (contacts.ADDRESSES["US"][1],))]
    got = [r[0] for r in df.select(patterns.redact("text", chosen, "[x]")).collect()]
    assert got == ["12 ab é [x], and [x]", "nothing 12"]

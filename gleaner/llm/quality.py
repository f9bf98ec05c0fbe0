"""Quality rules as a ledger of bits, in DataFrame functions only.

Every rule is evaluated once per text: the ledger holds the measurements and a bit per failed rule. A policy is a versioned
mask of rules; applying one, or asking what each of its rules does on its own, needs the bits alone and no text.

Results for odd input: null, empty and blank texts have no words, lines or symbols, so they fail only the rules on
length; ratios of texts without words count as 0; repeated rows are measured each; an empty table gives an empty ledger; texts of any
length are measured whole; other columns are kept, whatever their names, and columns named like the outputs are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import set_apart, set_back, split_words

SYMBOLS, BLANK_CHARS = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: Words from which positions do not fit into the 20 bits below a hash.
LONGS = 1 << 20
#: Columns that exist only while a text is measured.
INNER = ("_text", "_words", "_lines", "_runs", "_clash", "_whole", "_at")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A text fails where ``test``, an SQL condition on the measurements, holds."""

    name: str
    test: str


#: Bit i of a ledger belongs to rule i; new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "4 * n_symbols > n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version of what is asked of a text: the rules that have to hold."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [r.name for r in RULES]
        return sum(1 << names.index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
STRICT = Policy("2", tuple(r.name for r in RULES))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measurements of ``text``.

    Words of repeated runs: in texts of under a million words, every run of three becomes one long, 44 bits of its hash above its
    position. Sorted as longs, equal runs are neighbours; the words of neighbours with equal hash bits are compared. Where two
    neighbours have equal bits and other words, and in longer texts, the words themselves are sorted along with the hash, so
    that chance collisions neither add nor hide a run.
    """
    df, old, (text,) = set_apart(df, INNER, text)
    own = F.coalesce(F.col(text), F.lit(""))
    rows = df.withColumn("_text", own).withColumn("_words", split_words(F.col("_text")))
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate("_text", BLANK_CHARS, "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
        "_lines": F.filter(F.split("_text", "\n"), lambda line: F.length(F.translate(line, BLANK_CHARS, "")) > 0),
    })
    rows = rows.withColumns({
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_runs": F.expr(f"""CASE WHEN n_words < 3 OR n_words >= {LONGS} THEN CAST(array() AS array<bigint>) ELSE sort_array(transform(
            sequence(0, size(_words) - 3),
            i -> shiftleft(shiftright(xxhash64(slice(_words, i + 1, 3)), 20), 20) | CAST(i AS bigint))) END"""),
    })
    place = "CAST({r} & 1048575 AS int)"
    bits = "shiftright({r}, 20) = shiftright(r, 20)"
    words = f"slice(_words, {place} + 1, 3) = slice(_words, {place.format(r='r')} + 1, 3)"
    same = f"({bits} AND {words})"
    before, after = "get(_runs, i - 1)", "get(_runs, i + 1)"
    rows = rows.withColumn("_clash", F.expr(f"""n_words >= {LONGS} OR exists(
        filter(_runs, (r, i) -> i > 0 AND {bits.format(r=before)} AND NOT {words.format(r=before)}), r -> true)"""))
    rows = rows.withColumn("_whole", F.expr("""CASE WHEN _clash THEN sort_array(transform(sequence(0, size(_words) - 3),
        i -> struct(xxhash64(slice(_words, i + 1, 3)) AS hash, slice(_words, i + 1, 3) AS run, i AS at))) END"""))
    rows = rows.withColumn("_at", F.expr(f"""CASE WHEN _clash THEN sort_array(transform(
        filter(_whole, (r, i) -> (i > 0 AND get(_whole, i - 1).run = r.run) OR (i + 1 < size(_whole) AND get(_whole, i + 1).run = r.run)),
        r -> r.at)) ELSE sort_array(transform(
        filter(_runs, (r, i) -> (i > 0 AND {same.format(r=before)}) OR (i + 1 < size(_runs) AND {same.format(r=after)})),
        r -> {place.format(r="r")})) END"""))
    rows = rows.withColumn("n_repeat_words", F.expr("""
        aggregate(transform(_at, (p, i) -> least(3, coalesce(get(_at, i + 1) - p, 3))), 0L, (n, x) -> n + x)"""))
    return set_back(rows.drop(*INNER), old)


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measurements and ``failed_bits``: bit i is set if rule i fails."""
    bits = [F.when(F.expr(rule.test), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(RULES)]
    return measured(df, text).withColumn("failed_bits", sum(bits[1:], bits[0]))


def passes(policy: Policy) -> Column:
    """Whether a row of a ledger keeps to the policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: ``rule, n_failed, n_alone``, the texts failing it, and those that fail no other rule.

    Texts are first counted per pattern of bits; only the patterns are combined with the rules.
    """
    mask = F.lit(policy.mask).cast("long")
    patterns = rows.groupBy(F.col("failed_bits").bitwiseAND(mask).alias("bits")).count()
    names = [r.name for r in RULES]
    bit = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules]))
    each = patterns.select("bits", "count", bit.alias("r")).select("bits", "count", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("count")).otherwise(0)).alias("n_alone"),
    )

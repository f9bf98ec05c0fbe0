"""Files as frames: CSV with detected dialect, landed pages, arbitrary files, lists of inputs."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleaner.functions.text import _col

# Delimiters in the order that breaks ties, and how much of a file is looked at.
DELIMITERS = [",", ";", "\t", "|"]
SAMPLE = 1024


def sniff_delimiter(sample: Column | str) -> Column:
    """The most frequent delimiter of a text sample; the earlier one on a tie; a comma if there is none."""
    text = _col(sample)
    counts = [F.length(text) - F.length(F.replace(text, F.lit(d), F.lit(""))) for d in DELIMITERS]
    top = F.greatest(*counts)
    chosen = F.when(F.coalesce(top, F.lit(0)) == 0, F.lit(","))
    for delimiter, count in zip(DELIMITERS, counts):
        chosen = chosen.when(count == top, F.lit(delimiter))
    return chosen


def sniff_encoding(content: Column | str) -> Column:
    """``utf-8`` if the head of the file decodes as such, else ``latin1``, which decodes anything.

    A character cut at the end of the sample is no error: up to three bytes may be left off.
    """
    head = F.substring(_col(content), 1, SAMPLE)
    fits = F.call_function("is_valid_utf8", head.cast("string"))
    for cut in (1, 2, 3):
        shorter = F.substring(head, F.lit(1), F.greatest(F.length(head) - cut, F.lit(0)))
        fits = fits | ((F.length(head) == SAMPLE) & F.call_function("is_valid_utf8", shorter.cast("string")))
    return F.when(fits, "utf-8").otherwise("latin1")


def _heads(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path, head, first``: the first bytes of each file and its first line. Only first splits are read, no file is held whole."""
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", False).text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("line"))

    def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, out = None, 0, {}
        for batch in batches:
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now, size = name, size if name == now else 0
                if size < SAMPLE:
                    out[name] = out.get(name, b"") + line[:SAMPLE] + b"\n"
                    size += len(line) + 1
        yield pa.RecordBatch.from_pydict({"path": list(out), "head": list(out.values())}, pa.schema([("path", pa.string()), ("head", pa.binary())]))

    found = rows.where("at = 0").select("path", "line").mapInArrow(first_lines, "path string, head binary")
    return found.groupBy("path").agg(F.max("head").alias("head"))


def csv_dialects(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """``path, encoding, delimiter, header`` of each file, from its head alone."""
    head = _heads(spark, path, pattern).withColumn("encoding", sniff_encoding("head"))
    text = F.when(F.col("encoding") == "utf-8", F.col("head").cast("string")).otherwise(F.decode("head", "ISO-8859-1"))
    named = head.withColumn("text", F.regexp_replace(text, "^\ufeff", ""))
    return named.select("path", "encoding", sniff_delimiter(F.substring("text", 1, SAMPLE)).alias("delimiter"), F.element_at(F.split("text", "\r?\n"), 1).alias("header"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None, delimiter: str | None = None, encoding: str | None = None,
             pattern: str = "*", multi_line: bool = True) -> DataFrame:
    """CSV files with headers, each in its own dialect.

    Files are grouped by dialect and header and read group by group. Lines with more fields than the header has are skipped, unless all
    surplus fields are empty; shorter ones are filled up with nulls. With a schema, a cell that its type cannot hold is null and the row stays;
    columns are matched by name if the header has all names, else by place. Without one, a column becomes a number only if all its cells
    are. Set ``multi_line`` to False for files without line ends inside quotes: they are then split.
    """
    groups = (
        csv_dialects(spark, path, pattern)
        .select("path", F.lit(encoding).alias("e") if encoding else F.col("encoding").alias("e"), F.lit(delimiter).alias("d") if delimiter else F.col("delimiter").alias("d"), "header")
        .groupBy("e", "d", "header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header", "d", "e").collect()
    )
    wanted = StructType.fromDDL(schema) if schema else None
    frames = []
    for g in groups:
        names = next(csv.reader([g["header"]], delimiter=g["d"]), [])
        frames.append(_read_group(spark, g["paths"], names, g["d"], g["e"], multi_line, wanted))
    if not frames:
        return spark.createDataFrame([], wanted or StructType([]))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows if wanted else _inferred(rows)


def _read_group(spark: SparkSession, paths: list[str], names: list[str], delimiter: str, encoding: str, multi_line: bool, wanted: StructType | None) -> DataFrame:
    """All cells as text, without the lines that have surplus fields; then in the wanted types.

    The reader hands over the line itself if it has more or fewer fields than the header; only those lines are looked at again.
    """
    cells = [f"_c{i}" for i in range(len(names))]
    fields = ", ".join(f"{c} string" for c in [*cells, "_line"])
    reader = spark.read.schema(fields).option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"')
    reader = reader.option("multiLine", multi_line).option("encoding", "ISO-8859-1" if encoding == "latin1" else encoding)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").option("enforceSchema", True)
    rows = reader.csv(paths).where(F.col("_line").isNull() | ~_has_surplus(F.col("_line"), delimiter, len(cells)))
    if wanted is None:
        return rows.select(*[F.col(c).alias(n) for c, n in zip(cells, names)])
    by_name = set(wanted.names) <= set(names)
    source = {f.name: names.index(f.name) if by_name else i for i, f in enumerate(wanted.fields)}
    return rows.select(*[
        (F.col(cells[source[f.name]]) if source[f.name] < len(cells) else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in wanted.fields
    ])


def _has_surplus(line: Column, delimiter: str, width: int) -> Column:
    """Whether a cell after the first ``width`` holds anything. Quoted cells are shortened first, as they may hold the delimiter."""
    plain = F.regexp_replace(F.regexp_replace(line, '"(?:[^"]|"")++"', "x"), "[\r\n]+$", "")
    shortened = F.split(plain, f"\\Q{delimiter}\\E", -1)
    return F.exists(F.slice(shortened, width + 1, 1 << 20), lambda cell: ~cell.isin("", '""'))


def _inferred(rows: DataFrame) -> DataFrame:
    """Columns whose cells are all whole numbers as bigint, all numbers as double; one pass over the rows."""
    fits = [
        F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(kind).isNull()).alias(f"{kind}_{i}")
        for i, c in enumerate(rows.columns) for kind in ("bigint", "double")
    ]
    seen = [F.count(F.col(f"`{c}`")).alias(f"seen_{i}") for i, c in enumerate(rows.columns)]
    found = rows.agg(*fits, *seen).first()

    def kind(i: int) -> str:
        return "string" if not found[f"seen_{i}"] else next((k for k in ("bigint", "double") if not found[f"{k}_{i}"]), "string")

    return rows.select(*[F.col(f"`{c}`").cast(kind(i)).alias(c) for i, c in enumerate(rows.columns)])


def read_pages(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """Landed pages: ``url`` (the file) and ``html``."""
    pages = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return pages.select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def map_files(spark: SparkSession, path: str, pattern: str, function: Callable[[str, bytes], str]) -> DataFrame:
    """A function over each file: ``path, result, error``. Files are spread by Spark, failures are captured."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    rows.append((name, function(name, content), None))
                except Exception as exc:  # the failure is the result
                    rows.append((name, None, str(exc)))
            yield pd.DataFrame(rows, columns=["path", "result", "error"])

    return files.mapInPandas(run, "path string, result string, error string")


def route_inputs(lines: DataFrame, line: str, order: str, per_row: bool = False) -> DataFrame:
    """Inputs from a list: ``source, kind`` with kind ``url`` or ``pdf``; blank lines dropped.

    The first input decides for the whole list; ``per_row`` lets each decide for itself.
    """
    sources = lines.select(order, F.trim(line).alias("source")).filter(F.col("source") != "")
    kind = lambda c: F.when(c.rlike(r"\Ahttps?://"), "url").otherwise("pdf")
    if per_row:
        return sources.select("source", kind(F.col("source")).alias("kind"))
    first = sources.agg(F.min_by("source", order)).scalar()
    return sources.select("source", kind(first).alias("kind"))


def assemble_pages(pages: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """Documents from their pages: ``key, page_count, char_count, text``, pages in order and a blank line apart."""
    grouped = pages.groupBy(key).agg(
        F.count("*").alias("page_count"),
        F.sum(F.length(text)).cast("long").alias("char_count"),
        F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.col(text).alias("t")))).alias("p"),
    )
    return grouped.select(
        key, "page_count", "char_count",
        F.array_join(F.transform("p", lambda p: F.coalesce(p["t"], F.lit(""))), "\n\n").alias("text"),
    )

"""Sinks: JSON, CSV, tables, quarantine and the folder layout of a run."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.quality import invalid_rows
from gleaner.sources.tables import query


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which CSV can hold."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields
    ])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """CSV with a header. Nothing is written for an empty frame."""
    if df.isEmpty():
        return False
    _flat(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return True


_TABLE_MODES = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}


def write_table(df: DataFrame, name: str, if_exists: str = "append") -> int:
    """Rows into a table; returns how many, counted while they are written."""
    seen = Observation(f"gleaner_{name}")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(_TABLE_MODES[if_exists]).saveAsTable(name)
    return seen.get["rows"]


def export_query(spark: SparkSession, sql: str, path: str, params: Mapping[str, Any] | None = None) -> bool:
    return write_csv(query(spark, sql, params), path)


def save_results(df: DataFrame, path: str, fmt: str = "json") -> None:
    if fmt not in ("json", "csv"):
        raise ValueError(f"unsupported format: {fmt}")
    (write_json if fmt == "json" else write_csv)(df, path)


def write_quarantine(checked: DataFrame, path: str) -> None:
    """Rejected rows with their errors."""
    write_json(invalid_rows(checked), path)


def distinct_emails(*sources: DataFrame) -> DataFrame:
    """Addresses of all sources, each spelling once, sorted."""
    merged = sources[0].select("email")
    for other in sources[1:]:
        merged = merged.unionAll(other.select("email"))
    return merged.distinct().orderBy("email")


def write_distinct_emails(path: str, *sources: DataFrame) -> None:
    """One address per line. The sort is by range, so the part files follow each other."""
    distinct_emails(*sources).write.mode("overwrite").text(path)


def run_folders(root: str, stamp: str) -> dict[str, str]:
    """Folders of one run: fetched pages and results."""
    base = f"{root}/scraper_project_{stamp}"
    return {"base": base, "raw": f"{base}/raw", "output": f"{base}/output"}

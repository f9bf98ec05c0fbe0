"""Tables and SQL: queries with parameters, catalogues, schemas, scripts."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import small_frame

# Column types in generated tables.
_SQL_TYPES = {
    "INTEGER": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "REAL": (T.FloatType, T.DoubleType, T.DecimalType),
    "TIMESTAMP": (T.TimestampType, T.TimestampNTZType, T.DateType),
    "BOOLEAN": (T.BooleanType,),
}


def register(spark: SparkSession, folder: str, *names: str) -> None:
    """Parquet tables of a folder as views."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def query(spark: SparkSession, sql: str, params: Mapping[str, Any] | None = None) -> DataFrame:
    """A query with named parameters (``:name``)."""
    return spark.sql(sql, args=dict(params or {}))


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, partitions: int = 32, **options: str) -> DataFrame:
    """A remote table; with a partition column it is read in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column is not None:
        reader = (
            reader.option("partitionColumn", partition_column).option("lowerBound", lower)
            .option("upperBound", upper).option("numPartitions", partitions)
        )
    return reader.load()


def list_tables(spark: SparkSession) -> DataFrame:
    """``name`` of every table and view but internal ones."""
    names = [(t.name,) for t in spark.catalog.listTables() if not t.name.startswith("sqlite_")]
    return small_frame(spark, names, "name string").orderBy("name")


def sql_type(dtype: T.DataType) -> str:
    return next((name for name, kinds in _SQL_TYPES.items() if isinstance(dtype, kinds)), "TEXT")


def table_schema(df: DataFrame, primary_key: str | None = None) -> DataFrame:
    """``position, name, type, nullable, pk`` of each column."""
    rows = [(i, f.name, sql_type(f.dataType), f.nullable, f.name == primary_key) for i, f in enumerate(df.schema.fields)]
    return small_frame(df.sparkSession, rows, "position int, name string, type string, nullable boolean, pk boolean")


def read_table(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    """A table and its structure."""
    df = spark.table(name)
    return df, table_schema(df)


def create_table_like(df: DataFrame, name: str, primary_key: str | None = None) -> str:
    """An empty table with the frame's columns in the fixed types; returns the DDL that describes it."""
    spark_types = {"INTEGER": "bigint", "REAL": "double", "TIMESTAMP": "timestamp", "BOOLEAN": "boolean", "TEXT": "string"}
    kinds = [(f.name, sql_type(f.dataType)) for f in df.schema.fields]
    empty = df.limit(0).select(*[F.col(n).cast(spark_types[k]).alias(n) for n, k in kinds])
    empty.write.mode("ignore").saveAsTable(name)
    columns = ", ".join(f"{n} {k}" + (" PRIMARY KEY" if n == primary_key else "") for n, k in kinds)
    return f"CREATE TABLE IF NOT EXISTS {name} ({columns})"


def key_is_unique(df: DataFrame, key: str) -> DataFrame:
    """One row ``rows, distinct_keys, is_unique``; copies of a key meet after being counted."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_keys")).withColumn(
        "is_unique", F.col("rows") == F.col("distinct_keys"))


def run_script(spark: SparkSession, script: str) -> DataFrame | None:
    """Statements separated by ``;``, blank ones skipped; the first error stops. Gives the last result."""
    result = None
    for statement in re.split(r";", script):
        if statement.strip():
            result = spark.sql(statement)
    return result

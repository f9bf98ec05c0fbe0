"""What the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that separates words: blank and the control characters 9 to 13.
BLANKS = r"[\x20\x09-\x0D]+"
#: Rows up to which a side whose size was counted is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z only."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, separators: str = BLANKS) -> Column:
    """The words between ``separators``; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def bounded_batches(spark: SparkSession, rows: int = 128) -> None:
    """Keeps Arrow batches small, as a text may have some hundred kB or more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def set_apart(df: DataFrame, inner: tuple[str, ...], *args: str) -> tuple[DataFrame, dict[str, str], list[str]]:
    """``df`` with its columns named like one of ``inner`` renamed, old names by new ones, and ``args`` by their new names.

    What an operator calls its own columns thus never meets a column of the caller; without a clash ``df`` stays as it is.
    """
    own, taken = {c.lower() for c in inner}, {c.lower() for c in df.columns}
    prefix = "_apart"
    while any(c.startswith(prefix) for c in taken | own):
        prefix += "_"
    new = {c: f"{prefix}{i}" for i, c in enumerate(df.columns) if c.lower() in own}
    if not new:
        return df, {}, list(args)
    moved = df.select(*[F.col(f"`{c}`").alias(new.get(c, c)) for c in df.columns])
    return moved, {n: c for c, n in new.items()}, [new.get(a, a) for a in args]


def set_back(df: DataFrame, old: dict[str, str]) -> DataFrame:
    """``df`` with the names that ``set_apart`` has changed."""
    return df.select(*[F.col(f"`{c}`").alias(old.get(c, c)) for c in df.columns]) if old else df


def text_key(key: str, text: str) -> list[Column]:
    """Two columns that tell rows apart up to full repetitions; results of equal rows are equal."""
    return [F.col(key).alias("_key"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_digest")]


def same_row(left: DataFrame, right: DataFrame):
    return left["_key"].eqNullSafe(right["_key"]) & (left["_digest"] == right["_digest"])


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below the folder that all executors share (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends there."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcasts a side of ``rows`` counted rows if that is little enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df

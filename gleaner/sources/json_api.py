"""Nested JSON of API responses: paths, wildcards, flattening, projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import _col


def json_items(json: Column | str, path: str, element: str) -> Column:
    """The array or single object at a dotted path, as an array of ``element`` (a DDL type)."""
    found = F.get_json_object(_col(json), "$." + path)
    listed = F.when(found.startswith("["), found).when(found.isNotNull(), F.concat(F.lit("["), found, F.lit("]")))
    return F.from_json(listed, f"array<{element}>")


def json_path(json: Column | str, path: str) -> Column:
    """Values at a path such as ``items[*].name`` as an array of strings; one value gives one element."""
    found = F.get_json_object(_col(json), "$." + path)
    many = F.from_json(found, "array<string>")
    return F.when(found.startswith("["), many).when(found.isNotNull(), F.array(found))


def explode_items(df: DataFrame, json: str, path: str, element: str, carry: Sequence[str] = ()) -> DataFrame:
    """One row per item with the item's fields as columns."""
    return df.select(*carry, F.inline(json_items(json, path, element)))


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested structs as columns with joined names; arrays and maps as JSON text."""

    def walk(kind: T.StructType, at: str, name: str) -> list[Column]:
        out: list[Column] = []
        for f in kind.fields:
            path = f"{at}.`{f.name}`" if at else f"`{f.name}`"
            full = f"{name}{separator}{f.name}" if name else f.name
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, path, full)
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                out.append(F.to_json(F.col(path)).alias(full))
            else:
                out.append(F.col(path).alias(full))
        return out

    return df.select(*walk(df.schema, "", ""))


def project(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The listed fields that exist; a nested field ``a.b`` becomes ``a_b``."""

    def exists(path: str) -> bool:
        kind: T.DataType = df.schema
        for part in path.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
                return False
            kind = kind[part].dataType
        return True

    return df.select(*[F.col(f).alias(f.replace(".", "_")) for f in fields if exists(f)])

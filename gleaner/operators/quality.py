"""Schema and quality rules. All failures of a row go into one array column, so data is read once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERRORS = "validation_errors"
_NO_ERRORS = "array<struct<field:string,message:string>>"


@dataclass(frozen=True)
class Rule:
    """A named test of one field. Fields a frame does not have are not tested."""

    field: str
    test: Callable[[Column], Column]
    message: str


@dataclass(frozen=True)
class Schema:
    """Required fields and field types (``bigint``, ``double``, ``string``, ``boolean``)."""

    required: Sequence[str] = ()
    types: Mapping[str, str] | None = None


def _error(field: str, message: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))


def _collect(errors: Sequence[Column]) -> Column:
    if not errors:
        return F.array().cast(_NO_ERRORS)
    return F.filter(F.array(*errors), lambda e: e.isNotNull())


def rule_errors(df: DataFrame, rules: Sequence[Rule]) -> Column:
    """Failed rules of a row; a test that gives NULL has failed."""
    return _collect([
        F.when(~F.coalesce(r.test(F.col(r.field)), F.lit(False)), _error(r.field, r.message))
        for r in rules if r.field in df.columns
    ])


#: Which column types count as an instance of a declared type: truth values are whole numbers, whole
#: numbers are not fractions.
_INSTANCES = {
    "bigint": {"tinyint", "smallint", "int", "bigint", "boolean"},
    "double": {"float", "double"},
    "string": {"string"},
    "boolean": {"boolean"},
}


def schema_errors(df: DataFrame, schema: Schema) -> Column:
    """Schema failures of rows in a typed frame: absent fields, wrong types, NULL where a type is declared."""
    kinds = dict(df.dtypes)
    errors = [_error(f, "required field is missing") for f in schema.required if f not in kinds]
    for name, wanted in (schema.types or {}).items():
        if name not in kinds:
            continue
        message = _error(name, f"expected {wanted}")
        errors.append(F.when(F.col(name).isNull(), message) if kinds[name] in _INSTANCES[wanted] else message)
    return _collect(errors)


_JSON_SHAPES = {
    "bigint": r"\A(?:-?\d+|true|false)\z",
    "double": r"\A-?\d+(?:\.\d+(?:[eE][-+]?\d+)?|[eE][-+]?\d+)\z",
    "string": r'\A"',
    "boolean": r"\A(?:true|false)\z",
}


def json_schema_errors(record: Column | str, schema: Schema) -> Column:
    """The same for schemaless rows: a ``map<string,string>`` of field names to JSON literals."""
    fields = F.col(record) if isinstance(record, str) else record
    errors = [
        F.when(~F.map_contains_key(fields, name), _error(name, "required field is missing")) for name in schema.required
    ]
    for name, wanted in (schema.types or {}).items():
        value = F.try_element_at(fields, F.lit(name))
        fits = F.coalesce(value.rlike(_JSON_SHAPES[wanted]), F.lit(False))
        errors.append(F.when(F.map_contains_key(fields, name) & ~fits, _error(name, f"expected {wanted}")))
    return _collect(errors)


def json_fields(json: Column | str) -> Column:
    """A JSON object as ``map<field, JSON literal>``; the literal keeps its type."""
    text = F.col(json) if isinstance(json, str) else json
    typed = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    return F.transform_values(typed, lambda _k, v: F.coalesce(F.to_json(v), F.lit("null")))


def check(df: DataFrame, rules: Sequence[Rule] = (), schema: Schema | None = None) -> DataFrame:
    """Adds the error array. Rules are tested on rows the schema accepts, as chained validators do."""
    by_rules = rule_errors(df, rules)
    if schema is None:
        return df.withColumn(ERRORS, by_rules)
    by_schema = schema_errors(df, schema)
    return df.withColumn(ERRORS, F.when(F.size(by_schema) > 0, by_schema).otherwise(by_rules))


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size(ERRORS) == 0).drop(ERRORS)


def invalid_rows(checked: DataFrame) -> DataFrame:
    """Rejected rows with their errors."""
    return checked.filter(F.size(ERRORS) > 0)


def capture_errors(df: DataFrame, column: str, function: Callable, result_type: str) -> DataFrame:
    """A Python function per item with its failures captured: adds ``result`` and ``error``.

    One bad item fails neither its batch nor its task.
    """
    @F.pandas_udf(f"result {result_type}, error string")
    def guarded(items: pd.Series) -> pd.DataFrame:
        def one(item):
            try:
                return function(item), None
            except Exception as exc:  # the failure is the result
                return None, str(exc)

        return pd.DataFrame([one(i) for i in items], columns=["result", "error"])

    return df.withColumn("_r", guarded(F.col(column))).select(*df.columns, "_r.result", "_r.error")

"""Row-local transforms. Each is a projection or a filter, so Catalyst folds a chain of them into one stage."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..columns import col
from ..errors import SpecError
from ..functions.casts import cast_column
from ..functions.expr import compile_expression, compile_predicate


def noop(df: DataFrame) -> DataFrame:
    """The input, unchanged."""
    return df


def drop_fields(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Without the named fields; names that are not there are ignored."""
    gone = set(fields)
    return df.select(*[col(c) for c in df.columns if c not in gone])


def rename_fields(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename pair after pair, each seeing the result of the one before.

    A pair whose old name is missing is skipped; a new name that already exists is overwritten in its place,
    otherwise the renamed field moves to the end.
    """
    layout = {name: col(name) for name in df.columns}
    for old, new in mapping.items():
        source = layout.pop(old, None)
        if source is not None:
            layout[new] = source
    return df.select(*[source.alias(name) for name, source in layout.items()])


def filter_rows(df: DataFrame, predicate: str | Column, dialect: str = "python") -> DataFrame:
    """Rows for which the predicate is true; NULL does not pass.

    A Column is used as it is; text is read as a Python-notation expression or, with ``dialect="sql"``, as Spark SQL.
    """
    if isinstance(predicate, Column):
        return df.where(predicate)
    if dialect == "sql":
        return df.where(F.expr(predicate))
    if dialect != "python":
        raise SpecError(f"dialect must be python or sql, not {dialect!r}")
    return df.where(compile_predicate(predicate, df.schema))


def constant(value: Any) -> Column:
    """A JSON-like Python value as a literal column."""
    if isinstance(value, (dict, list)):
        text = F.lit(json.dumps(value))
        return F.from_json(text, F.schema_of_json(text))
    if value is None:
        return F.lit(None).cast("string")
    if isinstance(value, int) and not isinstance(value, bool):
        return F.lit(value).cast("bigint")
    return F.lit(value)


def add_constant(df: DataFrame, field: str, value: Any) -> DataFrame:
    """The same value in ``field`` on every row, replacing a field of that name."""
    return df.withColumn(field, constant(value))


def compute_expression(df: DataFrame, field: str, expression: str, dialect: str = "python") -> DataFrame:
    """``field`` computed from the other fields.

    On rows where a Python-notation expression fails, an existing ``field`` keeps its value (as far as it fits the
    new type) and a new one is NULL. SQL expressions are assigned as they are.
    """
    if dialect == "sql":
        return df.withColumn(field, F.expr(expression))
    if dialect != "python":
        raise SpecError(f"dialect must be python or sql, not {dialect!r}")
    value, data_type = compile_expression(expression, df.schema)
    if field in df.columns:
        old_type = df.schema[field].dataType
        if isinstance(data_type, T.NullType):
            return df
        if isinstance(old_type, (T.StringType, T.NumericType, T.BooleanType)) or old_type == data_type:
            old = col(field)
            value = F.coalesce(value, old if old_type == data_type else old.try_cast(data_type))
    elif isinstance(data_type, T.NullType):
        value = F.lit(None).cast("string")
    return df.withColumn(field, value)


def type_cast(df: DataFrame, casts: Mapping[str, str], on_error: str = "null") -> DataFrame:
    """Fields cast to int, float, bool or str in one projection.

    Unknown fields and unknown type names are ignored. See :func:`millrace.functions.cast_column` for ``on_error``.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    known = {
        name: cast_column(col(name), types[name], to, on_error)
        for name, to in casts.items()
        if name in types and to in ("int", "float", "bool", "str")
    }
    return df.withColumns(known) if known else df

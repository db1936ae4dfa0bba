"""Singer message logs as a target."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..columns import col
from ..session import local_frame
from ..types import BINARY, BOOLEAN, DATE, DATETIME, FLOAT, INTEGER, JSON, logical_type
from .files import _TEXT_WRITE

_SINGER_TYPE = {INTEGER: "integer", FLOAT: "number", BOOLEAN: "boolean", JSON: "object", BINARY: "string"}


def schema_message(schema: T.StructType, stream: str, key_properties: Sequence[str] = ()) -> str:
    """SCHEMA message describing a DataFrame."""
    properties = {}
    for field in schema.fields:
        logical = logical_type(field.dataType)
        name = "array" if isinstance(field.dataType, T.ArrayType) else _SINGER_TYPE.get(logical, "string")
        properties[field.name] = {"type": ["null", name] if field.nullable else name}
        if logical in (DATE, DATETIME):
            properties[field.name]["format"] = "date" if logical == DATE else "date-time"
    body = {"type": "object", "properties": properties}
    return json.dumps({"type": "SCHEMA", "stream": stream, "schema": body, "key_properties": list(key_properties)})


def write_singer(
    df: DataFrame,
    path: str,
    stream: str,
    key_properties: Sequence[str] = (),
    state: Mapping[str, object] | None = None,
    mode: str = "overwrite",
) -> None:
    """A log below ``path``: the schema, the records (many files), then the state.

    Folder names sort in that order, so a reader taking files by name meets the SCHEMA first and the STATE last.
    """
    spark = df.sparkSession
    base = path.rstrip("/")

    def one_line(name: str, text: str) -> None:
        local_frame(spark, [(text,)], "value string").coalesce(1).write.mode(mode).text(f"{base}/{name}")

    one_line("0-schema", schema_message(df.schema, stream, key_properties))
    message = F.struct(
        F.lit("RECORD").alias("type"), F.lit(stream).alias("stream"), F.struct(*[col(c) for c in df.columns]).alias("record")
    )
    text = F.to_json(message, {**_TEXT_WRITE, "ignoreNullFields": "false"})
    df.select(text.alias("value")).write.mode(mode).text(f"{base}/1-records")
    one_line("2-state", json.dumps({"type": "STATE", "value": dict(state or {})}))

"""Singer message logs: text files with one SCHEMA, RECORD or STATE message per line."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..errors import SpecError
from ..types import JSON, source_logical_type, spark_type
from .files import TEXT_OPTIONS

_JSON_OPTIONS = {k: str(v) for k, v in TEXT_OPTIONS.items()}


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", glob).text(path)


def _property_type(details: dict) -> tuple[T.DataType, str, bool]:
    """(Spark type, logical type, nullable) of one property of a JSON schema."""
    declared = details.get("type", "string")
    names = [declared] if isinstance(declared, str) else list(declared)
    primary = next((n for n in names if n != "null"), "string")
    if primary == "string" and details.get("format") == "date-time":
        primary = "datetime"
    logical = source_logical_type(primary, "singer")
    return (T.StringType() if logical == JSON else spark_type(logical)), logical, "null" in names


def json_schema_fields(schema: dict) -> T.StructType:
    """Spark schema of a SCHEMA message; nested values stay JSON text."""
    fields = []
    for name, details in schema.get("properties", {}).items():
        data_type, logical, nullable = _property_type(details)
        fields.append(T.StructField(name, data_type, True, {"logical_type": logical, "declared_nullable": nullable}))
    return T.StructType(fields)


def _last(spark: SparkSession, path: str, glob: str, kind: str, field: str, stream: str | None = None) -> str | None:
    """``field`` of the last message of a kind: files in name order, lines in file order.

    Lines that cannot be of the kind are passed over before they are parsed.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    message = F.from_json("value", f"type string, stream string, {field} string")
    found = _lines(spark, path, glob).select("value", place.alias("place")).where(F.contains("value", F.lit(f'"{kind}"')))
    found = found.select(message.alias("m"), "place").where(F.col("m.type") == kind)
    if stream is not None:
        found = found.where(F.col("m.stream") == stream)
    return found.agg(F.max_by(f"m.{field}", "place")).first()[0]


def singer_schema(spark: SparkSession, path: str, stream: str, glob: str = "*") -> T.StructType:
    """Schema declared for ``stream`` by the last SCHEMA message about it. Looks through the log once."""
    declared = _last(spark, path, glob, "SCHEMA", "schema", stream)
    if declared is None:
        raise SpecError(f"the log declares no schema for stream {stream!r}; pass one")
    return json_schema_fields(json.loads(declared))


def read_singer(
    spark: SparkSession, path: str, stream: str, schema: T.StructType | str | None = None, glob: str = "*"
) -> DataFrame:
    """Records of one stream. Lines that are not JSON, and messages of other kinds or streams, are passed over.

    Pass a ``schema`` for large logs: otherwise the log is read once more to find the declared one.
    """
    fields = schema if schema is not None else singer_schema(spark, path, stream, glob)
    if isinstance(fields, str):
        fields = T.StructType.fromDDL(fields)
    envelope = T.StructType().add("type", "string").add("stream", "string").add("record", fields)
    message = F.from_json("value", envelope, _JSON_OPTIONS)
    return (
        _lines(spark, path, glob)
        .select(message.alias("m"))
        .where((F.col("m.type") == "RECORD") & (F.col("m.stream") == stream))
        .select("m.record.*")
    )


def read_singer_state(spark: SparkSession, path: str, glob: str = "*") -> str | None:
    """JSON text of the last STATE message."""
    return _last(spark, path, glob, "STATE", "value")

"""Schema discovery and the catalogue: one row per column of every table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .columns import col
from .errors import TableNotFoundError
from .session import local_frame
from .sources.envelope import record_count
from .types import STRING, logical_type, source_logical_type_column

CATALOG_COLUMNS = (
    "schema_name string, table_name string, column_name string, ordinal int, data_type string, nullable boolean, "
    "primary_key boolean, foreign_key string, default_value string, description string, version string, "
    "discovered_at timestamp"
)


def describe_column(
    field: T.StructField, primary_key: bool = False, foreign_key: str | None = None
) -> T.StructField:
    """``field`` with key facts in its metadata, where :func:`discover` finds them."""
    facts: dict[str, Any] = dict(field.metadata or {})
    if primary_key:
        facts["primary_key"] = True
    if foreign_key:
        facts["foreign_key"] = foreign_key
    return T.StructField(field.name, field.dataType, field.nullable, facts)


def _rows(schema: str, table: str, fields: T.StructType, keys: Mapping[str, Any], all_string: bool) -> list[tuple]:
    primary = set(keys.get("primary_key") or ())
    foreign = keys.get("foreign_keys") or {}
    rows = []
    for ordinal, f in enumerate(fields.fields, 1):
        facts = f.metadata or {}
        default = facts.get("default")
        rows.append(
            (
                schema,
                table,
                f.name,
                ordinal,
                STRING if all_string else facts.get("logical_type") or logical_type(f.dataType),
                facts.get("declared_nullable", f.nullable),
                f.name in primary or bool(facts.get("primary_key")),
                foreign.get(f.name) or facts.get("foreign_key"),
                None if default is None else str(default),
                facts.get("description"),
            )
        )
    return rows


def discover(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    schema: str = "main",
    keys: Mapping[str, Mapping[str, Any]] | None = None,
    all_string: bool = False,
    counts: bool = True,
    version: str | None = None,
) -> DataFrame:
    """Catalogue of named DataFrames, with the row count of each table unless ``counts`` is off.

    ``version`` names the schema version; ``discovered_at`` is the (UTC) time of the call.

    ``keys`` declares keys per table: ``{"primary_key": [...], "foreign_keys": {column: "table.column"}}``. Columns
    come from the schemas without reading data; all counts are taken in one job. ``all_string`` reports every column
    as a string, as sampling a CSV header does.
    """
    rows = []
    for name, df in tables.items():
        rows += _rows(schema, name, df.schema, (keys or {}).get(name, {}), all_string)
    moment = datetime.now(timezone.utc)
    columns = local_frame(spark, [(*row, version, moment) for row in rows], CATALOG_COLUMNS)
    if not counts:
        return columns.withColumn("row_count", F.lit(None).cast("bigint"))
    counted = record_count(tables).withColumnRenamed("stream", "table_name")
    return columns.join(counted, "table_name", "left").select("schema_name", "table_name", *columns.columns[2:], "row_count")


def from_listing(listing: DataFrame, dialect: str) -> DataFrame:
    """Catalogue rows from a database's own list of columns (see ``read_jdbc_catalog``)."""
    default = F.col("column_default") if "column_default" in listing.columns else F.lit(None)
    nothing = F.lit(None).cast("string")
    return listing.select(
        F.col("table_schema").alias("schema_name"),
        "table_name",
        "column_name",
        F.col("ordinal_position").cast("int").alias("ordinal"),
        source_logical_type_column(F.col("data_type"), dialect).alias("data_type"),
        F.upper("is_nullable").startswith("Y").alias("nullable"),
        F.lit(False).alias("primary_key"),
        nothing.alias("foreign_key"),
        default.cast("string").alias("default_value"),
        nothing.alias("description"),
        nothing.alias("version"),
        F.current_timestamp().alias("discovered_at"),
        F.lit(None).cast("bigint").alias("row_count"),
    )


def discover_documents(df: DataFrame, document: str) -> DataFrame:
    """(key, data_type, documents) of a column of JSON object texts: every key of every document, not one sample.

    Types differing between documents give one row each. A task keeps one count per key and type it has met.
    """
    value = F.variant_get(F.try_parse_json(col(document)), "$", "map<string, variant>")
    found = df.select(F.explode(value).alias("key", "value"))
    name = F.lower(F.split_part(F.schema_of_variant("value"), F.lit("<"), F.lit(1)))
    return (
        found.select("key", document_type(name).alias("data_type"))
        .groupBy("key", "data_type")
        .agg(F.count(F.lit(1)).alias("documents"))
    )


def document_type(variant_type: Column) -> Column:
    """Logical type of a JSON value from the name of its variant type."""
    base = F.trim(F.split_part(variant_type, F.lit("("), F.lit(1)))
    return (
        F.when(base == "bigint", "integer")
        .when(base.isin("double", "float", "decimal"), "float")
        .when(base == "boolean", "boolean")
        .when(base.isin("object", "array"), "json")
        .when(base == "void", "null")
        .otherwise("string")
    )


def list_tables(catalogue: DataFrame) -> DataFrame:
    """(table_name, schema_name, row_count, column_count) per table."""
    return catalogue.groupBy("table_name", "schema_name").agg(
        F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("column_count")
    )


def table_detail(catalogue: DataFrame, table: str) -> DataFrame:
    """Columns of one table in order."""
    detail = catalogue.where(col("table_name") == table)
    if detail.isEmpty():
        raise TableNotFoundError(f"table {table!r} is not in the catalogue")
    return detail.orderBy("ordinal")


def totals(catalogue: DataFrame) -> DataFrame:
    """(total_tables, total_columns, total_rows) of a catalogue."""
    return list_tables(catalogue).agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.coalesce(F.sum("column_count"), F.lit(0)).alias("total_columns"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
    )


def erd_nodes(catalogue: DataFrame) -> DataFrame:
    """(id, label, row_count, columns, primary_keys) per table; keys in column order."""
    keys = F.array_sort(F.collect_list(F.when(col("primary_key"), F.struct("ordinal", "column_name"))))
    nodes = catalogue.groupBy(col("table_name").alias("id")).agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("columns"),
        F.transform(keys, lambda k: k["column_name"]).alias("primary_keys"),
    )
    return nodes.select("id", F.col("id").alias("label"), "row_count", "columns", "primary_keys")


def erd_edges(catalogue: DataFrame) -> DataFrame:
    """One edge per foreign key written ``table.column``, split at the first dot; others are passed over."""
    target = F.regexp_extract("foreign_key", r"^([^.]*)\.(.*)$", 1)
    column = F.regexp_extract("foreign_key", r"^([^.]*)\.(.*)$", 2)
    edges = catalogue.where(F.instr("foreign_key", ".") > 0)
    return edges.select(
        F.concat_ws("-", F.concat_ws(".", "table_name", "column_name"), F.concat_ws(".", target, column)).alias("id"),
        F.col("table_name").alias("source"),
        target.alias("target"),
        F.col("column_name").alias("source_column"),
        column.alias("target_column"),
    )


def check_foreign_keys(tables: Mapping[str, DataFrame], edges: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """(source, source_column, target, target_column, rows, orphans) of (source, column, target, column) edges.

    Key values of both sides meet in one aggregate per edge and value, without a join: each task first reduces its
    rows to one count per value, so a value that fills much of a table is one row in the shuffle.
    """
    parts = []
    for source, source_column, target, target_column in edges:
        data_type = tables[source].schema[source_column].dataType
        edge = F.struct(
            F.lit(source).alias("source"),
            F.lit(source_column).alias("source_column"),
            F.lit(target).alias("target"),
            F.lit(target_column).alias("target_column"),
        ).alias("edge")
        for table, column, n in ((source, source_column, 1), (target, target_column, 0)):
            value = col(column).cast(data_type).cast("string").alias("value")
            parts.append(tables[table].select(edge, value, F.lit(n).alias("n"), F.lit(n == 0).alias("known")))
    per_value = reduce(DataFrame.unionAll, parts).where("value IS NOT NULL").groupBy("edge", "value")
    per_value = per_value.agg(F.sum("n").alias("n"), F.max("known").alias("known"))
    return per_value.groupBy("edge").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("known"), F.lit(0)).otherwise(F.col("n"))).alias("orphans")
    ).select("edge.*", "rows", "orphans")

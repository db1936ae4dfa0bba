import pytest
from conftest import rows
from pyspark.sql import types as T

from millrace.catalog import (
    check_foreign_keys,
    describe_column,
    discover,
    discover_documents,
    erd_edges,
    erd_nodes,
    from_listing,
    list_tables,
    table_detail,
    totals,
)
from millrace.errors import TableNotFoundError


@pytest.fixture(scope="module")
def tables(spark):
    schema = T.StructType([describe_column(T.StructField("id", T.LongType(), False), primary_key=True), T.StructField("tags", T.ArrayType(T.StringType()))])
    parents = spark.createDataFrame([(1, None), (2, ["x"])], schema)
    children = spark.createDataFrame([(1, 1), (2, 1), (3, 9), (4, None)], "id long, parent long")
    return {"parents": parents, "children": children}


KEYS = {"children": {"primary_key": ["id"], "foreign_keys": {"parent": "parents.id.extra", "id": "nodot"}}}


def test_discovery(spark, tables):
    catalogue = discover(spark, tables, keys=KEYS)
    got = rows(catalogue, "table_name", "column_name", "data_type", "nullable", "primary_key", "foreign_key", "row_count")
    assert ("parents", "id", "integer", False, True, None, 2) in got
    assert ("parents", "tags", "json", True, False, None, 2) in got
    assert ("children", "parent", "integer", True, False, "parents.id.extra", 4) in got
    assert rows(discover(spark, tables, version="v2").select("version").distinct()) == [("v2",)]
    assert catalogue.select("discovered_at").distinct().count() == 1
    assert {r["data_type"] for r in discover(spark, tables, all_string=True).collect()} == {"string"}


def test_listing_detail_and_totals(spark, tables):
    catalogue = discover(spark, tables, keys=KEYS)
    assert rows(list_tables(catalogue), "table_name", "row_count", "column_count") == [("children", 4, 2), ("parents", 2, 2)]
    assert [r["column_name"] for r in table_detail(catalogue, "children").collect()] == ["id", "parent"]
    assert rows(totals(catalogue)) == [(2, 4, 6)]
    assert rows(totals(catalogue.limit(0))) == [(0, 0, 0)]
    with pytest.raises(TableNotFoundError):
        table_detail(catalogue, "nobody")


def test_diagram(spark, tables):
    catalogue = discover(spark, tables, keys=KEYS)
    assert rows(erd_nodes(catalogue), "id", "columns", "primary_keys") == [("children", 2, ["id"]), ("parents", 2, ["id"])]
    assert [tuple(r) for r in erd_edges(catalogue).collect()] == [("children.parent-parents.id.extra", "children", "parents", "parent", "id.extra")]
    assert rows(check_foreign_keys(tables, [("children", "parent", "parents", "id")]), "rows", "orphans") == [(3, 1)]


def test_document_keys(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": 2.5, "c": [1], "d": null}',), ("broken",), (None,), ('{"a": {"k": 1}, "b": true}',)], "doc string")
    got = {(r["key"], r["data_type"]): r["documents"] for r in discover_documents(df, "doc").collect()}
    assert got == {("a", "integer"): 1, ("a", "float"): 1, ("a", "json"): 1, ("b", "string"): 1, ("b", "boolean"): 1, ("c", "json"): 1, ("d", "null"): 1}


def test_database_listing(spark):
    listing = spark.createDataFrame(
        [("public", "t", "id", 1, "bigint", "NO", None), ("public", "t", "j", 2, "jsonb", "YES", "'{}'")],
        "table_schema string, table_name string, column_name string, ordinal_position long, data_type string, is_nullable string, column_default string",
    )
    got = rows(from_listing(listing, "postgresql"), "column_name", "data_type", "nullable", "default_value")
    assert got == [("id", "integer", False, None), ("j", "json", True, "'{}'")]

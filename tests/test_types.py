import pytest
from conftest import rows
from pyspark.sql import functions as F, types as T

from millrace.errors import SpecError
from millrace.types import (
    GENERIC_RULES,
    LOGICAL_TYPES,
    SOURCE_TYPES,
    TARGET_TYPES,
    logical_type,
    source_logical_type,
    source_logical_type_column,
    spark_type,
    target_columns,
    target_type,
)

GENERIC = {
    "VARCHAR": "string", "varchar(255)": "string", "nvarchar(10)": "string", "TEXT": "string", "uuid": "string", "String": "string",
    "INT": "integer", "integer": "integer", "bigint": "integer", "TINYINT(1)": "integer", "uint": "integer", "point": "integer",
    "float": "float", "DOUBLE": "float", "real": "float", "decimal(10,2)": "float", "numeric": "float",
    "bool": "boolean", "BOOLEAN": "boolean", "date": "date", "timestamp": "datetime", "TIMESTAMP WITH TIME ZONE": "datetime",
    "datetime2": "datetime", "json": "json", "blob": "binary", "varbinary(8)": "binary", "bytea": "binary",
    "double precision": "string", "number(10,2)": "string", "jsonb": "string", "int8": "string", "": "string", "geometry": "string",
}
OTHERS = [
    ("postgresql", "double precision", "float"), ("postgresql", "jsonb", "json"), ("postgresql", "money", "float"),
    ("postgresql", "timestamp with time zone", "datetime"), ("postgresql", "inet", "string"),
    ("mysql", "mediumtext", "string"), ("mysql", "decimal(5,1)", "float"), ("mysql", "blob", "binary"),
    ("mssql", "bit", "boolean"), ("mssql", "datetimeoffset", "datetime"), ("mssql", "image", "binary"), ("mssql", "time", "string"),
    ("oracle", "NUMBER", "float"), ("oracle", "DATE", "datetime"), ("oracle", "RAW", "binary"),
    ("sqlite", "BOOLEAN", "boolean"), ("bigquery", "INT64", "integer"), ("bigquery", "BYTES", "binary"), ("bigquery", "NUMERIC", "string"),
    ("singer", "number", "float"), ("singer", "array", "json"), ("mongodb", "dict", "json"), ("mongodb", "ObjectId", "string"),
]


def test_generic_names():
    assert {n: source_logical_type(n) for n in GENERIC} == GENERIC
    assert GENERIC_RULES[0][0] == "string"


@pytest.mark.parametrize("dialect, name, want", OTHERS)
def test_dialect_names(dialect, name, want):
    assert source_logical_type(name, dialect) == want


@pytest.mark.parametrize("dialect", ["generic", *SOURCE_TYPES])
def test_column_form_agrees(spark, dialect):
    names = [*GENERIC, *(n for _, n, _ in OTHERS)]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = dict(rows(df.select("n", source_logical_type_column(F.col("n"), dialect).alias("t"))))
    assert got == {n: source_logical_type(n, dialect) for n in names}


def test_spark_types_round_trip():
    for logical in LOGICAL_TYPES:
        back = logical_type(spark_type(logical))
        assert back == ("string" if logical == "null" else logical)
    assert logical_type(T.DecimalType(10, 2)) == "float"
    assert logical_type(T.ArrayType(T.LongType())) == "json"
    assert logical_type(T.TimestampNTZType()) == "datetime"
    assert logical_type(T.NullType()) == "null"


def test_every_target_knows_every_type():
    for dialect, names in TARGET_TYPES.items():
        assert set(names) == set(LOGICAL_TYPES), dialect
    schema = T.StructType().add("a", T.LongType()).add("b", T.MapType(T.StringType(), T.StringType())).add("c", T.BooleanType())
    assert target_columns(schema, "oracle") == [("a", "NUMBER"), ("b", "CLOB"), ("c", "NUMBER(1)")]
    with pytest.raises(SpecError):
        target_type("money", "mysql")
    with pytest.raises(SpecError):
        target_type("string", "dbase")
    with pytest.raises(SpecError):
        source_logical_type("int", "dbase")

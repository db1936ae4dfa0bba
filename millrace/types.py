"""Logical types, how Spark and source types map onto them, and how they map onto target columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .errors import SpecError

# The nine logical types.
STRING = "string"
INTEGER = "integer"
FLOAT = "float"
BOOLEAN = "boolean"
DATE = "date"
DATETIME = "datetime"
JSON = "json"
BINARY = "binary"
NULL = "null"

LOGICAL_TYPES = (STRING, INTEGER, FLOAT, BOOLEAN, DATE, DATETIME, JSON, BINARY, NULL)

_SPARK_OF = {
    STRING: T.StringType(),
    INTEGER: T.LongType(),
    FLOAT: T.DoubleType(),
    BOOLEAN: T.BooleanType(),
    DATE: T.DateType(),
    DATETIME: T.TimestampType(),
    JSON: T.VariantType(),
    BINARY: T.BinaryType(),
    NULL: T.StringType(),
}

_LOGICAL_OF = [
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), INTEGER),
    ((T.FloatType, T.DoubleType, T.DecimalType), FLOAT),
    ((T.BooleanType,), BOOLEAN),
    ((T.DateType,), DATE),
    ((T.TimestampType, T.TimestampNTZType), DATETIME),
    ((T.StructType, T.ArrayType, T.MapType, T.VariantType), JSON),
    ((T.BinaryType,), BINARY),
    ((T.NullType,), NULL),
]


def spark_type(logical: str) -> T.DataType:
    """Spark type that holds a logical type."""
    if logical not in _SPARK_OF:
        raise SpecError(f"unknown logical type {logical!r}; one of {', '.join(LOGICAL_TYPES)}")
    return _SPARK_OF[logical]


def logical_type(data_type: T.DataType) -> str:
    """Logical type of a Spark type. Decimals report as float; nested values report as json."""
    for classes, logical in _LOGICAL_OF:
        if isinstance(data_type, classes):
            return logical
    return STRING


# Column types each source database reports, by logical type.
SOURCE_TYPES = {
    "postgresql": {
        INTEGER: ["integer", "bigint", "smallint"],
        FLOAT: ["numeric", "real", "double precision", "decimal", "money"],
        STRING: ["character varying", "varchar", "character", "char", "text", "uuid"],
        BOOLEAN: ["boolean"],
        DATE: ["date"],
        DATETIME: ["timestamp", "timestamp without time zone", "timestamp with time zone"],
        JSON: ["json", "jsonb"],
        BINARY: ["bytea"],
    },
    "mysql": {
        INTEGER: ["int", "tinyint", "smallint", "mediumint", "bigint"],
        FLOAT: ["float", "double", "decimal"],
        STRING: ["varchar", "char", "text", "tinytext", "mediumtext", "longtext"],
        JSON: ["json"],
        DATE: ["date"],
        DATETIME: ["datetime", "timestamp"],
        BINARY: ["blob"],
    },
    "mssql": {
        INTEGER: ["int", "bigint", "smallint", "tinyint"],
        BOOLEAN: ["bit"],
        FLOAT: ["decimal", "numeric", "money", "smallmoney", "float", "real"],
        DATE: ["date"],
        DATETIME: ["datetime", "smalldatetime", "datetime2", "datetimeoffset"],
        STRING: ["char", "varchar", "nvarchar", "nchar", "text", "ntext", "time"],
        BINARY: ["binary", "varbinary", "image"],
    },
    "oracle": {
        FLOAT: ["number", "float", "binary_float", "binary_double"],
        INTEGER: ["integer"],
        STRING: ["varchar2", "nvarchar2", "char", "nchar", "clob", "nclob", "long"],
        BINARY: ["blob", "raw"],
        DATETIME: ["date", "timestamp", "timestamp with time zone", "timestamp with local time zone"],
    },
    "sqlite": {
        INTEGER: ["integer", "int", "tinyint", "smallint", "mediumint", "bigint"],
        FLOAT: ["real", "double", "float", "numeric", "decimal"],
        STRING: ["text", "varchar", "char", "clob"],
        BINARY: ["blob"],
        BOOLEAN: ["boolean"],
        DATE: ["date"],
        DATETIME: ["datetime", "timestamp"],
    },
    "bigquery": {
        STRING: ["string"],
        INTEGER: ["int64", "integer"],
        FLOAT: ["float64", "float"],
        BOOLEAN: ["bool"],
        DATE: ["date"],
        DATETIME: ["datetime", "timestamp"],
        JSON: ["json"],
        BINARY: ["bytes"],
    },
    "singer": {
        STRING: ["string"],
        INTEGER: ["integer"],
        FLOAT: ["number"],
        BOOLEAN: ["boolean"],
        DATE: ["date"],
        DATETIME: ["datetime"],
        JSON: ["object", "array"],
    },
    "mongodb": {
        STRING: ["str"],
        INTEGER: ["int"],
        FLOAT: ["float"],
        BOOLEAN: ["bool"],
        DATETIME: ["datetime"],
        JSON: ["dict", "list"],
        BINARY: ["bytes"],
    },
}

# Name rules for SQL types of an unnamed database, tried from top to bottom on the
# lower-case name without its "(...)" part. Names no rule matches are strings.
GENERIC_RULES = [
    (STRING, "contains", ["char", "text", "string", "uuid"]),
    (INTEGER, "equals", ["int", "integer", "smallint", "tinyint", "mediumint"]),
    (INTEGER, "ends", ["int"]),
    (FLOAT, "equals", ["float", "double", "real", "decimal", "numeric"]),
    (BOOLEAN, "equals", ["bool", "boolean"]),
    (DATE, "equals", ["date"]),
    (DATETIME, "contains", ["timestamp", "datetime"]),
    (JSON, "equals", ["json"]),
    (BINARY, "contains", ["blob", "binary", "varbinary", "bytea"]),
]

_PY_TESTS = {
    "contains": lambda name, word: word in name,
    "equals": lambda name, word: name == word,
    "ends": lambda name, word: name.endswith(word),
}
_COLUMN_TESTS = {
    "contains": lambda name, word: name.contains(word),
    "equals": lambda name, word: name == word,
    "ends": lambda name, word: name.endswith(word),
}


def _by_name(dialect: str) -> dict[str, str]:
    if dialect not in SOURCE_TYPES:
        raise SpecError(f"unknown type dialect {dialect!r}")
    return {name: logical for logical, names in SOURCE_TYPES[dialect].items() for name in names}


def source_logical_type(type_name: str, dialect: str = "generic") -> str:
    """Logical type of a type name as the given source reports it."""
    lowered = type_name.lower()
    if dialect in ("bigquery", "singer", "mongodb"):
        return _by_name(dialect).get(lowered, STRING)
    base = lowered.split("(")[0].strip()
    if dialect != "generic":
        return _by_name(dialect).get(base, STRING)
    for logical, test, words in GENERIC_RULES:
        if any(_PY_TESTS[test](base, word) for word in words):
            return logical
    return STRING


def source_logical_type_column(type_name: Column, dialect: str = "generic") -> Column:
    """Column form of :func:`source_logical_type`, for catalogue DataFrames."""
    base = F.lower(type_name)
    if dialect not in ("bigquery", "singer", "mongodb"):
        base = F.trim(F.split_part(base, F.lit("("), F.lit(1)))
    if dialect == "generic":
        rules = [
            (_COLUMN_TESTS[test](base, word), logical) for logical, test, words in GENERIC_RULES for word in words
        ]
    else:
        _by_name(dialect)
        rules = [(base.isin(names), logical) for logical, names in SOURCE_TYPES[dialect].items()]
    (first, logical), *rest = rules
    chain = F.when(first, logical)
    for condition, logical in rest:
        chain = chain.when(condition, logical)
    return chain.otherwise(STRING)


# Target column type of each logical type, by database.
TARGET_TYPES = {
    "postgresql": {
        INTEGER: "BIGINT",
        FLOAT: "DOUBLE PRECISION",
        STRING: "TEXT",
        BOOLEAN: "BOOLEAN",
        DATE: "DATE",
        DATETIME: "TIMESTAMP",
        JSON: "JSONB",
        BINARY: "BYTEA",
        NULL: "TEXT",
    },
    "mysql": {
        INTEGER: "BIGINT",
        FLOAT: "DOUBLE",
        STRING: "TEXT",
        BOOLEAN: "BOOLEAN",
        DATE: "DATE",
        DATETIME: "DATETIME",
        JSON: "JSON",
        BINARY: "BLOB",
        NULL: "TEXT",
    },
    "mssql": {
        INTEGER: "BIGINT",
        FLOAT: "FLOAT",
        STRING: "NVARCHAR(MAX)",
        BOOLEAN: "BIT",
        DATE: "DATE",
        DATETIME: "DATETIME2",
        JSON: "NVARCHAR(MAX)",
        BINARY: "VARBINARY(MAX)",
        NULL: "NVARCHAR(MAX)",
    },
    "oracle": {
        INTEGER: "NUMBER",
        FLOAT: "NUMBER",
        STRING: "VARCHAR2(4000)",
        BOOLEAN: "NUMBER(1)",
        DATE: "DATE",
        DATETIME: "TIMESTAMP",
        JSON: "CLOB",
        BINARY: "BLOB",
        NULL: "VARCHAR2(255)",
    },
    "sqlite": {
        INTEGER: "INTEGER",
        FLOAT: "REAL",
        STRING: "TEXT",
        BOOLEAN: "BOOLEAN",
        DATE: "TEXT",
        DATETIME: "TEXT",
        JSON: "TEXT",
        BINARY: "BLOB",
        NULL: "TEXT",
    },
    "bigquery": {
        STRING: "STRING",
        INTEGER: "INT64",
        FLOAT: "FLOAT64",
        BOOLEAN: "BOOL",
        DATE: "DATE",
        DATETIME: "TIMESTAMP",
        BINARY: "BYTES",
        JSON: "JSON",
        NULL: "STRING",
    },
    "snowflake": {
        STRING: "VARCHAR",
        INTEGER: "INT",
        FLOAT: "FLOAT",
        BOOLEAN: "BOOLEAN",
        DATE: "DATE",
        DATETIME: "TIMESTAMP_NTZ",
        JSON: "VARIANT",
        BINARY: "BINARY",
        NULL: "VARCHAR",
    },
}


def target_type(logical: str, dialect: str) -> str:
    """Column type a logical type gets in a target database."""
    spark_type(logical)
    if dialect not in TARGET_TYPES:
        raise SpecError(f"unknown target dialect {dialect!r}")
    return TARGET_TYPES[dialect][logical]


def target_columns(schema: T.StructType, dialect: str) -> list[tuple[str, str]]:
    """(column, target type) pairs for a DataFrame schema."""
    return [(f.name, target_type(logical_type(f.dataType), dialect)) for f in schema.fields]

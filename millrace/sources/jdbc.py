"""Relational database scans through Spark's JDBC source."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..errors import SpecError

# Default ports, URL forms and driver classes of the supported databases.
_PORTS = {"postgresql": 5432, "mysql": 3306, "mssql": 1433}
_URLS = {
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "mssql": "jdbc:sqlserver://{host}:{port};databaseName={database}",
    "oracle": "jdbc:oracle:thin:@{dsn}",
}
_DRIVERS = {
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "oracle": "oracle.jdbc.OracleDriver",
}
# How each database lists its columns.
CATALOG_QUERIES = {
    "postgresql": (
        "SELECT table_schema, table_name, column_name, ordinal_position, data_type, is_nullable, column_default "
        "FROM information_schema.columns WHERE table_schema = '{schema}'"
    ),
    "mysql": (
        "SELECT table_schema, table_name, column_name, ordinal_position, data_type, is_nullable, column_default "
        "FROM information_schema.columns WHERE table_schema = '{schema}'"
    ),
    "mssql": (
        "SELECT table_schema, table_name, column_name, ordinal_position, data_type, is_nullable, column_default "
        "FROM INFORMATION_SCHEMA.COLUMNS WHERE table_schema = '{schema}'"
    ),
    "oracle": (
        "SELECT owner AS table_schema, table_name, column_name, column_id AS ordinal_position, data_type, "
        "nullable AS is_nullable FROM all_tab_columns WHERE owner = '{schema}'"
    ),
}


def stream_name(config: Mapping[str, object]) -> str | None:
    """The table, collection or stream a config names, under any of the four keys in use."""
    for key in ("stream", "table_name", "table", "name"):
        if config.get(key):
            return str(config[key])
    return None


def jdbc_options(config: Mapping[str, object]) -> dict[str, str]:
    """Connection options for a database config (``type``, ``host``, ``port``, ``user``, ``password``, ...)."""
    options = {}
    kind = str(config.get("type", ""))
    if config.get("url"):
        options["url"] = str(config["url"])
    elif kind in _URLS:
        try:
            options["url"] = _URLS[kind].format(**{"port": _PORTS.get(kind), **config})
        except KeyError as error:
            raise SpecError(f"{kind} config lacks {error}") from error
    else:
        raise SpecError(f"unknown database type {kind!r}; one of {', '.join(_URLS)}, or give a url")
    if config.get("driver") or kind in _DRIVERS:
        options["driver"] = str(config.get("driver") or _DRIVERS[kind])
    for key in ("user", "password"):
        if config.get(key):
            options[key] = str(config[key])
    return options


def read_options(config: Mapping[str, object]) -> dict[str, str]:
    """All options of a scan. A query wins over a table.

    Without ``partition_column`` one connection reads everything; with it (and its bounds) ``num_partitions`` tasks
    read ranges of it in parallel, which large tables need. A query cannot be combined with partitioning, so it is
    given as a derived table then.
    """
    options = jdbc_options(config)
    table = stream_name(config)
    if config.get("schema") and table and "." not in table:
        table = f"{config['schema']}.{table}"
    query = config.get("query")
    if not query and not table:
        raise SpecError("a database scan needs a table or a query")
    partitioned = config.get("partition_column")
    if query and not partitioned:
        options["query"] = str(query)
    else:
        options["dbtable"] = f"({query}) src" if query else str(table)
    if partitioned:
        for key in ("lower_bound", "upper_bound", "num_partitions"):
            if config.get(key) is None:
                raise SpecError(f"partition_column needs {key}")
        options["partitionColumn"] = str(partitioned)
        options["lowerBound"] = str(config["lower_bound"])
        options["upperBound"] = str(config["upper_bound"])
        options["numPartitions"] = str(config["num_partitions"])
    options["fetchsize"] = str(config.get("batch_size", 1000))
    options["preferTimestampNTZ"] = "true"
    return options


def read_jdbc(spark: SparkSession, config: Mapping[str, object]) -> DataFrame:
    """A database table or query. Filters on the result (a cursor, say) are sent to the database."""
    return spark.read.format("jdbc").options(**read_options(config)).load()


def read_jdbc_catalog(spark: SparkSession, config: Mapping[str, object]) -> DataFrame:
    """Columns of every table of a database schema, as the database lists them."""
    kind = str(config.get("type", ""))
    if kind not in CATALOG_QUERIES:
        raise SpecError(f"no catalogue query for {kind!r}")
    schema = str(config.get("schema") or config.get("database") or config.get("user"))
    if "'" in schema:
        raise SpecError("schema names must not hold quotes")
    return read_jdbc(spark, {**config, "query": CATALOG_QUERIES[kind].format(schema=schema)})

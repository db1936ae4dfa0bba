"""MongoDB, Snowflake and BigQuery through their own Spark connectors: option mapping only."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..columns import col
from ..errors import MissingConnectorError, SpecError
from .jdbc import stream_name

VENDORS = ("mongodb", "snowflake", "bigquery")


def _need(config: Mapping[str, object], *keys: str) -> None:
    missing = [k for k in keys if not config.get(k)]
    if missing:
        raise SpecError(f"{config.get('type')} config lacks {', '.join(missing)}")


def _mongo(config: Mapping[str, object], stream: str | None) -> dict[str, str]:
    _need(config, "host", "database")
    if not stream:
        raise SpecError("mongodb needs a collection name")
    if bool(config.get("username")) != bool(config.get("password")):
        raise SpecError("mongodb needs username and password together")
    login = f"{config['username']}:{config['password']}@" if config.get("username") else ""
    auth = f"/?authSource={config['auth_source']}" if config.get("auth_source") else ""
    return {
        "connection.uri": f"mongodb://{login}{config['host']}:{config.get('port', 27017)}{auth}",
        "database": str(config["database"]),
        "collection": stream,
    }


def _snowflake(config: Mapping[str, object], stream: str | None) -> dict[str, str]:
    _need(config, "account", "username", "password", "database", "schema")
    options = {
        "sfURL": f"{config['account']}.snowflakecomputing.com",
        "sfUser": config["username"],
        "sfPassword": config["password"],
        "sfDatabase": config["database"],
        "sfSchema": config["schema"],
    }
    for key, option in (("warehouse", "sfWarehouse"), ("role", "sfRole")):
        if config.get(key):
            options[option] = config[key]
    if stream:
        options["dbtable"] = stream
    return {k: str(v) for k, v in options.items()}


def _bigquery(config: Mapping[str, object], stream: str | None) -> dict[str, str]:
    _need(config, "project_id", "dataset_id")
    options = {"parentProject": str(config["project_id"]), "dataset": str(config["dataset_id"])}
    if stream:
        options["table"] = f"{config['project_id']}.{config['dataset_id']}.{stream}"
    return options


_MAPPERS = {"mongodb": _mongo, "snowflake": _snowflake, "bigquery": _bigquery}


def vendor_options(config: Mapping[str, object]) -> dict[str, str]:
    """Connector options of a config."""
    kind = str(config.get("type"))
    if kind not in _MAPPERS:
        raise SpecError(f"unknown vendor {kind!r}; one of {', '.join(VENDORS)}")
    return _MAPPERS[kind](config, stream_name(config))


def vendor_read_options(config: Mapping[str, object]) -> dict[str, str]:
    """Options of a scan: a filter dict (MongoDB) or SQL text (the warehouses) narrows it at the source."""
    options = vendor_options(config)
    query = config.get("query")
    if config["type"] == "mongodb":
        if isinstance(query, Mapping) and query:
            options["aggregation.pipeline"] = json.dumps([{"$match": dict(query)}])
        return options
    if query:
        options.pop("dbtable", None)
        options.pop("table", None)
        options["query"] = str(query)
        if config["type"] == "bigquery":
            options["viewsEnabled"] = "true"
            options["materializationDataset"] = str(config["dataset_id"])
    elif not stream_name(config):
        raise SpecError(f"{config['type']} needs a table or a query")
    return options


def read_vendor(spark: SparkSession, config: Mapping[str, object]) -> DataFrame:
    """A collection or table. MongoDB's own ``_id`` is left out."""
    try:
        df = spark.read.format(str(config["type"])).options(**vendor_read_options(config)).load()
    except Exception as error:
        if isinstance(error, SpecError):
            raise
        if "DATA_SOURCE_NOT_FOUND" in str(error) or "ClassNotFoundException" in str(error):
            raise MissingConnectorError(f"the Spark connector for {config['type']} is not on the class path") from error
        raise
    return df.drop("_id") if config["type"] == "mongodb" else df


def _missing_or(test: Column, field: Column) -> Column:
    return field.isNull() | test


_OPERATORS = {
    "$eq": lambda c, v: c.eqNullSafe(F.lit(v)),
    "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: _missing_or(~c.isin(list(v)), c),
    "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
}


def mongo_predicate(query: Mapping[str, object]) -> Column:
    """A MongoDB filter dict as a Spark predicate, for data already landed outside MongoDB."""
    tests = [F.lit(True)]
    for key, wanted in query.items():
        if key in ("$and", "$or"):
            parts = [mongo_predicate(part) for part in wanted]
            tests.append(reduce(lambda a, b: a & b if key == "$and" else a | b, parts))
        elif key.startswith("$"):
            raise SpecError(f"filter operator {key!r} is not supported")
        elif isinstance(wanted, Mapping) and any(k.startswith("$") for k in wanted):
            for operator, value in wanted.items():
                if operator not in _OPERATORS:
                    raise SpecError(f"filter operator {operator!r} is not supported")
                tests.append(_OPERATORS[operator](col(key), value))
        else:
            tests.append(col(key).eqNullSafe(F.lit(wanted)))
    return reduce(lambda a, b: a & b, tests)

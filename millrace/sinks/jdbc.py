"""Relational database targets through Spark's JDBC writer."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..errors import SpecError
from ..session import work_path
from ..sources.jdbc import jdbc_options, read_jdbc, stream_name
from ..types import STRING, logical_type
from .files import nested_as_json
from .upsert import latest_per_key, merge_rows

# Mode names in use, and the Spark save mode and truncation each means.
MODES = {
    "append": ("append", False),
    "insert": ("append", False),
    "replace": ("overwrite", True),
    "truncate": ("overwrite", True),
    "overwrite": ("overwrite", False),
}


def write_options(df: DataFrame, config: Mapping[str, object]) -> dict[str, str]:
    """Options of a write. Oracle strings get their full length; other types follow Spark's dialects."""
    table = stream_name(config)
    if not table:
        raise SpecError("a database write needs a table")
    if config.get("schema") and "." not in table:
        table = f"{config['schema']}.{table}"
    options = {**jdbc_options(config), "dbtable": table, "batchsize": str(config.get("batch_size", 1000))}
    if config.get("num_partitions"):
        options["numPartitions"] = str(config["num_partitions"])
    strings = [f.name for f in df.schema.fields if logical_type(f.dataType) == STRING]
    if config.get("type") == "oracle" and strings:
        options["createTableColumnTypes"] = ", ".join(f"`{name}` VARCHAR(4000)" for name in strings)
    return options


def write_jdbc(df: DataFrame, config: Mapping[str, object], mode: str = "append") -> None:
    """Insert ``df`` into a database table, created from the schema when missing.

    Nested values are written as JSON text. Each partition is one transaction; give ``staging_table`` to load there
    first and move the rows with one statement of your own. An upsert reads the table, merges in Spark, stages the
    result in the shared folder and reloads the table.
    """
    flat = nested_as_json(df)
    if mode == "upsert":
        keys, order_by = config.get("keys"), config.get("order_by")
        if not keys or not order_by:
            raise SpecError("an upsert needs keys and order_by")
        staged = work_path(df.sparkSession, "jdbc-upsert")
        latest = latest_per_key(flat, keys, order_by)
        merge_rows(read_jdbc(df.sparkSession, {**config, "query": None}), latest, keys).write.parquet(staged)
        flat, mode = df.sparkSession.read.parquet(staged), "truncate"
    if mode not in MODES:
        raise SpecError(f"unknown write mode {mode!r}; one of {', '.join(MODES)}, upsert")
    save_mode, truncate = MODES[mode]
    if config.get("staging_table"):
        config = {**config, "table": config["staging_table"], "stream": None, "table_name": None}
    writer = flat.write.format("jdbc").mode(save_mode).options(**write_options(flat, config))
    writer.option("truncate", str(truncate).lower()).save()


def write_jdbc_streams(streams: Mapping[str, DataFrame], config: Mapping[str, object], mode: str = "append") -> None:
    """Each named DataFrame into the table of its name."""
    for name, df in streams.items():
        write_jdbc(df, {**config, "stream": name}, mode)

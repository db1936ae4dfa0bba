"""MongoDB, Snowflake and BigQuery targets through their own Spark connectors: option mapping only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..errors import MissingConnectorError, SpecError
from ..sources.vendor import vendor_options

_SAVE_MODE = {"append": "append", "truncate": "overwrite", "overwrite": "overwrite"}


def vendor_write_options(config: Mapping[str, object], mode: str = "append") -> dict[str, str]:
    """Connector options of a write."""
    if mode not in _SAVE_MODE:
        raise SpecError(f"unknown write mode {mode!r}; one of {', '.join(_SAVE_MODE)}")
    options = vendor_options(config)
    batch = int(config.get("batch_size", 1000))
    if config["type"] == "mongodb":
        options["maxBatchSize"] = str(batch)
        options["operationType"] = "insert"
    elif config["type"] == "snowflake":
        if mode == "truncate":
            options["truncate_table"] = "on"
            options["usestagingtable"] = "off"
    else:
        options["writeMethod"] = "direct"  # the storage API sizes its own requests, so batch_size has no use here
    return options


def write_vendor(df: DataFrame, config: Mapping[str, object], mode: str = "append") -> None:
    """Write to a collection or table of the vendor's store."""
    options = vendor_write_options(config, mode)
    try:
        df.write.format(str(config["type"])).mode(_SAVE_MODE[mode]).options(**options).save()
    except Exception as error:
        if "DATA_SOURCE_NOT_FOUND" in str(error) or "ClassNotFoundException" in str(error):
            raise MissingConnectorError(f"the Spark connector for {config['type']} is not on the class path") from error
        raise

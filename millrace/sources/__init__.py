"""Sources: each returns a lazy DataFrame."""

from .envelope import record_count, stamp
from .files import read_files, read_json_values, read_prefix, read_raw, s3_options
from .jdbc import jdbc_options, read_jdbc
from .singer import read_singer, read_singer_state, singer_schema
from .vendor import mongo_predicate, read_vendor, vendor_options

__all__ = [
    "jdbc_options",
    "mongo_predicate",
    "read_files",
    "read_jdbc",
    "read_json_values",
    "read_prefix",
    "read_raw",
    "read_singer",
    "read_singer_state",
    "read_vendor",
    "record_count",
    "s3_options",
    "singer_schema",
    "stamp",
    "vendor_options",
]

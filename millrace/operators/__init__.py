"""DataFrame-to-DataFrame operators."""

from .basic import add_constant, compute_expression, drop_fields, filter_rows, noop, rename_fields, type_cast
from .custom import custom_batch, custom_record
from .intervals import interval_join
from .quantiles import exact_quantiles
from .registry import apply_chain, register_transform, resolve_chain, transform_names
from .relational import asof_join, asof_join_scan, range_join, top_k_per_group
from .segments import Segments
from .sql import sql_transform

__all__ = [
    "Segments",
    "add_constant",
    "apply_chain",
    "asof_join",
    "asof_join_scan",
    "compute_expression",
    "custom_batch",
    "custom_record",
    "drop_fields",
    "exact_quantiles",
    "filter_rows",
    "interval_join",
    "noop",
    "range_join",
    "register_transform",
    "rename_fields",
    "resolve_chain",
    "sql_transform",
    "top_k_per_group",
    "transform_names",
    "type_cast",
]

"""Column-level functions: lenient casts and computed expressions."""

from .casts import cast_column, python_str, truthy
from .expr import compile_expression

__all__ = ["cast_column", "compile_expression", "python_str", "truthy"]

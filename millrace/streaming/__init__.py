"""Incremental runs over arriving files with Structured Streaming."""

from .arriving import run_arriving_files

__all__ = ["run_arriving_files"]

"""From a JSON-like spec to one lazy DataFrame, and from there to a run."""

from .incremental import State, StateStore, after_cursor, after_cursor_lenient, sync_plan
from .run import RunResult, build, run
from .spec import RunSpec

__all__ = [
    "RunResult",
    "RunSpec",
    "State",
    "StateStore",
    "after_cursor",
    "after_cursor_lenient",
    "build",
    "run",
    "sync_plan",
]

"""Cursor filters, saved state and sync modes."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..columns import col
from ..errors import SpecError
from ..session import local_frame, path_exists
from ..types import BOOLEAN, DATE, DATETIME, FLOAT, INTEGER, STRING, logical_type

CursorValue = int | float | str | bool | date | datetime | Decimal | None

_COMPARABLE = {
    STRING: (str,),
    INTEGER: (int, float, Decimal),
    FLOAT: (int, float, Decimal),
    BOOLEAN: (bool,),
    DATE: (date, str),
    DATETIME: (datetime, date, str),
}


def _last(value: CursorValue, data_type: T.DataType) -> Column:
    if isinstance(value, datetime) and value.tzinfo is None:
        return F.lit(value.isoformat(sep=" ")).cast(data_type)  # as text: no time zone of this process comes in
    if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        return F.lit(value)
    return F.lit(value).cast(data_type)


def after_cursor(df: DataFrame, cursor_field: str, last: CursorValue) -> DataFrame:
    """Rows whose cursor is greater than ``last``; rows without a cursor value are left out.

    A plain comparison with a literal, which Spark hands to parquet statistics and to databases. The rows are not
    sorted: the next cursor is their maximum. With no last value everything is read.
    """
    if last is None:
        return df
    return with_cursor(df, cursor_field, col(cursor_field) > _last(last, df.schema[cursor_field].dataType))


def with_cursor(df: DataFrame, cursor_field: str, test: Column | None = None) -> DataFrame:
    """Rows that have a cursor value (and pass ``test``, which NULL does not). NaN is no cursor."""
    value = col(cursor_field)
    test = value.isNotNull() if test is None else test
    if isinstance(df.schema[cursor_field].dataType, (T.FloatType, T.DoubleType)):
        test = test & ~F.isnan(value)
    return df.where(test)


def after_cursor_lenient(df: DataFrame, cursor_field: str | None, last: CursorValue) -> DataFrame:
    """Like :func:`after_cursor`, but rows that cannot be compared stay: no such field, no value, other type."""
    if last is None or not cursor_field or cursor_field not in df.columns:
        return df
    data_type = df.schema[cursor_field].dataType
    if not isinstance(last, _COMPARABLE.get(logical_type(data_type), ())):
        return df
    value = col(cursor_field)
    return df.where(value.isNull() | (value > _last(last, data_type)))


def next_cursor(df: DataFrame, cursor_field: str) -> Column:
    """Aggregate giving the cursor to save, as text that :func:`parse_cursor` reads back exactly. NaN is no cursor."""
    value = F.max(col(cursor_field))
    data_type = df.schema[cursor_field].dataType
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        value = F.max(F.when(~F.isnan(col(cursor_field)), col(cursor_field)))
    if isinstance(data_type, T.TimestampType):
        value = F.unix_micros(value)
    return value.cast("string")


def parse_cursor(text: str | None, data_type: T.DataType) -> CursorValue:
    """A saved cursor in the type of its column."""
    if text is None:
        return None
    if isinstance(data_type, T.TimestampType):
        return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=int(text))
    if isinstance(data_type, T.TimestampNTZType):
        return datetime.fromisoformat(text)
    if isinstance(data_type, T.DateType):
        return date.fromisoformat(text)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return float(text)
    if isinstance(data_type, T.DecimalType):
        return Decimal(text)
    if isinstance(data_type, T.IntegralType):
        return int(text)
    if isinstance(data_type, T.BooleanType):
        return text == "true"
    return text


def stepped_back(value: CursorValue, lookback: float) -> CursorValue:
    """A cursor value moved back by seconds (times) or units (numbers); text and booleans have no distance."""
    if not lookback or isinstance(value, (str, bool)):
        return value
    if isinstance(value, datetime):
        return value - timedelta(seconds=lookback)
    if isinstance(value, date):
        return value - timedelta(days=math.ceil(lookback / 86_400))
    return value - type(value)(lookback)


@dataclass(frozen=True)
class State:
    """Where the last successful run of a stream stopped."""

    pipeline: str
    stream: str
    cursor_field: str | None = None
    cursor_value: str | None = None
    run: int = 0
    last_record_count: int = 0
    total_records_synced: int = 0
    updated_at: str | None = None

    def advanced(self, cursor_field: str | None, cursor_value: str | None, records: int) -> State:
        """State after a run that wrote ``records`` rows. A run that saw no cursor value keeps the old one."""
        return replace(
            self,
            cursor_field=cursor_field or self.cursor_field,
            cursor_value=cursor_value if cursor_value is not None else self.cursor_value,
            run=self.run + 1,
            last_record_count=records,
            total_records_synced=self.total_records_synced + records,
            updated_at=datetime.now(timezone.utc).isoformat(),
        )


_STATE_SCHEMA = (
    "pipeline string, stream string, cursor_field string, cursor_value string, run bigint, "
    "last_record_count bigint, total_records_synced bigint, updated_at string"
)


class StateStore:
    """States as one small JSON file per save, below a folder; the greatest run number is the current one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def load(self, pipeline: str, stream: str) -> State:
        if not path_exists(self.spark, self.path):
            return State(pipeline, stream)
        saved = self.spark.read.schema(_STATE_SCHEMA).json(self.path)
        mine = saved.where((col("pipeline") == pipeline) & (col("stream") == stream))
        latest = mine.orderBy(F.col("run").desc(), F.col("updated_at").desc()).limit(1).first()
        return State(**latest.asDict()) if latest else State(pipeline, stream)

    def save(self, state: State) -> None:
        """Write a state; called only after the data it describes has been published."""
        row = local_frame(self.spark, [tuple(asdict(state).values())], _STATE_SCHEMA)
        row.coalesce(1).write.mode("append").json(self.path)


def _row_hash(df: DataFrame) -> Column:
    """A hash of the whole row."""
    return F.sha2(F.to_json(F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"}), 256)


class Ties:
    """Which rows with the greatest cursor value a stream has taken: a table of hashes and counts per run, beside the states.

    Rows that are equal in all columns are told apart by their number: a third equal row is new where two were taken.
    """

    def __init__(self, store: StateStore, state: State):
        self._spark = store.spark
        self._folder = f"{store.path}__ties/{_file_name(state.pipeline)}/{_file_name(state.stream)}"
        self._state = state

    def after(self, df: DataFrame, cursor_field: str, last: CursorValue) -> DataFrame:
        """Rows beyond ``last``, and those equal to it that were not taken yet."""
        beyond = after_cursor(df, cursor_field, last)
        path = f"{self._folder}/{self._state.run}"
        if last is None or not path_exists(self._spark, path):
            return beyond
        equal = df.where(col(cursor_field) == _last(last, df.schema[cursor_field].dataType)).withColumn("_tie", _row_hash(df))
        taken = self._spark.read.schema("_tie string, _taken bigint").parquet(path)
        number = F.row_number().over(Window.partitionBy("_tie").orderBy("_tie"))
        fresh = equal.withColumn("_nth", number).join(taken, "_tie", "left").where(F.col("_nth") > F.coalesce("_taken", F.lit(0)))
        return beyond.unionByName(fresh.select(*[col(c) for c in df.columns]))

    def save(self, read: DataFrame, cursor_field: str, cursor: CursorValue, last: CursorValue) -> None:
        """Remember the rows of this run whose cursor is the new one, with those taken before if it has not moved."""
        path = f"{self._folder}/{self._state.run + 1}"
        hashes = read.where(col(cursor_field) == _last(cursor, read.schema[cursor_field].dataType)).select(_row_hash(read).alias("_tie"), F.lit(1).cast("bigint").alias("_taken"))
        old = f"{self._folder}/{self._state.run}"
        if cursor == last and path_exists(self._spark, old):
            hashes = hashes.unionByName(self._spark.read.schema("_tie string, _taken bigint").parquet(old))
        hashes.groupBy("_tie").agg(F.sum("_taken").alias("_taken")).write.mode("overwrite").parquet(path)


def _file_name(text: str) -> str:
    return quote(text, safe="") or "_"


# Sync modes, and for each whether the cursor limits the read and how rows are written.
_SYNC = {
    "full_refresh": (False, "overwrite"),
    "append": (False, "append"),
    "incremental": (True, "append"),
    "upsert": (True, "upsert"),
}


# Other names of write modes, and the modes a sync mode may be combined with. A mode left out would
# lose rows (an overwrite with only the new ones) or double them.
_MODE_NAMES = {"replace": "truncate", "insert": "append"}
_MODES = {
    "full_refresh": ("overwrite", "truncate", "append", "upsert"),
    "append": ("append",),
    "incremental": ("append", "upsert"),
    "upsert": ("upsert",),
}


def write_mode_of(sync_mode: str, cursor_field: str | None, wanted: str | None) -> str:
    """The write mode of a sync, or the ``wanted`` one if it fits."""
    _, mode = sync_plan(sync_mode, cursor_field)
    mode = _MODE_NAMES.get(wanted, wanted) or mode
    if mode not in _MODES[sync_mode]:
        raise SpecError(f"write mode {wanted!r} does not fit sync mode {sync_mode!r}; one of {', '.join(_MODES[sync_mode])}")
    return mode


def sync_plan(sync_mode: str, cursor_field: str | None) -> tuple[bool, str]:
    """(read from the cursor on, write mode) of a sync mode."""
    if sync_mode not in _SYNC:
        raise SpecError(f"unknown sync mode {sync_mode!r}; one of {', '.join(_SYNC)}")
    uses_cursor, write_mode = _SYNC[sync_mode]
    if sync_mode == "incremental" and not cursor_field:
        raise SpecError("sync mode incremental needs a cursor_field")
    return uses_cursor and bool(cursor_field), write_mode

"""Tables of immutable files and a log of commits: replacement and upserts that are whole or not there, on any store.

A table is a folder. ``data/`` holds parquet files that never change; ``_log/`` one small parquet object per commit,
numbered, that lists the files it adds, with the range of their keys, and those it removes. A commit is the creation
of the next number, which fails if another job was first; readers list the log and see a commit or do not. Nothing is
renamed, so a store that copies on rename costs nothing more. Files that no commit names are what a stopped job left;
``vacuum`` deletes them, and those that only old versions read.

With ``keys`` the rows of a commit are written in ranges of the key, so a file covers a short range. An upsert compares
those ranges with the ranges of the incoming keys, looks up the keys of the files that are left, and rewrites only
files that hold one of them.
"""

from __future__ import annotations

import io
import json
import uuid
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..columns import col
from ..errors import SpecError
from ..session import delete_path, hadoop_path, path_exists, staged
from .files import write_files
from .upsert import latest_per_key, merge_rows

_RANGED = (T.IntegralType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType, T.BooleanType)


class ConflictError(RuntimeError):
    """Another job committed first."""


@dataclass
class Snapshot:
    """What a version holds: its number (0 before the first commit), schema, and files with the range of their keys."""

    version: int = 0
    schema: T.StructType | None = None
    keys: tuple[str, ...] = ()
    files: dict[str, tuple | None] = field(default_factory=dict)
    transactions: dict[str, list[str]] = field(default_factory=dict)


def _log_path(path: str) -> str:
    return f"{path.rstrip('/')}/_log"


def _read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, jpath = hadoop_path(spark, path)
    stream = fs.open(jpath)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, content: bytes) -> None:
    """Create an object that must not exist yet."""
    fs, jpath = hadoop_path(spark, path)
    try:
        stream = fs.create(jpath, False)
    except Exception as error:
        if fs.exists(jpath):
            raise ConflictError(f"{path} was committed by another job") from error
        raise
    stream.write(content)
    stream.close()


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The last version of a table, or a given one. As large as its list of files, like any scan of it on the driver."""
    out = Snapshot()
    fs, log = hadoop_path(spark, _log_path(path))
    if not fs.exists(log):
        return out
    names = sorted(s.getPath().getName() for s in fs.listStatus(log) if s.getPath().getName().endswith(".commit"))
    for name in names:
        number = int(name.removesuffix(".commit"))
        if version is not None and number > version:
            break
        entry = pq.read_table(io.BytesIO(_read_bytes(spark, f"{_log_path(path)}/{name}")))
        told = {k.decode(): v.decode() for k, v in entry.schema.metadata.items()}
        out.version, out.schema = number, T.StructType.fromJson(json.loads(told["table_schema"]))
        out.keys = tuple(json.loads(told["keys"]))
        added = out.transactions.setdefault(told["transaction"], [])
        for row in entry.to_pylist():
            if row["added"]:
                added.append(row["file"])
                out.files[row["file"]] = None if row["low"] is None else (tuple(row["low"].values()), tuple(row["high"].values()))
            else:
                out.files.pop(row["file"], None)
    if version is not None and out.version != version:
        raise SpecError(f"{path} has no version {version}")
    return out


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a table as of its last version, or of a given one."""
    return _rows(spark, path, snapshot(spark, path, version))


def _rows(spark: SparkSession, path: str, at: Snapshot, files: Sequence[str] | None = None) -> DataFrame:
    if at.schema is None:
        raise SpecError(f"{path} has no commit")
    names = list(at.files if files is None else files)
    if not names:
        return spark.createDataFrame([], at.schema)
    return spark.read.schema(at.schema).parquet(*[f"{path.rstrip('/')}/data/{n}" for n in names])


def _key_fields(schema: T.StructType, keys: Sequence[str]) -> list[T.StructField]:
    fields = [schema[k] for k in keys]
    odd = [f.name for f in fields if not isinstance(f.dataType, _RANGED)]
    if odd:
        raise SpecError(f"keys of a ranged table must be integers, text, dates, times, decimals or booleans, not {', '.join(odd)}")
    return fields


def _write_data(df: DataFrame, path: str, keys: Sequence[str], options: dict) -> list[dict]:
    """Write files below ``data/`` and list them with the range of their keys, which only reads the key columns."""
    spark, folder = df.sparkSession, uuid.uuid4().hex
    place = f"{path.rstrip('/')}/data/{folder}"
    kept = None
    if keys:
        _key_fields(df.schema, keys)
        kept = df = df if hasattr(df, "staged_path") else staged(df, "unsorted")  # ranges are cut by a look at all rows
        df = df.repartitionByRange(*[col(k) for k in keys]).sortWithinPartitions(*[col(k) for k in keys])
    write_files(df, place, mode="errorifexists", **options)
    if not keys:
        fs, jpath = hadoop_path(spark, place)
        names = [s.getPath().getName() for s in fs.listStatus(jpath)]
        return [{"file": f"{folder}/{n}", "added": True, "low": None, "high": None} for n in names if n.endswith(".parquet")]
    key = F.struct(*[col(k) for k in keys])
    known = [col(k).isNotNull() for k in keys]
    whole = known[0]
    for k in known[1:]:
        whole = whole & k
    ranges = spark.read.schema(df.schema).parquet(place).groupBy(F.col("_metadata.file_name").alias("file"))
    found = ranges.agg(F.min(F.when(whole, key)).alias("low"), F.max(F.when(whole, key)).alias("high")).collect()  # a row per file
    delete_path(spark, kept.staged_path)
    return [{"file": f"{folder}/{r.file}", "added": True, "low": r.low and r.low.asDict(), "high": r.high and r.high.asDict()} for r in found]


def _commit(spark: SparkSession, path: str, base: Snapshot, schema: T.StructType, keys: Sequence[str], added: list[dict], removed: Sequence[str], transaction: str | None) -> int:
    span = to_arrow_schema(T.StructType([T.StructField(k, schema[k].dataType) for k in keys])) if keys else []
    span = pa.struct(list(span)) if keys else pa.null()
    fields = pa.schema([("file", pa.string()), ("added", pa.bool_()), ("low", span), ("high", span)])
    told = {"table_schema": schema.json(), "keys": json.dumps(list(keys)), "transaction": transaction or uuid.uuid4().hex}
    rows = [*added, *[{"file": f, "added": False, "low": None, "high": None} for f in removed]]
    content = io.BytesIO()
    pq.write_table(pa.Table.from_pylist(rows, fields.with_metadata(told)), content)
    _create(spark, f"{_log_path(path)}/{base.version + 1:020d}.commit", content.getvalue())
    return base.version + 1


def append_snapshot(df: DataFrame, path: str, keys: Sequence[str] = (), transaction: str | None = None, **options) -> int:
    """Add rows; return the version.

    What earlier commits of the same ``transaction`` added is replaced, so a job that is repeated because it stopped
    after its commit adds nothing twice, and loses nothing if it reads more this time.
    """
    base = snapshot(df.sparkSession, path)
    again = [f for f in base.transactions.get(transaction or "", ()) if f in base.files]
    if base.schema is not None:
        missing = [f.name for f in df.schema.fields if f.name not in base.schema.names]
        if missing:
            raise SpecError(f"the table has no columns {', '.join(missing)}; replace it to change its schema")
        df = df.select(*[(col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in base.schema.fields])
    keys = keys or base.keys
    return _commit(df.sparkSession, path, base, base.schema or df.schema, keys, _write_data(df, path, keys, options), again, transaction)


def replace_snapshot(df: DataFrame, path: str, keys: Sequence[str] = (), keep_schema: bool = False, **options) -> int:
    """Put ``df`` in the place of all rows; ``df`` may read the table. ``keep_schema`` fits it into the columns there are.

    Readers go on with the version they began with; one that starts sees all of the old rows or all of the new.
    """
    spark = df.sparkSession
    base = snapshot(spark, path)
    if keep_schema and base.schema is not None:
        extra = [c for c in df.columns if c not in base.schema.names]
        if extra:
            raise SpecError(f"the target has no columns {', '.join(extra)}; overwrite it to change its schema")
        df = df.select(*[(col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in base.schema.fields])
    keys = keys or tuple(k for k in base.keys if k in df.columns)
    return _commit(spark, path, base, df.schema, keys, _write_data(df, path, keys, options), list(base.files), None)


def _may_hold(files: dict[str, tuple | None], incoming: list[tuple[tuple, tuple]]) -> list[str]:
    """Files whose range of keys meets one of the ``incoming`` ranges, which do not overlap."""
    lows, highs = zip(*sorted(incoming)) if incoming else ((), ())
    out = []
    for name, span in files.items():
        if span is not None:
            at = bisect_left(highs, span[0])
            if at < len(lows) and lows[at] <= span[1]:
                out.append(name)
    return out


def upsert_snapshot(incoming: DataFrame, path: str, keys: Sequence[str], order_by: Sequence[str], **options) -> int:
    """Insert or replace by key: of the incoming rows of a key the greatest by ``order_by`` wins. Return the version.

    The source is read once, into a staged copy in ranges of the key. Of the files whose range meets one of those,
    only the key columns are read to tell which hold an incoming key; only these are rewritten. All others keep their
    place in the table. Rows whose key holds a NULL are added. The first upsert creates the table.
    """
    spark = incoming.sparkSession
    base = snapshot(spark, path)
    if base.schema is not None and tuple(base.keys) != tuple(keys):
        raise SpecError(f"the table at {path} has the keys {list(base.keys)}, not {list(keys)}")
    fields = _key_fields(incoming.schema, keys)
    schema = base.schema or incoming.schema
    unknown = [c for c in incoming.columns if c not in schema.names]
    if unknown:
        raise SpecError(f"the target has no columns {', '.join(unknown)}; replace it to change its schema")
    once = staged(incoming, "incoming")
    latest = latest_per_key(once, keys, order_by)
    latest = latest.select(*[(col(f.name) if f.name in incoming.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    ranged = staged(latest.repartitionByRange(*[col(f.name) for f in fields]), "upsert")
    key = F.struct(*[col(k) for k in keys])
    pieces = ranged.dropna(subset=list(keys)).groupBy(F.col("_metadata.file_name")).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    spans = [(tuple(r.low), tuple(r.high)) for r in pieces.collect()]  # a row per staged file
    touched: list[str] = []
    likely = _may_hold(base.files, spans)
    if likely:
        stored = _rows(spark, path, base, likely).select(*[col(k) for k in keys], F.col("_metadata.file_path").alias("_file"))
        met = stored.join(ranged.select(*[col(k) for k in keys]), list(keys), "left_semi").select("_file").distinct()
        touched = sorted("/".join(r[0].split("/")[-2:]) for r in met.collect())  # as many as files to rewrite
    rows = merge_rows(_rows(spark, path, base, touched), ranged, keys) if touched else ranged
    version = _commit(spark, path, base, schema, keys, _write_data(rows, path, keys, options), touched, None)
    delete_path(spark, once.staged_path)
    delete_path(spark, ranged.staged_path)
    return version


def vacuum(spark: SparkSession, path: str, keep_from: int | None = None) -> list[str]:
    """Delete folders of data that no version from ``keep_from`` (the last one) on reads; return their names.

    Not while a job is writing to the table: what it has not committed yet would go too.
    """
    last = snapshot(spark, path)
    needed = set()
    for version in range(keep_from or last.version, last.version + 1):
        needed |= {name.split("/")[0] for name in snapshot(spark, path, version).files}
    data = f"{path.rstrip('/')}/data"
    if not path_exists(spark, data):
        return []
    fs, jpath = hadoop_path(spark, data)
    gone = sorted(s.getPath().getName() for s in fs.listStatus(jpath) if s.getPath().getName() not in needed)
    for name in gone:
        delete_path(spark, f"{data}/{name}")
    return gone

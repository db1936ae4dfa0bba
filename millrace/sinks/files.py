"""File sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..columns import col
from ..errors import MissingConnectorError, SpecError
from ..session import delete_path, hadoop_path, path_exists, work_path
from ..sources.files import _FORMAT_OPTIONS

FORMATS = ("parquet", "csv", "json", "jsonl", "avro")
_NTZ_WRITE = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_TEXT_WRITE = {"timestampNTZFormat": _NTZ_WRITE, "timestampFormat": _NTZ_WRITE + "XXX"}
_DIR = "__dir"
_NESTED = (T.StructType, T.ArrayType, T.MapType, T.VariantType)


def nested_as_json(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text and untyped NULL columns as strings, for targets with flat columns."""
    columns = []
    for field in df.schema.fields:
        value = col(field.name)
        if isinstance(field.dataType, _NESTED):
            value = F.to_json(value)
        elif isinstance(field.dataType, T.NullType):
            value = value.cast("string")
        columns.append(value.alias(field.name))
    return df.select(*columns)


def _avro_ready(df: DataFrame) -> DataFrame:
    flat = nested_as_json(df)
    times = [f.name for f in flat.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    return flat.withColumns({name: F.date_format(col(name), _NTZ_WRITE) for name in times}) if times else flat


def write_files(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    mode: str = "append",
    compression: str | None = None,
    partition_by: Sequence[str] = (),
    batch_size: int | None = None,
    sort_columns: bool = False,
    rebalance: bool = True,
    options: Mapping[str, object] | None = None,
) -> None:
    """Write below ``path``; every task writes its own files.

    ``batch_size`` caps the rows of one file (of one array for ``json``). Parquet is compressed with snappy unless
    told otherwise. CSV columns are put in name order with ``sort_columns``. With ``partition_by`` the rows of a
    directory are gathered into files of the advisory size first, unless ``rebalance`` is off: small directories do
    not get one file per task, and a directory holding most of the rows is still written by many tasks.
    """
    format = format.lower()
    if format not in FORMATS:
        raise SpecError(f"unsupported file format {format!r}; one of {', '.join(FORMATS)}")
    if format == "json":
        write_json_arrays(df, path, mode, compression=compression, partition_by=partition_by, options=options, **({"batch_size": batch_size} if batch_size else {}))
        return
    if format == "csv":
        df = nested_as_json(df)
        if sort_columns:
            df = df.select(*[col(c) for c in sorted(df.columns)])
    if format == "avro":
        df = _avro_ready(df)
    if partition_by and rebalance:
        df = df.hint("rebalance", *[col(name) for name in partition_by])
    writer = df.write.format("json" if format == "jsonl" else format).mode(mode)
    if format in ("csv", "jsonl"):
        writer = writer.options(**_TEXT_WRITE)
    if format == "csv":
        writer = writer.option("header", True).option("escape", '"')
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if format == "jsonl":
        writer = writer.option("ignoreNullFields", False)
    if compression or format == "parquet":
        writer = writer.option("compression", compression or "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if batch_size:
        writer = writer.option("maxRecordsPerFile", batch_size)
    try:
        writer.options(**(options or {})).save(path)
    except Exception as error:
        if format == "avro" and "avro" in str(error).lower():
            raise MissingConnectorError("the spark-avro package is not on the class path") from error
        raise


def write_json_arrays(
    df: DataFrame,
    path: str,
    mode: str = "append",
    batch_size: int = 100_000,
    batch_chars: int = 64_000_000,
    compression: str | None = None,
    partition_by: Sequence[str] = (),
    options: Mapping[str, object] | None = None,
) -> None:
    """JSON documents holding one array of up to ``batch_size`` rows (and about ``batch_chars`` characters) each.

    Spark renders every row as JSON; each task then joins the texts of its own rows and holds one array at a time.
    With ``partition_by`` the columns name directories and are left out of the rows, and rows of a directory are
    gathered first; without, nothing is shuffled.
    """
    missing = [c for c in partition_by if c not in df.columns]
    if missing:
        raise SpecError(f"no column {', '.join(missing)} to partition by")
    row = F.to_json(F.struct(*[col(c) for c in df.columns if c not in partition_by]), {**_TEXT_WRITE, "ignoreNullFields": "false"})
    places = [col(c).alias(f"p{i}") for i, c in enumerate(partition_by)]
    texts = df.select(*places, row.alias("value"))
    names = [f"p{i}" for i in range(len(partition_by))]
    if names:
        texts = texts.hint("rebalance", *names).sortWithinPartitions(*names)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[str] = []
        size, place = 0, None

        def done() -> pa.RecordBatch:
            columns = [*place, pa.array(["[" + ",\n".join(waiting) + "]"])]
            return pa.RecordBatch.from_arrays(columns, [*names, "value"])

        for batch in batches:
            keys = list(zip(*(batch.column(n).to_pylist() for n in names))) if names else [()] * len(batch)
            for i, (key, text) in enumerate(zip(keys, batch.column("value").to_pylist())):
                if waiting and (len(waiting) == batch_size or size >= batch_chars or key != last):
                    yield done()
                    waiting, size = [], 0
                last, place = key, [batch.column(n).slice(i, 1) for n in names]
                waiting.append(text)
                size += len(text)
        if waiting:
            yield done()

    kinds = T.StructType([*[texts.schema[n] for n in names], T.StructField("value", T.StringType())])
    documents = texts.mapInArrow(arrays, kinds)
    documents = documents.select(*[F.col(n).alias(c) for n, c in zip(names, partition_by)], "value")
    writer = documents.write.mode(mode).option("maxRecordsPerFile", 1).options(**(options or {}))
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.text(path)


def write_partitioned(
    df: DataFrame, path: str, fields: Sequence[str], format: str = "parquet", mode: str = "append", rebalance: bool = True
) -> None:
    """One ``field__dir=value`` directory level per field, with ``/`` and spaces in values replaced by ``_``.

    The directories are named by copies; the files keep the fields themselves. :func:`read_partitioned` leaves the
    copies out, and a filter on a copy prunes directories.
    """
    clean = {name + _DIR: F.translate(F.coalesce(col(name).cast("string"), F.lit("None")), "/ ", "__") for name in fields}
    write_files(df.withColumns(clean), path, format, mode, partition_by=list(clean), rebalance=rebalance)


def read_partitioned(
    spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """What :func:`write_partitioned` wrote, with the values as they were."""
    reader = spark.read.format("json" if format == "jsonl" else format).options(**_FORMAT_OPTIONS[format])
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df.drop(*[c for c in df.columns if c.endswith(_DIR)])


def write_streams(
    streams: DataFrame | Mapping[str, DataFrame],
    base: str,
    format: str = "parquet",
    mode: str = "append",
    stream_column: str = "_stream",
) -> None:
    """Each stream below its own directory of ``base``.

    Named DataFrames go to ``base/<name>``; one DataFrame with a stream column goes to ``base/_stream=<name>`` in a
    single pass.
    """
    if isinstance(streams, DataFrame):
        write_files(streams, base, format, mode, partition_by=[stream_column])
        return
    for name, df in streams.items():
        write_files(df, f"{base.rstrip('/')}/{name}", format, mode)


def ensure_target(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet") -> bool:
    """Create an empty target with ``schema`` unless there is one; True if it was created."""
    if path_exists(spark, path):
        return False
    write_files(spark.createDataFrame([], schema), path, format, mode="errorifexists")
    return True


def publish(spark: SparkSession, staged: str, target: str) -> None:
    """Put a completely written directory in the place of ``target``.

    The old directory is moved aside first and removed last; :func:`restore` brings it back if the job stops between.
    """
    fs, staged_path = hadoop_path(spark, staged)
    target_path = spark._jvm.org.apache.hadoop.fs.Path(target)
    aside = spark._jvm.org.apache.hadoop.fs.Path(target.rstrip("/") + "__previous")
    if fs.exists(target_path):
        fs.delete(aside, True)
        if not fs.rename(target_path, aside):
            raise OSError(f"cannot move {target} aside")
    elif not fs.exists(target_path.getParent()):
        fs.mkdirs(target_path.getParent())
    if not fs.rename(staged_path, target_path):
        raise OSError(f"cannot move {staged} to {target}")
    fs.delete(aside, True)


def restore(spark: SparkSession, target: str) -> None:
    """Undo a replacement that stopped after the old directory was moved aside."""
    fs, target_path = hadoop_path(spark, target)
    aside = spark._jvm.org.apache.hadoop.fs.Path(target.rstrip("/") + "__previous")
    if fs.exists(aside) and not fs.exists(target_path):
        fs.rename(aside, target_path)


def staging_path(target: str) -> str:
    """A sibling of ``target``, so that moving it there is a rename within one file system."""
    return f"{target.rstrip('/')}__staged_{uuid.uuid4().hex}"


def replace_files(df: DataFrame, path: str, format: str = "parquet", reads_target: bool = True, by_rename: bool = True, **options) -> None:
    """Overwrite ``path``; ``df`` may read it itself unless ``reads_target`` is off.

    The new files are written beside the old ones and take their place when complete, by renames, whatever the store.
    One that copies on a rename copies every byte then: ``by_rename=False`` writes straight to ``path`` (by way of the
    shared folder if the rows are read from it), and a job that stops leaves part of the rows. Snapshot tables
    (``sinks.snapshots``) need neither.
    """
    spark = df.sparkSession
    if by_rename:
        restore(spark, path)
        staged = staging_path(path)
        write_files(df, staged, format, mode="errorifexists", **options)
        publish(spark, staged, path)
        return
    kept = None
    if reads_target:
        kept = work_path(spark, "replace")
        write_files(df, kept)
        df = spark.read.schema(df.schema).parquet(kept)
    write_files(df, path, format, mode="overwrite", **options)
    if kept:
        delete_path(spark, kept)


def truncate_files(df: DataFrame, path: str, format: str = "parquet", reads_target: bool = True, **options) -> None:
    """Replace the rows of ``path`` but keep its columns and types; columns ``df`` lacks become NULL."""
    reader = df.sparkSession.read.format("json" if format == "jsonl" else format)
    schema = reader.options(**_FORMAT_OPTIONS[format]).load(path).schema
    fitted = [
        (col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    extra = [c for c in df.columns if c not in schema.names]
    if extra:
        raise SpecError(f"the target has no columns {', '.join(extra)}; overwrite it to change its schema")
    replace_files(df.select(*fitted), path, format, reads_target=reads_target, **options)


def layouts(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """(whether ``path`` holds numbered runs, whether it holds other data)."""
    fs, inside = hadoop_path(spark, path.rstrip("/") + "/_run=*")
    plain = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/[^_.]*")
    return bool(fs.globStatus(inside)), bool(fs.globStatus(plain))


def write_run(df: DataFrame, path: str, run: int | str, format: str = "parquet", **options) -> None:
    """Append as run ``run``. Repeating a run replaces what it wrote before, so retries add no duplicates.

    Refused where other files lie beside the runs: readers of the one layout do not see the other.
    """
    if layouts(df.sparkSession, path)[1]:
        raise SpecError(f"{path} holds files outside numbered runs; read_runs would not see them")
    write_files(df, f"{path.rstrip('/')}/_run={run}", format, mode="overwrite", **options)


def read_runs(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Rows of all runs below ``path``; refused if other files lie beside them."""
    if all(layouts(spark, path)):
        raise SpecError(f"{path} holds numbered runs and other files")
    reader = spark.read.format("json" if format == "jsonl" else format).options(**_FORMAT_OPTIONS[format])
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df.drop("_run")



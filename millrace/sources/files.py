"""File and object-store scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..errors import SpecError
from ..session import hadoop_path

# JSON and CSV keep microseconds and zone-free timestamps only when told to.
NTZ_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
TEXT_OPTIONS = {
    "timestampNTZFormat": NTZ_FORMAT,
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
}
_FORMAT_OPTIONS = {
    "parquet": {},
    "avro": {},
    "csv": {"header": True, "multiLine": True, "escape": '"', **TEXT_OPTIONS},
    "json": {"multiLine": True, **TEXT_OPTIONS},
    "jsonl": dict(TEXT_OPTIONS),
}
_NO_FILES = "UNABLE_TO_INFER_SCHEMA"


def read_files(
    spark: SparkSession,
    path: str | Sequence[str],
    format: str = "parquet",
    glob: str = "*",
    schema: T.StructType | str | None = None,
    recursive: bool = False,
    skip_bad: bool = False,
    merge_schema: bool = False,
    options: Mapping[str, object] | None = None,
    missing_ok: bool = False,
) -> DataFrame:
    """Rows of a file, or of the files of a directory whose names match ``glob``.

    ``json`` is one document per file (an array gives a row per element, an object one row) and cannot be split;
    ``jsonl`` is one object per line. Pass a ``schema`` for large text inputs: without one Spark reads them an extra
    time to infer it. CSV fields may hold line breaks; for files known not to, ``options={"multiLine": False}``
    makes them splittable. A directory without matching files gives an empty DataFrame with ``schema``; a path that
    does not exist is an error unless ``missing_ok``, which reads what exists. Unreadable files and malformed JSON fail;
    ``skip_bad`` leaves out such files and lines. To keep malformed lines apart, name a string column of ``schema`` for
    them: ``options={"mode": "PERMISSIVE", "columnNameOfCorruptRecord": ...}``.
    """
    format = format.lower()
    if format not in _FORMAT_OPTIONS:
        raise SpecError(f"unsupported file format {format!r}; one of {', '.join(_FORMAT_OPTIONS)}")
    reader = spark.read.format("json" if format == "jsonl" else format).options(**_FORMAT_OPTIONS[format])
    if glob != "*":
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if merge_schema:
        reader = reader.option("mergeSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    elif format == "csv":
        reader = reader.option("inferSchema", True)
    if skip_bad:
        reader = reader.option("ignoreCorruptFiles", True)
        if format not in ("parquet", "avro"):
            reader = reader.option("mode", "DROPMALFORMED")
    elif format in ("json", "jsonl"):
        reader = reader.option("mode", "FAILFAST")
    reader = reader.options(**(options or {}))
    paths = [path] if isinstance(path, str) else list(path)
    if missing_ok:
        paths = [p for p in paths if _matches(spark, p)]
    try:
        if paths:
            return reader.load(paths)
    except AnalysisException as error:
        if error.getCondition() != _NO_FILES:
            raise
    empty = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.createDataFrame([], empty or T.StructType([]))


def _matches(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a pattern of paths, leads to anything."""
    fs, jpath = hadoop_path(spark, path)
    return bool(fs.globStatus(jpath))


def s3_options(config: Mapping[str, object]) -> dict[str, str]:
    """Reader or writer options for the credentials and region of an object-store config."""
    if bool(config.get("aws_access_key_id")) != bool(config.get("aws_secret_access_key")):
        raise SpecError("aws_access_key_id and aws_secret_access_key go together")
    names = {
        "aws_access_key_id": "fs.s3a.access.key",
        "aws_secret_access_key": "fs.s3a.secret.key",
        "region": "fs.s3a.endpoint.region",
    }
    return {option: str(config[key]) for key, option in names.items() if config.get(key)}


def prefix_path(bucket: str, prefix: str | None = None, stream: str | None = None, scheme: str = "s3a://") -> str:
    """URL of a stream below a prefix of a bucket."""
    parts = [part.strip("/") for part in (prefix, stream) if part and part.strip("/")]
    return "/".join([f"{scheme}{bucket.rstrip('/')}", *parts])


def read_prefix(
    spark: SparkSession,
    bucket: str,
    prefix: str | None = None,
    stream: str | None = None,
    format: str = "parquet",
    glob: str = "*",
    schema: T.StructType | str | None = None,
    skip_bad: bool = False,
    scheme: str = "s3a://",
    credentials: Mapping[str, object] | None = None,
    options: Mapping[str, object] | None = None,
    merge_schema: bool = False,
    missing_ok: bool = False,
) -> DataFrame:
    """Every object below ``prefix/stream``, at any depth. Unreadable objects fail the read unless ``skip_bad``."""
    if format not in ("parquet", "csv", "json", "jsonl"):
        raise SpecError(f"unsupported object format {format!r}")
    return read_files(
        spark,
        prefix_path(bucket, prefix, stream, scheme),
        format,
        glob=glob,
        schema=schema,
        recursive=True,
        skip_bad=skip_bad,
        merge_schema=merge_schema,
        options={**s3_options(credentials or {}), **(options or {})},
        missing_ok=missing_ok,
    )


def read_json_values(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """JSON documents of any shape as a VARIANT column ``value``: a scalar document is a row like any other."""
    text = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    return text.select(F.try_parse_json("value").alias("value")).where(F.col("value").isNotNull())


def read_raw(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files of an unknown format, one row each, as bytes in ``raw``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("content").alias("raw"))

import json
from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from conftest import SF, plan, rows

from millrace.errors import MissingConnectorError, SpecError
from millrace.sources import (
    jdbc_options,
    mongo_predicate,
    read_files,
    read_json_values,
    read_prefix,
    read_raw,
    read_singer,
    read_singer_state,
    read_vendor,
    record_count,
    s3_options,
    singer_schema,
    stamp,
    vendor_options,
)
from millrace.sources.files import prefix_path
from millrace.sources.jdbc import CATALOG_QUERIES, read_options
from millrace.sources.vendor import vendor_read_options


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    return str(folder / name)


def test_csv_infers_types_and_missing_cells(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'id,name,score\n1,"two\nlines, ""quoted""",2.5\n2,,\n')
    df = read_files(spark, path, "csv")
    assert dict(df.dtypes) == {"id": "int", "name": "string", "score": "double"}
    assert rows(df) == [(1, 'two\nlines, "quoted"', 2.5), (2, None, None)]


def test_json_arrays_objects_and_ragged_keys(spark, tmp_path):
    put(tmp_path / "j", "a.json", '[{"a": 1}, {"a": 2, "b": "x"}]')
    put(tmp_path / "j", "b.json", '{"a": 3,\n "c": true}')
    assert rows(read_files(spark, str(tmp_path / "j"), "json"), "a", "b", "c") == [(1, None, None), (2, "x", None), (3, None, True)]


def test_jsonl_blank_and_broken_lines(spark, tmp_path):
    put(tmp_path / "l", "a.jsonl", '{"a": 1}\n\n{"a": \n{"a": 2}\n')
    assert rows(read_files(spark, str(tmp_path / "l"), "jsonl", schema="a long", skip_bad=True)) == [(1,), (2,)]


def test_glob_directory_and_nothing_there(spark, tmp_path):
    for n in (1, 2):
        put(tmp_path / "d", f"p{n}.jsonl", f'{{"a": {n}}}')
    put(tmp_path / "d", "q.txt", "no json")
    assert rows(read_files(spark, str(tmp_path / "d"), "jsonl", glob="p*")) == [(1,), (2,)]
    nothing = str(tmp_path / "none")
    empty = read_files(spark, nothing, "parquet", schema="a long, b string", missing_ok=True)
    assert empty.columns == ["a", "b"] and empty.count() == 0
    for absent in (nothing, [str(tmp_path / "d"), nothing]):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            read_files(spark, absent, "jsonl", glob="p*", schema="a long").collect()
    assert rows(read_files(spark, [str(tmp_path / "d"), nothing], "jsonl", glob="p*", schema="a long", missing_ok=True)) == [(1,), (2,)]
    assert read_files(spark, str(tmp_path / "d"), "parquet", glob="*.parquet", schema="a long").count() == 0
    with pytest.raises(SpecError):
        read_files(spark, str(tmp_path), "xml")


def test_merged_parquet_schemas(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "m" / "one"))
    spark.range(2).selectExpr("id", "'x' AS tag").write.parquet(str(tmp_path / "m" / "two"))
    df = read_files(spark, str(tmp_path / "m"), recursive=True, merge_schema=True)
    assert sorted(df.columns) == ["id", "tag"] and df.count() == 4


def test_prefix_reads_every_level_and_skips_bad_objects(spark, tmp_path):
    base = tmp_path / "bucket" / "landing" / "s"
    spark.range(3).write.parquet(str(base / "2024" / "01"))
    spark.range(2).write.parquet(str(base / "2024" / "02"))
    put(base, "broken.parquet", "not parquet at all")
    df = read_prefix(spark, str(tmp_path / "bucket"), "landing", "s", scheme="", schema="id long", skip_bad=True)
    assert df.count() == 5
    with pytest.raises(Exception):
        read_prefix(spark, str(tmp_path / "bucket"), "landing", "s", scheme="", schema="id long").collect()


def test_malformed_json_fails_or_is_kept_apart(spark, tmp_path):
    path = put(tmp_path, "a.jsonl", '{"id": 1}\n{"id": "two"}\n{"id": 3}\n')
    with pytest.raises(Exception, match="MALFORMED"):
        read_files(spark, path, "jsonl", schema="id long").collect()
    apart = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}
    assert rows(read_files(spark, path, "jsonl", schema="id long, bad string", options=apart)) == [(1, None), (3, None), (None, '{"id": "two"}')]


def test_prefix_urls_and_credentials():
    assert prefix_path("b", "p/", "/s") == "s3a://b/p/s"
    assert prefix_path("b") == "s3a://b"
    assert s3_options({"aws_access_key_id": "k", "aws_secret_access_key": "s", "region": "eu-west-1"}) == {
        "fs.s3a.access.key": "k",
        "fs.s3a.secret.key": "s",
        "fs.s3a.endpoint.region": "eu-west-1",
    }
    with pytest.raises(SpecError):
        s3_options({"aws_access_key_id": "k"})


def test_scalar_documents_and_raw_bytes(spark, tmp_path):
    put(tmp_path / "v", "a.json", "42")
    put(tmp_path / "v", "b.json", '{"k": [1]}')
    put(tmp_path / "v", "c.json", "{broken")
    values = read_json_values(spark, str(tmp_path / "v"))
    assert sorted(r[0] for r in values.selectExpr("to_json(value)").collect()) == ["42", '{"k":[1]}']
    put(tmp_path / "r", "x.bin", "\x01\x02")
    assert [bytes(r["raw"]) for r in read_raw(spark, str(tmp_path / "r")).collect()] == [b"\x01\x02"]


LOG = [
    {"type": "SCHEMA", "stream": "u", "schema": {"properties": {"id": {"type": ["null", "integer"]}, "n": {"type": "number"}, "o": {"type": "object"}, "d": {"type": "string", "format": "date-time"}}}, "key_properties": ["id"]},
    {"type": "RECORD", "stream": "u", "record": {"id": 1, "n": 1.5, "o": {"k": 1}, "d": "2024-01-02T03:04:05Z"}},
    {"type": "STATE", "value": {"at": 1}},
    {"type": "RECORD", "stream": "w", "record": {"id": 9}},
    {"type": "RECORD", "stream": "u", "record": {"id": 2}},
    {"type": "STATE", "value": {"at": 2}},
]


def test_singer_log(spark, tmp_path):
    path = put(tmp_path / "log", "a.jsonl", "\n".join(["{oops", "", *map(json.dumps, LOG), '"text"']))
    schema = singer_schema(spark, path, "u")
    assert [f.dataType.simpleString() for f in schema] == ["bigint", "double", "string", "timestamp"]
    got = rows(read_singer(spark, path, "u"), "id", "n", "o")
    assert got == [(1, 1.5, '{"k":1}'), (2, None, None)]
    assert rows(read_singer(spark, path, "w", "id long")) == [(9,)]
    assert json.loads(read_singer_state(spark, path)) == {"at": 2}
    with pytest.raises(SpecError):
        read_singer(spark, path, "nope")


def test_envelope_and_counts(spark):
    moment = datetime(2024, 5, 6, tzinfo=timezone.utc)
    df = stamp(spark.range(2), "s", moment)
    assert [r["_stream"] for r in df.collect()] == ["s", "s"]
    assert df.select("_extracted_at").distinct().count() == 1
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    counted = record_count({"a": lines, "b": spark.range(7)})
    assert dict(rows(counted)) == {"a": 6000, "b": 7}
    assert "ReadSchema: struct<>" in plan(counted)


def test_jdbc_options():
    pg = {"type": "postgresql", "host": "h", "database": "d", "user": "u", "password": "p", "table_name": "t", "schema": "s"}
    assert read_options(pg) == {
        "url": "jdbc:postgresql://h:5432/d", "driver": "org.postgresql.Driver", "user": "u", "password": "p",
        "dbtable": "s.t", "fetchsize": "1000", "preferTimestampNTZ": "true",
    }
    query = read_options({**pg, "query": "SELECT 1", "batch_size": 5})
    assert query["query"] == "SELECT 1" and "dbtable" not in query and query["fetchsize"] == "5"
    split = read_options({**pg, "query": "SELECT 1", "partition_column": "id", "lower_bound": 0, "upper_bound": 9, "num_partitions": 3})
    assert split["dbtable"] == "(SELECT 1) src" and split["numPartitions"] == "3" and "query" not in split
    assert jdbc_options({"type": "mysql", "host": "h", "database": "d"})["url"] == "jdbc:mysql://h:3306/d"
    assert jdbc_options({"type": "mssql", "host": "h", "port": 1, "database": "d"})["url"] == "jdbc:sqlserver://h:1;databaseName=d"
    assert jdbc_options({"type": "oracle", "dsn": "x:1521/y"})["url"] == "jdbc:oracle:thin:@x:1521/y"
    assert set(CATALOG_QUERIES) == {"postgresql", "mysql", "mssql", "oracle"}
    for bad in ({"type": "db2"}, {"type": "mysql", "host": "h"}):
        with pytest.raises(SpecError):
            jdbc_options(bad)
    with pytest.raises(SpecError):
        read_options({**pg, "table_name": None})
    with pytest.raises(SpecError):
        read_options({**pg, "partition_column": "id"})


def test_vendor_options():
    mongo = {"type": "mongodb", "host": "h", "database": "d", "stream": "c", "username": "u", "password": "p", "auth_source": "admin"}
    assert vendor_options(mongo) == {"connection.uri": "mongodb://u:p@h:27017/?authSource=admin", "database": "d", "collection": "c"}
    assert json.loads(vendor_read_options({**mongo, "query": {"a": 1}})["aggregation.pipeline"]) == [{"$match": {"a": 1}}]
    snow = {"type": "snowflake", "account": "a", "username": "u", "password": "p", "database": "d", "schema": "s", "table": "t", "role": "r"}
    assert vendor_options(snow)["sfURL"] == "a.snowflakecomputing.com" and vendor_options(snow)["sfRole"] == "r"
    assert "dbtable" not in vendor_read_options({**snow, "query": "SELECT 1"})
    big = {"type": "bigquery", "project_id": "p", "dataset_id": "d", "name": "t"}
    assert vendor_options(big)["table"] == "p.d.t"
    assert vendor_read_options({**big, "query": "SELECT 1"})["viewsEnabled"] == "true"
    for bad in ({**mongo, "password": None}, {**mongo, "stream": None}, {"type": "redis"}, {**snow, "account": None}):
        with pytest.raises(SpecError):
            vendor_options(bad)


def test_missing_vendor_connector_is_named(spark):
    with pytest.raises(MissingConnectorError, match="bigquery"):
        read_vendor(spark, {"type": "bigquery", "project_id": "p", "dataset_id": "d", "table": "t"})


def test_document_filters(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "n long, s string")

    def kept(query):
        return [r[0] for r in rows(df.where(mongo_predicate(query)), "n")]

    assert kept({}) == [1, 2, 3]
    assert kept({"s": None}) == [2]
    assert kept({"n": {"$gt": 1, "$lte": 3}}) == [2, 3]
    assert kept({"s": {"$ne": "x"}}) == [2, 3]
    assert kept({"s": {"$nin": ["x"]}}) == [2, 3]
    assert kept({"s": {"$exists": True}}) == [1, 3]
    assert kept({"$or": [{"n": 1}, {"s": "y"}]}) == [1, 3]
    with pytest.raises(SpecError):
        mongo_predicate({"s": {"$regex": "x"}})


def test_avro_needs_its_package(spark, tmp_path):
    try:
        spark.range(1).write.format("avro").save(str(tmp_path / "probe"))
    except Exception:
        pytest.skip("spark-avro is not on the class path")
    from millrace.sinks import write_files

    write_files(spark.range(3), str(tmp_path / "a"), "avro")
    assert read_files(spark, str(tmp_path / "a"), "avro").count() == 3


def test_all_types_survive_each_format(spark, tmp_path):
    from millrace.sinks import write_files

    df = spark.createDataFrame(
        [(1, 1.5, "a\n\"b\", c", True, date(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5, 678901), Decimal("1.25"), [1, 2], b"\x00\xff"), (None,) * 9],
        "l long, d double, s string, b boolean, t date, n timestamp_ntz, m decimal(10,2), v array<long>, y binary",
    )
    for format in ("parquet", "jsonl", "json"):
        path = str(tmp_path / format)
        write_files(df, path, format)
        assert rows(read_files(spark, path, format, schema=df.schema)) == rows(df), format
    flat = df.drop("v", "y")
    write_files(flat, str(tmp_path / "csv"), "csv")
    assert rows(read_files(spark, str(tmp_path / "csv"), "csv", schema=flat.schema)) == rows(flat)

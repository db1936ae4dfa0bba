from conftest import rows

from millrace.sinks import read_runs, write_files
from millrace.streaming import run_arriving_files


def test_each_file_is_taken_once(spark, where):
    landing, target, checkpoint = where("landing"), where("target"), where("checkpoint")
    chain = {"transformers": [{"type": "filter_rows", "config": {"predicate": "id != 1"}}]}
    for n in (3, 5):
        write_files(spark.range(n), landing)
        run_arriving_files(spark, landing, "id long", target, checkpoint, chain, max_files=1)
    run_arriving_files(spark, landing, "id long", target, checkpoint, chain)
    assert [r[0] for r in rows(read_runs(spark, target))] == [0, 0, 2, 2, 3, 4]


def test_a_new_checkpoint_replaces_nothing(spark, where):
    for n in (1, 2):
        landing = where(f"landing{n}")
        write_files(spark.range(n), landing)
        run_arriving_files(spark, landing, "id long", where("target"), where(f"checkpoint{n}"))
    assert [r[0] for r in rows(read_runs(spark, where("target")))] == [0, 0, 1]


def test_arriving_rows_can_be_upserted(spark, where):
    landing, target = where("landing"), where("target")
    for tag in ("a", "b"):
        write_files(spark.range(2).selectExpr("id", f"'{tag}' AS tag"), landing, "jsonl")
        run_arriving_files(spark, landing, "id long, tag string", target, where("cp"), format="jsonl", keys=("id",), order_by=("tag",))
    assert rows(spark.read.parquet(target)) == [(0, "b"), (1, "b")]


def test_sql_runs_on_each_micro_batch(spark, where):
    landing, target = where("landing"), where("target")
    sql = {"type": "duckdb_sql_transformer", "config": {"sql_query": "SELECT id % 2 AS odd, count(*) AS n FROM data GROUP BY 1"}}
    for n in (4, 3):
        write_files(spark.range(0, n, 1, 1), landing)
        run_arriving_files(spark, landing, "id long", target, where("cp"), {"transformers": [sql]})
    assert rows(read_runs(spark, target)) == [(0, 2), (0, 2), (1, 1), (1, 2)]


def test_partitioned_upserts_of_arriving_rows(spark, where):
    landing, target = where("landing"), where("target")
    for batch in ([("a", 1, 1), ("b", 1, 1)], [("a", 1, 5), ("a", 2, 2)]):
        write_files(spark.createDataFrame(batch, "p string, k long, v long"), landing)
        run_arriving_files(
            spark, landing, "p string, k long, v long", target, where("cp"), keys=("p", "k"), order_by=("v",), partition_by=("p",)
        )
    assert rows(spark.read.parquet(target), "p", "k", "v") == [("a", 1, 5), ("a", 2, 2), ("b", 1, 1)]

"""Intermediate tables in the shared folder, and the documents as the operators see them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.session import delete_path, work_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read again: lineage ends there, and lost executors cost no rework."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged = path
    return back


def forget(*frames: DataFrame) -> None:
    """Delete written tables that no returned frame reads."""
    for df in frames:
        delete_path(df.sparkSession, df._staged)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so other columns can't clash."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts(spark: SparkSession, total_bytes: float, each: float) -> int:
    """How many tasks share ``total_bytes`` when each takes about ``each``; not under the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total_bytes / each), 1)

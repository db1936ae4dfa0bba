"""Arbitrary Spark SQL over the incoming rows and any further named DataFrames."""

from __future__ import annotations

import re
import threading
from collections.abc import Mapping
from contextlib import contextmanager

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from ..errors import SpecError

# Constructs of another SQL dialect users may bring along, and what Spark SQL offers instead.
DIALECT_HINTS = {
    r"\bqualify\b": "wrap the window in a subquery and filter outside it",
    r"\*\s*exclude\b": "write * EXCEPT (...)",
    r"\basof\s+(left\s+)?join\b": "use millrace.operators.asof_join",
    r"\bstrftime\s*\(": "use date_format",
    r"\blist\s*\(": "use collect_list or array_agg",
    r"\barg_max\s*\(": "use max_by",
    r"\barg_min\s*\(": "use min_by",
    r"\bjson_extract_string\s*\(": "use get_json_object",
    r"\bby\s+name\b": "use DataFrame.unionByName",
    r"//": "use floor(a / b) or div",
}
_POSITIONAL = re.compile(r"\bpositional\s+join\b", re.IGNORECASE)
_VIEWS = threading.Lock()


@contextmanager
def _temp_views(spark: SparkSession, frames: Mapping[str, DataFrame]):
    """Frames visible as temp views while a statement is analysed; views of the same names come back after."""
    with _VIEWS:
        before = {}
        for name, frame in frames.items():
            if spark.catalog.tableExists(name) and spark.catalog.getTable(name).isTemporary:
                before[name] = spark.table(name)
            frame.createOrReplaceTempView(name)
        try:
            yield
        finally:
            for name in frames:
                spark.catalog.dropTempView(name)
            for name, frame in before.items():
                frame.createOrReplaceTempView(name)


def sql_transform(
    df: DataFrame,
    sql_query: str,
    tables: Mapping[str, DataFrame] | None = None,
    empty_input: str = "run",
) -> DataFrame:
    """Result of ``sql_query``, in which the incoming rows are called ``data`` (or ``input``).

    ``tables`` adds named DataFrames for joins. With ``empty_input="skip"`` a query that would return rows on no
    input (a global aggregate, say) returns none: the plan itself looks for one row, when the result is computed.
    """
    if empty_input not in ("run", "skip"):
        raise SpecError(f"empty_input must be run or skip, not {empty_input!r}")
    if _POSITIONAL.search(sql_query):
        raise SpecError("POSITIONAL JOIN has no meaning on distributed rows; join on a key instead")
    spark = df.sparkSession
    with _temp_views(spark, {"data": df, "input": df, **(tables or {})}):
        try:
            result = spark.sql(sql_query)
        except (ParseException, AnalysisException) as error:
            hints = [hint for pattern, hint in DIALECT_HINTS.items() if re.search(pattern, sql_query, re.IGNORECASE)]
            if hints:
                raise SpecError(f"{error}\nHint: {'; '.join(hints)}") from error
            raise
    return result.where(df.exists()) if empty_input == "skip" else result

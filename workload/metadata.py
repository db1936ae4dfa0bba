"""Discovery and catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import check_foreign_keys, discover, discover_documents, erd_edges, erd_nodes, list_tables, totals
from millrace.session import local_frame
from millrace.types import source_logical_type_column

from .registry import query, table
from .scans import TABLES

KEYS = {
    "region": {"primary_key": ["r_regionkey"]},
    "nation": {"primary_key": ["n_nationkey"], "foreign_keys": {"n_regionkey": "region.r_regionkey"}},
    "customer": {"primary_key": ["c_custkey"], "foreign_keys": {"c_nationkey": "nation.n_nationkey"}},
    "supplier": {"primary_key": ["s_suppkey"], "foreign_keys": {"s_nationkey": "nation.n_nationkey"}},
    "part": {"primary_key": ["p_partkey"]},
    "orders": {"primary_key": ["o_orderkey"], "foreign_keys": {"o_custkey": "customer.c_custkey"}},
    "lineitem": {
        "primary_key": ["l_orderkey", "l_linenumber"],
        "foreign_keys": {"l_orderkey": "orders.o_orderkey", "l_partkey": "part.p_partkey", "l_suppkey": "no_table"},
    },
    "labels": {"foreign_keys": {"doc_id": "documents.doc_id"}},
    "documents": {"primary_key": ["doc_id"]},
}
EDGES = [
    (t, c, *fk.split(".", 1)) for t, k in KEYS.items() for c, fk in k.get("foreign_keys", {}).items() if "." in fk
]

_NAMES = ", ".join(f"'{t}'" for t in TABLES)
_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in TABLES)
_LOGICAL = """
    CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') THEN 'integer'
         WHEN data_type IN ('DOUBLE', 'FLOAT') OR data_type LIKE 'DECIMAL%' THEN 'float'
         WHEN data_type = 'BOOLEAN' THEN 'boolean' WHEN data_type = 'DATE' THEN 'date'
         WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' WHEN data_type LIKE '%[]' THEN 'json' ELSE 'string' END
"""
_COLUMNS = f"""
    SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS ordinal, {_LOGICAL} AS data_type
    FROM information_schema.columns WHERE table_name IN ({_NAMES})
"""


def _tables(spark, sf):
    return {t: table(spark, sf, t) for t in TABLES}


def _catalogue(spark, sf):
    return discover(spark, _tables(spark, sf), keys=KEYS)


def _key_sql(kind):
    rows = []
    for name, facts in KEYS.items():
        if kind == "primary":
            rows += [(name, c) for c in facts.get("primary_key", [])]
    return ", ".join(f"('{t}', '{c}')" for t, c in rows)


@query(
    "cat_discover",
    f"""
    SELECT c.table_name, c.column_name, c.ordinal, c.data_type, k.t IS NOT NULL AS primary_key, n.row_count
    FROM ({_COLUMNS}) c JOIN ({_COUNTS}) n ON c.table_name = n.table_name
    LEFT JOIN (VALUES {_key_sql("primary")}) k(t, col) ON k.t = c.table_name AND k.col = c.column_name
    """,
)
def cat_discover(spark, sf):
    return _catalogue(spark, sf).select("table_name", "column_name", "ordinal", "data_type", "primary_key", "row_count")


@query(
    "cat_tables",
    f"""
    SELECT c.table_name, n.row_count, COUNT(*) AS column_count
    FROM ({_COLUMNS}) c JOIN ({_COUNTS}) n ON c.table_name = n.table_name GROUP BY c.table_name, n.row_count
    """,
)
def cat_tables(spark, sf):
    return list_tables(_catalogue(spark, sf)).drop("schema_name")


@query(
    "cat_totals",
    f"""
    SELECT (SELECT COUNT(DISTINCT table_name) FROM ({_COLUMNS})) AS total_tables,
           (SELECT COUNT(*) FROM ({_COLUMNS})) AS total_columns,
           (SELECT CAST(SUM(row_count) AS BIGINT) FROM ({_COUNTS})) AS total_rows
    """,
)
def cat_totals(spark, sf):
    return totals(_catalogue(spark, sf))


@query(
    "cat_type_map",
    f"""
    SELECT c.table_name, c.column_name,
           CASE c.data_type WHEN 'json' THEN 'string' ELSE c.data_type END AS logical_type, n.row_count
    FROM ({_COLUMNS}) c JOIN ({_COUNTS}) n ON c.table_name = n.table_name
    """,
)
def cat_type_map(spark, sf):
    """Logical types from the type names alone, by the rules for databases of no known kind."""
    tables = _tables(spark, sf)
    names = [(t, c, kind) for t, df in tables.items() for c, kind in df.dtypes]
    physical = local_frame(spark, names, "table_name string, column_name string, type_name string")
    mapped = physical.withColumn("logical_type", source_logical_type_column(F.col("type_name"), "generic"))
    return mapped.drop("type_name").join(list_tables(discover(spark, tables)), "table_name").select(
        "table_name", "column_name", "logical_type", "row_count"
    )


@query(
    "cat_documents",
    """
    SELECT key, CASE WHEN t IN ('UBIGINT', 'BIGINT') THEN 'integer' WHEN t = 'DOUBLE' THEN 'float' WHEN t = 'BOOLEAN' THEN 'boolean'
                     WHEN t IN ('OBJECT', 'ARRAY') THEN 'json' WHEN t = 'NULL' THEN 'null' ELSE 'string' END AS data_type,
           COUNT(*) AS documents
    FROM (SELECT key, json_type(props, '$.' || key) AS t FROM (SELECT props, unnest(json_keys(props)) AS key FROM events)) k
    GROUP BY 1, 2
    """,
)
def cat_documents(spark, sf):
    return discover_documents(table(spark, sf, "events"), "props")


@query(
    "cat_erd_nodes",
    f"""
    SELECT c.table_name AS id, c.table_name AS label, n.row_count, COUNT(*) AS columns,
           coalesce(string_agg(k.col, ',' ORDER BY c.ordinal), '') AS primary_keys
    FROM ({_COLUMNS}) c JOIN ({_COUNTS}) n ON c.table_name = n.table_name
    LEFT JOIN (VALUES {_key_sql("primary")}) k(t, col) ON k.t = c.table_name AND k.col = c.column_name
    GROUP BY c.table_name, n.row_count
    """,
)
def cat_erd_nodes(spark, sf):
    return erd_nodes(_catalogue(spark, sf)).withColumn("primary_keys", F.array_join("primary_keys", ","))


@query(
    "cat_erd_edges",
    " UNION ALL ".join(
        f"""
    SELECT '{s}.{sc}-{t}.{tc}' AS id, '{s}' AS source, '{t}' AS target, '{sc}' AS source_column, '{tc}' AS target_column,
           COUNT({sc}) AS "rows", COUNT(*) FILTER (WHERE {sc} IS NOT NULL AND {sc} NOT IN (SELECT {tc} FROM {t})) AS orphans
    FROM {s}"""
        for s, sc, t, tc in EDGES
    ),
)
def cat_erd_edges(spark, sf):
    """Edges of the diagram, each with the rows that use it and those pointing nowhere."""
    tables = _tables(spark, sf)
    used = check_foreign_keys(tables, EDGES)
    return erd_edges(discover(spark, tables, keys=KEYS, counts=False)).join(used, ["source", "source_column", "target", "target_column"])

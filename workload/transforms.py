"""Transforms and chains."""

from __future__ import annotations

import json

from millrace.operators import (
    add_constant,
    apply_chain,
    compute_expression,
    custom_batch,
    custom_record,
    drop_fields,
    filter_rows,
    noop,
    rename_fields,
    type_cast,
)

from .registry import query, table


@query("tr_noop", "SELECT * FROM customer")
def tr_noop(spark, sf):
    return noop(table(spark, sf, "customer"))


@query("tr_drop_fields", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")
def tr_drop_fields(spark, sf):
    return drop_fields(table(spark, sf, "orders"), ["o_totalprice", "o_orderpriority", "not_there"])


@query(
    "tr_rename_fields",
    "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
)
def tr_rename_fields(spark, sf):
    return rename_fields(table(spark, sf, "orders"), {"o_orderkey": "order_id", "gone": "x", "o_custkey": "customer_id"})


@query("tr_rename_collision", "SELECT c_custkey, c_nationkey, c_acctbal, c_name AS c_mktsegment FROM customer")
def tr_rename_collision(spark, sf):
    return rename_fields(table(spark, sf, "customer"), {"c_name": "c_mktsegment"})


@query("tr_filter_rows", "SELECT * FROM lineitem WHERE l_quantity >= 30 AND (l_returnflag = 'R' OR l_discount > 0.05)")
def tr_filter_rows(spark, sf):
    return filter_rows(table(spark, sf, "lineitem"), "l_quantity >= 30 and (l_returnflag == 'R' or l_discount > 0.05)")


@query("tr_add_constant", "SELECT *, 'batch' AS origin, 7::BIGINT AS version, 2.5::DOUBLE AS weight, TRUE AS active FROM orders")
def tr_add_constant(spark, sf):
    df = table(spark, sf, "orders")
    for field, value in (("origin", "batch"), ("version", 7), ("weight", 2.5), ("active", True)):
        df = add_constant(df, field, value)
    return df


@query(
    "tr_compute_expression",
    """
    SELECT l_orderkey, l_linenumber,
           l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
           (l_partkey - 7 * floor(l_partkey / 7.0))::BIGINT AS part_group,
           (-floor(-l_partkey / 2.0))::BIGINT AS half_up,
           CASE WHEN l_quantity > 25 THEN 'bulk-' || lower(l_returnflag) ELSE 'unit' END AS size_class,
           l_returnflag IN ('A', 'R') AND NOT l_linestatus = 'F' AS open_return
    FROM lineitem
    """,
)
def tr_compute_expression(spark, sf):
    df = table(spark, sf, "lineitem")
    df = compute_expression(df, "charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)")
    df = compute_expression(df, "part_group", "l_partkey % 7")
    df = compute_expression(df, "half_up", "-(-l_partkey // 2)")
    df = compute_expression(df, "size_class", "'bulk-' + l_returnflag.lower() if l_quantity > 25 else 'unit'")
    df = compute_expression(df, "open_return", "l_returnflag in ['A', 'R'] and not l_linestatus == 'F'")
    return df.select("l_orderkey", "l_linenumber", "charge", "part_group", "half_up", "size_class", "open_return")


@query(
    "tr_compute_division_by_zero",
    """
    SELECT l_orderkey, l_linenumber, l_discount,
           CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END AS ratio,
           CASE WHEN l_discount = 0 THEN l_extendedprice ELSE l_tax / l_discount END AS l_extendedprice
    FROM lineitem
    """,
)
def tr_compute_division_by_zero(spark, sf):
    df = compute_expression(table(spark, sf, "lineitem"), "ratio", "l_extendedprice / l_discount")
    df = compute_expression(df, "l_extendedprice", "l_tax / l_discount")  # rows that fail keep their value
    return df.select("l_orderkey", "l_linenumber", "l_discount", "ratio", "l_extendedprice")


@query(
    "tr_type_cast",
    """
    SELECT event_id::VARCHAR AS event_id, user_id::DOUBLE AS user_id, trunc(value)::BIGINT AS value,
           length(event_type) > 0 AS event_type, ts, props
    FROM events
    """,
)
def tr_type_cast(spark, sf):
    casts = {"event_id": "str", "user_id": "float", "value": "int", "event_type": "bool", "ts": "unknown", "gone": "int"}
    return type_cast(table(spark, sf, "events"), casts)


@query(
    "tr_type_cast_bad",
    """
    SELECT event_id, TRY_CAST(event_type AS BIGINT) AS event_type, event_type AS event_type_kept,
           trunc(value)::BIGINT AS value
    FROM events
    """,
)
def tr_type_cast_bad(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "event_type", "value").toDF(
        "event_id", "event_type", "event_type_kept", "value"
    )
    typed = type_cast(events, {"event_type": "int", "value": "int"})
    return type_cast(typed, {"event_type_kept": "int"}, on_error="keep")


def _read_props(record):
    if record["event_type"] == "click":
        return None
    return {"event_id": record["event_id"], "k": json.loads(record["props"])["k"], "kind": record["event_type"].upper()}


@query(
    "tr_custom_record",
    """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, upper(event_type) AS kind
    FROM events WHERE event_type <> 'click'
    """,
)
def tr_custom_record(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "props")
    return custom_record(events, _read_props, "event_id bigint, k bigint, kind string")


def _split_turn(records):
    for record in records:
        for position, word in enumerate(record["text"].split(" ")):
            yield {"conv_id": record["conv_id"], "turn": record["turn"], "position": position, "word": word}


@query(
    "tr_custom_batch",
    """
    SELECT conv_id, turn, (unnest(range(len(words))))::BIGINT AS position, unnest(words) AS word
    FROM (SELECT conv_id, turn, string_split(text, ' ') AS words FROM conversations)
    """,
)
def tr_custom_batch(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return custom_batch(turns, _split_turn, "conv_id bigint, turn bigint, position bigint, word string")


CHAIN = {
    "transformers": [
        {"type": "filter_rows", "config": {"predicate": "l_shipdate > DATE'1998-12-31'", "dialect": "sql"}},
        {"type": "Drop Fields", "config": {"fields": ["l_tax", "l_linestatus"]}},
        {"transformer_id": 1, "config_override": {"expression": "l_extendedprice * (1 - l_discount)"}},
        {"transformer_id": 99},
        {
            "type": "duckdb_sql_transformer",
            "config": {
                "sql_query": "SELECT l_returnflag, round(sum(revenue), 2) AS revenue, count(*) AS lines "
                "FROM data GROUP BY l_returnflag"
            },
        },
        {"type": "rename_fields", "config": {"mapping": {"l_returnflag": "flag"}}},
        {"type": "add_constant", "config": {"field": "since", "value": 1999}},
    ]
}
SAVED = {1: {"type": "compute_expression", "config": {"field": "revenue", "expression": "l_extendedprice"}}}
CHAIN_SQL = """
    SELECT l_returnflag AS flag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines,
           1999::BIGINT AS since
    FROM lineitem WHERE l_shipdate > DATE '1998-12-31' GROUP BY l_returnflag
    """


@query("tr_chain", CHAIN_SQL)
def tr_chain(spark, sf):
    return apply_chain(table(spark, sf, "lineitem"), CHAIN, SAVED)

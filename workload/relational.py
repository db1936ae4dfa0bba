"""Relational families reached through the SQL transform, and the joins composed on top."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import Segments, asof_join, asof_join_scan, exact_quantiles, interval_join, range_join, sql_transform, top_k_per_group
from millrace.session import work_path
from millrace.sinks import write_files

from .registry import query, sql_query, table

sql_query(
    "sql_project",
    "lineitem",
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net,
           CASE WHEN l_quantity >= 40 THEN 'large' WHEN l_quantity >= 20 THEN 'medium' ELSE 'small' END AS size_class,
           COALESCE(NULLIF(l_returnflag, 'N'), 'none') AS returned,
           l_quantity * 2 + 1 AS doubled
    FROM data
    """,
)

sql_query(
    "sql_filter",
    "lineitem",
    """
    SELECT * FROM data
    WHERE l_quantity BETWEEN 10 AND 30 AND l_returnflag IN ('A', 'R')
      AND (l_linestatus LIKE 'O%' OR NOT l_discount > 0.05) AND l_shipdate IS NOT NULL
      AND l_shipdate >= DATE '1996-01-01'
    """,
)

sql_query(
    "sql_join_inner",
    "orders",
    """
    SELECT r_name, n_name, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS total
    FROM data JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
         JOIN region ON n_regionkey = r_regionkey
    GROUP BY r_name, n_name
    """,
    extra=["customer", "nation", "region"],
)

sql_query(
    "sql_join_outer",
    "documents",
    """
    SELECT d.doc_id, d.lang, l.quality, l.toxic FROM data d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """,
    extra=["labels"],
)

sql_query(
    "sql_join_right",
    "orders",
    """
    SELECT c.c_custkey, COUNT(o.o_orderkey) AS orders FROM data o RIGHT JOIN customer c
      ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'
    GROUP BY c.c_custkey
    """,
    extra=["customer"],
)

sql_query(
    "sql_join_full",
    "customer",
    """
    SELECT COALESCE(c.nation, s.nation) AS nation, c.customers, s.suppliers
    FROM (SELECT c_nationkey AS nation, COUNT(*) AS customers FROM data WHERE c_acctbal < 0 GROUP BY c_nationkey) c
    FULL OUTER JOIN (SELECT s_nationkey AS nation, COUNT(*) AS suppliers FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey) s
      ON c.nation = s.nation
    """,
    extra=["supplier"],
)

sql_query(
    "sql_join_semi",
    "orders",
    """
    SELECT o_orderkey, o_orderstatus FROM data
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
      AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    """,
    extra=["lineitem", "customer"],
)

sql_query(
    "sql_join_anti",
    "customer",
    """
    SELECT c_custkey, c_name FROM data
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 200000)
    """,
    extra=["orders"],
)

MONTHS_SQL = """
    SELECT date_trunc('month', o_orderdate) AS month, MIN(o_orderdate) AS first_day, MAX(o_orderdate) AS last_day,
           COUNT(*) AS orders
    FROM orders GROUP BY 1
"""


@query(
    "sql_join_range",
    f"""
    SELECT strftime(m.month, '%Y-%m') AS month, m.orders, COUNT(*) AS shipped, SUM(l_quantity) AS quantity
    FROM lineitem JOIN ({MONTHS_SQL}) m ON l_shipdate >= m.first_day AND l_shipdate < m.last_day
    GROUP BY 1, 2
    """,
)
def sql_join_range(spark, sf):
    months = sql_transform(table(spark, sf, "orders"), MONTHS_SQL.replace("FROM orders", "FROM data"))
    lines = table(spark, sf, "lineitem").groupBy("l_shipdate").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    inside = range_join(lines, months, "l_shipdate", "first_day", "last_day", width=7 * 86400)
    return inside.groupBy(F.date_format("month", "yyyy-MM").alias("month"), "orders").agg(
        F.sum("n").alias("shipped"), F.sum("q").alias("quantity")
    )


@query(
    "asof_join",
    """
    SELECT p.event_id, p.user_id, p.ts, p.value, v.event_id AS view_event_id, v.value AS view_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts
    """,
)
def asof(spark, sf):
    events = table(spark, sf, "events")
    purchases = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    views = events.where("event_type = 'view'").select("event_id", "user_id", "ts", "value")
    return asof_join(purchases, views, ["user_id"], "ts", ["event_id", "value"], slice_width=86400, prefix="view_")


sql_query(
    "sql_group_by",
    "lineitem",
    """
    SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base,
           ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS lines, COUNT(*) FILTER (WHERE l_tax = 0) AS untaxed,
           MIN(l_shipdate) AS first_ship, MAX(l_shipdate) AS last_ship
    FROM data GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 10
    """,
)

sql_query(
    "sql_distinct",
    "lineitem",
    """
    SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(DISTINCT l_partkey) AS parts
    FROM (SELECT DISTINCT l_returnflag, l_suppkey, l_partkey FROM data) d GROUP BY l_returnflag
    """,
)

sql_query(
    "sql_cube",
    "orders",
    """
    SELECT o_orderstatus, o_orderpriority, CAST(GROUPING(o_orderstatus) AS BIGINT) AS g_status,
           CAST(GROUPING(o_orderpriority) AS BIGINT) AS g_priority, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS total
    FROM data GROUP BY CUBE (o_orderstatus, o_orderpriority)
    """,
)

sql_query(
    "sql_rollup",
    "orders",
    """
    SELECT EXTRACT(YEAR FROM o_orderdate) AS order_year, o_orderstatus, COUNT(*) AS orders
    FROM data GROUP BY ROLLUP (EXTRACT(YEAR FROM o_orderdate), o_orderstatus)
    """,
    oracle="""
    SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INTEGER) AS order_year, o_orderstatus, COUNT(*) AS orders
    FROM orders GROUP BY ROLLUP (EXTRACT(YEAR FROM o_orderdate), o_orderstatus)
    """,
)

sql_query(
    "sql_grouping_sets",
    "lineitem",
    """
    SELECT l_returnflag, l_linestatus, COUNT(*) AS lines, SUM(l_quantity) AS quantity
    FROM data GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())
    """,
)

sql_query(
    "sql_stat_aggs",
    "lineitem",
    """
    SELECT l_returnflag, MEDIAN(l_quantity) AS median_qty, percentile(l_quantity, 0.9) AS p90_qty,
           ROUND(STDDEV_SAMP(l_quantity), 6) AS sd_qty, ROUND(VAR_POP(l_discount), 8) AS var_disc,
           ROUND(CORR(l_quantity, l_discount), 6) AS correlation
    FROM data GROUP BY l_returnflag
    """,
    oracle="""
    SELECT l_returnflag, MEDIAN(l_quantity) AS median_qty, QUANTILE_CONT(l_quantity, 0.9) AS p90_qty,
           ROUND(STDDEV_SAMP(l_quantity), 6) AS sd_qty, ROUND(VAR_POP(l_discount), 8) AS var_disc,
           ROUND(CORR(l_quantity, l_discount), 6) AS correlation
    FROM lineitem GROUP BY l_returnflag
    """,
)

sql_query(
    "sql_list_aggs",
    "orders",
    """
    SELECT region, max_by(nation, orders * 1000 + nation_key) AS busiest, array_join(array_sort(collect_list(nation)), ',') AS nations
    FROM (SELECT n_regionkey AS region, n_nationkey AS nation_key, n_name AS nation, COUNT(*) AS orders
          FROM data JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
          GROUP BY n_regionkey, n_nationkey, n_name) t
    GROUP BY region
    """,
    extra=["customer", "nation"],
    oracle="""
    SELECT region, arg_max(nation, orders * 1000 + nation_key) AS busiest, string_agg(nation, ',' ORDER BY nation) AS nations
    FROM (SELECT n_regionkey AS region, n_nationkey AS nation_key, n_name AS nation, COUNT(*) AS orders
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
          GROUP BY n_regionkey, n_nationkey, n_name) t
    GROUP BY region
    """,
)


# Distinct parts are estimated to 1 % (one standard deviation). A median is right by rank: about half of the rows lie on
# either side of it, which is counted in place of an exact median, for that would hold a group's values in one task.
sql_query(
    "sql_approx",
    "lineitem",
    """
    WITH guess AS (
      SELECT l_returnflag AS flag, approx_count_distinct(l_partkey, 0.01) AS parts, approx_percentile(l_extendedprice, 0.5) AS median_price
      FROM data GROUP BY l_returnflag
    )
    SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts,
           ABS(MAX(guess.parts) - COUNT(DISTINCT l_partkey)) <= 0.05 * COUNT(DISTINCT l_partkey) AS parts_close,
           SUM(CASE WHEN l_extendedprice <= median_price THEN 1 ELSE 0 END) >= 0.49 * COUNT(l_extendedprice)
             AND SUM(CASE WHEN l_extendedprice < median_price THEN 1 ELSE 0 END) <= 0.51 * COUNT(l_extendedprice) AS median_close
    FROM data JOIN guess ON l_returnflag <=> flag GROUP BY l_returnflag
    """,
    oracle="SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, TRUE AS parts_close, TRUE AS median_close FROM lineitem GROUP BY l_returnflag",
)


DAILY = "SELECT CAST(ts AS DATE) AS day, event_type, COUNT(*) AS n FROM data GROUP BY CAST(ts AS DATE), event_type"

# Windows run over daily aggregates: a window group holds one row per type or day, whatever the event volume.
sql_query(
    "sql_window_rank",
    "events",
    f"""
    SELECT CAST(day AS STRING) AS day, event_type, n, CAST(ROW_NUMBER() OVER (PARTITION BY day ORDER BY n DESC, event_type) AS BIGINT) AS position,
           CAST(RANK() OVER (PARTITION BY day ORDER BY n DESC) AS BIGINT) AS place,
           CAST(DENSE_RANK() OVER (PARTITION BY day ORDER BY n DESC) AS BIGINT) AS dense_place,
           CAST(NTILE(2) OVER (PARTITION BY day ORDER BY n DESC, event_type) AS BIGINT) AS half
    FROM ({DAILY}) d
    """,
)

sql_query(
    "sql_window_lag",
    "events",
    f"""
    SELECT CAST(day AS STRING) AS day, event_type, n, LAG(n) OVER w AS before, LEAD(n, 2, 0) OVER w AS later, FIRST_VALUE(n) OVER w AS first_n,
           LAST_VALUE(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_n
    FROM ({DAILY}) d WINDOW w AS (PARTITION BY event_type ORDER BY day)
    """,
)

sql_query(
    "sql_window_frame",
    "events",
    f"""
    SELECT CAST(day AS STRING) AS day, event_type, SUM(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS three_rows,
           SUM(n) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS seven_days,
           SUM(n) OVER (PARTITION BY event_type ORDER BY day) AS running
    FROM ({DAILY}) d
    """,
    oracle=f"""
    SELECT CAST(day AS STRING) AS day, event_type,
           CAST(SUM(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS three_rows,
           CAST(SUM(n) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS seven_days,
           CAST(SUM(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS running
    FROM ({DAILY.replace("FROM data", "FROM events")}) d
    """,
)

sql_query(
    "sql_topk",
    "lineitem",
    """
    SELECT * FROM data
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20 OFFSET 5
    """,
)


@query(
    "sql_topk_per_group",
    """
    SELECT * FROM (
      SELECT o_orderpriority, o_orderkey, o_totalprice,
             CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank
      FROM orders) t
    WHERE rank <= 10
    """,
)
def sql_topk_per_group(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return top_k_per_group(orders, ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 10)


sql_query(
    "sql_set_ops",
    "orders",
    """
    SELECT 'both' AS part, k FROM (SELECT o_custkey AS k FROM data WHERE o_orderstatus = 'F'
                                   INTERSECT SELECT o_custkey FROM data WHERE o_orderstatus = 'P') a
    UNION ALL
    SELECT 'only_f' AS part, k FROM (SELECT o_custkey AS k FROM data WHERE o_orderstatus = 'F'
                                     EXCEPT SELECT o_custkey FROM data WHERE o_orderstatus = 'P') b
    UNION ALL
    SELECT 'either' AS part, k FROM (SELECT o_custkey AS k FROM data WHERE o_orderstatus = 'F'
                                     UNION SELECT o_custkey FROM data WHERE o_orderstatus = 'P') c
    """,
)

sql_query(
    "sql_subquery",
    "orders",
    """
    SELECT o_orderkey, o_totalprice FROM data
    WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM data)
      AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
      AND o_totalprice > (SELECT 10 * MAX(c_acctbal) FROM customer WHERE c_custkey = o_custkey)
    """,
    extra=["customer"],
)

sql_query(
    "sql_cte",
    "lineitem",
    """
    WITH per_order AS (SELECT l_orderkey, SUM(l_quantity) AS quantity FROM data GROUP BY l_orderkey),
         big AS (SELECT * FROM per_order WHERE quantity > 150)
    SELECT o_orderstatus, COUNT(*) AS orders, SUM(quantity) AS quantity
    FROM big JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus
    """,
    extra=["orders"],
)

YEARS_SQL = "SELECT EXTRACT(YEAR FROM o_orderdate) AS y, COUNT(*) AS n FROM data GROUP BY EXTRACT(YEAR FROM o_orderdate)"
WALK_SQL = """
    walk(y, total) AS (
      SELECT y, n FROM per_year WHERE y = (SELECT MIN(y) FROM per_year)
      UNION ALL
      SELECT p.y, w.total + p.n FROM walk w JOIN per_year p ON p.y = w.y + 1)
    SELECT CAST(y AS BIGINT) AS y, CAST(total AS BIGINT) AS total FROM walk
"""


@query("sql_recursive", f"WITH RECURSIVE per_year AS ({YEARS_SQL.replace('FROM data', 'FROM orders')}), {WALK_SQL}")
def sql_recursive(spark, sf):
    """Every step of a recursion runs its plan anew, so what it steps over is aggregated and stored first."""
    path = work_path(spark, "per_year")
    write_files(sql_transform(table(spark, sf, "orders"), YEARS_SQL), path)
    return sql_transform(spark.read.parquet(path), f"WITH RECURSIVE per_year AS (SELECT * FROM data), {WALK_SQL}")


sql_query(
    "sql_string_fns",
    "part",
    """
    SELECT p_partkey, upper(p_name) AS upper_name, substr(p_name, 3, 4) AS middle, length(p_type) AS type_len,
           replace(p_brand, '#', '-') AS brand, regexp_replace(p_name, '[aeiou]', '') AS first_gone,
           trim(concat('  ', p_type, ' ')) AS trimmed, lpad(p_brand, 12, '*') AS padded, split_part(p_name, ' ', 2) AS noun,
           p_name || '/' || p_type AS joined, reverse(p_name) AS reversed, strpos(p_name, 'r') AS r_at
    FROM data
    """.replace("regexp_replace(p_name, '[aeiou]', '')", "regexp_replace(p_name, '[aeiou]', '', 1)").replace("strpos(", "instr("),
    oracle="""
    SELECT p_partkey, upper(p_name) AS upper_name, substr(p_name, 3, 4) AS middle, CAST(length(p_type) AS INTEGER) AS type_len,
           replace(p_brand, '#', '-') AS brand, regexp_replace(p_name, '[aeiou]', '', 'g') AS first_gone,
           trim(concat('  ', p_type, ' ')) AS trimmed, lpad(p_brand, 12, '*') AS padded, split_part(p_name, ' ', 2) AS noun,
           p_name || '/' || p_type AS joined, reverse(p_name) AS reversed, CAST(strpos(p_name, 'r') AS INTEGER) AS r_at
    FROM part
    """,
)

sql_query(
    "sql_text_fns",
    "documents",
    r"""
    SELECT doc_id, char_length(text) AS chars, md5(text) AS digest, size(split(text, ' ')) AS pieces,
           length(text) - length(replace(text, '.', '')) AS stops, contains(text, 'http') AS has_link
    FROM data
    """,
    oracle=r"""
    SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, md5(text) AS digest, CAST(len(string_split(text, ' ')) AS INTEGER) AS pieces,
           CAST(length(text) - length(replace(text, '.', '')) AS INTEGER) AS stops, contains(text, 'http') AS has_link
    FROM documents
    """,
)

sql_query(
    "sql_date_fns",
    "orders",
    """
    SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS month, year(o_orderdate) AS y, quarter(o_orderdate) AS q,
           weekofyear(o_orderdate) AS w, dayofyear(o_orderdate) AS doy, datediff(DATE '2002-01-01', o_orderdate) AS age_days,
           CAST(CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS STRING) AS due, date_format(o_orderdate, 'yyyy/MM/dd') AS shown,
           CAST(last_day(CAST(o_orderdate AS DATE)) AS STRING) AS month_end
    FROM data
    """,
    oracle="""
    SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS month, CAST(year(o_orderdate) AS INTEGER) AS y,
           CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(weekofyear(o_orderdate) AS INTEGER) AS w,
           CAST(dayofyear(o_orderdate) AS INTEGER) AS doy,
           CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER) AS age_days,
           CAST(CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS STRING) AS due, strftime(o_orderdate, '%Y/%m/%d') AS shown,
           CAST(last_day(CAST(o_orderdate AS DATE)) AS STRING) AS month_end
    FROM orders
    """,
)

sql_query(
    "sql_math_fns",
    "lineitem",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_extendedprice), 6) AS ln_price, floor(l_extendedprice) AS floor_price,
           ceil(l_quantity / 7) AS packs, abs(l_tax - l_discount) AS gap, power(l_quantity, 2) AS squared,
           round(sqrt(l_quantity), 6) AS root, mod(l_orderkey, 10) AS last_digit, sign(l_tax - l_discount) AS side,
           greatest(l_tax, l_discount) AS top, least(l_tax, l_discount) AS bottom
    FROM data
    """,
    oracle="""
    SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_extendedprice), 6) AS ln_price, CAST(floor(l_extendedprice) AS BIGINT) AS floor_price,
           CAST(ceil(l_quantity / 7) AS BIGINT) AS packs, abs(l_tax - l_discount) AS gap, power(l_quantity, 2) AS squared,
           round(sqrt(l_quantity), 6) AS root, mod(l_orderkey, 10) AS last_digit, CAST(sign(l_tax - l_discount) AS DOUBLE) AS side,
           greatest(l_tax, l_discount) AS top, least(l_tax, l_discount) AS bottom
    FROM lineitem
    """,
)

sql_query(
    "sql_json_fns",
    "events",
    """
    SELECT event_id, get_json_object(props, '$.k') AS k_text, from_json(props, 'k BIGINT').k AS k,
           get_json_object(props, '$.missing') IS NULL AS no_such, json_array_length('[1,2,3]') AS three
    FROM data
    """,
    oracle="""
    SELECT event_id, json_extract_string(props, '$.k') AS k_text, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
           json_extract(props, '$.missing') IS NULL AS no_such, CAST(json_array_length('[1,2,3]') AS INTEGER) AS three
    FROM events
    """,
)

sql_query(
    "sql_array_fns",
    "embeddings",
    """
    SELECT vec_id, size(embedding) AS dims, CAST(element_at(embedding, 1) AS DOUBLE) AS first_value, CAST(array_max(embedding) AS DOUBLE) AS top,
           round(sqrt(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE) * x)), 6) AS norm,
           size(filter(embedding, x -> x > 0)) AS positive
    FROM data
    """,
    oracle="""
    SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, CAST(embedding[1] AS DOUBLE) AS first_value, CAST(list_max(embedding) AS DOUBLE) AS top,
           round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm,
           CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive
    FROM embeddings
    """,
)

sql_query(
    "sql_explode",
    "embeddings",
    """
    SELECT label, pos, COUNT(*) AS n, ROUND(AVG(CAST(x AS DOUBLE)), 6) AS mean
    FROM data LATERAL VIEW posexplode(embedding) e AS pos, x GROUP BY label, pos
    """,
    oracle="""
    SELECT label, CAST(pos - 1 AS INTEGER) AS pos, COUNT(*) AS n, ROUND(AVG(CAST(x AS DOUBLE)), 6) AS mean
    FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) t GROUP BY label, pos
    """,
)


@query(
    "sql_pivot",
    """
    SELECT l_returnflag, coalesce(SUM(l_quantity) FILTER (WHERE l_linestatus = 'F'), 0) AS qty_f,
           coalesce(SUM(l_quantity) FILTER (WHERE l_linestatus = 'O'), 0) AS qty_o
    FROM lineitem GROUP BY l_returnflag
    """,
)
def sql_pivot(spark, sf):
    return sql_transform(
        table(spark, sf, "lineitem"),
        """
        SELECT l_returnflag, coalesce(qty_f, 0) AS qty_f, coalesce(qty_o, 0) AS qty_o
        FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM data)
        PIVOT (SUM(l_quantity) FOR l_linestatus IN ('F' AS qty_f, 'O' AS qty_o))
        """,
    )


sql_query(
    "sql_unpivot",
    "part",
    """
    SELECT p_partkey, measure, amount FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM data) t
    UNPIVOT (amount FOR measure IN (size, price))
    """,
)


@query(
    "sql_window_events",
    """
    SELECT event_id, user_id, row_number() OVER w AS n, rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS day_place,
           dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS day_number, count(*) OVER (PARTITION BY user_id) AS events,
           max(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best, max(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS best_of_7,
           lag(event_type, 2, 'none') OVER w AS two_before, lead(event_id) OVER w AS next_event
    FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, ts, event_type, value FROM events)
    WINDOW w AS (PARTITION BY user_id ORDER BY CAST(ts AS DATE), event_id)
    """,
)
def sql_window_events(spark, sf):
    """Windows over all event rows, where one user holds a third of them."""
    user = F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id"))
    events = table(spark, sf, "events").select("event_id", user.alias("user_id"), F.col("ts").cast("date").alias("day"), "event_type", "value")
    s = Segments(events, ["user_id"], ["day"], tie=["event_id"]).row_number("n").rank("day_place", dense="day_number")
    s = s.total({"events": ("count", F.lit(1))}).running({"best": ("max", "value")}).settled()
    s = s.moving(6, 0, {"best_of_7": F.max("value")}).shift({"two_before": ("event_type", 2, "none"), "next_event": ("event_id", -1, None)})
    return s.frame().drop("day", "event_type", "value")


RANGES = "s_suppkey, DATE '1992-01-01' + CAST(s_suppkey * 37 % 2400 AS INTEGER) AS low, CASE WHEN s_suppkey % 50 > 0 THEN DATE '1992-01-01' + CAST(s_suppkey * 37 % 2400 + s_suppkey % 20 AS INTEGER) END AS high"


@query(
    "sql_join_range_outer",
    f"""
    SELECT s_suppkey, count(o_orderkey) AS orders, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order
    FROM (SELECT {RANGES} FROM supplier) s FULL JOIN orders o ON CAST(o_orderdate AS DATE) >= low AND (high IS NULL OR CAST(o_orderdate AS DATE) < high)
    GROUP BY s_suppkey
    """,
)
def sql_join_range_outer(spark, sf):
    """Orders in date ranges, some open, some empty: rows of both sides that meet nothing stay."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    ranges = table(spark, sf, "supplier").selectExpr(
        "s_suppkey",
        "date_add(DATE'1992-01-01', CAST(s_suppkey * 37 % 2400 AS INTEGER)) AS low",
        "CASE WHEN s_suppkey % 50 > 0 THEN date_add(DATE'1992-01-01', CAST(s_suppkey * 37 % 2400 + s_suppkey % 20 AS INTEGER)) END AS high",
    )
    totals = {"orders": ("count", "o_orderkey"), "first_order": ("min", "o_orderkey"), "last_order": ("max", "o_orderkey")}
    return interval_join(orders, ranges, "day", "low", "high", "full", by=["s_suppkey"], totals=totals)


@query(
    "sql_exact_quantiles",
    """
    SELECT l_returnflag, share, round(CASE share WHEN 0.25 THEN q1 WHEN 0.5 THEN q2 ELSE q3 END, 4) AS price
    FROM (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2, quantile_cont(l_extendedprice, 0.99) AS q3
          FROM lineitem GROUP BY l_returnflag), (SELECT CAST(unnest([0.25, 0.5, 0.99]) AS DOUBLE) AS share)
    """,
)
def sql_exact_quantiles(spark, sf):
    found = exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.99])
    return found.select("l_returnflag", "share", F.round("quantile", 4).alias("price"))


@query(
    "asof_join_scan",
    """
    SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_event_id, v.value AS view_value
    FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, ts FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, ts, value FROM events WHERE event_type = 'view') v
    ON p.user_id = v.user_id AND p.ts >= v.ts
    """,
)
def asof_scan(spark, sf):
    """One user holds a third of both sides."""
    events = table(spark, sf, "events").withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))
    purchases = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").select("event_id", "user_id", "ts", "value")
    return asof_join_scan(purchases, views, ["user_id"], "ts", ["event_id", "value"], prefix="view_")

"""Registered queries of the dialect over the test tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.errors import SqlError
from skarn.session import Engine
from skarn.streaming import windowed_counts
from skarn.types import JSONB, SqlType

#: Least urgent first, so that the enum's order is not the text's.
PRIORITIES = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")
TABLES = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
    "orders": "o_orderkey", "lineitem": None, "events": "event_id",
}
_TYPES = {"orders": {"o_orderpriority": SqlType("ENUM", variants=PRIORITIES)}, "events": {"props": JSONB}}
_ORDINAL = "CASE {} " + " ".join(f"WHEN '{p}' THEN {k + 1}" for k, p in enumerate(PRIORITIES)) + " END"


def engine(spark: SparkSession, sf_dir: str, root: str | None = None) -> Engine:
    """An engine over the tables of a folder."""
    found = Engine(spark, root)
    for name, key in TABLES.items():
        found.register(name, f"{sf_dir}/{name}.parquet", _TYPES.get(name), key)
    return found


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to two places, since sums depend on their order."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({n: F.round(F.col(f"`{n}`").cast("double"), 2) for n in doubles}) if doubles else df


# name: (dialect, DuckDB)
SQL: dict[str, tuple[str, str]] = {
    "scan_full": ("SELECT * FROM nation;", "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "scan_point": ("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42;", "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey = 42"),
    "scan_range": ("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 2000;", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 2000"),
    "scan_or_ranges": (
        "SELECT o_orderkey FROM orders WHERE o_orderkey < 50 OR o_orderkey > 14000 OR o_orderkey BETWEEN 30 AND 90;",
        "SELECT o_orderkey FROM orders WHERE o_orderkey < 50 OR o_orderkey > 14000 OR o_orderkey BETWEEN 30 AND 90",
    ),
    "filter_cmp": ("SELECT p_partkey, p_size FROM part WHERE p_size != 5 AND p_retailprice <= 950.5;", "SELECT p_partkey, p_size FROM part WHERE p_size != 5 AND p_retailprice <= 950.5"),
    "filter_and_or": (
        "SELECT p_partkey FROM part WHERE (p_size > 40 OR p_brand = 'Brand#2') AND p_type = 'ECONOMY';",
        "SELECT p_partkey FROM part WHERE (p_size > 40 OR p_brand = 'Brand#2') AND p_type = 'ECONOMY'",
    ),
    "filter_between": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07;", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07"),
    "filter_in": ("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY');", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "filter_in_expressions": ("SELECT p_partkey FROM part WHERE p_size IN (p_partkey, 7, p_partkey - 3);", "SELECT p_partkey FROM part WHERE p_size IN (p_partkey, 7, p_partkey - 3)"),
    "filter_like": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'r_d %t';", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'r_d %t'"),
    "filter_is_null": (
        "SELECT c.c_custkey AS k FROM customer AS c LEFT JOIN supplier AS s ON c.c_custkey = s.s_suppkey WHERE s.s_name IS NULL;",
        "SELECT c.c_custkey AS k FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey WHERE s.s_name IS NULL",
    ),
    "filter_is_not_null": (
        "SELECT c.c_custkey AS k, s.s_name AS s FROM customer AS c LEFT JOIN supplier AS s ON c.c_custkey = s.s_suppkey WHERE s.s_name IS NOT NULL;",
        "SELECT c.c_custkey AS k, s.s_name AS s FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey WHERE s.s_name IS NOT NULL",
    ),
    "filter_timestamp": (
        "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1997-05-28 00:00:00' AND o_orderdate < '1998-10-03T00:00:00';",
        "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-05-28 00:00:00' AND o_orderdate < TIMESTAMP '1998-10-03 00:00:00'",
    ),
    "project_arith": (
        "SELECT l_orderkey, l_linenumber, l_quantity * (1 - l_discount) AS charge, -l_linenumber + 2 AS m, l_linenumber / 2 AS h FROM lineitem;",
        "SELECT l_orderkey, l_linenumber, round(l_quantity * (1 - l_discount), 2) AS charge, CAST(-l_linenumber + 2 AS BIGINT) AS m, round(l_linenumber / 2, 2) AS h FROM lineitem",
    ),
    "project_constants": ("SELECT r_name, 2 * 3 + 4 AS seven, 10 - 2 * 3 AS four, r_regionkey * 1 + 0 AS same FROM region;", "SELECT r_name, CAST(10 AS BIGINT) AS seven, CAST(4 AS BIGINT) AS four, CAST(r_regionkey AS BIGINT) AS same FROM region"),
    "alias_in_where": (
        "SELECT l_orderkey, l_quantity * 2 AS double_quantity FROM lineitem WHERE double_quantity > 90;",
        "SELECT l_orderkey, l_quantity * 2 AS double_quantity FROM lineitem WHERE l_quantity * 2 > 90",
    ),
    "join_inner": (
        "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'F' ORDER BY o.o_totalprice DESC, o.o_orderkey;",
        "SELECT o_orderkey, c_name, round(o_totalprice, 2) AS o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F'",
    ),
    "join_left": (
        "SELECT c.c_custkey AS k, s.s_suppkey AS s FROM customer AS c LEFT JOIN supplier AS s ON c.c_custkey = s.s_suppkey;",
        "SELECT c_custkey AS k, s_suppkey AS s FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey",
    ),
    "join_right": (
        "SELECT s.s_suppkey AS s, c.c_custkey AS k FROM supplier AS s RIGHT JOIN customer AS c ON s.s_suppkey = c.c_custkey;",
        "SELECT s_suppkey AS s, c_custkey AS k FROM supplier RIGHT JOIN customer ON s_suppkey = c_custkey",
    ),
    "join_full": (
        "SELECT p.p_partkey AS p, c.c_custkey AS c FROM part AS p FULL JOIN customer AS c ON p.p_partkey = c.c_custkey + 1000;",
        "SELECT p_partkey AS p, c_custkey AS c FROM part FULL JOIN customer ON p_partkey = c_custkey + 1000",
    ),
    "join_self": (
        "SELECT a.n_name AS a, b.n_name AS b FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey;",
        "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
    ),
    "join_multi": (
        "SELECT o.o_orderkey, l.l_linenumber, p.p_name FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey JOIN lineitem AS l ON o.o_orderkey = l.l_orderkey"
        " JOIN part AS p ON l.l_partkey = p.p_partkey WHERE p.p_brand = 'Brand#2' AND o.o_orderstatus = 'F' ORDER BY o.o_orderdate;",
        "SELECT o_orderkey, l_linenumber, p_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey"
        " JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#2' AND o_orderstatus = 'F'",
    ),
    "join_expr_key": (
        "SELECT n.n_name, r.r_name FROM nation AS n JOIN region AS r ON n.n_regionkey + 1 = r.r_regionkey * 2;",
        "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey + 1 = r_regionkey * 2",
    ),
    "join_cross_type": (
        "SELECT c.c_custkey, n.n_name FROM customer AS c JOIN nation AS n ON c.c_custkey = n.n_nationkey;",
        "SELECT c_custkey, n_name FROM customer JOIN nation ON c_custkey = n_nationkey",
    ),
    "join_theta": (
        "SELECT a.r_name AS a, b.r_name AS b FROM region AS a JOIN region AS b ON a.r_regionkey = b.r_regionkey AND a.r_name != 'ASIA';",
        "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey = b.r_regionkey AND a.r_name != 'ASIA'",
    ),
    "agg_count": ("SELECT COUNT(*) AS n, COUNT(o_custkey) AS m FROM orders;", "SELECT count(*) AS n, count(o_custkey) AS m FROM orders"),
    "agg_count_nulls": (
        "SELECT COUNT(*) AS n, COUNT(s.s_name) AS m FROM customer AS c LEFT JOIN supplier AS s ON c.c_custkey = s.s_suppkey;",
        "SELECT count(*) AS n, count(s_name) AS m FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey",
    ),
    "agg_sum": (
        "SELECT l_returnflag, SUM(l_quantity) AS q, SUM(l_linenumber) AS n FROM lineitem GROUP BY l_returnflag;",
        "SELECT l_returnflag, round(sum(l_quantity), 2) AS q, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_avg": (
        "SELECT l_returnflag, l_linestatus, AVG(l_quantity) AS q, AVG(l_linenumber) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus;",
        "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 2) AS q, round(avg(l_linenumber), 2) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    ),
    "agg_min_max": (
        "SELECT c_mktsegment, MIN(c_name) AS a, MAX(c_name) AS z, MIN(c_acctbal) AS low, MAX(c_acctbal) AS high FROM customer GROUP BY c_mktsegment;",
        "SELECT c_mktsegment, min(c_name) AS a, max(c_name) AS z, round(min(c_acctbal), 2) AS low, round(max(c_acctbal), 2) AS high FROM customer GROUP BY c_mktsegment",
    ),
    "agg_enum_min_max": (
        "SELECT o_orderstatus, MIN(o_orderpriority) AS least, MAX(o_orderpriority) AS most FROM orders GROUP BY o_orderstatus;",
        f"SELECT o_orderstatus, arg_min(o_orderpriority, {_ORDINAL.format('o_orderpriority')}) AS least, arg_max(o_orderpriority, {_ORDINAL.format('o_orderpriority')}) AS most FROM orders GROUP BY o_orderstatus",
    ),
    "agg_empty": ("SELECT COUNT(*) AS n, SUM(o_custkey) AS s, MAX(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0;", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, max(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0"),
    "agg_nested_expr": (
        "SELECT l_returnflag, TRUNC(AVG(l_quantity), 1) AS t, ABS(MIN(l_linenumber) - MAX(l_linenumber)) AS d, COUNT(*) * 2 AS n FROM lineitem GROUP BY l_returnflag;",
        "SELECT l_returnflag, round(trunc(avg(l_quantity) * 10) / 10, 2) AS t, CAST(abs(min(l_linenumber) - max(l_linenumber)) AS BIGINT) AS d, count(*) * 2 AS n FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_over_expr": (
        "SELECT l_linestatus, SUM(l_extendedprice * (1 - l_discount)) AS revenue, SUM(l_linenumber + COALESCE(l_linenumber, 0)) AS n FROM lineitem GROUP BY l_linestatus;",
        "SELECT l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(sum(l_linenumber * 2) AS BIGINT) AS n FROM lineitem GROUP BY l_linestatus",
    ),
    "group_by_expr": ("SELECT p_size / 10 AS s, COUNT(*) AS n FROM part GROUP BY p_size / 10;", "SELECT round(p_size / 10, 2) AS s, count(*) AS n FROM part GROUP BY 1"),
    "group_by_alias": (
        "SELECT EXTRACT(YEAR FROM o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY y ORDER BY y;",
        "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1",
    ),
    "group_by_fd": (
        "SELECT c.c_custkey, c.c_name, COUNT(*) AS n, SUM(o.o_totalprice) AS s FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey ORDER BY c.c_name;",
        "SELECT c_custkey, c_name, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name",
    ),
    "group_distinct": ("SELECT p_brand, p_type FROM part GROUP BY p_brand, p_type;", "SELECT DISTINCT p_brand, p_type FROM part"),
    "group_nulls": (
        "SELECT s.s_nationkey AS n, COUNT(*) AS c FROM customer AS c LEFT JOIN supplier AS s ON c.c_custkey = s.s_suppkey GROUP BY s.s_nationkey;",
        "SELECT s_nationkey AS n, count(*) AS c FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey GROUP BY s_nationkey",
    ),
    "sort_multi": (
        "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, o_custkey, o_orderkey LIMIT 100;",
        "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, o_custkey, o_orderkey LIMIT 100",
    ),
    "sort_nulls_desc": (
        "SELECT c.c_custkey AS k, s.s_suppkey AS s FROM customer AS c LEFT JOIN supplier AS s ON c.c_custkey = s.s_suppkey ORDER BY s DESC, k LIMIT 20;",
        "SELECT c_custkey AS k, s_suppkey AS s FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey ORDER BY s DESC NULLS FIRST, k LIMIT 20",
    ),
    "sort_nulls_asc": (
        "SELECT c.c_custkey AS k, s.s_suppkey AS s FROM customer AS c LEFT JOIN supplier AS s ON c.c_custkey = s.s_suppkey ORDER BY s, k LIMIT 120;",
        "SELECT c_custkey AS k, s_suppkey AS s FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey ORDER BY s ASC NULLS LAST, k LIMIT 120",
    ),
    "sort_expr": ("SELECT p_partkey FROM part ORDER BY p_size * -1, p_partkey LIMIT 30;", "SELECT p_partkey FROM part ORDER BY p_size * -1, p_partkey LIMIT 30"),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 40;", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 40"),
    "offset_alone": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20;", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20"),
    "limit_zero": ("SELECT n_name FROM nation LIMIT 0;", "SELECT n_name FROM nation LIMIT 0"),
    "topk": (
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10;",
        "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_orders.o_totalprice DESC, o_orderkey LIMIT 10".replace("o_orders.", "orders."),
    ),
    "fn_substring": (
        "SELECT p_partkey, SUBSTRING(p_name FROM 2 FOR 3) AS a, SUBSTRING(p_name FROM 4) AS b, SUBSTRING(p_name FOR 2) AS c, SUBSTRING(p_name FROM 0 FOR 2) AS d FROM part;",
        "SELECT p_partkey, substring(p_name, 2, 3) AS a, substring(p_name, 4) AS b, substring(p_name, 1, 2) AS c, substring(p_name, 1, 2) AS d FROM part",
    ),
    "fn_concat": ("SELECT p_partkey, CONCAT(p_name, ' ', p_brand) AS c FROM part;", "SELECT p_partkey, p_name || ' ' || p_brand AS c FROM part"),
    "fn_ascii": ("SELECT p_partkey, ASCII(p_name) AS a FROM part;", "SELECT p_partkey, CAST(ascii(p_name) AS INTEGER) AS a FROM part"),
    "fn_position": ("SELECT p_partkey, POSITION('e' IN p_name) AS p FROM part;", "SELECT p_partkey, CAST(position('e' IN p_name) AS INTEGER) AS p FROM part"),
    "fn_abs_sign": (
        "SELECT p_partkey, ABS(p_size - 25) AS a, SIGN(p_size - 25) AS s FROM part;",
        "SELECT p_partkey, CAST(abs(p_size - 25) AS BIGINT) AS a, CAST(sign(p_size - 25) AS INTEGER) AS s FROM part",
    ),
    "fn_sqrt_power": (
        "SELECT p_partkey, SQRT(p_size) AS r, POWER(p_size, 3) AS c, POWER(p_retailprice, 0.5) AS h FROM part;",
        "SELECT p_partkey, round(sqrt(p_size), 2) AS r, CAST(power(p_size, 3) AS BIGINT) AS c, round(power(p_retailprice, 0.5), 2) AS h FROM part",
    ),
    "fn_trunc": (
        "SELECT l_orderkey, l_linenumber, TRUNC(l_extendedprice) AS t, TRUNC(-l_extendedprice, 1) AS u FROM lineitem;",
        "SELECT l_orderkey, l_linenumber, trunc(l_extendedprice) AS t, round(-floor(l_extendedprice * 10) / 10, 2) AS u FROM lineitem",
    ),
    "fn_coalesce": (
        "SELECT c.c_custkey AS k, COALESCE(s.s_name, c.c_name) AS n FROM customer AS c LEFT JOIN supplier AS s ON c.c_custkey = s.s_suppkey;",
        "SELECT c_custkey AS k, coalesce(s_name, c_name) AS n FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey",
    ),
    "fn_typeof": ("SELECT TYPEOF(o_orderdate) FROM orders;", "SELECT 'TIMESTAMP' AS \"TYPEOF\""),
    "fn_extract": (
        "SELECT o_orderkey, EXTRACT(CENTURY FROM o_orderdate) AS c, EXTRACT(DECADE FROM o_orderdate) AS de, EXTRACT(YEAR FROM o_orderdate) AS y, EXTRACT(QUARTER FROM o_orderdate) AS q,"
        " EXTRACT(MONTH FROM o_orderdate) AS m, EXTRACT(DAY FROM o_orderdate) AS d, EXTRACT(EPOCH FROM o_orderdate) AS e FROM orders;",
        "SELECT o_orderkey, " + ", ".join(f"CAST(extract({u} FROM o_orderdate) AS BIGINT) AS {a}" for u, a in (("century", "c"), ("decade", "de"), ("year", "y"), ("quarter", "q"), ("month", "m"), ("day", "d"), ("epoch", "e"))) + " FROM orders",
    ),
    "fn_extract_time": (
        "SELECT event_id, EXTRACT(HOUR FROM ts) AS h, EXTRACT(MINUTE FROM ts) AS m, EXTRACT(SECOND FROM ts) AS s FROM events;",
        "SELECT event_id, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS m, CAST(second(ts) AS BIGINT) AS s FROM events",
    ),
    "fn_extract_interval": (
        "SELECT r_name, EXTRACT(MONTH FROM INTERVAL '1 year 2 months') AS m, EXTRACT(HOUR FROM INTERVAL '27 hours 90 minutes') AS h, EXTRACT(EPOCH FROM INTERVAL '1 month 1 day') AS e FROM region;",
        "SELECT r_name, CAST(14 AS BIGINT) AS m, CAST(28 AS BIGINT) AS h, CAST(31 * 86400 AS BIGINT) AS e FROM region",
    ),
    "interval_ts_add": (
        "SELECT o_orderkey, o_orderdate + INTERVAL '2 months 15 days 27 hours 90 minutes' AS t, o_orderdate - INTERVAL '1 day 5 seconds' AS u FROM orders;",
        "SELECT o_orderkey, o_orderdate + INTERVAL 2 MONTH + INTERVAL 15 DAY + INTERVAL 1710 MINUTE AS t, o_orderdate - INTERVAL 86405 SECOND AS u FROM orders",
    ),
    "json_path_scalar": ("SELECT event_id, props.k AS k, props.missing AS m FROM events;", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS m FROM events"),
    "json_filter": ("SELECT event_id FROM events WHERE props.k >= 90 AND event_type = 'click';", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 90 AND event_type = 'click'"),
    "json_group_by": ("SELECT props.k AS k, COUNT(*) AS n FROM events GROUP BY k;", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1"),
    "json_order": ("SELECT event_id FROM events ORDER BY props.k DESC, event_id LIMIT 25;", "SELECT event_id FROM events ORDER BY CAST(json_extract_string(props, '$.k') AS DOUBLE) DESC, event_id LIMIT 25"),
    "enum_compare": ("SELECT o_orderkey FROM orders WHERE o_orderpriority > '3-MEDIUM';", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('2-HIGH', '1-URGENT')"),
    "enum_order": (
        "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 40;",
        f"SELECT o_orderkey, o_orderpriority FROM orders ORDER BY {_ORDINAL.format('o_orderpriority')}, o_orderkey LIMIT 40",
    ),
    "bench_simple_join": (
        "SELECT c.c_name, o.o_orderkey, o.o_totalprice FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'F' ORDER BY o.o_totalprice DESC, o.o_orderkey;",
        "SELECT c_name, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F' ORDER BY orders.o_totalprice DESC, o_orderkey",
    ),
    "bench_join_aggregate": (
        "SELECT c.c_mktsegment, COUNT(o.o_orderkey) AS n, SUM(o.o_totalprice) AS total, AVG(o.o_totalprice) AS mean FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment ORDER BY total DESC;",
        "SELECT c_mktsegment, count(o_orderkey) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment",
    ),
    "bench_multiple_joins": (
        "SELECT o.o_orderkey, c.c_name, p.p_name, l.l_quantity FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey JOIN lineitem AS l ON o.o_orderkey = l.l_orderkey"
        " JOIN part AS p ON l.l_partkey = p.p_partkey WHERE p.p_brand = 'Brand#3' AND o.o_orderstatus = 'O' ORDER BY o.o_orderdate, o.o_orderkey;",
        "SELECT o_orderkey, c_name, p_name, l_quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey"
        " JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#3' AND o_orderstatus = 'O'",
    ),
    "bench_join_group": (
        "SELECT p.p_type, COUNT(*) AS n, SUM(l.l_quantity) AS q, SUM(l.l_extendedprice) AS s FROM part AS p JOIN lineitem AS l ON p.p_partkey = l.l_partkey JOIN orders AS o ON l.l_orderkey = o.o_orderkey GROUP BY p.p_type ORDER BY s DESC;",
        "SELECT p_type, count(*) AS n, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice), 2) AS s FROM part JOIN lineitem ON p_partkey = l_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY p_type",
    ),
    "bench_stress": (
        "SELECT c.c_nationkey, COUNT(*) AS n, AVG(o.o_totalprice) AS mean FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey ORDER BY n DESC;",
        "SELECT c_nationkey, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey",
    ),
    "flagship_revenue": (
        "SELECT r.r_name AS region, COUNT(*) AS n, SUM(l.l_extendedprice) AS revenue FROM lineitem AS l JOIN orders AS o ON l.l_orderkey = o.o_orderkey JOIN customer AS c ON o.o_custkey = c.c_custkey"
        " JOIN nation AS n ON c.c_nationkey = n.n_nationkey JOIN region AS r ON n.n_regionkey = r.r_regionkey WHERE o.o_orderstatus = 'F' GROUP BY r.r_name ORDER BY revenue DESC LIMIT 5;",
        "SELECT r_name AS region, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
        " JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F' GROUP BY r_name ORDER BY sum(l_extendedprice) DESC LIMIT 5",
    ),
}

_WORKED = "CREATE TABLE planets (id SERIAL PRIMARY KEY, name VARCHAR(20) UNIQUE, moons INT NULLABLE, mass NUMERIC(10,4)); "
_WORKED += "INSERT INTO planets (name, moons, mass) VALUES ('Earth', 1, 1.0), ('Mars', 2, 0.1074), ('Jupiter', 95, 317.83), ('Venus', NULL, 0.815); "
_FOUR = "(VALUES (1, 'Earth', 1, 1.0), (2, 'Mars', 2, 0.1074), (3, 'Jupiter', 95, 317.83), (4, 'Venus', NULL, 0.815)) AS p(id, name, moons, mass)"

# Scripts that change tables of their own, and what they leave.
SCRIPTS: dict[str, tuple[str, str]] = {
    "dml_insert_returning": (
        _WORKED + "INSERT INTO planets (name, moons, mass) VALUES ('Saturn', 146, 95.159) RETURNING id, name, moons * 2 AS twice;",
        "SELECT CAST(5 AS INTEGER) AS id, 'Saturn' AS name, CAST(292 AS BIGINT) AS twice",
    ),
    "dml_update_returning": (
        _WORKED + "UPDATE planets SET moons = moons + 1, name = CONCAT(name, '!') WHERE moons < 50 RETURNING id, old.moons AS before, new.moons AS after, name;",
        f"SELECT CAST(id AS INTEGER) AS id, CAST(moons AS INTEGER) AS before, CAST(moons + 1 AS INTEGER) AS after, name || '!' AS name FROM {_FOUR} WHERE moons < 50",
    ),
    "dml_update_stored": (
        _WORKED + "UPDATE planets SET moons = COALESCE(moons, 0) * 10; SELECT id, moons FROM planets;",
        f"SELECT CAST(id AS INTEGER) AS id, CAST(coalesce(moons, 0) * 10 AS INTEGER) AS moons FROM {_FOUR}",
    ),
    "dml_delete": (_WORKED + "DELETE FROM planets WHERE moons > 1; SELECT id, name FROM planets;", f"SELECT CAST(id AS INTEGER) AS id, name FROM {_FOUR} WHERE NOT coalesce(moons > 1, false)"),
    "txn_rollback": (_WORKED + "BEGIN TRANSACTION; DELETE FROM planets; ROLLBACK; SELECT id, name FROM planets;", f"SELECT CAST(id AS INTEGER) AS id, name FROM {_FOUR}"),
    "txn_commit": (_WORKED + "BEGIN TRANSACTION; DELETE FROM planets WHERE id = 2; COMMIT; SELECT id FROM planets;", f"SELECT CAST(id AS INTEGER) AS id FROM {_FOUR} WHERE id <> 2"),
    "serial_gaps": (
        _WORKED + "BEGIN TRANSACTION; INSERT INTO planets (name, mass) VALUES ('X', 1.5); ROLLBACK; INSERT INTO planets (name, mass) VALUES ('Y', 2.5) RETURNING id, name, moons;",
        "SELECT CAST(6 AS INTEGER) AS id, 'Y' AS name, CAST(NULL AS INTEGER) AS moons",
    ),
    "json_table": (
        "CREATE TABLE people (id SERIAL PRIMARY KEY, body JSONB); INSERT INTO people (body) VALUES ({name: 'Ann', tags: ['a', 'b'], home: {zip: 7}}), ({name: 'Bob', tags: []}), ('{\"name\": \"Cy\"}');"
        " SELECT id, body.name AS name, body.tags[-1] AS last, body.home.zip AS zip, body.tags[*] AS tags FROM people;",
        "SELECT * FROM (VALUES (1, 'Ann', 'b', '7', '[\"a\",\"b\"]'), (2, 'Bob', NULL, NULL, '[]'), (3, 'Cy', NULL, NULL, NULL)) AS t(id, name, last, zip, tags)",
    ),
    "interval_dates": (
        "CREATE TABLE days (id SERIAL PRIMARY KEY, d DATE, t TIME); INSERT INTO days (d, t) VALUES ('2024-01-31', '23:30:00'), ('2023-02-28', '00:10:00');"
        " SELECT id, d + INTERVAL '1 month' AS a, d - INTERVAL '35 days' AS b, t + INTERVAL '2 hours' AS c, t - INTERVAL '1 hour' AS e FROM days;",
        "SELECT * FROM (VALUES (1, DATE '2024-02-29', DATE '2023-12-27', '01:30:00', '22:30:00'), (2, DATE '2023-03-28', DATE '2023-01-24', '02:10:00', '23:10:00')) AS t(id, a, b, c, e)",
    ),
    "json_min_max": (
        "CREATE TABLE docs (id SERIAL PRIMARY KEY, body JSONB); INSERT INTO docs (body) VALUES ({q: 2, order: 'b', key: 1}), ({q: 10, order: 'a', key: 3}), ({q: 9.5, Index: 1}), ({other: 1});"
        " SELECT MIN(body.q) AS low, MAX(body.q) AS high, MIN(body.order) AS a, MAX(body.order) AS b, MAX(body.key) AS k, COUNT(body.Index) AS n FROM docs;",
        "SELECT '2' AS low, '10' AS high, 'a' AS a, 'b' AS b, '3' AS k, CAST(1 AS BIGINT) AS n",
    ),
    "big_numbers": (
        "CREATE TABLE wide (id SERIAL PRIMARY KEY, u INT UNSIGNED, b BIGINT); INSERT INTO wide (u, b) VALUES (4294967295, 9223372036854775807), (2, 3);"
        " SELECT id, u * u AS squares, b * b AS big, b + 0 AS same FROM wide WHERE b < 99999999999999999999;",
        "SELECT * FROM (VALUES (1, CAST('18446744065119617025' AS DECIMAL(38,0)), CAST('85070591730234615847396907784232501249' AS DECIMAL(38,0)), CAST(9223372036854775807 AS BIGINT)),"
        " (2, CAST('4' AS DECIMAL(38,0)), CAST('9' AS DECIMAL(38,0)), CAST(3 AS BIGINT))) AS t(id, squares, big, same)",
    ),
    "fn_power_exact": (
        "CREATE TABLE bases (id SERIAL PRIMARY KEY, x INT, y INT); INSERT INTO bases (x, y) VALUES (3, 35), (-3, 35), (2, 62), (10, 0), (0, 5), (-1, 999), (7, 1);"
        " SELECT id, POWER(x, y) AS p, POWER(x, 3) AS c FROM bases;",
        "SELECT id, CAST(p AS BIGINT) AS p, CAST(x * x * x AS BIGINT) AS c FROM (VALUES (1, 3, 50031545098999707), (2, -3, -50031545098999707), (3, 2, 4611686018427387904), (4, 10, 1), (5, 0, 0), (6, -1, -1), (7, 7, 7)) AS t(id, x, p)",
    ),
    "unique_index": (
        _WORKED + "CREATE UNIQUE INDEX by_mass ON planets(mass); SELECT id, mass FROM planets WHERE mass = 0.8150;",
        "SELECT CAST(4 AS INTEGER) AS id, CAST(0.8150 AS DECIMAL(10,4)) AS mass",
    ),
    "sequence_and_drop": (
        _WORKED + "CREATE SEQUENCE own AS BIGINT OWNED BY planets; DROP TABLE planets; CREATE TABLE planets (id SERIAL PRIMARY KEY, name TEXT); INSERT INTO planets (name) VALUES ('again'); SELECT id, name FROM planets;",
        "SELECT CAST(1 AS INTEGER) AS id, 'again' AS name",
    ),
    "uuid_keys": (
        "CREATE TABLE contracts (id UUID PRIMARY KEY, name TEXT); INSERT INTO contracts (name) VALUES ('a'), ('b');"
        " INSERT INTO contracts (id, name) VALUES ('AAAAAAAA-0000-4000-8000-000000000001', 'c'); SELECT id, name FROM contracts WHERE id = 'aaaaaaaa-0000-4000-8000-000000000001';",
        "SELECT 'aaaaaaaa-0000-4000-8000-000000000001' AS id, 'c' AS name",
    ),
    "interval_columns": (
        "CREATE TABLE spans (id SERIAL PRIMARY KEY, at TIMESTAMP, span INTERVAL); INSERT INTO spans (at, span) VALUES ('2024-01-31 10:00:00', '1 month 2 hours'), ('2023-12-31 23:59:59', '1 year 3 days 1 second');"
        " SELECT id, at + span AS later, span + at AS same, EXTRACT(MONTH FROM span) AS m, EXTRACT(HOUR FROM span) AS h FROM spans;",
        "SELECT * FROM (VALUES (1, TIMESTAMP '2024-02-29 12:00:00', TIMESTAMP '2024-02-29 12:00:00', CAST(1 AS BIGINT), CAST(2 AS BIGINT)),"
        " (2, TIMESTAMP '2025-01-04 00:00:00', TIMESTAMP '2025-01-04 00:00:00', CAST(12 AS BIGINT), CAST(0 AS BIGINT))) AS t(id, later, same, m, h)",
    ),
    "numeric_sums": (
        _WORKED + "SELECT SUM(mass) AS s, AVG(moons) AS a, MIN(mass) AS low, MAX(mass) AS high, COUNT(moons) AS n FROM planets;",
        "SELECT CAST(319.7524 AS DECIMAL(20,4)) AS s, round(98 / 3, 2) AS a, CAST(0.1074 AS DECIMAL(10,4)) AS low, CAST(317.8300 AS DECIMAL(10,4)) AS high, CAST(3 AS BIGINT) AS n",
    ),
    "json5_input": (
        "CREATE TABLE notes (id SERIAL PRIMARY KEY, body JSONB); INSERT INTO notes (body) VALUES ('{a: 0x10, /* c */ b: [1, 2,], d: NaN,}'), ('plain text');"
        " SELECT id, body.a AS a, body.b[-1] AS b, body.d AS d FROM notes;",
        "SELECT * FROM (VALUES (1, '16', '2', NULL), (2, NULL, NULL, NULL)) AS t(id, a, b, d)",
    ),
    "join_null_keys": (
        "CREATE TABLE a (id SERIAL PRIMARY KEY, k INT NULLABLE); CREATE TABLE b (id SERIAL PRIMARY KEY, k INT NULLABLE); INSERT INTO a (k) VALUES (1), (NULL), (3); INSERT INTO b (k) VALUES (1), (NULL), (4);"
        " SELECT a.id AS x, b.id AS y FROM a FULL JOIN b ON a.k = b.k;",
        "SELECT * FROM (VALUES (1, 1), (2, NULL), (3, NULL), (NULL, 2), (NULL, 3)) AS t(x, y)",
    ),
    "numeric_table": (
        "CREATE TABLE loans (id SERIAL PRIMARY KEY, principal NUMERIC(10,2), rate NUMERIC(5,4)); INSERT INTO loans (principal, rate) VALUES (1000.50, 0.0525), (250.00, 0.1000);"
        " SELECT id, TRUNC(principal * rate, 3) AS interest FROM loans;",
        "SELECT CAST(id AS INTEGER) AS id, CAST(i AS DECIMAL(38,3)) AS interest FROM (VALUES (1, 52.526), (2, 25.000)) AS t(id, i)",
    ),
}


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(engine(spark, sf_dir).sql(sql))


def _script(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(Engine(spark).sql(sql))


def _refused(sql: str, bad: str, after: str) -> Callable[[SparkSession, str], DataFrame]:
    """What is left after a statement that must fail."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Engine(spark)
        db.sql(sql)
        try:
            db.sql(bad)
        except SqlError:
            return rounded(db.sql(after))
        raise AssertionError(f"not refused: {bad}")

    return run


def _loaded(change: str, after: str) -> Callable[[SparkSession, str], DataFrame]:
    """A change of a table that holds all orders."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Engine(spark)
        db.sql("CREATE TABLE own (o_orderkey BIGINT PRIMARY KEY, o_orderstatus VARCHAR(1), o_totalprice DOUBLE PRECISION);")
        db.load("own", spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice"))
        db.sql(change)
        return rounded(db.sql(after))

    return run


# name: (query, DuckDB)
CHECKED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "duplicate_key": (
        _refused(_WORKED, "INSERT INTO planets (name, mass) VALUES ('Pluto', 0.0022), ('Mars', 1.0);", "SELECT id, name FROM planets;"),
        f"SELECT CAST(id AS INTEGER) AS id, name FROM {_FOUR}",
    ),
    "txn_aborted": (
        _refused(_WORKED + "BEGIN TRANSACTION; DELETE FROM planets WHERE id = 1;", "INSERT INTO planets (name) VALUES ('no mass');", "COMMIT; SELECT id FROM planets;"),
        f"SELECT CAST(id AS INTEGER) AS id FROM {_FOUR}",
    ),
    "dml_update_table": (
        _loaded("UPDATE own SET o_totalprice = o_totalprice * 2, o_orderstatus = 'X' WHERE o_orderstatus = 'P';", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM own;"),
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, round(CASE o_orderstatus WHEN 'P' THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS o_totalprice FROM orders",
    ),
    "dml_delete_table": (
        _loaded("DELETE FROM own WHERE o_totalprice > 100000.0;", "SELECT o_orderkey, o_orderstatus FROM own;"),
        "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT o_totalprice > 100000.0",
    ),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by region: five relations, one filter, grouped and sorted."""
    return _query(SQL["flagship_revenue"][0])(spark, sf_dir)


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "event_type")
    return counted.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("EXPLAIN SELECT o_orderkey FROM orders WHERE o_orderkey = 1;")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _query(sql) for name, (sql, _) in SQL.items()},
    **{name: _script(sql) for name, (sql, _) in SCRIPTS.items()},
    **{name: query for name, (query, _) in CHECKED.items()},
    "stream_windows": _windows,
    "explain": _explain,
}
ORACLE_SQL: dict[str, str] = {
    **{name: oracle for name, (_, oracle) in (SQL | SCRIPTS | CHECKED).items()},
    "stream_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
}

"""Registered queries over the driver's tables, with the SQL that checks each.

Every query runs through the engine. JSON tables are made once for each folder of input, by the engine's own insert:
``ev`` (events with ``props``), ``oj`` (an order with its customer and lines as one nested document) and ``mixed``
(three inserts whose documents disagree in keys and types).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.expressions import text_as_text, text_as_type
from .sources.files import shared_dir
from .streaming.tail import tail

TABLES = "region nation customer supplier part orders lineitem events".split()
_engines: dict[tuple, Engine] = {}


def engine_for(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine with views of the input; the JSON tables are added when first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _engines:
        e = Engine(spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}")
        for t in TABLES:
            e.view(t, e.spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        _engines[key] = e
    return _engines[key]


def _with(e: Engine, *names: str) -> Engine:
    for name in names:
        if not e.catalog.exists(name):
            _MAKE[name](e)
    return e


def _make_ev(e: Engine) -> None:
    e.sql("CREATE TABLE ev (event_id BIGINT, user_id BIGINT, event_type TEXT, value DOUBLE, props JSON)")
    e.sql("INSERT INTO ev SELECT event_id, user_id, event_type, value, props FROM events")


def _make_oj(e: Engine) -> None:
    e.sql("CREATE TABLE oj (o_orderkey BIGINT, doc JSON)")
    e.sql(
        """INSERT INTO oj SELECT o.o_orderkey, to_json(named_struct('status', o.o_orderstatus, 'total', o.o_totalprice, 'customer', named_struct('key', c.c_custkey, 'segment', c.c_mktsegment), 'lines', l.lines))
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
        LEFT JOIN (SELECT l_orderkey, sort_array(collect_list(named_struct('n', l_linenumber, 'part', l_partkey, 'qty', CAST(l_quantity AS BIGINT)))) AS lines FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey"""
    )


def _make_mixed(e: Engine) -> None:
    e.sql("CREATE TABLE mixed (id BIGINT, d JSON)")
    e.sql("""INSERT INTO mixed SELECT event_id, concat('{"a":', event_id, ',"b":"', event_type, '"}') FROM events WHERE event_id % 3 = 0""")
    e.sql("""INSERT INTO mixed SELECT event_id, concat('{"a":"', event_type, '","c":[', user_id, ',null]}') FROM events WHERE event_id % 3 = 1""")
    e.sql("""INSERT INTO mixed SELECT event_id, concat('{"c":[],"e":{"f":', CAST(event_id % 2 = 0 AS STRING), '},"g":[', event_id, ',"', event_type, '"]}') FROM events WHERE event_id % 3 = 2""")


_MAKE = {"ev": _make_ev, "oj": _make_oj, "mixed": _make_mixed}

#: name: (JSON tables, statement, the same in the checking dialect or None if it is the same text)
_SQL: dict[str, tuple[tuple[str, ...], str, str | None]] = {
    # paths and JSON functions
    "j_value_counts": (("ev",), "SELECT props.k AS k, count(*) AS n FROM ev GROUP BY props.k", "SELECT json_extract(props, '$.k')::VARCHAR AS k, count(*) AS n FROM events GROUP BY 1"),
    "j_value_counts_ordered": (("ev",), "SELECT props.k AS k, count(*) AS n FROM ev GROUP BY props.k ORDER BY n DESC, k LIMIT 10", "SELECT json_extract(props, '$.k')::VARCHAR AS k, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, k LIMIT 10"),
    "j_untyped_path": (("ev",), "SELECT event_id, props.k AS k, props.nothing.here AS gone FROM ev", "SELECT event_id, json_extract(props, '$.k')::VARCHAR AS k, NULL::VARCHAR AS gone FROM events"),
    "j_whole_document": (("ev",), "SELECT event_id, props FROM ev", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS props FROM events"),
    "j_json_display": (("oj",), "SELECT o_orderkey, json_display(doc) AS d FROM oj WHERE doc.lines IS NULL", "SELECT o_orderkey, '{\"customer\":{\"key\":' || c_custkey || ',\"segment\":\"' || c_mktsegment || '\"},\"status\":\"' || o_orderstatus || '\",\"total\":' || o_totalprice || '}' AS d FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "j_get_field_typed": (("ev",), "SELECT event_id, get_field_typed(props, 'k') AS t, get_field_typed(props, 'k', CAST(NULL AS INT)) AS i, get_field_typed(props, 'k', CAST(NULL AS STRING)) AS s FROM ev", "SELECT event_id, json_extract(props, '$.k')::VARCHAR AS t, json_extract(props, '$.k')::INT AS i, json_extract_string(props, '$.k') AS s FROM events"),
    "j_typed_filter": (("ev",), "SELECT event_id, props.k + 1 AS k1 FROM ev WHERE props.k > 50 AND props['k'] <= 60", "SELECT event_id, json_extract(props, '$.k')::BIGINT + 1 AS k1 FROM events WHERE json_extract(props, '$.k')::BIGINT > 50 AND json_extract(props, '$.k')::BIGINT <= 60"),
    "j_cast": (("ev",), "SELECT event_id, CAST(props.k AS DOUBLE) AS d, props.k::string AS s FROM ev", "SELECT event_id, json_extract(props, '$.k')::DOUBLE AS d, json_extract_string(props, '$.k') AS s FROM events"),
    "j_like": (("oj",), "SELECT o_orderkey, doc.customer.segment AS seg FROM oj WHERE doc.customer.segment LIKE 'B%' OR doc.customer.segment SIMILAR TO 'M%Y'", "SELECT o_orderkey, '\"' || c_mktsegment || '\"' AS seg FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment LIKE 'B%' OR regexp_full_match(c_mktsegment, 'M.*Y')"),
    "j_between_in": (("ev",), "SELECT event_id FROM ev WHERE props.k BETWEEN 10 AND 20 OR props.k IN (30, 31)", "SELECT event_id FROM events WHERE json_extract(props, '$.k')::INT BETWEEN 10 AND 20 OR json_extract(props, '$.k')::INT IN (30, 31)"),
    "j_case": (("oj",), "SELECT CASE doc.status WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS what, count(*) AS n FROM oj GROUP BY 1", "SELECT CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS what, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1"),
    "j_boolean": (("mixed",), "SELECT id, CASE WHEN d.e.f THEN 1 ELSE 0 END AS f FROM mixed WHERE d.e.f IS NOT NULL AND NOT d.e.f", "SELECT event_id AS id, 0 AS f FROM events WHERE event_id % 3 = 2 AND event_id % 2 <> 0"),
    "j_is_null": (("mixed",), "SELECT id FROM mixed WHERE d.a IS NULL", "SELECT event_id AS id FROM events WHERE event_id % 3 = 2"),
    "j_schema_merge": (("mixed",), "SELECT id, d FROM mixed", "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN '{\"a\":' || event_id || ',\"b\":\"' || event_type || '\"}' WHEN 1 THEN '{\"a\":\"' || event_type || '\",\"c\":[' || user_id || ']}' ELSE '{\"e\":{\"f\":' || (event_id % 2 = 0)::VARCHAR || '},\"g\":[' || event_id || ',\"' || event_type || '\"]}' END AS d FROM events"),
    "j_variant_path": (("mixed",), "SELECT id, d.a AS a FROM mixed WHERE d.a = 'click' OR d.a = 6", "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN event_id::VARCHAR ELSE '\"' || event_type || '\"' END AS a FROM events WHERE (event_id % 3 = 1 AND event_type = 'click') OR event_id = 6"),
    "j_aggregate": (("oj",), "SELECT doc.customer.segment AS seg, sum(doc.customer.key) AS s, max(doc.status) AS m, count(DISTINCT doc.customer.key) AS d FROM oj GROUP BY doc.customer.segment", "SELECT '\"' || c_mktsegment || '\"' AS seg, sum(c_custkey)::BIGINT AS s, max(o_orderstatus) AS m, count(DISTINCT c_custkey) AS d FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment"),
    "j_window": (("ev",), "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY props.k::bigint DESC, event_id) AS BIGINT) AS r FROM ev", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY json_extract(props, '$.k')::BIGINT DESC, event_id) AS r FROM events"),
    "j_order_as_text": (("ev",), "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY props.k, event_id) AS BIGINT) AS r FROM ev", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY json_extract(props, '$.k')::VARCHAR, event_id) AS r FROM events"),
    "j_join": (("oj",), "SELECT n.n_name, count(*) AS n FROM oj JOIN customer c ON oj.doc.customer.key = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name", "SELECT n_name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name"),
    "j_join_paths": (("ev", "oj"), "SELECT count(*) AS n FROM ev JOIN oj ON ev.props.k = oj.doc.customer.key", "SELECT count(*) AS n FROM events JOIN orders ON json_extract(props, '$.k')::BIGINT = o_custkey JOIN customer ON c_custkey = o_custkey"),
    "j_array": (("oj",), "SELECT o_orderkey, size(doc.lines) AS n, array_max(transform(doc.lines, x -> x.qty)) AS q FROM oj WHERE doc.lines IS NOT NULL", "SELECT o_orderkey, count(*)::INT AS n, max(l_quantity)::BIGINT AS q FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"),
    "j_explode": (("oj",), "SELECT o_orderkey, x.l.part AS part, x.l.qty AS qty FROM oj LATERAL VIEW explode(doc.lines) x AS l WHERE x.l.n = 1", "SELECT o_orderkey, l_partkey AS part, l_quantity::BIGINT AS qty FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1"),
    "j_subquery": (("ev",), "SELECT event_id FROM ev WHERE props.k::bigint > (SELECT avg(props.k) FROM ev) AND event_type IN (SELECT event_type FROM ev WHERE props.k = 5)", "SELECT event_id FROM events WHERE json_extract(props, '$.k')::BIGINT > (SELECT avg(json_extract(props, '$.k')::BIGINT) FROM events) AND event_type IN (SELECT event_type FROM events WHERE json_extract(props, '$.k')::BIGINT = 5)"),
    "j_distinct_union": (("ev", "mixed"), "SELECT DISTINCT props.k AS v FROM ev UNION SELECT d.e.f AS v FROM mixed", "SELECT DISTINCT json_extract(props, '$.k')::VARCHAR AS v FROM events UNION SELECT CASE WHEN event_id % 3 = 2 THEN (event_id % 2 = 0)::VARCHAR END FROM events"),
    "j_derived_tables": (("oj",), "WITH big AS (SELECT o_orderkey, doc FROM oj) SELECT d.doc.customer.segment AS seg, count(*) AS n FROM (SELECT doc FROM big WHERE doc.status = 'O') d GROUP BY d.doc.customer.segment", "SELECT '\"' || c_mktsegment || '\"' AS seg, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' GROUP BY 1"),
    "j_ilike_is_true": (("mixed",), "SELECT id FROM mixed WHERE d.b ILIKE 'C%' OR d.e.f IS TRUE", "SELECT event_id AS id FROM events WHERE (event_id % 3 = 0 AND event_type ILIKE 'c%') OR (event_id % 3 = 2 AND event_id % 2 = 0)"),
    "j_distinct_document": (("ev",), "SELECT DISTINCT props FROM ev", "SELECT DISTINCT '{\"k\":' || json_extract_string(props, '$.k') || '}' AS props FROM events"),
    "j_cube_paths": (("oj",), "SELECT doc.status AS st, doc.customer.segment AS seg, count(*) AS n FROM oj GROUP BY CUBE (doc.status, doc.customer.segment)", "SELECT '\"' || o_orderstatus || '\"' AS st, '\"' || c_mktsegment || '\"' AS seg, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY CUBE (1, 2)"),
    # where a path stands: brackets, mixed documents beside columns, unseen and mixed arrays
    "j_paren_compare": (("oj",), "SELECT o_orderkey FROM oj WHERE (doc.status) = 'O' AND ((doc.customer.key)) > 10 AND NOT ((doc.customer.segment) = 'BUILDING')", "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' AND c_custkey > 10 AND c_mktsegment <> 'BUILDING'"),
    "j_paren_in": (("mixed",), "SELECT id FROM mixed WHERE (d.b) IN ('click', 'view') OR (d.e.f)", "SELECT event_id AS id FROM events WHERE (event_id % 3 = 0 AND event_type IN ('click', 'view')) OR (event_id % 3 = 2 AND event_id % 2 = 0)"),
    "j_variant_vs_column": (("mixed",), "SELECT id FROM mixed WHERE d.a = id OR d.a > id + 1", "SELECT event_id AS id FROM events WHERE event_id % 3 = 0"),
    "j_variant_join": (("mixed",), "SELECT c_mktsegment AS seg, count(*) AS n FROM mixed m JOIN customer c ON m.d.a = c.c_custkey + 1 GROUP BY c_mktsegment", "SELECT c_mktsegment AS seg, count(*) AS n FROM events JOIN customer ON event_id = c_custkey + 1 WHERE event_id % 3 = 0 GROUP BY 1"),
    "j_variant_between": (("mixed",), "SELECT id FROM mixed WHERE d.a BETWEEN id - 1 AND 500", "SELECT event_id AS id FROM events WHERE event_id % 3 = 0 AND event_id <= 500"),
    "j_two_cases": (("mixed",), "SELECT id, CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS x, CASE WHEN id % 2 = 0 THEN d.b ELSE 'odd' END AS y FROM mixed", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS x, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN event_type END ELSE 'odd' END AS y FROM events"),
    "j_unseen_array": (("mixed",), "SELECT id, array_contains(d.nothing, 'x') AS h, coalesce(size(d.nothing.here), -1) AS n FROM mixed", "SELECT event_id AS id, NULL::BOOLEAN AS h, -1 AS n FROM events"),
    "j_variant_array": (("mixed",), "SELECT id FROM mixed WHERE array_contains(d.g, 'click') AND array_contains(d.g, id)", "SELECT event_id AS id FROM events WHERE event_id % 3 = 2 AND event_type = 'click'"),
    "j_index_past_end": (("oj",), "SELECT o_orderkey, doc.lines[3].qty AS q, doc.lines[99].qty AS gone FROM oj", "SELECT o_orderkey, l_quantity::BIGINT AS q, NULL::BIGINT AS gone FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS r FROM lineitem) l ON l_orderkey = o_orderkey AND r = 4"),
    "j_having_path": (("oj",), "SELECT doc.status AS st, count(*) AS n FROM oj GROUP BY doc.status HAVING doc.status <> 'P' AND count(*) > 1", "SELECT '\"' || o_orderstatus || '\"' AS st, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING count(*) > 1"),
    "j_int_argument": (("ev",), "SELECT event_id, CAST(date_add(DATE '2024-01-01', props.k) AS STRING) AS d, left(event_type, props.k) AS l FROM ev", "SELECT event_id, (DATE '2024-01-01' + json_extract(props, '$.k')::INT)::VARCHAR AS d, left(event_type, json_extract(props, '$.k')::INT) AS l FROM events"),
    "j_display_any": ((), "SELECT n_nationkey, json_display(n_nationkey) AS a, json_display(array(n_regionkey, NULL, 2)) AS b, json_display(named_struct('x', n_name, 'y', NULLIF(n_regionkey, 1))) AS c, get_field_typed(n_name, '') AS d FROM nation", "SELECT n_nationkey, n_nationkey::VARCHAR AS a, '[' || n_regionkey || ',2]' AS b, CASE WHEN n_regionkey = 1 THEN '{\"x\":\"' || n_name || '\"}' ELSE '{\"x\":\"' || n_name || '\",\"y\":' || n_regionkey || '}' END AS c, '\"' || n_name || '\"' AS d FROM nation"),
    "j_in_subquery": (("ev", "mixed"), "SELECT id FROM mixed WHERE d.a IN (SELECT o_orderkey FROM orders)", "SELECT event_id AS id FROM events WHERE event_id % 3 = 0 AND event_id IN (SELECT o_orderkey FROM orders)"),
    "information_schema": (("ev", "mixed"), "SELECT table_name, column_name, is_nullable FROM information_schema.columns WHERE table_name IN ('ev', 'mixed')", "SELECT * FROM (VALUES ('ev', 'event_id', 'YES'), ('ev', 'user_id', 'YES'), ('ev', 'event_type', 'YES'), ('ev', 'value', 'YES'), ('ev', 'props', 'YES'), ('mixed', 'id', 'YES'), ('mixed', 'd', 'YES')) AS t(table_name, column_name, is_nullable)"),
    # relational operators
    "scan_filter": ((), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_discount > 0.05 AND l_returnflag = 'R'", None),
    "values": ((), "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) AS t(x, y)", None),
    "join_inner": ((), "SELECT c_name, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 200000", None),
    "join_left": ((), "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'", None),
    "join_right": ((), "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey", None),
    "join_full": ((), "SELECT c_custkey, o.k, o.n FROM customer FULL JOIN (SELECT o_custkey + 7 AS k, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.k = c_custkey", None),
    "join_semi": ((), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", None),
    "join_anti": ((), "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_linenumber = l.l_linenumber + 1)", None),
    "join_cross": ((), "SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_theta": ((), "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "group_by_having": ((), "SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 10", None),
    "count_distinct_filter": ((), "SELECT o_orderpriority, count(DISTINCT o_custkey) AS d, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY o_orderpriority", None),
    "grouping_sets": ((), "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())", None),
    "cube": ((), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", None),
    "rollup": ((), "SELECT o_orderstatus, o_orderpriority, max(o_totalprice) AS m FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", None),
    "distinct": ((), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "window_rank": ((), "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)", None),
    "window_offset": ((), "SELECT o_orderkey, lag(o_totalprice, 1) OVER w AS prev, lead(o_totalprice, 2, 0.0) OVER w AS nxt, first_value(o_orderkey) OVER w AS f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", None),
    "window_frame": ((), "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c, max(value) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS m FROM events", None),
    "sort_limit_offset": ((), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 10", None),
    "union_all": ((), "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "intersect_except": ((), "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1", None),
    "cte": ((), "WITH big AS (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE m > 250000) SELECT c_name, m FROM top JOIN customer ON c_custkey = o_custkey", None),
    "cte_recursive": ((), "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t", None),
    "subquery_correlated": ((), "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", None),
    # functions
    "f_string": ((), "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, substring(c_name, 3, 5) AS s, replace(c_name, '0', 'o') AS r, reverse(c_name) AS v, lpad(c_mktsegment, 12, '.') AS p, concat(c_name, '-', c_mktsegment) AS c, trim(concat('  ', c_name, ' ')) AS t, split_part(c_name, '#', 2) AS sp, levenshtein(c_mktsegment, 'BUILDING') AS d, translate(c_name, 'Cu', 'ku') AS tr, repeat('ab', 3) AS rp FROM customer", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name)::INT AS n, substring(c_name, 3, 5) AS s, replace(c_name, '0', 'o') AS r, reverse(c_name) AS v, lpad(c_mktsegment, 12, '.') AS p, concat(c_name, '-', c_mktsegment) AS c, trim(concat('  ', c_name, ' ')) AS t, split_part(c_name, '#', 2) AS sp, levenshtein(c_mktsegment, 'BUILDING')::INT AS d, translate(c_name, 'Cu', 'ku') AS tr, repeat('ab', 3) AS rp FROM customer"),
    "f_regex": ((), "SELECT p_partkey, regexp_like(p_type, 'A.*S') AS m, regexp_extract(p_brand, '([0-9]+)', 1) AS x, regexp_replace(p_name, '[aeiou]', '*') AS r FROM part", "SELECT p_partkey, regexp_matches(p_type, 'A.*S') AS m, regexp_extract(p_brand, '([0-9]+)', 1) AS x, regexp_replace(p_name, '[aeiou]', '*', 'g') AS r FROM part"),
    "f_math": ((), "SELECT p_partkey, abs(-p_size) AS a, CAST(ceil(p_retailprice / 7) AS BIGINT) AS c, CAST(floor(p_retailprice / 7) AS BIGINT) AS f, sqrt(p_size) AS q, sign(p_size - 20.0) AS s, greatest(p_size, 10) AS g, least(p_size, 10) AS l, p_size % 7 AS m FROM part", "SELECT p_partkey, abs(-p_size) AS a, ceil(p_retailprice / 7)::BIGINT AS c, floor(p_retailprice / 7)::BIGINT AS f, sqrt(p_size) AS q, sign(p_size - 20.0)::DOUBLE AS s, greatest(p_size, 10) AS g, least(p_size, 10) AS l, p_size % 7 AS m FROM part"),
    "f_datetime": ((), "SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS m, CAST(date_part('year', o_orderdate) AS BIGINT) AS y, CAST(date_add(CAST(o_orderdate AS DATE), 30) AS STRING) AS d, CAST(datediff(DATE '2030-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS n FROM orders", "SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE::VARCHAR AS m, date_part('year', o_orderdate)::BIGINT AS y, (o_orderdate::DATE + 30)::DATE::VARCHAR AS d, date_diff('day', o_orderdate::DATE, DATE '2030-01-01')::BIGINT AS n FROM orders"),
    "f_conditional": ((), "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') AS c, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS s FROM orders", None),
    "f_array": ((), "SELECT c_custkey, array_contains(array(c_custkey, 5L), 5L) AS h, element_at(sequence(1, 5), 2) AS e, array_join(transform(sequence(1, 3), x -> CAST(x * 2 AS STRING)), ',') AS j, aggregate(array(1, 2, 3), 0, (a, x) -> a + x) AS g FROM customer", "SELECT c_custkey, list_contains([c_custkey, 5], 5) AS h, 2 AS e, '2,4,6' AS j, 6 AS g FROM customer"),
    "f_map_struct": ((), "SELECT n_nationkey, element_at(map('k', n_name), 'k') AS v, named_struct('a', n_regionkey).a AS a, size(map_keys(map('x', 1, 'y', 2))) AS s FROM nation", "SELECT n_nationkey, n_name AS v, n_regionkey AS a, 2 AS s FROM nation"),
    "f_json": ((), "SELECT event_id, get_json_object(props, '$.k') AS g, try_variant_get(try_parse_json(props), '$.k', 'bigint') AS v FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS g, json_extract(props, '$.k')::BIGINT AS v FROM events"),
    "f_hash": ((), "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s, hex(c_mktsegment) AS h, base64(CAST(c_mktsegment AS BINARY)) AS b FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, hex(c_mktsegment) AS h, base64(c_mktsegment::BLOB) AS b FROM customer"),
    "f_aggregates": ((), "SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(stddev_samp(o_totalprice), 4) AS sd, round(corr(o_totalprice, o_custkey), 6) AS c, bool_or(o_totalprice > 400000) AS b, CAST(bit_xor(o_orderkey) AS BIGINT) AS x, median(o_custkey) AS md FROM orders GROUP BY o_orderstatus", None),
    "f_string_agg": ((), "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "f_string_more": ((), "SELECT c_custkey, ltrim(concat(' ', c_name)) AS lt, rtrim(concat(c_name, ' ')) AS rt, rpad(c_mktsegment, 12, '*') AS rp, repeat(c_mktsegment, 2) AS rep, concat_ws('/', c_name, NULL, c_mktsegment) AS ws, instr(c_name, '#') AS i, startswith(c_name, 'Cust') AS sw, endswith(c_name, '1') AS ew, contains(c_mktsegment, 'L') AS ct, left(c_name, 4) AS l4, right(c_name, 4) AS r4, ascii(c_name) AS a FROM customer", "SELECT c_custkey, ltrim(' ' || c_name) AS lt, rtrim(c_name || ' ') AS rt, rpad(c_mktsegment, 12, '*') AS rp, repeat(c_mktsegment, 2) AS rep, concat_ws('/', c_name, NULL, c_mktsegment) AS ws, instr(c_name, '#')::INT AS i, starts_with(c_name, 'Cust') AS sw, ends_with(c_name, '1') AS ew, contains(c_mktsegment, 'L') AS ct, left(c_name, 4) AS l4, right(c_name, 4) AS r4, ascii(c_name)::INT AS a FROM customer"),
    "f_regex_more": ((), "SELECT p_partkey, array_join(regexp_extract_all(p_name, '([aeiou])', 1), '') AS v, CAST(regexp_count(p_name, '[aeiou]') AS BIGINT) AS n, p_type RLIKE '^[A-Z]' AS k FROM part", "SELECT p_partkey, array_to_string(regexp_extract_all(p_name, '([aeiou])', 1), '') AS v, len(regexp_extract_all(p_name, '[aeiou]')) AS n, regexp_matches(p_type, '^[A-Z]') AS k FROM part"),
    "f_math_more": ((), "SELECT p_partkey, round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(tan(p_size), 4) AS t, round(atan2(p_size, 3), 6) AS a2, round(exp(p_size / 10.0), 4) AS e, round(ln(p_size), 6) AS l, round(log10(p_size), 6) AS l10, round(log2(p_size), 6) AS l2, round(pow(p_size, 1.5), 4) AS p, round(cbrt(p_size), 6) AS cb, round(degrees(p_size), 4) AS d, round(radians(p_size), 6) AS r, round(p_retailprice / 3, 2) AS rd FROM part", "SELECT p_partkey, round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(tan(p_size), 4) AS t, round(atan2(p_size, 3), 6) AS a2, round(exp(p_size / 10.0), 4) AS e, round(ln(p_size), 6) AS l, round(log10(p_size), 6) AS l10, round(log2(p_size), 6) AS l2, round(pow(p_size, 1.5), 4) AS p, round(cbrt(p_size), 6) AS cb, round(degrees(p_size), 4) AS d, round(radians(p_size), 6) AS r, round(p_retailprice / 3, 2) AS rd FROM part"),
    "f_datetime_more": ((), "SELECT event_id, CAST(CAST(date_trunc('hour', ts) AS TIMESTAMP) AS STRING) AS h, CAST(hour(ts) AS BIGINT) AS hr, CAST(dayofyear(ts) AS BIGINT) AS dy, CAST(quarter(ts) AS BIGINT) AS q, CAST(last_day(CAST(ts AS DATE)) AS STRING) AS ld, CAST(make_date(year(ts), month(ts), 1) AS STRING) AS md, date_format(ts, 'yyyy-MM') AS f FROM events", "SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS h, hour(ts) AS hr, dayofyear(ts) AS dy, quarter(ts) AS q, last_day(ts::DATE)::VARCHAR AS ld, make_date(year(ts), month(ts), 1)::VARCHAR AS md, strftime(ts, '%Y-%m') AS f FROM events"),
    "f_array_more": ((), "SELECT n_nationkey, array_join(array_sort(array_distinct(array(n_regionkey, 3, n_regionkey, 1))), ',') AS d, array_max(array(n_regionkey, 2)) AS mx, array_min(array(n_regionkey, 2)) AS mn, CAST(array_position(array(9, n_regionkey), n_regionkey) AS BIGINT) AS p, array_join(slice(array(n_nationkey, 5, 6, 7), 2, 2), ',') AS sl, size(flatten(array(array(1, 2), array(n_nationkey)))) AS fl, array_join(filter(sequence(1, 6), x -> x % 2 = 0), ',') AS ev, array_join(array_except(array(1, 2, 9), array(2)), ',') AS ex, array_join(array_intersect(array(1, 2), array(2)), ',') AS ins FROM nation", "SELECT n_nationkey, array_to_string(list_sort(list_distinct([n_regionkey, 3, n_regionkey, 1])), ',') AS d, greatest(n_regionkey, 2) AS mx, least(n_regionkey, 2) AS mn, list_position([9, n_regionkey], n_regionkey)::BIGINT AS p, '5,6' AS sl, 3 AS fl, '2,4,6' AS ev, '1,9' AS ex, '2' AS ins FROM nation"),
    "f_aggregates_more": ((), "SELECT o_orderstatus, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS d, bool_and(o_totalprice > 0) AS ba, CAST(bit_and(o_custkey) AS BIGINT) AS bn, CAST(bit_or(o_custkey) AS BIGINT) AS bo, round(var_pop(o_totalprice), 0) AS vp, round(covar_pop(o_totalprice / 1000, o_custkey), 3) AS cp, array_join(sort_array(collect_set(o_orderpriority)), ',') AS cs, max_by(o_orderkey, o_totalprice) AS mb, count_if(o_totalprice > 100000) AS ci FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(DISTINCT o_orderpriority) AS d, bool_and(o_totalprice > 0) AS ba, bit_and(o_custkey) AS bn, bit_or(o_custkey) AS bo, round(var_pop(o_totalprice), 0) AS vp, round(covar_pop(o_totalprice / 1000, o_custkey), 3) AS cp, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS cs, arg_max(o_orderkey, o_totalprice) AS mb, count(*) FILTER (WHERE o_totalprice > 100000) AS ci FROM orders GROUP BY o_orderstatus"),
    "f_window_more": ((), "SELECT o_orderkey, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS nv FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)", None),
    "f_encoding": ((), "SELECT n_nationkey, CAST(unhex(hex(n_name)) AS STRING) AS u, CAST(unbase64(base64(CAST(n_name AS BINARY))) AS STRING) AS b, sha1(n_name) AS s1, bit_length(n_name) AS bl FROM nation", "SELECT n_nationkey, n_name AS u, n_name AS b, sha1(n_name) AS s1, bit_length(n_name)::INT AS bl FROM nation"),
    "f_string_rest": ((), "SELECT c_custkey, locate('#', c_name) AS lo, initcap(lower(c_mktsegment)) AS ic, position('o' IN c_name) AS po, char_length(c_name) AS cl, overlay(c_name PLACING 'xx' FROM 2 FOR 3) AS ov FROM customer", "SELECT c_custkey, instr(c_name, '#')::INT AS lo, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS ic, instr(c_name, 'o')::INT AS po, length(c_name)::INT AS cl, left(c_name, 1) || 'xx' || substr(c_name, 5) AS ov FROM customer"),
    "f_math_rest": ((), "SELECT p_partkey, round(log(2, p_size), 6) AS lg, round(asin(p_size / 50.0), 6) AS s, round(acos(p_size / 50.0), 6) AS c, round(atan(p_size), 6) AS t, pmod(-p_size, 7) AS pm, factorial(p_size % 10) AS f, p_size DIV 3 AS d FROM part", "SELECT p_partkey, round(log2(p_size), 6) AS lg, round(asin(p_size / 50.0), 6) AS s, round(acos(p_size / 50.0), 6) AS c, round(atan(p_size), 6) AS t, ((-p_size % 7) + 7) % 7 AS pm, factorial((p_size % 10)::INT)::BIGINT AS f, (p_size // 3)::BIGINT AS d FROM part"),
    "f_datetime_rest": ((), "SELECT o_orderkey, CAST(date_sub(CAST(o_orderdate AS DATE), 5) AS STRING) AS ds, months_between(TIMESTAMP '2024-03-01', TIMESTAMP '2024-01-01') AS mb, CAST(to_date(substring(CAST(o_orderdate AS STRING), 1, 10)) AS STRING) AS td, CAST(to_timestamp('2024-05-06 07:08:09') AS STRING) AS tt, from_unixtime(86400) AS fu, unix_timestamp('1970-01-02', 'yyyy-MM-dd') AS ut, CAST(make_timestamp(2024, 2, 29, 1, 2, 3) AS STRING) AS mt, current_date() <= CAST(current_timestamp() AS DATE) AS now, CAST(add_months(CAST(o_orderdate AS DATE), 1) AS STRING) AS am FROM orders", "SELECT o_orderkey, (o_orderdate::DATE - 5)::DATE::VARCHAR AS ds, 2.0::DOUBLE AS mb, o_orderdate::DATE::VARCHAR AS td, '2024-05-06 07:08:09' AS tt, '1970-01-02 00:00:00' AS fu, 86400::BIGINT AS ut, '2024-02-29 01:02:03' AS mt, true AS now, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE::VARCHAR AS am FROM orders"),
    "f_conditional_rest": ((), "SELECT o_orderkey, nvl(nullif(o_orderstatus, 'O'), 'open') AS a, ifnull(nullif(o_orderstatus, 'F'), 'done') AS b, nvl2(nullif(o_orderstatus, 'P'), 1, 0) AS c, if(o_totalprice > 1000, 'x', 'y') AS d FROM orders", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') AS a, coalesce(nullif(o_orderstatus, 'F'), 'done') AS b, CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS c, CASE WHEN o_totalprice > 1000 THEN 'x' ELSE 'y' END AS d FROM orders"),
    "f_array_rest": ((), "SELECT n_nationkey, array_join(array_append(array(n_regionkey, 2), 9), ',') AS a, array_join(array_sort(array_union(array(n_regionkey, 1), array(1, 8))), ',') AS u, array_join(array_remove(array(n_regionkey, 1, 7), 1), ',') AS r, size(array_repeat(n_name, 3)) AS rp, arrays_overlap(array(n_regionkey), array(1, 2)) AS o FROM nation", "SELECT n_nationkey, n_regionkey || ',2,9' AS a, array_to_string(list_sort(list_distinct([n_regionkey, 1, 8])), ',') AS u, array_to_string([x FOR x IN [n_regionkey, 1, 7] IF x <> 1], ',') AS r, 3 AS rp, n_regionkey IN (1, 2) AS o FROM nation"),
    "f_map_struct_rest": ((), "SELECT n_nationkey, struct(n_name AS nm).nm AS s, array_join(map_values(map('a', n_name)), ',') AS mv, map_entries(map('a', n_regionkey))[0].value AS me, element_at(map_from_entries(array(struct('k', n_name))), 'k') AS mf, element_at(map_from_arrays(array('p'), array(n_regionkey)), 'p') AS ma FROM nation", "SELECT n_nationkey, n_name AS s, n_name AS mv, n_regionkey AS me, n_name AS mf, n_regionkey AS ma FROM nation"),
    "f_json_rest": ((), "SELECT event_id, from_json(props, 'k INT').k AS fj, CAST(variant_get(parse_json(props), '$.k', 'bigint') AS BIGINT) AS vg, schema_of_variant(parse_json(props)) AS sv, is_variant_null(parse_json('null')) AS vn, to_json(named_struct('k', user_id)) AS tj, json_array_length('[1,2]') AS jl FROM events", "SELECT event_id, json_extract(props, '$.k')::INT AS fj, json_extract(props, '$.k')::BIGINT AS vg, 'OBJECT<k: BIGINT>' AS sv, true AS vn, '{\"k\":' || user_id || '}' AS tj, 2 AS jl FROM events"),
    "f_encoding_rest": ((), "SELECT n_nationkey, crc32('abc') AS c, CAST(decode(encode(n_name, 'UTF-8'), 'UTF-8') AS STRING) AS e, url_encode('a b') AS u, octet_length(n_name) AS ol FROM nation", "SELECT n_nationkey, 891568578::BIGINT AS c, n_name AS e, 'a+b' AS u, octet_length(n_name::BLOB)::INT AS ol FROM nation"),
    "f_aggregates_rest": ((), "SELECT o_orderstatus, percentile_approx(o_custkey, 0.5, 1000000) AS p, approx_count_distinct(o_orderpriority) AS ad, round(stddev(o_custkey), 4) AS sd, round(variance(o_custkey), 2) AS v, any_value(o_orderstatus) AS av, mode(o_orderstatus) AS m, round(skewness(o_custkey), 2) < 5 AS sk FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, quantile_disc(o_custkey, 0.5) AS p, count(DISTINCT o_orderpriority) AS ad, round(stddev_samp(o_custkey), 4) AS sd, round(var_samp(o_custkey), 2) AS v, o_orderstatus AS av, o_orderstatus AS m, true AS sk FROM orders GROUP BY o_orderstatus"),
    # reports over the star schema
    "q1_pricing": ((), "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus", None),
    "q3_shipping": ((), "SELECT o_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10", None),
    "q5_local_supplier": ((), "SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name", None),
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    tables, statement, _ = _SQL[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _with(engine_for(spark, sf_dir), *tables).sql(statement)

    run.__name__ = name
    return run


def j_text_getters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The getters on JSON text, without a table: untyped, and strictly typed; half of the texts hold a string."""
    rows = engine_for(spark, sf_dir).spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = rows.withColumn("t", F.expr("""CASE WHEN event_id % 2 = 0 THEN props ELSE concat('{"k":"', event_type, '"}') END"""))
    return rows.select("event_id", F.expr(text_as_text("t", "k")).alias("t"), F.expr(text_as_type("t", "k", "bigint")).alias("i"), F.expr(text_as_type("t", "k", "string")).alias("s"))


def _fresh(e: Engine, columns: str, options: str = "") -> str:
    name = f"made_{uuid.uuid4().hex[:8]}"
    e.sql(f"CREATE TABLE {name} ({columns}){options}")
    return name


def copy_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY of newline-delimited JSON, then a query of the new table."""
    e = engine_for(spark, sf_dir)
    path = f"{e.catalog.base}/_lines-{uuid.uuid4().hex}"
    e.spark.read.parquet(f"{sf_dir}/events.parquet").select("props").write.text(path)
    name = _fresh(e, "id BIGINT, props JSON", " WITH (compression = 'snappy')")
    e.sql(f"COPY {name} (props) FROM '{path}' WITH (FORMAT ndjson)")
    e.catalog.files.delete(path)
    return e.sql(f"SELECT props.k AS k, count(*) AS n, count(id) AS ids FROM {name} GROUP BY props.k")


def table_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared paths: typed from the start, laid over what is inferred; a violation refuses the whole insert."""
    e = engine_for(spark, sf_dir)
    name = _fresh(e, "id BIGINT, d JSON (k INT NOT NULL, w.x SMALLINT, s TEXT)")
    refused = 0
    for bad in ("{}", '{"k":null}', '{"k":"x"}', '{"k":1,"w":{"x":70000}}'):
        try:
            e.sql(f"INSERT INTO {name} SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN '{bad}' ELSE '{{\"k\":1}}' END FROM nation")
        except ValueError:
            refused += 1
    e.sql(f"INSERT INTO {name} SELECT event_id, concat('{{\"k\":', event_id, ',\"w\":{{\"x\":', event_id % 100, '}}}}') FROM events")
    return e.sql(f"SELECT id, d.k + d.w.x AS k, d.s AS s, {refused} AS refused FROM {name}")


def table_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One insert for each codec; the file names tell what was written."""
    e = engine_for(spark, sf_dir)
    parts = []
    for codec, level, ending in (("zstd", ", zstd_level = 3", ".zstd.parquet"), ("gzip", ", gzip_level = 9", ".gz.parquet"), ("snappy", ", enable_dict = 'off'", ".snappy.parquet"), ("lz4_raw", "", ".lz4raw.parquet"), ("uncompressed", "", "0.parquet")):
        name = _fresh(e, "k BIGINT, d JSON", f" WITH (compression = '{codec}'{level})")
        e.sql(f"INSERT INTO {name} SELECT n_nationkey, '{{\"a\":1}}' FROM nation")
        t = e.table(name)
        files = [f for f in e.catalog.files.list(f"{t.root}/{t.manifest.state()[0][0].id}") if f.endswith(".parquet")]
        parts.append(f"SELECT '{codec}' AS codec, {str(all(f.endswith(ending) for f in files) and bool(files)).lower()} AS written, count(d.a) AS n FROM {name}")
    return e.sql(" UNION ALL ".join(parts))


def ddl_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that are refused, and whether each was."""
    e = _with(engine_for(spark, sf_dir), "ev")
    two = _fresh(e, "a JSON, b JSON")
    refused = []
    for n, statement in enumerate(("COPY ev TO 'x'", "COPY (SELECT 1) FROM 'x'", "COPY ev FROM STDIN", "COPY ev FROM 'x' WITH (FORMAT csv)", "COPY ev FROM 'x' CSV", "COPY ev (value) FROM 'x'", "COPY ev (nope) FROM 'x'", "COPY ev (value, props) FROM 'x'", f"COPY {two} FROM 'x'", "CREATE TABLE ev (a INT)", "CREATE TABLE bad (a JSON (x DATE))", "CREATE TABLE bad (a INT) WITH (nope = 1)", "CREATE TABLE bad (a INT) WITH (compression = 'zip')", "CREATE TABLE bad (a INT) WITH (gzip_level = 3)", "DROP TABLE nope", "INSERT INTO nope VALUES (1)", "INSERT INTO ev (event_id) VALUES (1, 2)")):
        try:
            e.sql(statement)
            refused.append((n, False))
        except ValueError:
            refused.append((n, True))
    return e.spark.createDataFrame(refused, "n int, refused boolean")


def empty_and_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of a table without rows; tables that another engine finds in the folder, and no longer once dropped."""
    e = engine_for(spark, sf_dir)
    name, gone = _fresh(e, "id BIGINT, d JSON"), _fresh(e, "id BIGINT")
    e.sql(f"DROP TABLE {gone}")
    e.sql(f"DROP TABLE IF EXISTS {gone}")
    other = Engine(spark, e.catalog.base)
    found = [other.catalog.exists(name), other.catalog.exists(gone), e.catalog.exists(name)]
    return e.sql(f"SELECT count(*) AS n, count(d.x) AS x, {str(found[0]).lower()} AS there, {str(found[1]).lower()} AS gone, {str(found[2]).lower()} AS own FROM {name}")


def value_counts_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without the path are a bucket of their own."""
    return _with(engine_for(spark, sf_dir), "mixed").table("mixed").value_counts("d", "b")


def escaped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings with quotes, backslashes and control characters, as JSON text and as values."""
    e = engine_for(spark, sf_dir)
    name = _fresh(e, "id BIGINT, d JSON")
    e.table(name).insert(e.spark.table("nation").select(F.col("n_nationkey").alias("id"), F.to_json(F.struct(F.concat("n_name", F.lit('"\\\t\n')).alias("s"))).alias("d")))
    return e.sql(f"SELECT id, d.s AS t, d.s::string AS v FROM {name}")


def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that arrive in a folder, into a table by two runs of a stream: each line once."""
    e = engine_for(spark, sf_dir)
    base, name = f"{e.catalog.base}/_stream-{uuid.uuid4().hex}", _fresh(e, "d JSON")
    lines = e.spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
    for part in ("event_id < 500", "event_id >= 500"):
        lines.where(part).select("props").write.mode("append").text(f"{base}/in")
        tail(e.table(name), f"{base}/in", f"{base}/checkpoint", once=True).awaitTermination()
    e.catalog.files.delete(base)
    return e.sql(f"SELECT d.k AS k, count(*) AS n FROM {name} GROUP BY d.k")


def named_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in a schema of its own, joined with one of the same name in ``public``."""
    e = engine_for(spark, sf_dir)
    schema, name = f"s{uuid.uuid4().hex[:8]}", f"t{uuid.uuid4().hex[:8]}"
    e.sql(f"CREATE SCHEMA {schema}")
    e.sql(f"CREATE TABLE {schema}.{name} (id BIGINT, d JSON)")
    e.sql(f"CREATE TABLE {name} (id BIGINT)")
    e.sql(f"INSERT INTO {schema}.{name} SELECT n_nationkey, to_json(named_struct('r', n_regionkey)) FROM nation")
    e.sql(f"INSERT INTO public.{name} SELECT r_regionkey FROM region WHERE r_regionkey < 3")
    return e.sql(f"SELECT q.id AS id, count(*) AS n FROM {schema}.{name} p JOIN {name} q ON p.d.r = q.id GROUP BY q.id")


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three inserts that disagree in their types, as one file set; one of a fourth insert is taken out again."""
    e = engine_for(spark, sf_dir)
    name = _fresh(e, "id BIGINT, d JSON")
    for k in range(3):
        value = ("n_nationkey", "n_name", "array(n_regionkey)")[k]
        e.sql(f"INSERT INTO {name} SELECT n_nationkey, to_json(named_struct('v', {value})) FROM nation WHERE n_nationkey % 3 = {k}")
    t = e.table(name)
    t.compact()
    (kept,) = t.manifest.state()[0]
    e.sql(f"INSERT INTO {name} VALUES (99, NULL)")
    t.manifest.remove(*(s.id for s in t.manifest.state()[0] if s.id != kept.id))
    return e.sql(f"SELECT id, d.v AS v FROM {name}")


_MORE = (named_schema, compacted, j_text_getters, copy_ndjson, table_hints, table_options, ddl_errors, empty_and_dropped, value_counts_with_nulls, escaped_text, stream_tail)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _query(n) for n in _SQL} | {f.__name__: f for f in _MORE}
ORACLE_SQL: dict[str, str] = {n: check or statement for n, (_, statement, check) in _SQL.items()} | {
    "j_text_getters": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract(props, '$.k')::VARCHAR ELSE '\"' || event_type || '\"' END AS t, CASE WHEN event_id % 2 = 0 THEN json_extract(props, '$.k')::BIGINT END AS i, CASE WHEN event_id % 2 = 1 THEN event_type END AS s FROM events",
    "copy_ndjson": "SELECT json_extract(props, '$.k')::VARCHAR AS k, count(*) AS n, 0::BIGINT AS ids FROM events GROUP BY 1",
    "named_schema": "SELECT r_regionkey AS id, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey < 3 GROUP BY 1",
    "compacted": "SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN n_nationkey::VARCHAR WHEN 1 THEN '\"' || n_name || '\"' ELSE '[' || n_regionkey || ']' END AS v FROM nation",
    "table_hints": "SELECT event_id AS id, event_id + event_id % 100 AS k, NULL::VARCHAR AS s, 4 AS refused FROM events",
    "table_options": "SELECT codec, true AS written, 25::BIGINT AS n FROM (VALUES ('zstd'), ('gzip'), ('snappy'), ('lz4_raw'), ('uncompressed')) AS t(codec)",
    "ddl_errors": "SELECT n::INT AS n, true AS refused FROM range(17) AS t(n)",
    "empty_and_dropped": "SELECT 0::BIGINT AS n, 0::BIGINT AS x, true AS there, false AS gone, true AS own",
    "value_counts_with_nulls": "SELECT CASE WHEN event_id % 3 = 0 THEN '\"' || event_type || '\"' END AS value, count(*) AS count FROM events GROUP BY 1",
    "escaped_text": r"""SELECT n_nationkey AS id, '"' || n_name || '\"\\\t\n"' AS t, n_name || '"\' || chr(9) || chr(10) AS v FROM nation""",
    "stream_tail": "SELECT json_extract(props, '$.k')::VARCHAR AS k, count(*) AS n FROM events GROUP BY 1",
}

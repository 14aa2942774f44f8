"""The reference queries by name, over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators.structure import structure_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: Engines whose collections a lazy result still reads.
_alive: list[Engine] = []

_IDS = {"orders": "o_orderkey", "part": "p_partkey", "events": "event_id", "customer": "c_custkey", "supplier": "s_suppkey", "documents": "doc_id"}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _customer_docs(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (_table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    home = F.struct(F.struct(F.col("n_name").alias("name"), F.struct(F.col("r_name").alias("name")).alias("region")).alias("nation"))
    return j.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")).alias("profile"), home.alias("home"))


def _party_docs(spark: SparkSession, d: str) -> DataFrame:
    c, s, n = (_table(spark, d, t) for t in ("customer", "supplier", "nation"))
    first = s.groupBy("s_nationkey").agg(F.min(F.struct("s_suppkey", "s_name")).alias("s"))
    j = c.join(first, c.c_nationkey == first.s_nationkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.select(F.col("c_custkey").alias("key"), F.struct(F.col("c_name").alias("name"), F.col("n_name").alias("nation")).alias("buyer"), F.struct(F.col("s.s_name").alias("name"), F.col("n_name").alias("nation")).alias("seller"))


def _event_docs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").withColumn("props", F.from_json("props", "k int"))


def _order_docs(spark: SparkSession, d: str) -> DataFrame:
    o, l = _table(spark, d, "orders"), _table(spark, d, "lineitem")
    lines = l.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("lines"))
    return o.join(lines, o.o_orderkey == lines.l_orderkey, "left").select("o_orderkey", "o_totalprice", F.struct("o_orderstatus", "o_orderpriority").alias("state"), "lines")


_DERIVED = {"customer_docs": (_customer_docs, "key"), "party_docs": (_party_docs, "key"), "event_docs": (_event_docs, "event_id"), "order_docs": (_order_docs, "o_orderkey")}

_CUSTOMER_DOCS = "customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"
_PARTY_DOCS = "customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN (SELECT s_nationkey, arg_min(s_name, s_suppkey) AS s_name FROM supplier GROUP BY 1) s ON c.c_nationkey = s.s_nationkey"


def engine(spark: SparkSession, d: str, *names: str) -> Engine:
    e = Engine(spark)
    for name in names:
        if name in _DERIVED:
            make, key = _DERIVED[name]
            e.register(name, make(spark, d), key)
        elif name == "lineitem":
            e.register(name, _table(spark, d, name).withColumn("object_id", F.col("l_orderkey") * 8 + F.col("l_linenumber")))
        else:
            e.register(name, _table(spark, d, name), _IDS[name])
    _alive.append(e)
    return e


def _add(name: str, collection: str, statement: str, oracle: str | None, params: Any = None) -> None:
    _QUERIES[name] = lambda spark, d: engine(spark, d, collection).query(statement, params)
    if oracle:
        _ORACLES[name] = oracle


# Projection
_add("project_fields", "orders", "SELECT o_custkey, o_orderstatus FROM orders", "SELECT o_orderkey AS object_id, o_custkey, o_orderstatus FROM orders")
_add("project_alias", "orders", 'SELECT object_id AS id, o_totalprice AS "Price" FROM orders o WHERE o.o_orderstatus = \'F\'', "SELECT o_orderkey AS id, o_totalprice AS \"Price\" FROM orders WHERE o_orderstatus = 'F'")
_add("project_expr", "lineitem", "SELECT l_extendedprice * (1 - l_discount) AS revenue, l_linenumber + 2 AS n FROM lineitem", "SELECT l_orderkey * 8 + l_linenumber AS object_id, l_extendedprice * (1 - l_discount) AS revenue, CAST(l_linenumber + 2 AS BIGINT) AS n FROM lineitem")
_add("project_case", "orders", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state, CASE WHEN o_totalprice > 200000 THEN 1 END AS big FROM orders", "SELECT o_orderkey AS object_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state, CAST(CASE WHEN o_totalprice > 200000 THEN 1 END AS BIGINT) AS big FROM orders")
_add("select_documents", "part", "SELECT * FROM part WHERE p_size <= 10", "SELECT * FROM part WHERE p_size <= 10")
_add("find_documents", "part", "FIND part WHERE p_size = 7", "SELECT * FROM part WHERE p_size = 7")
_add("wildcard_top", "party_docs", "SELECT ? FROM party_docs", f"SELECT c.c_custkey AS object_id, c.c_custkey AS key, CAST(2 AS BIGINT) AS buyer, CAST(2 AS BIGINT) AS seller FROM {_PARTY_DOCS}")
_add("wildcard_child", "customer_docs", "SELECT profile.? FROM customer_docs", f"SELECT c_custkey AS object_id, c_mktsegment AS segment, c_acctbal AS balance FROM {_CUSTOMER_DOCS}")
_add("wildcard_recursive", "customer_docs", "SELECT home.* FROM customer_docs", f'SELECT c_custkey AS object_id, CAST(2 AS BIGINT) AS nation, n_name AS "home.nation.name", CAST(1 AS BIGINT) AS region, r_name AS "home.nation.region.name" FROM {_CUSTOMER_DOCS}')
_add("leaf_unique", "customer_docs", "SELECT segment FROM customer_docs WHERE balance > 0", f"SELECT c_custkey AS object_id, c_mktsegment AS segment FROM {_CUSTOMER_DOCS} WHERE c_acctbal > 0")
_add("leaf_ambiguous", "party_docs", "SELECT nation, buyer.name AS b FROM party_docs", f'SELECT c_custkey AS object_id, n_name AS "buyer.nation", n_name AS "seller.nation", c_name AS b FROM {_PARTY_DOCS}')
_add("object_projection", "order_docs", "SELECT state.o_orderpriority AS p, o_totalprice FROM order_docs WHERE state.o_orderstatus = 'P'", "SELECT o_orderkey AS object_id, o_orderpriority AS p, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
_add("case_insensitive_field", "orders", "SELECT O_CUSTKEY AS k FROM orders WHERE O_TotalPrice < 5000", "SELECT o_orderkey AS object_id, o_custkey AS k FROM orders WHERE o_totalprice < 5000")
# Filters
_add("filter_cmp", "orders", "SELECT o_custkey FROM orders WHERE o_totalprice >= 150000 AND o_custkey <> 7", "SELECT o_orderkey AS object_id, o_custkey FROM orders WHERE o_totalprice >= 150000 AND o_custkey <> 7")
_add("filter_logic", "part", "SELECT p_name FROM part WHERE (p_size < 5 OR p_size > 45) AND NOT p_retailprice > 1500", "SELECT p_partkey AS object_id, p_name FROM part WHERE (p_size < 5 OR p_size > 45) AND NOT p_retailprice > 1500")
_add("filter_in", "orders", "SELECT o_orderpriority FROM orders WHERE o_orderstatus IN ('F','P') AND o_custkey IN (1,2,3,4,5)", "SELECT o_orderkey AS object_id, o_orderpriority FROM orders WHERE o_orderstatus IN ('F','P') AND o_custkey IN (1,2,3,4,5)")
_add("filter_not_in", "orders", "SELECT o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F','O')", "SELECT o_orderkey AS object_id, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F','O')")
_add("filter_between", "part", "SELECT p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 1000 AND 1200", "SELECT p_partkey AS object_id, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 1000 AND 1200")
_add("filter_like", "part", "SELECT p_name FROM part WHERE p_brand LIKE 'brand#1%'", "SELECT p_partkey AS object_id, p_name FROM part WHERE p_brand ILIKE 'brand#1%'")
_add("filter_not_like", "part", "SELECT p_type FROM part WHERE p_type NOT LIKE '%E%'", "SELECT p_partkey AS object_id, p_type FROM part WHERE p_type NOT ILIKE '%E%'")
_add("filter_like_escape", "documents", "SELECT source FROM documents WHERE text LIKE '%!%!%!%%' ESCAPE '!'", "SELECT doc_id AS object_id, source FROM documents WHERE text LIKE '%!%!%!%%' ESCAPE '!'")
_add("filter_glob", "part", "SELECT p_brand FROM part WHERE p_brand GLOB 'Brand#[1-3]?'", "SELECT p_partkey AS object_id, p_brand FROM part WHERE p_brand GLOB 'Brand#[1-3]?'")
_add("filter_is_null", "event_docs", "SELECT value FROM event_docs WHERE props.k IS NULL", "SELECT event_id AS object_id, value FROM events WHERE TRY_CAST(props->>'k' AS INTEGER) IS NULL")
_add("filter_is_not", "orders", "SELECT o_custkey FROM orders WHERE o_orderstatus IS NOT 'O' AND o_custkey IS NOT NULL", "SELECT o_orderkey AS object_id, o_custkey FROM orders WHERE o_orderstatus IS DISTINCT FROM 'O' AND o_custkey IS NOT NULL")
_add("filter_not_3vl", "event_docs", "SELECT user_id FROM event_docs WHERE NOT (props.k > 50 OR nowhere = 1)", "SELECT event_id AS object_id, user_id FROM events WHERE NOT (TRY_CAST(props->>'k' AS INTEGER) > 50 OR NULL)")
_add("filter_ambiguous_pos", "party_docs", "SELECT key FROM party_docs WHERE name LIKE '%1'", f"SELECT c_custkey AS object_id, c_custkey AS key FROM {_PARTY_DOCS} WHERE c_name ILIKE '%1' OR s_name ILIKE '%1'")
_add("filter_ambiguous_neg", "party_docs", "SELECT key FROM party_docs WHERE name NOT LIKE '%1'", f"SELECT c_custkey AS object_id, c_custkey AS key FROM {_PARTY_DOCS} WHERE c_name NOT ILIKE '%1' AND s_name NOT ILIKE '%1'")
_add("filter_cross_class", "orders", "SELECT o_orderstatus = 1 AS never, o_custkey < 'a' AS always FROM orders", "SELECT o_orderkey AS object_id, CAST(0 AS BIGINT) AS never, CAST(1 AS BIGINT) AS always FROM orders")
_add("unknown_field_null", "orders", "SELECT nowhere, COALESCE(nowhere, o_orderstatus) AS s FROM orders", "SELECT o_orderkey AS object_id, CAST(NULL AS VARCHAR) AS nowhere, o_orderstatus AS s FROM orders")
# Parameters
_add("param_positional", "orders", "SELECT o_custkey FROM orders WHERE o_orderstatus = ? AND o_totalprice BETWEEN ? AND ?", "SELECT o_orderkey AS object_id, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 1000 AND 90000", ["O", 1000, 90000])
_add("param_named", "orders", "SELECT o_custkey FROM orders WHERE o_orderstatus = $s OR o_custkey = $k", "SELECT o_orderkey AS object_id, o_custkey FROM orders WHERE o_orderstatus = 'P' OR o_custkey = 10", {"s": "P", "$k": 10})
_add("param_in_list", "part", "SELECT p_name FROM part WHERE p_size IN (?, ?, ?)", "SELECT p_partkey AS object_id, p_name FROM part WHERE p_size IN (1, 2, 3)", [1, 2, 3])
# Aggregation
_add("agg_global", "lineitem", "SELECT COUNT(*) AS n, SUM(l_linenumber) AS s, ROUND(AVG(l_quantity), 6) AS a, MIN(l_tax) AS lo, MAX(l_shipdate) AS hi FROM lineitem", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, round(avg(l_quantity), 6) AS a, min(l_tax) AS lo, epoch_us(max(l_shipdate)) // 1000 AS hi FROM lineitem")
_add("agg_group", "lineitem", "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS q, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2")
_add("agg_having_alias", "orders", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 10", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10")
_add("agg_distinct", "lineitem", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS s, SUM(DISTINCT l_linenumber) AS t FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS t FROM lineitem GROUP BY 1")
_add("agg_total", "orders", "SELECT TOTAL(o_custkey) AS t, SUM(o_custkey) AS s FROM orders WHERE o_totalprice < 0", "SELECT CAST(coalesce(sum(o_custkey), 0) AS DOUBLE) AS t, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders WHERE o_totalprice < 0")
_add("agg_group_concat", "part", "SELECT p_brand, GROUP_CONCAT(DISTINCT p_size) AS sizes FROM part GROUP BY p_brand", "SELECT p_brand, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS sizes FROM part GROUP BY 1")
_add("agg_group_expr", "orders", "SELECT o_custkey % 10 AS bucket, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10 ORDER BY bucket", "SELECT o_custkey % 10 AS bucket, count(*) AS n FROM orders GROUP BY 1")
_add("agg_min_max_date", "events", "SELECT event_type, MIN(ts) AS lo, MAX(ts) AS hi FROM events GROUP BY event_type", "SELECT event_type, epoch_us(min(ts)) // 1000 AS lo, epoch_us(max(ts)) // 1000 AS hi FROM events GROUP BY 1")
_add("agg_bare_max", "part", "SELECT p_brand, MAX(p_partkey) AS m, p_name FROM part GROUP BY p_brand", "SELECT p_brand, max(p_partkey) AS m, arg_max(p_name, p_partkey) AS p_name FROM part GROUP BY 1")
_add("group_without_aggregate", "orders", "SELECT o_orderstatus FROM orders GROUP BY o_orderstatus", "SELECT min(o_orderkey) AS object_id, o_orderstatus FROM orders GROUP BY 2")
_add("scalar_min_max_null", "event_docs", "SELECT object_id, MAX(user_id, 500) AS hi, MIN(props.k, nowhere) AS none FROM event_docs", "SELECT event_id AS object_id, greatest(user_id, 500) AS hi, CAST(NULL AS BIGINT) AS none FROM events")
# Distinct, order, pages
_add("distinct_values", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_add("order_limit", "orders", "SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice >= ? ORDER BY o_totalprice DESC, object_id LIMIT 100", "SELECT o_orderkey AS object_id, o_custkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", [1000])
_add("order_offset", "part", "SELECT p_name FROM part ORDER BY p_retailprice, object_id LIMIT 20 OFFSET 30", "SELECT p_partkey AS object_id, p_name FROM part ORDER BY p_retailprice, p_partkey LIMIT 20 OFFSET 30")
_add("order_alias_vs_field", "orders", "SELECT o_custkey AS o_totalprice, o_orderstatus FROM orders ORDER BY o_totalprice, object_id LIMIT 50", "SELECT o_orderkey AS object_id, o_custkey AS o_totalprice, o_orderstatus FROM (SELECT * FROM orders ORDER BY orders.o_totalprice, o_orderkey LIMIT 50)")
_add("order_distinct_hidden", "part", "SELECT DISTINCT p_brand FROM part ORDER BY p_retailprice, p_brand LIMIT 5", "SELECT p_brand FROM (SELECT p_brand, min(p_retailprice) AS r FROM part GROUP BY 1) ORDER BY r, p_brand LIMIT 5")
_add("limit_negative", "part", "SELECT p_size FROM part LIMIT -1 OFFSET 0", "SELECT p_partkey AS object_id, p_size FROM part")
# Functions
_add("fn_string", "part", "SELECT UPPER(p_name) AS u, LENGTH(p_name) AS n, SUBSTR(p_name, -3, 2) AS s, SUBSTR(p_name, 0, 3) AS z, REPLACE(p_brand, '#', '-') AS r, INSTR(p_type, 'A') AS i, p_brand || '/' || p_size AS c, TRIM('xx' || p_brand || 'x', 'x') AS t, HEX(p_brand) AS h FROM part", "SELECT p_partkey AS object_id, upper(p_name) AS u, length(p_name) AS n, substr(p_name, -3, 2) AS s, substr(p_name, 1, 2) AS z, replace(p_brand, '#', '-') AS r, instr(p_type, 'A') AS i, p_brand || '/' || p_size AS c, p_brand AS t, hex(p_brand) AS h FROM part")
_add("fn_math", "events", "SELECT ABS(value - 50) AS a, ROUND(value, 1) AS r, SIGN(value - 50) AS s, FLOOR(value) AS f, CEIL(value) AS c, ROUND(SQRT(ABS(value)), 6) AS q, ROUND(POW(value, 2), 4) AS p FROM events", "SELECT event_id AS object_id, abs(value - 50) AS a, round(value, 1) AS r, CAST(sign(value - 50) AS BIGINT) AS s, floor(value) AS f, ceil(value) AS c, round(sqrt(abs(value)), 6) AS q, round(pow(value, 2), 4) AS p FROM events")
_add("fn_null", "orders", "SELECT IFNULL(nowhere, 'x') AS a, NULLIF(o_orderstatus, 'F') AS b, IIF(o_custkey > 100, 'big', 'small') AS c, TYPEOF(o_totalprice) AS t FROM orders", "SELECT o_orderkey AS object_id, 'x' AS a, nullif(o_orderstatus, 'F') AS b, CASE WHEN o_custkey > 100 THEN 'big' ELSE 'small' END AS c, 'real' AS t FROM orders")
_add("fn_date", "events", "SELECT DATE(ts / 1000, 'unixepoch') AS d, STRFTIME('%Y-%m', ts / 1000, 'unixepoch') AS m, ts AS ms FROM events", "SELECT event_id AS object_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%Y-%m') AS m, epoch_us(ts) // 1000 AS ms FROM events")
_add("fn_json", "events", "SELECT JSON_EXTRACT(props, '$.k') AS k FROM events", "SELECT event_id AS object_id, props->>'k' AS k FROM events")
_add("fn_bitwise", "orders", "SELECT o_custkey & 7 AS a, o_custkey | 8 AS b, o_custkey << 2 AS c, o_custkey >> 1 AS d, ~o_custkey AS e FROM orders", "SELECT o_orderkey AS object_id, o_custkey & 7 AS a, o_custkey | 8 AS b, o_custkey << 2 AS c, o_custkey >> 1 AS d, ~o_custkey AS e FROM orders")
_add("fn_int_div", "orders", "SELECT o_custkey / 7 AS q, o_custkey % 7 AS r, o_totalprice / 2.0 AS h FROM orders", "SELECT o_orderkey AS object_id, o_custkey // 7 AS q, o_custkey % 7 AS r, o_totalprice / 2 AS h FROM orders")
_add("fn_div_zero", "orders", "SELECT o_custkey / 0 AS a, o_custkey % 0 AS b, o_totalprice / 0 AS c FROM orders", "SELECT o_orderkey AS object_id, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS DOUBLE) AS c FROM orders")
_add("fn_text_number", "part", "SELECT '3x' * 2 AS a, p_brand + 1 AS b FROM part", "SELECT p_partkey AS object_id, CAST(6 AS BIGINT) AS a, CAST(1 AS DOUBLE) AS b FROM part")
_add("fn_json_compare", "events", "SELECT COUNT(*) AS n, MAX(value) AS v FROM events WHERE JSON_EXTRACT(props, '$.k') > 50 AND JSON_EXTRACT(props, '$.k') <> 69", "SELECT count(*) AS n, max(value) AS v FROM events WHERE CAST(props->>'k' AS BIGINT) > 50 AND CAST(props->>'k' AS BIGINT) <> 69")
_add("fn_json_type", "events", "SELECT JSON_TYPE(props) AS t, JSON_TYPE(props, '$.k') AS k, props -> '$.k' AS j FROM events", "SELECT event_id AS object_id, lower(json_type(props)) AS t, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'real' WHEN 'VARCHAR' THEN 'text' WHEN 'NULL' THEN 'null' END AS k, CAST(props->'$.k' AS VARCHAR) AS j FROM events")
_add("fn_floor_div", "events", "SELECT FLOOR(value) / 2 AS f, CEIL(value) / 4 AS c, TRUNC(0 - value) AS t, FLOOR(user_id) / 2 AS w FROM events", "SELECT event_id AS object_id, floor(value) / 2 AS f, ceil(value) / 4 AS c, trunc(0 - value) + 0 AS t, user_id // 2 AS w FROM events")
_add("fn_case", "documents", "SELECT UPPER(text) AS u, LOWER(text) AS l FROM documents", "SELECT doc_id AS object_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS u, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS l FROM documents")
_add("fn_printf", "orders", "SELECT PRINTF('%05d|%.2f|%s|%x', o_custkey, o_totalprice, o_orderstatus, o_orderkey) AS p, PRINTF('%d', o_totalprice) AS d FROM orders", "SELECT o_orderkey AS object_id, printf('%05d|%.2f|%s|%x', o_custkey, o_totalprice, o_orderstatus, o_orderkey) AS p, CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) AS d FROM orders")
_add("fn_like_glob", "part", "SELECT LIKE('%A%', p_name) AS l, GLOB('*a*', p_name) AS g FROM part", "SELECT p_partkey AS object_id, CAST(p_name ILIKE '%a%' AS BIGINT) AS l, CAST(p_name GLOB '*a*' AS BIGINT) AS g FROM part")
_add("fn_concat", "part", "SELECT CONCAT(p_brand, '-', p_size) AS c, CONCAT_WS('/', p_brand, p_type) AS w FROM part", "SELECT p_partkey AS object_id, p_brand || '-' || p_size AS c, p_brand || '/' || p_type AS w FROM part")
_add("filter_regexp", "part", "SELECT p_brand FROM part WHERE p_brand REGEXP '#[1-3]' AND NOT p_name REGEXP '[0-9]5$'", "SELECT p_partkey AS object_id, p_brand FROM part WHERE regexp_matches(p_brand, '#[1-3]') AND NOT regexp_matches(p_name, '[0-9]5$')")
_add("literal_booleans", "orders", "SELECT o_custkey > 50 AND true AS t, false AS f FROM orders WHERE true", "SELECT o_orderkey AS object_id, CAST(o_custkey > 50 AS BIGINT) AS t, CAST(0 AS BIGINT) AS f FROM orders")
_add("order_ordinal", "orders", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY 2 DESC, 1 LIMIT 3", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
_add("filter_ambiguous_is_not", "party_docs", "SELECT key FROM party_docs WHERE name IS NOT NULL", f"SELECT c_custkey AS object_id, c_custkey AS key FROM {_PARTY_DOCS} WHERE c_name IS NOT NULL OR s.s_name IS NOT NULL")
_add("group_by_array", "order_docs", "SELECT COUNT(*) AS n, MIN(o_orderkey) AS lo FROM order_docs GROUP BY lines", "SELECT count(*) AS n, min(o_orderkey) AS lo FROM (SELECT o_orderkey, (SELECT list((l_linenumber, l_quantity) ORDER BY l_linenumber, l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders) GROUP BY lines")


# Mutations, on a collection loaded with all orders
def _mutated(*statements: tuple) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = Engine(spark)
        _alive.append(e)
        e.load("o", _table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "o_orderkey")
        for statement, params in statements:
            e.execute(statement, params)
        cols = [c for c in e.frame("o").columns if not c.startswith("__")]
        return e.frame("o").select(*cols)

    return run


_O = "SELECT o_orderkey AS object_id, o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


def _add_mutation(name: str, oracle: str, *statements: tuple) -> None:
    _QUERIES[name], _ORACLES[name] = _mutated(*statements), oracle


_add_mutation("insert_then_read", f"{_O} UNION ALL SELECT (SELECT max(o_orderkey) FROM orders) + 1, 0, 1, 'N', 1.5", ("INSERT INTO o", {"o_orderkey": 0, "o_custkey": 1, "o_orderstatus": "N", "o_totalprice": 1.5}))
_add_mutation("update_merge", f"SELECT * REPLACE (CASE WHEN o_custkey < 50 THEN 'M' ELSE o_orderstatus END AS o_orderstatus) FROM ({_O})", ("UPDATE o WHERE o_custkey < 50", {"o_orderstatus": "M"}))
_add_mutation("update_set_expr", f"SELECT *, o_totalprice * 2 AS twice FROM (SELECT * REPLACE (o_custkey + 1 AS o_custkey) FROM ({_O})) WHERE o_orderstatus = 'F' UNION ALL SELECT *, NULL FROM ({_O}) WHERE o_orderstatus <> 'F'", ("UPDATE o SET o_custkey = o_custkey + 1, twice = o_totalprice * 2 WHERE o_orderstatus = 'F'", None))
_add_mutation("update_swap", "SELECT o_orderkey AS object_id, o_custkey AS o_orderkey, o_orderkey AS o_custkey, o_orderstatus, o_totalprice FROM orders", ("UPDATE o SET o_orderkey = o_custkey, o_custkey = o_orderkey", None))
_add_mutation("upsert_match", f"SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS o_totalprice) FROM ({_O})", ("UPSERT INTO o WHERE o_orderstatus = 'P'", {"o_totalprice": 0.0}))
_add_mutation("upsert_miss", f"{_O} UNION ALL SELECT (SELECT max(o_orderkey) FROM orders) + 1, NULL, NULL, 'Z', NULL", ("UPSERT INTO o WHERE o_orderstatus = $o_orderstatus", {"o_orderstatus": "Z"}))
_add_mutation("replace_doc", f"SELECT object_id, CASE WHEN o_custkey = 3 THEN NULL ELSE o_orderkey END AS o_orderkey, o_custkey, CASE WHEN o_custkey = 3 THEN 'R' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey = 3 THEN NULL ELSE o_totalprice END AS o_totalprice FROM ({_O})", ("REPLACE INTO o WHERE o_custkey = $o_custkey", {"o_custkey": 3, "o_orderstatus": "R"}))
_add_mutation("unset_path", f"SELECT * REPLACE (CASE WHEN o_custkey > 100 THEN NULL ELSE o_totalprice END AS o_totalprice) FROM ({_O})", ("UNSET o_totalprice FROM o WHERE o_custkey > 100", None))
_add_mutation("delete_where", f"{_O} WHERE NOT o_totalprice > 100000", ("DELETE FROM o WHERE o_totalprice > 100000", None))
_TEN = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"
_add_mutation("update_limit", f"SELECT * REPLACE (CASE WHEN o_orderkey IN ({_TEN}) THEN 'T' ELSE o_orderstatus END AS o_orderstatus) FROM ({_O})", ("UPDATE o WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", {"o_orderstatus": "T"}))
_add_mutation("delete_limit", f"{_O} WHERE o_orderkey NOT IN ({_TEN})", ("DELETE FROM o WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None))

# Structure, streaming, raw passthrough
_QUERIES["structure_types"] = lambda spark, d: structure_table(_event_docs(spark, d))
_ORACLES["structure_types"] = """
SELECT path, type, CAST(n AS BIGINT) AS n FROM (
  SELECT 'event_id' AS path, 'number' AS type, count(event_id) AS n FROM events UNION ALL
  SELECT 'ts', 'date', count(ts) FROM events UNION ALL
  SELECT 'user_id', 'number', count(user_id) FROM events UNION ALL
  SELECT 'event_type', 'string', count(event_type) FROM events UNION ALL
  SELECT 'value', 'number', count(value) FROM events UNION ALL
  SELECT 'props', 'object', count(props) FROM events UNION ALL
  SELECT 'props.k', 'number', count(TRY_CAST(props->>'k' AS INTEGER)) FROM events UNION ALL
  SELECT 'props.k', 'null', count(*) FILTER (props IS NOT NULL AND TRY_CAST(props->>'k' AS INTEGER) IS NULL) FROM events
) WHERE n > 0"""


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    t = structure_table(_customer_docs(spark, d))
    n = _customer_docs(spark, d).agg(F.count(F.lit(1)).alias("documents"))
    return t.groupBy("path").agg(F.sum("n").alias("present")).join(F.broadcast(n)).select("path", "present", (F.col("present") / F.col("documents")).alias("coverage"))


_QUERIES["structure_coverage"] = _coverage
_ORACLES["structure_coverage"] = "SELECT path, (SELECT count(*) FROM customer) AS present, CAST(1 AS DOUBLE) AS coverage FROM (VALUES ('key'), ('name'), ('profile'), ('profile.segment'), ('profile.balance'), ('home'), ('home.nation'), ('home.nation.name'), ('home.nation.region'), ('home.nation.region.name')) t(path)"
_QUERIES["raw_query"] = lambda spark, d: engine(spark, d, "orders").raw("QUERY ON orders WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS customers FROM t WHERE n > ? GROUP BY n", [1])
_ORACLES["raw_query"] = "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) WHERE n > 1 GROUP BY 1"
_QUERIES["raw_window_join"] = lambda spark, d: engine(spark, d, "orders", "customer").raw("QUERY ON orders SELECT o_orderkey, c_name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders JOIN customer ON o_custkey = c_custkey")
_ORACLES["raw_window_join"] = "SELECT o_orderkey, c_name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders JOIN customer ON o_custkey = c_custkey"
_QUERIES["raw_recursive"] = lambda spark, d: engine(spark, d, "orders").raw("QUERY ON orders WITH RECURSIVE r(i) AS (SELECT 0 UNION ALL SELECT i + 1 FROM r WHERE i < 9) SELECT i, count(*) AS n FROM r JOIN orders ON o_custkey % 10 = i GROUP BY i")
_ORACLES["raw_recursive"] = "SELECT CAST(o_custkey % 10 AS INTEGER) AS i, count(*) AS n FROM orders GROUP BY 1"
_QUERIES["reference_join"] = lambda spark, d: engine(spark, d, "orders", "customer_docs").raw("QUERY ON orders SELECT o_orderkey, c.name, c.profile.segment AS segment FROM orders JOIN customer_docs c ON o_custkey = c.object_id")
_ORACLES["reference_join"] = "SELECT o_orderkey, c_name AS name, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey"


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)

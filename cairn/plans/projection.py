"""The driver's star schema as a property graph. One text serves Spark and the SQL that results are compared with.

Customers and suppliers are files, orders and parts symbols of those files; line items make calls and imports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.operators.graph import PropertyGraph
from cairn.session import is_written, load, materialize

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

_PLACES = "SELECT n_nationkey, lower(concat(r_name, '/', n_name)) AS folder, n_regionkey FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"
_CUSTOMER_FILES = """SELECT c_custkey, concat(CASE WHEN c_custkey % 41 = 0 THEN 'vendor/' ELSE '' END, folder, '/', CASE WHEN c_custkey % 211 = 0 THEN 'main.py'
  ELSE concat('c', CAST(c_custkey AS STRING_), CASE c_custkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.go' ELSE '.min.js' END) END) AS path, n_regionkey FROM {customer} JOIN places ON c_nationkey = n_nationkey"""
_SUPPLIER_FILES = "SELECT s_suppkey, concat(folder, '/s', CAST(s_suppkey AS STRING_), CASE s_suppkey % 2 WHEN 0 THEN '.ts' ELSE '.rs' END) AS path, n_regionkey FROM {supplier} JOIN places ON s_nationkey = n_nationkey"
_PART_HOME = "SELECT p_partkey, p_size, path FROM (SELECT p_partkey, p_size, p_partkey % n AS home FROM {part} CROSS JOIN (SELECT count(*) AS n FROM {supplier}) counted) placed JOIN supplier_files ON s_suppkey = home"

NODES = """
SELECT concat('file:', path) AS node_id, 'file' AS node_type, path AS file_path, CAST(NULL AS STRING_) AS name, CAST(NULL AS STRING_) AS qualified_name, CAST(NULL AS STRING_) AS kind,
  CAST(NULL AS BIGINT) AS complexity, CAST(key_ % 5 AS BIGINT) AS churn, n_regionkey AS region FROM (
  SELECT min(c_custkey) AS key_, path, min(n_regionkey) AS n_regionkey FROM customer_files GROUP BY path UNION ALL SELECT s_suppkey, path, n_regionkey FROM supplier_files) files
UNION ALL
SELECT concat('symbol:', path, ':order_', CAST(o_orderkey AS STRING_)), 'symbol', path, name,
  CASE o_orderstatus WHEN 'O' THEN concat(CASE WHEN o_orderkey % 2 = 0 THEN 'Order.' ELSE 'order.' END, name) ELSE name END,
  CASE o_orderstatus WHEN 'F' THEN 'function' WHEN 'O' THEN 'method' ELSE 'class' END, CAST(floor(o_totalprice / 30000) AS BIGINT), CAST(o_orderkey % 3 AS BIGINT), n_regionkey FROM (
  SELECT o_orderkey, o_orderstatus, o_totalprice, path, n_regionkey, CASE WHEN o_orderkey % 101 = 0 THEN 'main' WHEN o_orderkey % 53 = 0 THEN concat('__o', CAST(o_orderkey AS STRING_), '__')
    WHEN o_orderkey % 7 = 0 THEN concat('_order_', CAST(o_orderkey AS STRING_)) ELSE concat('order_', CAST(o_orderkey AS STRING_)) END AS name FROM {orders} JOIN customer_files ON o_custkey = c_custkey) named
UNION ALL
SELECT concat('symbol:', path, ':part_', CAST(p_partkey AS STRING_)), 'symbol', path, concat('part_', CAST(p_partkey AS STRING_)), concat('part_', CAST(p_partkey AS STRING_)), 'function',
  CAST(p_size AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS INT) FROM part_home
"""
EDGES = """
SELECT concat('file:', path) AS source, concat('symbol:', path, ':order_', CAST(o_orderkey AS STRING_)) AS target, 'contains' AS edge_type FROM {orders} JOIN customer_files ON o_custkey = c_custkey
UNION ALL SELECT concat('file:', path), concat('symbol:', path, ':part_', CAST(p_partkey AS STRING_)), 'contains' FROM part_home
UNION ALL SELECT concat('symbol:', c.path, ':order_', CAST(l_orderkey AS STRING_)), concat('symbol:', p.path, ':part_', CAST(l_partkey AS STRING_)), 'calls' FROM (
  SELECT DISTINCT l_orderkey, l_partkey FROM {lineitem} WHERE l_discount >= 0.09) called JOIN {orders} ON o_orderkey = l_orderkey JOIN customer_files c ON o_custkey = c_custkey JOIN part_home p ON p_partkey = l_partkey
UNION ALL SELECT DISTINCT concat('file:', c.path), concat('file:', s.path), 'imports' FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey
  JOIN customer_files c ON o_custkey = c_custkey JOIN supplier_files s ON s_suppkey = l_suppkey WHERE l_quantity >= 49
"""
#: Node rows of yearly snapshots: a customer's file is present in years with orders, its attribute is their number.
SNAPSHOTS = """SELECT CAST(year(o_orderdate) - 1994 AS BIGINT) AS snapshot_id, concat('file:c', CAST(o_custkey AS STRING_)) AS node_id, CAST(count(*) AS STRING_) AS attrs_hash FROM {orders} GROUP BY 1, 2"""
#: Trade between nations, the two greatest customers of each: a small graph whose cycles can be counted.
TRADE = """SELECT CAST(s AS STRING_) AS source, CAST(c AS STRING_) AS target FROM (SELECT s_nationkey + 100 AS s, c_nationkey + 100 AS c, row_number() OVER (PARTITION BY s_nationkey ORDER BY count(*) DESC, c_nationkey) AS rank_
  FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON s_suppkey = l_suppkey WHERE s_nationkey <> c_nationkey GROUP BY s_nationkey, c_nationkey) ranked WHERE rank_ <= 2"""


#: Links between customers, by their orders' keys: about 1.4 for each, so that a component grows with the data.
LINKS = """SELECT DISTINCT concat('c', CAST(o_custkey AS STRING_)) AS source, concat('c', CAST(1 + CAST(floor(o_orderkey / 7) AS BIGINT) % n AS STRING_)) AS target
  FROM {orders} CROSS JOIN (SELECT count(*) AS n FROM {customer}) counted WHERE o_orderkey % 7 = 0"""


def _with() -> str:
    return f"WITH places AS ({_PLACES}), customer_files AS ({_CUSTOMER_FILES}), supplier_files AS ({_SUPPLIER_FILES}), part_home AS ({_PART_HOME})"


def _spark(spark: SparkSession, sf_dir: str, sql: str, prefix: bool = True) -> DataFrame:
    text = (_with() + " " if prefix else "") + sql
    used = {t: load(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text.replace("STRING_", "STRING"), **used)


_graphs: dict[tuple[str, str], PropertyGraph] = {}


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The projected graph, written once per session and directory, in folders by type: queries read the types and columns they need."""
    key = spark.sparkContext.applicationId, sf_dir
    held = _graphs.get(key)
    if held is None or not (is_written(held.nodes) and is_written(held.edges)):
        nodes, edges = _spark(spark, sf_dir, NODES), _spark(spark, sf_dir, EDGES)
        held = _graphs[key] = PropertyGraph(materialize(nodes, "nodes", ("node_type",)), materialize(edges, "edges", ("edge_type",)))
    return held


def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, sf_dir, SNAPSHOTS, False)


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, sf_dir, TRADE, False)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, sf_dir, LINKS, False)


def _plain(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("STRING_", "VARCHAR")


def oracle(sql: str) -> str:
    """SQL over ``nodes``, ``edges``, ``snapshot_rows``, ``trade`` and ``links``."""
    parts = _with().replace("WITH ", "WITH RECURSIVE ", 1) + f", nodes AS ({NODES}), edges AS ({EDGES}), snapshot_rows AS ({SNAPSHOTS}), trade AS ({TRADE}), links AS ({LINKS})"
    sql = sql.strip()
    return _plain(parts) + (", " + sql[5:] if sql.upper().startswith("WITH ") else " " + sql)

"""Adapter views: fixes, road nodes, road edges and paired runs over the driver's tables, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_EDGES = """
WITH base AS (
  SELECT node_id AS u, node_id + 1 AS v, 90.0 AS b, s_nationkey AS nk FROM {nodes} WHERE node_id % w < w - 1 AND node_id + 1 < n
  UNION ALL SELECT node_id, node_id + w, 0.0, s_nationkey FROM {nodes} WHERE node_id + w < n),
dir AS (SELECT u, v, b, nk FROM base UNION ALL SELECT v, u, b + 180.0, nk FROM base WHERE nk % 5 <> 0),
keyed AS (SELECT u, v, 0 AS k, b, nk FROM dir UNION ALL SELECT u, v, 1, b, nk FROM dir WHERE nk % 7 = 0)
SELECT u, v, k, CAST(50.0 AS DOUBLE) AS length, CAST(b AS DOUBLE) AS bearing,
  CAST(40 + 10 * (nk % 7) AS DOUBLE) AS maxspeed, CAST(1 + u % 4 AS INT) AS lanes,
  CASE WHEN k = 1 THEN -1 WHEN nk % 11 = 0 THEN 1 ELSE 0 END AS layer,
  CASE WHEN k = 1 THEN 1 ELSE 0 END AS tunnel,
  CASE WHEN k = 0 AND nk % 11 = 0 THEN 1 ELSE 0 END AS bridge,
  CASE WHEN nk % 5 = 0 THEN 1 ELSE 0 END AS oneway FROM keyed"""

_NODES = """
SELECT s.s_suppkey AS node_id, CAST((s.s_suppkey % w.w) * 50 AS DOUBLE) AS x,
  CAST(floor(s.s_suppkey / w.w) * 50 AS DOUBLE) AS y, w.w, w.n, s.s_nationkey
FROM {supplier} s CROSS JOIN (SELECT CAST(ceil(sqrt(count(*))) AS INT) AS w, count(*) AS n FROM {supplier}) w"""

_RUNS = """
SELECT o_orderpriority AS case_name, month(o_orderdate) AS run_index,
  sqrt(avg(l_discount * l_discount)) AS baseline_rmse, sqrt(avg(l_tax * l_tax)) AS treatment_rmse
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY 1, 2"""

_PINGS = """
SELECT event_id, user_id AS track_id, ts, {seconds} AS t_s,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS obs_x,
  CASE WHEN event_type = 'error' THEN NULL ELSE CAST((event_id * 37) % 490 AS DOUBLE) END AS obs_y,
  value AS true_x, CAST((event_id * 37) % 490 AS DOUBLE) AS true_y,
  1.0{d} + CAST({k} AS INT) * 0.1{d} AS hdop,
  9 - CAST(floor(CAST({k} AS INT) / 10) AS INT) AS sat_count,
  event_type AS quality_state FROM {events}"""

#: Tracks with a true edge for each fix, some of them wrong on purpose: bad keys, missing edges, displaced points, uneven steps.
_TRUTH = """
SELECT p.*, CASE WHEN e.key_case = 0 THEN '1.0' WHEN e.key_case = 1 THEN '1' WHEN e.key_case = 2 THEN 'x' WHEN e.key_case = 3 THEN NULL ELSE '0' END AS edge_key,
  concat(CAST(edge_u AS {text}), CASE WHEN event_id % 3 = 0 THEN '.0' ELSE '' END) AS node_text, CAST(edge_v + CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END AS {text}) AS next_text,
  CASE WHEN e.key_case < 2 THEN -1 WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS true_layer, CASE WHEN e.key_case < 2 THEN 1 ELSE 0 END AS true_tunnel,
  (edge_u % w + edge_v % w) * 25.0{d} AS at_x, (floor(edge_u / w) + floor(edge_v / w)) * 25.0{d} + CASE WHEN event_id % 13 = 0 THEN 5 ELSE 0 END AS at_y,
  CASE WHEN event_id % 4 = 0 THEN 5.0{d} + event_id % 20 ELSE 10.0{d} END AS speed, step * CASE WHEN track_id % 2 = 0 THEN 10.0{d} ELSE 100.0{d} END + CASE WHEN event_id % 17 = 0 THEN 3 ELSE 0 END AS path, step + CASE WHEN event_id % 29 = 0 THEN 0.5{d} ELSE 0.0{d} END AS stamp,
  CASE quality_state WHEN 'view' THEN 'tunnel_blackout' WHEN 'click' THEN 'portal_degraded' WHEN 'error' THEN 'portal_blackout' WHEN 'purchase' THEN 'post_tunnel_recovery' ELSE 'open_sky' END AS state
FROM (
  SELECT p.*, row_number() OVER (PARTITION BY track_id ORDER BY t_s, event_id) AS step, event_id % n.n AS edge_u, event_id % n.n + CASE WHEN event_id % 5 = 0 THEN n.w ELSE 1 END AS edge_v, n.w
  FROM {pings} p CROSS JOIN (SELECT max(n) AS n, max(w) AS w FROM {nodes}) n) p
JOIN (SELECT 0 AS key_case UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) e ON event_id % 7 = e.key_case"""

#: Another survey's roads along some edges, with a bend and displaced, of other names, kinds and restrictions.
_ROADS = """
SELECT e.u * 1000000 + e.v AS road, a.x AS ax, a.y + e.u % 5 * 4.0{d} AS ay, (a.x + b.x) / 2 + e.v % 3 AS bx, (a.y + b.y) / 2 + e.u % 5 * 4.0{d} + 1 AS by_, b.x AS cx, b.y + e.u % 5 * 4.0{d} AS cy,
  concat(CASE e.u % 3 WHEN 0 THEN 'North Link ' WHEN 1 THEN 'Old Mill ' ELSE 'Harbour ' END, CASE e.v % 4 WHEN 0 THEN 'Tunnel' WHEN 1 THEN 'Road' ELSE 'St' END) AS name,
  CASE WHEN e.u % 6 = 0 THEN 'Tunnel' WHEN e.u % 6 = 1 THEN 'BRIDGE' WHEN e.u % 6 = 2 THEN 'Ramp' WHEN e.u % 6 = 3 THEN NULL ELSE 'ROAD' END AS kind,
  CASE WHEN e.v % 10 = 0 THEN 'Proposed' ELSE 'Operational' END AS status, CASE WHEN e.v % 12 = 1 THEN 'Private' ELSE NULL END AS access, CASE WHEN e.v % 14 = 3 THEN '4WD' ELSE '2WD' END AS trafficable,
  CASE e.u % 4 WHEN 0 THEN 'Two Way' WHEN 1 THEN 'One Way' WHEN 2 THEN 'From To' ELSE NULL END AS one_way, CASE WHEN e.v % 4 = 0 THEN 'TO FROM' ELSE 'FROM TO' END AS direction,
  CASE WHEN e.u % 3 = 0 THEN 80.0{d} WHEN e.u % 3 = 1 THEN -1.0{d} ELSE NULL END AS speed, CASE WHEN e.v % 2 = 0 THEN 3 ELSE 0 END AS lane_count
FROM {edges} e JOIN {nodes} a ON a.node_id = e.u JOIN {nodes} b ON b.node_id = e.v WHERE e.k = 0 AND (e.u + e.v) % 3 <> 0"""

#: The network with links of many lengths: parallel ones differ, ways there and back differ, and far links cut across or lead round.
_STREETS = """
SELECT u, v, k, CAST(50 + (u * 7 + v * 13 + k * 31) % 60 AS DOUBLE) AS length FROM {edges}
UNION ALL SELECT node_id, (node_id * 17 + 5) % n, 7, CAST(150 + node_id % 11 * 90 AS DOUBLE) FROM {nodes} WHERE node_id % 10 = 3 AND node_id <> (node_id * 17 + 5) % n"""

_SPARK_TIME = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 1000000.0D"
_DUCK_TIME = "date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1000000.0::DOUBLE"

#: The same views as common table expressions for DuckDB, over its registered tables.
DUCK = {
    "pings": _PINGS.format(seconds=_DUCK_TIME, d="::DOUBLE", k="json_extract_string(props, '$.k')", events="events"),
    "nodes": _NODES.format(supplier="supplier"),
    "edges": _EDGES.format(nodes="nodes"),
    "streets": _STREETS.format(edges="edges", nodes="nodes"),
    "runs": _RUNS.format(orders="orders", lineitem="lineitem"),
    "truth": _TRUTH.format(pings="pings", nodes="nodes", d="::DOUBLE", text="VARCHAR"),
    "roads": _ROADS.format(edges="edges", nodes="nodes", d="::DOUBLE"),
}
_NEEDS = {"edges": {"nodes"}, "truth": {"pings", "nodes"}, "roads": {"edges", "nodes"}, "streets": {"edges", "nodes"}}


def with_views(sql: str, *names: str) -> str:
    """sql for DuckDB with the named adapter views before it."""
    wanted = set(names).union(*(_NEEDS.get(n, set()) for n in names))
    needed = [n for n in DUCK if n in wanted]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({DUCK[n]})" for n in needed) + (", " if sql.lstrip().startswith("+") else " ") + sql.lstrip().removeprefix("+")


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PINGS.format(seconds=_SPARK_TIME, d="D", k="get_json_object(props, '$.k')", events="{events}"), events=read(spark, sf_dir, "events"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_NODES, supplier=read(spark, sf_dir, "supplier"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_EDGES, nodes=nodes(spark, sf_dir))


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_STREETS, edges=edges(spark, sf_dir), nodes=nodes(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_RUNS, orders=read(spark, sf_dir, "orders"), lineitem=read(spark, sf_dir, "lineitem"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_TRUTH.format(pings="{pings}", nodes="{nodes}", d="D", text="STRING"), pings=pings(spark, sf_dir), nodes=nodes(spark, sf_dir))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ROADS.format(edges="{edges}", nodes="{nodes}", d="D"), edges=edges(spark, sf_dir), nodes=nodes(spark, sf_dir))

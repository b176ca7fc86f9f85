"""Queries over dirty attributes: nested values, identities, subtypes, speeds, targets and fused edges; each with independent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import scalars as S
from roadloom.operators import fusion, graph
from roadloom.plans.tools import Plan, rounded
from roadloom.sources import tables


def _nested(spark, sf):
    """Parts with attributes as nested arrays, some of them missing."""
    p = tables.read(spark, sf, "part")
    key = F.col("p_partkey")
    text = lambda c: c.cast("string")
    layers = F.array(F.when(key % 5 == 0, "-2").when(key % 5 == 1, "1; 2").when(key % 5 == 2, "level 0"), F.when(key % 3 == 0, text(key % 4)))
    return p.select(
        "p_partkey", "p_name", layers.alias("layers"),
        F.array(F.when(key % 4 == 0, " NaN ").when(key % 4 == 1, "no"), F.when(key % 7 == 0, "Yes"), F.when(key % 6 == 0, "0.0")).alias("tunnels"),
        F.array(F.when(key % 8 == 0, "1"), F.when(key % 8 == 1, "viaduct")).alias("bridges"),
        F.array(F.when(key % 9 == 0, " Motorway_Link "), F.when(key % 2 == 0, "TRUNK"), F.lit("")).alias("highways"),
    )


_NESTED = """n AS (SELECT p_partkey, p_name, p_partkey AS k,
  [CASE k % 5 WHEN 0 THEN '-2' WHEN 1 THEN '1; 2' WHEN 2 THEN 'level 0' END, CASE WHEN k % 3 = 0 THEN CAST(k % 4 AS VARCHAR) END] AS layers,
  [CASE k % 4 WHEN 0 THEN ' NaN ' WHEN 1 THEN 'no' END, CASE WHEN k % 7 = 0 THEN 'Yes' END, CASE WHEN k % 6 = 0 THEN '0.0' END] AS tunnels,
  [CASE WHEN k % 8 = 0 THEN '1' END, CASE WHEN k % 8 = 1 THEN 'viaduct' END] AS bridges,
  [CASE WHEN k % 9 = 0 THEN ' Motorway_Link ' END, CASE WHEN k % 2 = 0 THEN 'TRUNK' END, ''] AS highways FROM part),
m AS (SELECT *, list_filter(list_transform(layers, lambda v: try_cast(nullif(regexp_extract(v, '-?[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE)), lambda v: v IS NOT NULL) AS numbers FROM n)"""


def b4_b5_b22_attributes(spark, sf):
    n = _nested(spark, sf)
    numbers = S.all_numbers(F.col("layers"))
    return n.select(
        "p_partkey", S.first_present(F.col("tunnels"), F.col("highways")).alias("first"), S.text_of_all(F.col("highways")).alias("text"), S.any_flag(F.col("tunnels")).alias("tunnel"),
        F.size(numbers).alias("numbers"), F.get(numbers, F.lit(0)).alias("number"), S.subtype(F.col("tunnels"), F.col("bridges"), F.col("layers"), F.col("highways")).alias("subtype"),
        F.size(S.name_tokens(F.col(S.pick_column(n.columns, ["label", "P_NAME"])))).alias("tokens"),
    )


B4 = f"""WITH {_NESTED} SELECT p_partkey, list_filter(list_concat(tunnels, highways), lambda v: v IS NOT NULL AND lower(trim(v)) <> 'nan')[1] AS first,
  array_to_string(list_filter(list_transform(highways, lambda v: lower(trim(v))), lambda v: v IS NOT NULL AND v <> ''), ' ') AS text, k % 7 = 0 AS tunnel, CAST(len(numbers) AS INT) AS numbers, numbers[1] AS number,
  CASE WHEN k % 7 = 0 OR list_min(numbers) < 0 THEN 'TUNNEL' WHEN k % 8 = 0 OR list_max(numbers) > 0 THEN 'BRIDGE' WHEN k % 9 = 0 THEN 'RAMP' ELSE 'ROAD' END AS subtype,
  CAST(len(list_distinct(string_split(p_name, ' '))) AS INT) AS tokens FROM m"""


def b22_one_way(spark, sf):
    r = tables.roads(spark, sf)
    odd = F.when(F.col("road") % 9 == 0, "1").when(F.col("road") % 9 == 1, "both").otherwise(F.col("one_way"))
    same = S.subtype_similarity(F.lit("ROAD"), F.upper("kind"))
    return r.select("road", S.one_way(odd).alias("single"), same.alias("subtype_score"), S.bearing(F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")).alias("bearing"), S.in_use(F.col("status"), F.col("access"), F.col("trafficable")).alias("in_use"))


B22 = tables.with_views(
    """SELECT road, CASE WHEN road % 9 = 0 THEN true WHEN road % 9 = 1 THEN false WHEN one_way IS NULL THEN NULL ELSE one_way <> 'Two Way' END AS single,
  CASE WHEN kind IS NULL THEN 0.5::DOUBLE WHEN kind = 'ROAD' THEN 1.0 WHEN kind = 'Ramp' THEN 0.75 ELSE 0.65 END AS subtype_score,
  CASE WHEN cx - ax = 0 AND cy - ay = 0 THEN NULL WHEN degrees(atan2(cx - ax, cy - ay)) < 0 THEN degrees(atan2(cx - ax, cy - ay)) + 360 ELSE degrees(atan2(cx - ax, cy - ay)) END AS bearing,
  status = 'Operational' AND access IS NULL AND trafficable = '2WD' AS in_use FROM roads""",
    "roads",
)


def b8_b9_true_edges(spark, sf):
    """Each fix's true edge, found by its exact identity or not at all."""
    t = tables.truth(spark, sf).withColumn("said", F.concat_ws("_", "edge_u", "edge_v", "edge_key"))
    e = tables.edges(spark, sf).select("u", "v", "k")
    found = graph.true_edges(t, e, F.col("edge_u").cast("string"), F.col("node_text"), F.col("edge_key"))
    parsed = S.parse_edge(F.col("said"))
    exact = graph.true_edges(t, e, S.node_id(F.col("edge_u")), S.node_id(F.col("edge_v")), F.col("edge_key"))
    both = exact.select("event_id", "u", "v", "k", parsed["k"].alias("said_key"), F.col("said"))
    return both.join(found.select("event_id", F.col("u").isNotNull().alias("loop_found")), "event_id")


B8 = tables.with_views(
    """SELECT event_id, u, v, k, CASE WHEN edge_key IN ('1', '1.0') THEN 1 ELSE 0 END AS said_key, edge_u || '_' || edge_v || CASE WHEN edge_key IS NULL THEN '' ELSE '_' || edge_key END AS said, false AS loop_found
FROM truth LEFT JOIN edges ON u = edge_u AND v = edge_v AND k = CAST(try_cast(edge_key AS DOUBLE) AS INT)""",
    "truth", "edges",
)


def b17_targets(spark, sf):
    t = tables.truth(spark, sf)
    return t.select("event_id", S.quality_target(F.col("hdop"), F.col("sat_count"), F.col("true_tunnel"), F.col("state")).alias("target"), S.ambiguous(F.col("true_tunnel"), F.col("state")).alias("ambiguous"))


B17 = tables.with_views(
    """SELECT event_id, CASE WHEN sat_count >= 8 AND hdop <= 1.5 AND true_tunnel = 0 THEN 1.0::DOUBLE WHEN true_tunnel = 1 OR state IN ('tunnel_blackout', 'portal_blackout') THEN 0.0 WHEN state = 'portal_degraded' THEN 0.35
  WHEN state = 'post_tunnel_recovery' THEN 0.55 ELSE 0.75 END AS target, CASE WHEN true_tunnel = 1 OR state LIKE '%blackout' THEN 1 ELSE 0 END AS ambiguous FROM truth""",
    "truth",
)


def b19_b20_cleanup(spark, sf):
    """Speed texts of several kinds, tunnels forced below ground, bearings wrapped, times read, provenance kept."""
    t = tables.truth(spark, sf)
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.col("event_id") % 90, F.lit(" mph"))).when(F.col("event_id") % 5 == 1, "none").when(F.col("event_id") % 5 == 2, F.concat(F.lit("signals;"), F.col("event_id") % 200)).otherwise("80.5")
    row = {c: F.col(c).cast("string") for c in ("track_id", "state")}
    kept = S.provenance(row, ["track_id", "state", "source_split"])
    return rounded(
        t.select(
            "event_id", S.speed_mps(text).alias("mps"), S.clean_speed(text).alias("speed"), S.clean_layer(F.col("true_layer").cast("string"), F.when(F.col("event_id") % 4 == 0, "yes").otherwise("no")).alias("layer"),
            F.pmod(S.number(F.col("event_id") * -7.5, 0), S.d(360)).alias("bearing"), F.date_format(S.moment(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")), "yyyy-MM-dd HH:mm:ss").alias("read_at"),
            S.tunnel_edge(F.col("true_tunnel"), F.col("true_layer")).alias("below"), S.bridge_edge(F.lit(0), F.col("true_layer")).alias("above"), *kept,
        )
    )


B19 = tables.with_views(
    """SELECT event_id, round(least(130, greatest(5, CASE event_id % 5 WHEN 0 THEN event_id % 90 * 1.609344::DOUBLE WHEN 1 THEN 60 WHEN 2 THEN event_id % 200 ELSE 80.5 END)) / 3.6::DOUBLE, 6) AS mps,
  CAST(CASE event_id % 5 WHEN 0 THEN event_id % 90 WHEN 1 THEN 60 WHEN 2 THEN event_id % 200 ELSE 80 END AS INT) AS speed, CAST(CASE WHEN event_id % 4 = 0 AND true_layer >= 0 THEN -1 ELSE true_layer END AS INT) AS layer,
  round(((event_id * -7.5::DOUBLE) % 360 + 360) % 360, 6) AS bearing, strftime(ts, '%Y-%m-%d %H:%M:%S') AS read_at, true_tunnel = 1 OR true_layer < 0 AS below, true_layer > 0 AS above,
  CAST(track_id AS VARCHAR) AS track_id, state, CAST(NULL AS VARCHAR) AS source_split FROM truth""",
    "truth",
)


def b18_fused_edges(spark, sf):
    """Edges with their survey's road of the same ends joined in: level, tunnel, bridge, speed, lanes and class."""
    e = tables.edges(spark, sf).withColumn("road", F.col("u") * 1000000 + F.col("v"))
    r = tables.roads(spark, sf).select("road", F.col("kind").alias("road_kind"), F.col("speed").alias("road_speed"), F.col("lane_count").alias("road_lanes"), (F.col("road") % 4 > 0).alias("confident"))
    held = e.join(r, "road", "left")
    layers = F.array(F.col("layer").cast("string"), F.when(F.col("u") % 10 == 0, "2"), F.when(F.col("v") % 10 == 0, "-3"))
    fused = fusion.fused_attributes(
        layers, F.array(F.col("tunnel").cast("string")), F.array(F.col("bridge").cast("string")), F.array(F.col("oneway").cast("string")),
        F.array(F.concat(F.col("maxspeed").cast("int").cast("string"), F.lit(" km/h"))), F.array(F.when(F.col("lanes") > 1, F.col("lanes").cast("string"))), F.when(F.col("lanes") == 4, "motorway_link").otherwise("primary"),
        F.col("confident"), F.col("road_kind"), F.col("road_speed"), F.col("road_lanes"),
    )
    return rounded(held.select("u", "v", "k", *[c.alias(n) for n, c in fused.items()]))


B18 = tables.with_views(
    """+ j AS (SELECT e.*, coalesce(road % 4 > 0, false) AS sure, upper(r.kind) AS kind, r.speed, r.lane_count FROM edges e LEFT JOIN roads r ON road = u * 1000000 + v),
l AS (SELECT *, least(layer, CASE WHEN v % 10 = 0 THEN -3 ELSE layer END) AS lo, greatest(layer, CASE WHEN u % 10 = 0 THEN 2 ELSE layer END) AS hi FROM j),
f AS (SELECT *, CASE WHEN lo < 0 THEN lo WHEN hi > 0 THEN hi ELSE layer END AS lv FROM l),
c AS (SELECT *, tunnel = 1 OR lv < 0 OR (sure AND coalesce(kind = 'TUNNEL', false)) AS tu FROM f),
g AS (SELECT *, NOT tu AND (bridge = 1 OR lv > 0 OR (sure AND coalesce(kind = 'BRIDGE', false))) AS br FROM c)
SELECT u, v, k, CAST(CASE WHEN tu THEN least(lv, -1) WHEN br THEN greatest(lv, 1) ELSE lv END AS INT) AS layer, round(CASE WHEN sure AND speed > 0 THEN speed ELSE maxspeed END, 6) AS maxspeed,
  CAST(CASE WHEN sure AND lane_count > 0 THEN lane_count WHEN lanes > 1 THEN lanes ELSE 1 END AS INT) AS lanes, CAST(tu AS INT) AS tunnel, CAST(br AS INT) AS bridge, CAST(oneway AS INT) AS oneway,
  CASE WHEN lanes = 4 THEN 1.0::DOUBLE ELSE 0.5 END AS highway_idx FROM g""",
    "edges", "roads",
)

PLANS = [
    Plan(b4_b5_b22_attributes, B4), Plan(b22_one_way, B22, "b21_b22_f3_roads"), Plan(b8_b9_true_edges, B8), Plan(b17_targets, B17), Plan(b19_b20_cleanup, B19, "b19_b20_b23_b25_f7_cleanup"), Plan(b18_fused_edges, B18),
]

"""Queries that look edges, lines and places up, and the audit of a network; each with independent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import scalars as S
from roadloom.operators import fusion, geo, graph, sequence
from roadloom.plans.fixes import IMPUTED_SQL
from roadloom.plans.network import CANDIDATES_SQL
from roadloom.plans.tools import Plan, rounded
from roadloom.sources import tables
from roadloom.sources.shared import stored


def _lines(spark, sf):
    return geo.with_points(tables.edges(spark, sf), tables.nodes(spark, sf))


def j17_route_geometry(spark, sf):
    """The line of every true edge, read forwards if the network has it so, else backwards."""
    ids = tables.truth(spark, sf).select("event_id", F.col("edge_v").alias("u"), F.col("edge_u").alias("v"))
    out = graph.route_geometry(ids, _lines(spark, sf))
    first = F.get("points", F.lit(0))
    return out.select("event_id", "way", first["x"].alias("x"), first["y"].alias("y"), geo.valid_line(F.col("points")).alias("valid"))


J17 = tables.with_views(
    """+ l AS (SELECT DISTINCT u, v, a.x, a.y FROM edges JOIN nodes a ON a.node_id = u)
SELECT event_id, CASE WHEN f.u IS NOT NULL THEN 'forward' WHEN b.u IS NOT NULL THEN 'reverse' END AS way, coalesce(f.x, b.x) AS x, coalesce(f.y, b.y) AS y, f.u IS NOT NULL OR b.u IS NOT NULL AS valid
FROM truth LEFT JOIN l f ON f.u = edge_v AND f.v = edge_u LEFT JOIN l b ON b.u = edge_u AND b.v = edge_v""",
    "truth", "edges", "nodes",
)


def j11_chosen_layer(spark, sf):
    """The decoded edge of each fix resolved to the network by text, and the layer that its first equal candidate states."""
    e = tables.edges(spark, sf)
    c = stored(geo.candidates(tables.pings(spark, sf), geo.segments(_lines(spark, sf)), top=3), "three")
    said = c.join(e.select("u", "v", "k", "layer"), ["u", "v", "k"])
    path = c.where("rank = 2").select("event_id", F.concat(F.col("u"), F.lit(".0")).alias("du"), F.concat(F.lit(" "), "v").alias("dv"), F.when(F.col("event_id") % 4 == 0, "0").otherwise(F.col("k").cast("string")).alias("dk"))
    found = graph.true_edges(path, e.select("u", "v", "k"), F.col("du"), F.col("dv"), F.col("dk")).select("event_id", "u", "v", "k")
    return graph.chosen_layer(found, said)


J11 = tables.with_views(
    CANDIDATES_SQL
    + """, p AS (SELECT event_id, u, v, CASE WHEN event_id % 4 = 0 THEN 0 ELSE k END AS k FROM c10 WHERE rank = 2),
r AS (SELECT p.event_id, e.u, e.v, e.k FROM p LEFT JOIN edges e ON e.u = p.u AND e.v = p.v AND e.k = p.k)
SELECT r.event_id, r.u, r.v, r.k, e.layer FROM r LEFT JOIN c10 ON c10.event_id = r.event_id AND c10.u = r.u AND c10.v = r.v AND c10.k = r.k AND c10.rank <= 3 LEFT JOIN edges e ON e.u = c10.u AND e.v = c10.v AND e.k = c10.k""",
    "pings", "edges",
)


def s7_end_mismatch(spark, sf):
    """How far each road's ends are from the nodes of its edge, and whether it is drawn backwards; every third is turned round."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    r = tables.roads(spark, sf).withColumns({"points": F.array(at("ax", "ay"), at("bx", "by_"), at("cx", "cy")), "u": F.floor(F.col("road") / 1_000_000).cast("int"), "v": F.pmod("road", F.lit(1_000_000)).cast("int")})
    r = r.withColumn("points", F.when(F.col("road") % 3 == 0, F.reverse("points")).otherwise(F.col("points")))
    n = tables.nodes(spark, sf)
    side = lambda p: n.select(F.col("node_id").alias(p), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    forward, backward = geo.ends_apart(F.col("points"), F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy"))
    held = r.join(side("u"), "u").join(side("v"), "v")
    return rounded(held.select("road", forward.alias("forward"), (forward > 2).alias("mismatch"), ((forward > 2) & (backward <= 2)).alias("backwards")))


S7 = tables.with_views(
    """+ r AS (SELECT road, CASE WHEN road % 3 = 0 THEN cx ELSE ax END AS px, CASE WHEN road % 3 = 0 THEN cy ELSE ay END AS py, CASE WHEN road % 3 = 0 THEN ax ELSE cx END AS qx, CASE WHEN road % 3 = 0 THEN ay ELSE cy END AS qy FROM roads),
d AS (SELECT road, sqrt((px - a.x) ** 2 + (py - a.y) ** 2) + sqrt((qx - b.x) ** 2 + (qy - b.y) ** 2) AS f, sqrt((px - b.x) ** 2 + (py - b.y) ** 2) + sqrt((qx - a.x) ** 2 + (qy - a.y) ** 2) AS g
  FROM r JOIN nodes a ON a.node_id = CAST(floor(road / 1000000) AS INT) JOIN nodes b ON b.node_id = road % 1000000)
SELECT road, round(f, 6) AS forward, f > 2 AS mismatch, f > 2 AND g <= 2 AS backwards FROM d""",
    "roads", "nodes",
)


def s11_actual_place(spark, sf):
    """Where a fix truly is: as recorded, else at the node nearest its observation within 100 m, else unknown."""
    t = tables.truth(spark, sf).withColumns({"tx": F.when(F.col("event_id") % 3 > 0, F.col("at_x")), "ty": F.when(F.col("event_id") % 3 > 0, F.col("at_y"))})
    near = fusion.nearest_node(t.where("tx is null and obs_x is not null").select("event_id", F.col("obs_x").alias("x"), F.col("obs_y").alias("y")), tables.nodes(spark, sf), "event_id", 100.0)
    held = t.join(near, "event_id", "left")
    return rounded(held.select("event_id", F.coalesce("tx", "node_x").alias("x"), F.coalesce("ty", "node_y").alias("y"), F.when(F.col("tx").isNotNull(), "recorded").when(F.col("node_id").isNotNull(), "nearest node").otherwise("unknown").alias("source")), 4)


S11 = tables.with_views(
    """+ m AS (SELECT event_id, node_id, x, y, row_number() OVER (PARTITION BY event_id ORDER BY sqrt((obs_x - x) ** 2 + (obs_y - y) ** 2), node_id) AS rn FROM truth JOIN nodes ON event_id % 3 = 0 AND obs_x IS NOT NULL AND sqrt((obs_x - x) ** 2 + (obs_y - y) ** 2) <= 100)
SELECT t.event_id, round(CASE WHEN t.event_id % 3 > 0 THEN at_x ELSE m.x END, 4) AS x, round(CASE WHEN t.event_id % 3 > 0 THEN at_y ELSE m.y END, 4) AS y, CASE WHEN t.event_id % 3 > 0 THEN 'recorded' WHEN node_id IS NOT NULL THEN 'nearest node' ELSE 'unknown' END AS source
FROM truth t LEFT JOIN m ON m.event_id = t.event_id AND rn = 1""",
    "truth", "nodes",
)


def j4_unlocalised(spark, sf):
    """Fixes that no position is known for keep every edge: how many, and the first and last by identity."""
    out = geo.unlocalised(sequence.impute(tables.pings(spark, sf)), tables.edges(spark, sf), x="eff_x", y="eff_y")
    return out.select("event_id", "candidates", F.col("first")["u"].alias("first_u"), F.col("last")["v"].alias("last_v"))


J4 = tables.with_views(IMPUTED_SQL + " SELECT event_id, count(*) AS candidates, first(u ORDER BY u, v, k) AS first_u, last(edges.v ORDER BY u, edges.v, k) AS last_v FROM f CROSS JOIN edges WHERE f.x IS NULL OR f.y IS NULL GROUP BY event_id", "pings", "edges")


def g2_network_audit(spark, sf):
    """Every count of the network's audit, on edges some of which are spoilt."""
    e = _lines(spark, sf).withColumns(
        {
            "length": F.when(F.col("u") % 17 == 0, None).otherwise(F.col("length")), "bridge": F.when(F.col("v") % 13 == 0, 1).otherwise(F.col("bridge")), "points": F.when(F.col("u") % 19 == 0, None).when(F.col("v") % 11 == 0, F.reverse("points")).otherwise(F.col("points")),
            "highway": F.when(F.col("v") % 23 == 0, "Construction").otherwise("primary"), "matched": F.col("u") % 2, "confident": F.when(F.col("u") % 4 == 1, "yes").otherwise("no"), "ambiguous": F.lit("0.0"), "road": F.when(F.col("u") % 5 > 0, F.col("u")), "method": F.lit("v1"),
        }
    )
    return graph.network_audit(tables.nodes(spark, sf), e, "EPSG:7855", "EPSG:7855", True)


G2N = tables.with_views(
    """+ e AS (SELECT edges.* REPLACE (CASE WHEN u % 17 = 0 THEN NULL ELSE length END AS length, CASE WHEN v % 13 = 0 THEN 1 ELSE bridge END AS bridge), sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS l FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v),
l AS (SELECT u AS a, v AS b FROM edges UNION SELECT v, u FROM edges), r AS (SELECT a, a AS o FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.o), c AS (SELECT count(DISTINCT m) AS n FROM (SELECT min(o) AS m FROM r GROUP BY a))
SELECT count(*) AS edges, count(*) FILTER (tunnel = 1 OR layer < 0) AS tunnel_edges, count(*) FILTER (bridge = 1 OR layer > 0) AS bridge_edges, count(*) FILTER (layer < 0) AS negative_layer_edges, count(*) FILTER (length IS NULL) AS missing_length_edges,
  count(*) FILTER (u % 19 = 0) AS missing_geometry_edges, count(*) FILTER (length IS NULL) AS invalid_numeric_edges, count(*) FILTER ((tunnel = 1 AND (layer >= 0 OR bridge = 1)) OR (bridge = 1 AND layer <= 0)) AS semantic_conflicts,
  count(*) FILTER (u % 19 <> 0 AND v % 11 = 0) AS endpoint_mismatches, count(*) FILTER (u % 19 <> 0 AND v % 11 = 0) AS reverse_oriented, count(*) FILTER (u % 2 = 1) AS matched_edges, count(*) FILTER (u % 4 = 1) AS confident_edges, 0::BIGINT AS ambiguous_edges,
  count(*) FILTER (u % 2 = 1 AND u % 5 = 0) AS missing_provenance, count(*) FILTER (v % 23 = 0) AS construction_edges, (SELECT count(*) FROM nodes) AS nodes, 0::BIGINT AS missing_xy_nodes, (SELECT n FROM c) AS weak_components,
  count(*) FILTER (tunnel = 1 OR layer < 0) = 0 AS tunnel_warning, false AS passed FROM e""",
    "edges", "nodes",
)

def s1_wkt_lines(spark, sf):
    """Lines read from their texts; a text that is no line gives the straight one between the edge's nodes."""
    r = tables.roads(spark, sf).withColumns({"u": F.floor(F.col("road") / 1_000_000).cast("long"), "v": F.pmod("road", F.lit(1_000_000)).cast("long"), "k": F.lit(0)})
    xy = lambda x, y: F.concat_ws(" ", x, y)
    text = F.concat(F.lit("LineString ("), F.concat_ws(", ", xy("ax", "ay"), xy("bx", "by_"), xy("cx", "cy")), F.lit(")"))
    wkt = F.when(F.col("road") % 5 == 0, "POINT (1 2)").when(F.col("road") % 5 == 1, None).otherwise(text)
    e = geo.with_points(r.withColumn("wkt", wkt), tables.nodes(spark, sf), "wkt")
    whole = geo.lengths(e).select("u", "v", "line_length")
    return rounded(e.join(whole, ["u", "v"]).select("road", F.size("points").alias("points"), "line_length", geo.line_length(F.col("points")).alias("again"), S.mean_bearing(F.col("points")).alias("bearing")), 6)


_PARTS = """+ p AS (SELECT road, ax, ay, bx, by_ AS "by", cx, cy, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS l1, sqrt((cx - bx) ** 2 + (cy - by_) ** 2) AS l2, CAST(floor(road / 1000000) AS BIGINT) AS u, road % 1000000 AS v FROM roads)"""
S1 = tables.with_views(
    _PARTS
    + """, q AS (SELECT p.*, road % 5 < 2 AS straight, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy FROM p JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v),
z AS (SELECT road, straight, CASE WHEN straight THEN sqrt((ux - vx) ** 2 + (uy - vy) ** 2) ELSE l1 + l2 END AS l, CASE WHEN straight THEN vx - ux ELSE cx - ax END AS dx, CASE WHEN straight THEN vy - uy ELSE cy - ay END AS dy FROM q)
SELECT road, CAST(CASE WHEN straight THEN 2 ELSE 3 END AS INT) AS points, round(l, 6) AS line_length, round(l, 6) AS again, round((degrees(atan2(dx, dy)) + 360) % 360, 6) AS bearing FROM z""",
    "roads", "nodes",
)


def s5_tangents(spark, sf):
    """The point and the direction of each road at a place along it, its ends among them."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    r = tables.roads(spark, sf).withColumn("points", F.array(at("ax", "ay"), at("bx", "by_"), at("cx", "cy")))
    r = r.withColumn("length", geo.line_length(F.col("points"))).withColumn("arc", F.col("length") * (F.col("road") % 7) / 6)
    p, t = geo.point_at(F.col("points"), F.col("arc")), geo.tangent(F.col("points"), F.col("arc"), F.col("length"))
    return rounded(r.select("road", p["x"].alias("x"), p["y"].alias("y"), t["tx"].alias("tx"), t["ty"].alias("ty")))


def _along(a: str) -> tuple[str, str]:
    return tuple(f'CASE WHEN {a} <= l1 THEN a{c} + {a} / l1 * ("b{c}" - a{c}) ELSE "b{c}" + ({a} - l1) / l2 * (c{c} - "b{c}") END' for c in "xy")


S5 = tables.with_views(
    _PARTS
    + f""", q AS (SELECT *, l1 + l2 AS l, (l1 + l2) * (road % 7) / 6 AS arc, greatest(0.5, least(5, (l1 + l2) * 0.02::DOUBLE)) AS s FROM p),
r AS (SELECT *, greatest(arc - s, 0) AS lo, least(arc + s, l) AS hi FROM q),
t AS (SELECT road, {_along("arc")[0]} AS x, {_along("arc")[1]} AS y, {_along("lo")[0]} AS x0, {_along("lo")[1]} AS y0, {_along("hi")[0]} AS x1, {_along("hi")[1]} AS y1 FROM r)
SELECT road, round(x, 6) AS x, round(y, 6) AS y, round((x1 - x0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 6) AS tx, round((y1 - y0) / sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 6) AS ty FROM t""",
    "roads",
)

PLANS = [
    Plan(s1_wkt_lines, S1, "s1_s4_wkt_lines"), Plan(s5_tangents, S5, "s5_s6_tangents"),
    Plan(j17_route_geometry, J17, "j17_f5_route_geometry"), Plan(j11_chosen_layer, J11, "j11_j19_chosen_layer"), Plan(s7_end_mismatch, S7), Plan(s11_actual_place, S11, "s11_s12_actual_place"), Plan(j4_unlocalised, J4), Plan(g2_network_audit, G2N),
]

"""Queries that fuse the network with another survey's roads; each with independent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import scalars as S
from roadloom.operators import fusion, geo, graph
from roadloom.plans.tools import Plan, rounded
from roadloom.sources import tables


def _edges(spark, sf):
    name = F.concat(F.when(F.col("u") % 2 == 0, "North Link").when(F.col("u") % 3 == 0, "Old Mill").otherwise("Harbour"), F.when(F.col("v") % 2 == 0, " Rd").otherwise(" Street"))
    e = geo.with_points(tables.edges(spark, sf), tables.nodes(spark, sf))
    kind = F.when((F.col("tunnel") == 1) | (F.col("layer") < 0), "TUNNEL").when((F.col("bridge") == 1) | (F.col("layer") > 0), "BRIDGE").when(F.col("lanes") == 4, "RAMP").otherwise("ROAD")
    return e.select("*", (F.col("u") * 1_000_000_000 + F.col("v") * 10 + F.col("k")).cast("long").alias("edge"), name.alias("name"), kind.alias("subtype"))


def _roads(spark, sf):
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return tables.roads(spark, sf).withColumn("points", F.array(at("ax", "ay"), at("bx", "by_"), at("cx", "cy")))


_E = """+ e AS (SELECT CAST(u AS BIGINT) * 1000000000 + v * 10 + k AS edge, edges.*, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1,
  concat(CASE WHEN u % 2 = 0 THEN 'North Link' WHEN u % 3 = 0 THEN 'Old Mill' ELSE 'Harbour' END, CASE WHEN v % 2 = 0 THEN ' Rd' ELSE ' Street' END) AS name,
  CASE WHEN tunnel = 1 OR layer < 0 THEN 'TUNNEL' WHEN bridge = 1 OR layer > 0 THEN 'BRIDGE' WHEN lanes = 4 THEN 'RAMP' ELSE 'ROAD' END AS subtype
  FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v),
rp AS (SELECT road, 0 AS piece, ax AS x0, ay AS y0, bx AS x1, by_ AS y1 FROM roads UNION ALL SELECT road, 1, bx, by_, cx, cy FROM roads)"""


def _near_sql(source: str, a: str, b: str, out: str, r: float) -> str:
    """Adds {out}l, {out}h: the part of piece a (columns {a}x0 and so on) within r of piece b; null where none is."""
    ax, ay, bx, by = f"({a}x1 - {a}x0)", f"({a}y1 - {a}y0)", f"({b}x1 - {b}x0)", f"({b}y1 - {b}y0)"
    one = f"SELECT *, sqrt({bx} ** 2 + {by} ** 2) AS zl, {ax} ** 2 + {ay} ** 2 AS zs FROM ({source})"
    two = f"""SELECT *, (({a}x0 - {b}x0) * {bx} + ({a}y0 - {b}y0) * {by}) / zl AS zu, ({ax} * {bx} + {ay} * {by}) / zl AS zm, (({a}y0 - {b}y0) * {bx} - ({a}x0 - {b}x0) * {by}) / zl AS zw, ({ay} * {bx} - {ax} * {by}) / zl AS zn,
  ({a}x0 - {b}x0) * {ax} + ({a}y0 - {b}y0) * {ay} AS zp, ({a}x0 - {b}x0) ** 2 + ({a}y0 - {b}y0) ** 2 - {r * r} AS zq, ({a}x0 - {b}x1) * {ax} + ({a}y0 - {b}y1) * {ay} AS zr, ({a}x0 - {b}x1) ** 2 + ({a}y0 - {b}y1) ** 2 - {r * r} AS zt FROM ({one})"""
    band = lambda start, slope, lo, hi, pick: f"CASE WHEN abs({slope}) < 1e-12 THEN CASE WHEN {start} BETWEEN {lo} AND {hi} THEN {0 if pick == 'least' else 1} END ELSE {pick}(({lo} - {start}) / {slope}, ({hi} - {start}) / {slope}) END"
    root = lambda half, rest, sign: f"CASE WHEN {half} ** 2 >= zs * {rest} THEN (-{half} {sign} sqrt({half} ** 2 - zs * {rest})) / zs END"
    three = f"""SELECT *, {band("zu", "zm", "0", "zl", "least")} AS zal, {band("zu", "zm", "0", "zl", "greatest")} AS zah, {band("zw", "zn", -r, r, "least")} AS zcl, {band("zw", "zn", -r, r, "greatest")} AS zch,
  {root("zp", "zq", "-")} AS zdl, {root("zp", "zq", "+")} AS zdh, {root("zr", "zt", "-")} AS zel, {root("zr", "zt", "+")} AS zeh FROM ({two})"""
    keep = lambda lo, hi, what: f"CASE WHEN {' AND '.join(f'{x} IS NOT NULL' for x in lo)} AND greatest(0, {', '.join(lo)}) <= least(1, {', '.join(hi)}) THEN {what} END"
    parts = [(["zal", "zcl"], ["zah", "zch"]), (["zdl"], ["zdh"]), (["zel"], ["zeh"])]
    low = ", ".join(keep(lo, hi, f"greatest(0, {', '.join(lo)})") for lo, hi in parts)
    high = ", ".join(keep(lo, hi, f"least(1, {', '.join(hi)})") for lo, hi in parts)
    return f"SELECT * EXCLUDE (zl, zs, zu, zm, zw, zn, zp, zq, zr, zt, zal, zah, zcl, zch, zdl, zdh, zel, zeh), least({low}) AS {out}l, greatest({high}) AS {out}h FROM ({three})"


def _point_sql(px: str, py: str, b: str) -> str:
    dx, dy = f"({b}x1 - {b}x0)", f"({b}y1 - {b}y0)"
    t = f"greatest(0, least(1, (({px} - {b}x0) * {dx} + ({py} - {b}y0) * {dy}) / ({dx} ** 2 + {dy} ** 2)))"
    return f"sqrt(({px} - {b}x0 - {t} * {dx}) ** 2 + ({py} - {b}y0 - {t} * {dy}) ** 2)"


def _apart_sql(a: str, b: str) -> str:
    side = lambda l, m, e: f"(({l}x1 - {l}x0) * ({m}y{e} - {l}y0) - ({l}y1 - {l}y0) * ({m}x{e} - {l}x0))"
    least = ", ".join([_point_sql(f"{a}x0", f"{a}y0", b), _point_sql(f"{a}x1", f"{a}y1", b), _point_sql(f"{b}x0", f"{b}y0", a), _point_sql(f"{b}x1", f"{b}y1", a)])
    return f"CASE WHEN {side(a, b, 0)} * {side(a, b, 1)} < 0 AND {side(b, a, 0)} * {side(b, a, 1)} < 0 THEN 0 ELSE least({least}) END"


_PAIRS = f"""SELECT edge, e.bearing, e.oneway, e.subtype, e.name, rp.road, piece, e.x0 AS ax0, e.y0 AS ay0, e.x1 AS ax1, e.y1 AS ay1, rp.x0 AS bx0, rp.y0 AS by0, rp.x1 AS bx1, rp.y1 AS by1
  FROM e JOIN rp ON least(e.x0, e.x1) - 50 <= greatest(rp.x0, rp.x1) AND least(rp.x0, rp.x1) - 50 <= greatest(e.x0, e.x1) AND least(e.y0, e.y1) - 50 <= greatest(rp.y0, rp.y1) AND least(rp.y0, rp.y1) - 50 <= greatest(e.y0, e.y1)
  JOIN roads r ON r.road = rp.road AND r.status = 'Operational' AND r.access IS NULL AND r.trafficable = '2WD'"""
_SPANS = _near_sql(_near_sql(f"SELECT *, {_apart_sql('a', 'b')} AS dist FROM ({_PAIRS})", "a", "b", "p", 8.0), "b", "a", "q", 8.0)


def j5_road_matches(spark, sf):
    """The road of another survey that fits each edge best."""
    roads = _roads(spark, sf).where(S.in_use(F.col("status"), F.col("access"), F.col("trafficable")))
    out = fusion.match_roads(_edges(spark, sf).withColumn("oneway", F.col("oneway") == 1), roads)
    return rounded(out)


J5 = tables.with_views(
    _E
    + f""", sp AS ({_SPANS}),
cv AS (SELECT edge, road, piece, dist, (qh - ql) * sqrt((bx1 - bx0) ** 2 + (by1 - by0) ** 2) AS cb, sqrt((bx1 - bx0) ** 2 + (by1 - by0) ** 2) AS lb, ph, pl,
  greatest(coalesce(ph, 0) - greatest(coalesce(pl, 0), coalesce(max(ph) OVER (PARTITION BY edge, road ORDER BY pl NULLS LAST, ph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS ca FROM sp),
ln AS (SELECT road, sum(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)) AS l FROM rp GROUP BY road),
o AS (SELECT edge, c.road, min(dist) AS distance, coalesce(sum(ca) FILTER (ph IS NOT NULL), 0) AS sa, coalesce(sum(cb), 0) / any_value(l) AS sb FROM cv c JOIN ln ON ln.road = c.road GROUP BY 1, 2 HAVING min(dist) <= 50),
tk AS (SELECT road, kind, upper(kind) AS ku, one_way, CASE one_way WHEN 'Two Way' THEN false WHEN 'One Way' THEN true WHEN 'From To' THEN true END AS ob,
  (degrees(atan2(cx - ax, cy - ay)) + CASE WHEN direction = 'TO FROM' THEN 180 ELSE 0 END + 720) % 360 AS bb, list_filter(string_split(lower(name), ' '), lambda t: t NOT IN ('road', 'st', 'tunnel')) AS tb FROM roads),
p AS (SELECT o.edge, o.road, ku, distance, least(1, greatest(0, 0.65::DOUBLE * greatest(sa, sb) + 0.35::DOUBLE * least(sa, sb))) AS ov, greatest(0, 1 - distance / 50) AS di,
  list_filter(string_split(lower(e.name), ' '), lambda t: t NOT IN ('rd', 'street')) AS ta, tb, e.subtype AS sa_, e.oneway = 1 AS oa, ob, e.bearing AS ba, bb FROM o JOIN e ON e.edge = o.edge JOIN tk ON tk.road = o.road),
s AS (SELECT *, len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb)))::DOUBLE AS na,
  CASE WHEN ob IS NULL THEN 0.5::DOUBLE WHEN oa AND ob THEN 0.5 * 1 + 0.5 * greatest(0, 1 - abs((ba - bb + 540) % 360 - 180) / 90) WHEN oa = ob THEN 1.0 ELSE 0.35 END AS dr,
  CASE WHEN ku IS NULL THEN 0.5::DOUBLE WHEN ku = sa_ THEN 1.0 WHEN sa_ IN ('ROAD', 'RAMP') AND ku IN ('ROAD', 'RAMP') THEN 0.75 WHEN sa_ = 'ROAD' AND ku IN ('TUNNEL', 'BRIDGE') THEN 0.65 ELSE 0.0 END AS su FROM p),
t AS (SELECT *, 0.35::DOUBLE * ov + 0.2::DOUBLE * di + 0.2::DOUBLE * na + 0.15::DOUBLE * dr + 0.1::DOUBLE * su AS score FROM s),
r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second, count(*) OVER (PARTITION BY edge) AS n FROM t WINDOW w AS (PARTITION BY edge ORDER BY round(score, 9) DESC, round(ov, 9) DESC, round(distance, 9), road)),
b AS (SELECT *, score - coalesce(second, 0) AS mg, score >= 0.5 AND (ov >= 0.15 OR distance <= 15) AS ac, n > 1 AND score - coalesce(second, 0) < 0.03 AS am, coalesce(ku NOT IN ('TUNNEL', 'BRIDGE'), true) OR ov >= 0.15 OR (na >= 0.75 AND dr >= 0.5) AS ve FROM r WHERE rn = 1)
SELECT e.edge, road, round(score, 6) AS score, round(mg, 6) AS margin, n AS candidates, round(ov, 6) AS overlap, round(distance, 6) AS distance, round(na, 6) AS name_score, round(dr, 6) AS direction_score, round(su, 6) AS subtype_score,
  ac AS accepted, ac AND NOT am AND ve AS confident, am OR NOT ve AS ambiguous, CASE WHEN road IS NULL THEN 'no_candidate_within_50m' ELSE 'overlap_name_direction_subtype_v1' END AS method FROM e LEFT JOIN b ON b.edge = e.edge""",
    "edges", "roads", "nodes",
)


def s8_tunnel_coverage(spark, sf):
    """How much of each road lies near existing tunnels."""
    present = _edges(spark, sf).where("tunnel = 1 or layer < 0").select(F.col("edge").alias("other"), "points")
    return rounded(fusion.coverage(_roads(spark, sf), present, "road"))


_COVER = f"""cs AS ({_near_sql("SELECT rp.road, rp.piece, rp.x0 AS ax0, rp.y0 AS ay0, rp.x1 AS ax1, rp.y1 AS ay1, e.x0 AS bx0, e.y0 AS by0, e.x1 AS bx1, e.y1 AS by1 FROM rp JOIN e ON (tunnel = 1 OR layer < 0) AND least(e.x0, e.x1) - 8 <= greatest(rp.x0, rp.x1) AND least(rp.x0, rp.x1) - 8 <= greatest(e.x0, e.x1) AND least(e.y0, e.y1) - 8 <= greatest(rp.y0, rp.y1) AND least(rp.y0, rp.y1) - 8 <= greatest(e.y0, e.y1)", "a", "b", "p", 8.0)}),
cw AS (SELECT road, greatest(ph - greatest(pl, coalesce(max(ph) OVER (PARTITION BY road, piece ORDER BY pl, ph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) * sqrt((ax1 - ax0) ** 2 + (ay1 - ay0) ** 2) AS c FROM cs WHERE pl IS NOT NULL),
sh AS (SELECT road, coalesce((SELECT sum(c) FROM cw WHERE cw.road = rp.road), 0) / sum(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)) AS share FROM rp GROUP BY road)"""

S8 = tables.with_views(f"{_E}, {_COVER} SELECT road, round(share, 6) AS share FROM sh", "edges", "roads", "nodes")


def r9_missing_tunnels(spark, sf):
    """Edges for the tunnels that the network lacks, with named approaches."""
    _, new = fusion.missing_tunnels(_edges(spark, sf), tables.nodes(spark, sf), _roads(spark, sf).withColumn("name", F.when(F.col("road") % 2 == 0, F.concat("name", F.lit(" Tunnel"))).otherwise(F.col("name"))))
    return rounded(new.drop("points"), 4)


R9 = tables.with_views(
    _E
    + f""", {_COVER},
rr AS (SELECT *, upper(kind) AS ku, upper(CASE WHEN road % 2 = 0 THEN name || ' Tunnel' ELSE name END) AS nu, CASE WHEN road % 2 = 0 THEN name || ' Tunnel' ELSE name END AS nm FROM roads WHERE status = 'Operational' AND access IS NULL AND trafficable = '2WD'),
cn AS (SELECT nu FROM rr WHERE ku IN ('ROAD', 'RAMP') AND nu IN (SELECT nu FROM rr WHERE ku = 'TUNNEL') AND nu LIKE '%TUNNEL%' GROUP BY nu HAVING count(*) <= 10),
lo AS (SELECT rr.* FROM rr JOIN sh USING (road) WHERE (ku = 'TUNNEL' AND share < 0.8) OR (ku IN ('ROAD', 'RAMP') AND nu IN (SELECT nu FROM cn))),
ft AS (SELECT *, round(ax, 3) || '|' || round(ay, 3) AS pa, round(cx, 3) || '|' || round(cy, 3) AS pb FROM lo),
en AS (SELECT p, any_value(x) AS x, any_value(y) AS y, count(*) AS degree FROM (SELECT pa AS p, round(ax, 3) AS x, round(ay, 3) AS y FROM ft UNION ALL SELECT pb, round(cx, 3), round(cy, 3) FROM ft) GROUP BY p),
li AS (SELECT pa AS f, pb AS t FROM ft UNION SELECT pb, pa FROM ft),
re AS (SELECT p, p AS o FROM en UNION SELECT re.p, li.t FROM re JOIN li ON li.f = re.o),
co AS (SELECT p, min(o) AS c FROM re GROUP BY p),
cp AS (SELECT DISTINCT c FROM ft JOIN co ON co.p = ft.pa WHERE ku <> 'TUNNEL'),
nn AS (SELECT en.p, node_id, nodes.x AS nx, nodes.y AS ny, sqrt((en.x - nodes.x) ** 2 + (en.y - nodes.y) ** 2) AS dist, row_number() OVER (PARTITION BY en.p ORDER BY (en.x - nodes.x) ** 2 + (en.y - nodes.y) ** 2, node_id) AS rn FROM en JOIN nodes ON degree = 1),
es AS (SELECT en.*, c, node_id, nx, ny, coalesce(degree = 1 AND dist <= CASE WHEN c IN (SELECT c FROM cp) THEN 100 ELSE 30 END, false) AS sn FROM en JOIN co USING (p) LEFT JOIN nn ON nn.p = en.p AND rn = 1),
nd AS (SELECT p, CASE WHEN sn THEN CAST(node_id AS VARCHAR) ELSE printf('tunnel_%.3f_%.3f', x, y) END AS node, CASE WHEN sn THEN nx ELSE x END AS x, CASE WHEN sn THEN ny ELSE y END AS y, sn FROM es WHERE c IN (SELECT c FROM es WHERE sn)),
h AS (SELECT ft.*, a.node AS an, b.node AS bn, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, a.sn AS sa, b.sn AS sb, coalesce(one_way <> 'Two Way', false) AS single FROM ft JOIN nd a ON a.p = pa JOIN nd b ON b.p = pb WHERE a.node <> b.node),
w AS (SELECT *, t.t FROM h JOIN (SELECT false AS t UNION ALL SELECT true) t ON NOT single OR t.t = (direction = 'TO FROM'))
SELECT CASE WHEN t THEN bn ELSE an END AS u, CASE WHEN t THEN an ELSE bn END AS v, road, nm AS name, CASE WHEN ku = 'TUNNEL' THEN 'motorway' ELSE 'motorway_link' END AS highway,
  round(sqrt((bx - x0) ** 2 + (by_ - y0) ** 2) + sqrt((x1 - bx) ** 2 + (y1 - by_) ** 2), 4) AS length, round((degrees(atan2(x1 - x0, y1 - y0)) + CASE WHEN t THEN 180 ELSE 0 END + 720) % 360, 4) AS bearing,
  CAST(CASE WHEN ku = 'TUNNEL' THEN -1 ELSE 0 END AS INT) AS layer, CAST(ku = 'TUNNEL' AS INT) AS tunnel, CASE WHEN speed > 0 THEN speed ELSE 80 END AS maxspeed, CAST(CASE WHEN lane_count > 0 THEN lane_count ELSE 3 END AS INT) AS lanes,
  single, t AND NOT single AS reversed, CASE WHEN t THEN sb ELSE sa END AS start_snapped, CASE WHEN t THEN sa ELSE sb END AS end_snapped FROM w""",
    "edges", "roads", "nodes",
)


def g18_j9_sanity(spark, sf):
    """Counts of levels, mean length and how the fused network's edges were matched."""
    e = _edges(spark, sf).select("edge", "layer", "length")
    m = tables.roads(spark, sf).select(((F.floor(F.col("road") / 1_000_000)) * 1_000_000_000 + F.pmod("road", F.lit(1_000_000)) * 10).cast("long").alias("edge"), (F.col("road") % 4 > 0).alias("confident"))
    held = e.join(m, "edge", "left")
    return rounded(
        held.agg(
            F.count("*").alias("edges"), F.count_if(F.expr("layer < 0")).alias("below"), F.count_if(F.expr("layer > 0")).alias("above"), F.avg("length").alias("mean_length"), F.coalesce(F.avg("length") > 0.01, F.lit(False)).alias("metric"),
            F.count("confident").alias("matched"), F.count_if(F.col("confident")).alias("confident"), F.count_if(~F.col("confident")).alias("ambiguous"),
        )
    )


G18 = tables.with_views(
    """SELECT count(*) AS edges, count(*) FILTER (layer < 0) AS below, count(*) FILTER (layer > 0) AS above, round(avg(length), 6) AS mean_length, avg(length) > 0.01 AS metric,
  count(*) FILTER (road IS NOT NULL) AS matched, count(*) FILTER (road % 4 > 0) AS confident, count(*) FILTER (road % 4 = 0) AS ambiguous FROM edges LEFT JOIN roads ON road = u * 1000000 + v AND k = 0""",
    "edges", "roads",
)


def r4_end_components(spark, sf):
    """Components of the roads' ends alone."""
    r = tables.roads(spark, sf).where("upper(kind) = 'TUNNEL'")
    end = lambda x, y: (F.round(F.col(x) * 1000).cast("long") * 1_000_000_000 + F.round(F.col(y) * 1000).cast("long"))
    return graph.components(r.select(end("ax", "ay").alias("u"), end("cx", "cy").alias("v")))


R4 = tables.with_views(
    """+ l AS (SELECT CAST(round(ax * 1000) AS BIGINT) * 1000000000 + CAST(round(ay * 1000) AS BIGINT) AS f, CAST(round(cx * 1000) AS BIGINT) * 1000000000 + CAST(round(cy * 1000) AS BIGINT) AS t FROM roads WHERE upper(kind) = 'TUNNEL'),
b AS (SELECT f, t FROM l UNION SELECT t, f FROM l), r AS (SELECT f AS node_id, f AS o FROM b UNION SELECT r.node_id, b.t FROM r JOIN b ON b.f = r.o)
SELECT node_id, min(o) AS component FROM r GROUP BY node_id""",
    "roads",
)

PLANS = [
    Plan(j5_road_matches, J5, "j5_j6_j7_j8_road_matches"), Plan(s8_tunnel_coverage, S8), Plan(r9_missing_tunnels, R9, "r9_s9_missing_tunnels"), Plan(g18_j9_sanity, G18), Plan(r4_end_components, R4),
]

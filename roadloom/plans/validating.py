"""Queries that validate trajectories against the network; each with independent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import scalars as S
from roadloom.operators import geo, sequence, validation
from roadloom.plans.tools import Plan, rounded
from roadloom.sources import tables


def _edges(spark, sf):
    return geo.with_points(tables.edges(spark, sf), tables.nodes(spark, sf)).withColumn("road_class", F.concat(F.lit("class "), F.col("lanes").cast("string")))


_W = "(PARTITION BY track_id ORDER BY step, event_id)"
_CHECKED = f"""+ x AS (
  SELECT t.*, e.u, e.v, e.k, e.maxspeed, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM truth t
  LEFT JOIN edges e ON e.u = edge_u AND e.v = edge_v AND e.k = CAST(try_cast(edge_key AS DOUBLE) AS INT) LEFT JOIN nodes a ON a.node_id = e.u LEFT JOIN nodes b ON b.node_id = e.v),
n AS (SELECT *, lead(u) OVER {_W} AS nu, lead(v) OVER {_W} AS nv, lead(k) OVER {_W} AS nk, lead(stamp) OVER {_W} - stamp AS dt, lead(path) OVER {_W} - path AS grew, lead(event_id) OVER {_W} IS NOT NULL AS more,
  lead(true_layer) OVER {_W} AS nl, lead(true_tunnel) OVER {_W} AS nt, last_value(CASE WHEN u IS NOT NULL THEN speed END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY step, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ls,
  greatest(0, least(1, ((at_x - x0) * (x1 - x0) + (at_y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS t FROM x),
rt AS (SELECT node_id AS src, node_id AS dst, 0.0::DOUBLE AS dist FROM (SELECT u AS node_id FROM edges UNION SELECT v FROM edges)
  UNION SELECT rt.src, l.v, rt.dist + l.length FROM rt JOIN (SELECT u, v, min(length) AS length FROM edges GROUP BY u, v) l ON l.u = rt.dst WHERE rt.dist + l.length <= 110),
way AS (SELECT src, dst, min(dist) AS dist FROM rt GROUP BY src, dst),
ck AS (SELECT n.*, u IS NULL AS bad_edge, event_id % 23 = 0 AS bad_link, u IS NOT NULL AND sqrt((at_x - x0 - t * (x1 - x0)) ** 2 + (at_y - y0 - t * (y1 - y0)) ** 2) > 1e-5 AS off,
  u IS NOT NULL AND speed > least(25, maxspeed / 3.6::DOUBLE) + 0.05 AS fast, coalesce(u IS NOT NULL AND abs(speed - ls) > 0.1, false) AS jerk, more AND abs(dt - 1) > 1e-9 AS cad, more AND (grew < -1e-9 OR abs(grew - speed * dt) > 1e-4) AS offp,
  coalesce(u IS NOT NULL AND nu IS NOT NULL AND NOT (u = nu AND v = nv AND k = nk) AND v <> nu AND coalesce(way.dist > grew + 1e-3, true), false) AS broken FROM n LEFT JOIN way ON way.src = v AND way.dst = nu)"""


def g7_validation(spark, sf):
    return rounded(validation.validate(tables.truth(spark, sf), _edges(spark, sf)))


G7 = tables.with_views(
    _CHECKED
    + f""", c AS (SELECT count(DISTINCT track_id) AS tracks, count(*) AS fixes, count(*) FILTER (bad_edge) AS invalid_edges, count(*) FILTER (bad_link) AS invalid_fix_links, count(*) FILTER (broken) AS invalid_sequence_links, count(*) FILTER (off) AS invalid_true_geometry,
  count(*) FILTER (offp) AS invalid_path_distance, count(*) FILTER (fast) AS speed_limit_violations, count(*) FILTER (jerk) AS acceleration_violations, count(*) FILTER (cad) AS cadence_violations,
  avg(hdop) FILTER (true_tunnel = 1) AS th, avg(sat_count) FILTER (true_tunnel = 1) AS ts_, avg(hdop) FILTER (true_tunnel = 0) AS oh, avg(sat_count) FILTER (true_tunnel = 0) AS os FROM ck),
tr AS (SELECT count(*) FILTER (l > 1) AS multilevel_tracks, count(*) FILTER (m = 1) AS tunnel_tracks FROM (SELECT track_id, count(DISTINCT true_layer) AS l, max(true_tunnel) AS m FROM ck GROUP BY track_id)),
ah AS (SELECT *, bool_or(state LIKE '%recovery%' OR state LIKE '%portal%') OVER (PARTITION BY track_id ORDER BY step, event_id ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS rec,
  bool_or(true_tunnel = 0) OVER (PARTITION BY track_id ORDER BY step, event_id ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS op FROM ck),
ex AS (SELECT count(*) AS tunnel_exits, count(*) FILTER (rec) AS recovered_exits, count(*) FILTER (op) AS open_after_exit FROM ah WHERE true_tunnel = 1 AND nt = 0),
us AS (SELECT e.*, 'class ' || lanes AS cl, EXISTS (SELECT 1 FROM ck WHERE ck.u = e.u AND ck.v = e.v AND ck.k = e.k) AS used FROM edges e),
cv AS (SELECT 100.0::DOUBLE * count(*) FILTER (used) / count(*) AS e, 100.0::DOUBLE * count(*) FILTER (used AND layer < 0) / nullif(count(*) FILTER (layer < 0), 0) AS t, 100.0::DOUBLE * count(*) FILTER (used AND layer > 0) / nullif(count(*) FILTER (layer > 0), 0) AS b,
  100.0::DOUBLE * count(DISTINCT cl) FILTER (used) / count(DISTINCT cl) AS c, array_to_string(list_sort(list_distinct(list(layer))), ',') AS lv, bool_or(layer < 0) AS un FROM us),
lc AS (SELECT count(*) = 0 AS ok FROM (SELECT DISTINCT layer FROM edges EXCEPT SELECT true_layer FROM ck)),
fe AS (SELECT DISTINCT a.layer AS a, b.layer AS b FROM edges a JOIN edges b ON a.v = b.u), se AS (SELECT DISTINCT true_layer AS a, nl AS b FROM ck WHERE more),
tu AS (SELECT 100.0::DOUBLE * (SELECT count(*) FROM fe JOIN se USING (a, b)) / greatest(1, count(*)) AS p FROM fe)
SELECT tracks, fixes, invalid_edges, invalid_fix_links, invalid_sequence_links, invalid_true_geometry, invalid_path_distance, speed_limit_violations, acceleration_violations, cadence_violations, round(th, 6) AS tunnel_hdop_mean, round(ts_, 6) AS tunnel_sat_count_mean,
  round(oh, 6) AS open_hdop_mean, round(os, 6) AS open_sat_count_mean, multilevel_tracks, tunnel_tracks, tunnel_exits, recovered_exits, open_after_exit, round(e, 6) AS edge_coverage_pct, round(t, 6) AS tunnel_coverage_pct, round(b, 6) AS bridge_coverage_pct,
  round(c, 6) AS class_coverage_pct, lv AS graph_levels, ok AS level_coverage_passed, round(p, 6) AS level_transition_coverage_pct, NOT un OR coalesce(th > oh AND ts_ < os, false) AS quality_contrast_passed, false AS passed FROM c, tr, ex, cv, lc, tu""",
    "truth", "edges", "nodes",
)


def w7_step_violations(spark, sf):
    """Each fix's checks."""
    out = validation.checked(tables.truth(spark, sf), _edges(spark, sf))
    return out.select("event_id", "invalid_edge", "invalid_link", "off_edge", "too_fast", "jerk", "off_cadence", "off_path", "broken")


W7 = tables.with_views(_CHECKED + " SELECT event_id, bad_edge AS invalid_edge, bad_link AS invalid_link, off AS off_edge, fast AS too_fast, jerk, cad AS off_cadence, offp AS off_path, broken FROM ck", "truth", "edges", "nodes")

_EACH = f"""+ d AS (SELECT *, state LIKE '%blackout' AS dark, row_number() OVER {_W} AS n, CASE WHEN state LIKE 'portal%' THEN 1 ELSE 0 END AS po FROM truth),
i AS (SELECT *, n - row_number() OVER (PARTITION BY track_id, dark ORDER BY step, event_id) AS il, po - lag(po) OVER {_W} AS up FROM d),
r AS (SELECT track_id, count(*) AS runs, max(c) AS longest, avg(c) AS mean_run FROM (SELECT track_id, il, count(*) AS c FROM i WHERE dark GROUP BY track_id, il) GROUP BY track_id),
g AS (SELECT track_id, count(*) AS n_fixes, last(stamp ORDER BY step, event_id) - first(stamp ORDER BY step, event_id) AS duration_s, last(path ORDER BY step, event_id) - first(path ORDER BY step, event_id) AS distance_m,
  avg(true_tunnel) AS tunnel_fix_fraction, avg(CASE WHEN dark THEN 1.0::DOUBLE ELSE 0 END) AS blackout_fix_fraction, count(*) FILTER (up = 1) AS n_portal_transitions FROM i GROUP BY track_id),
t AS (SELECT g.*, duration_s / greatest(1, n_fixes - 1) AS fi, coalesce(runs, 0) AS nb, coalesce(longest * duration_s / greatest(1, n_fixes - 1), 0) AS mx, coalesce(mean_run * duration_s / greatest(1, n_fixes - 1), 0) AS me FROM g LEFT JOIN r USING (track_id))"""


def g8_track_durations(spark, sf):
    return rounded(validation.durations(tables.truth(spark, sf)))


G8T = tables.with_views(
    _EACH
    + """ SELECT track_id, n_fixes, round(duration_s, 6) AS duration_s, round(distance_m, 6) AS distance_m, round(tunnel_fix_fraction, 6) AS tunnel_fix_fraction, round(blackout_fix_fraction, 6) AS blackout_fix_fraction, n_portal_transitions, round(fi, 6) AS fix_interval_s,
  nb AS n_blackout_intervals, round(mx, 6) AS max_blackout_interval_s, round(me, 6) AS mean_blackout_interval_s, mx >= 120 AS long_blackout FROM t""",
    "truth",
)


def g8_case_durations(spark, sf):
    return rounded(validation.duration_summary(validation.durations(tables.truth(spark, sf))))


G8C = tables.with_views(
    _EACH
    + """ SELECT count(DISTINCT track_id) AS n_tracks, round(avg(n_fixes), 6) AS n_fixes_mean, round(avg(duration_s), 6) AS duration_s_mean, round(median(duration_s), 6) AS duration_s_median, round(avg(distance_m), 6) AS distance_m_mean, round(avg(fi), 6) AS fix_interval_s_mean,
  round(avg(tunnel_fix_fraction), 6) AS tunnel_fix_fraction_mean, round(avg(blackout_fix_fraction), 6) AS blackout_fix_fraction_mean, round(avg(nb), 6) AS n_blackout_intervals_mean, round(avg(mx), 6) AS max_blackout_interval_s_mean,
  round(quantile_cont(mx, 0.95), 6) AS max_blackout_interval_s_p95, round(avg(me), 6) AS mean_blackout_interval_s_mean, round(avg(n_portal_transitions), 6) AS n_portal_transitions_mean, round(100 * avg(CASE WHEN mx >= 120 THEN 1.0::DOUBLE ELSE 0 END), 6) AS long_blackout_pct FROM t""",
    "truth",
)


def g3_complexity(spark, sf):
    """How tunnelled, bridged and branching a network is, and the fixes a track needs to show it."""
    e = _edges(spark, sf)
    under, over = S.tunnel_edge(F.col("tunnel"), F.col("layer")), S.bridge_edge(F.col("bridge"), F.col("layer"))
    ends = e.select(F.col("u").alias("n")).unionAll(e.select("v")).groupBy("n").agg(F.count("*").alias("deg")).agg(F.avg((F.col("deg") >= 3).cast("double")).alias("junction_ratio"))
    line = geo.line_length(F.col("points"))
    ratio = e.agg(F.avg(under.cast("double")).alias("tunnel_ratio"), F.avg(over.cast("double")).alias("bridge_ratio"), (F.sum(F.when(under, line).otherwise(0.0)) / F.sum(line)).alias("tunnel_length_ratio"))
    held = ratio.crossJoin(F.broadcast(ends))  # one row each
    complexity = S.d(0.6) * F.col("tunnel_ratio") + S.d(0.25) * F.col("bridge_ratio") + S.d(0.15) * F.col("junction_ratio")
    long = F.col("tunnel_length_ratio")
    pings = F.when(long <= 0, 50).when(long < 0.05, F.greatest(F.lit(50), F.lit(90))).otherwise(F.greatest(F.lit(50), F.lit(200)))
    return rounded(held.select("*", complexity.alias("complexity"), pings.alias("pings_per_track")))


G3 = tables.with_views(
    """+ d AS (SELECT n, count(*) AS deg FROM (SELECT u AS n FROM edges UNION ALL SELECT v FROM edges) GROUP BY n), j AS (SELECT avg(CASE WHEN deg >= 3 THEN 1.0::DOUBLE ELSE 0 END) AS jr FROM d),
l AS (SELECT edges.*, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS len FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v),
r AS (SELECT avg(CASE WHEN tunnel = 1 OR layer < 0 THEN 1.0::DOUBLE ELSE 0 END) AS tr, avg(CASE WHEN bridge = 1 OR layer > 0 THEN 1.0::DOUBLE ELSE 0 END) AS br, coalesce(sum(len) FILTER (tunnel = 1 OR layer < 0), 0) / sum(len) AS tl FROM l)
SELECT round(tr, 6) AS tunnel_ratio, round(br, 6) AS bridge_ratio, round(tl, 6) AS tunnel_length_ratio, round(jr, 6) AS junction_ratio, round(0.6::DOUBLE * tr + 0.25::DOUBLE * br + 0.15::DOUBLE * jr, 6) AS complexity,
  CAST(CASE WHEN tl <= 0 THEN 50 WHEN tl < 0.05 THEN 90 ELSE 200 END AS INT) AS pings_per_track FROM r, j""",
    "edges", "nodes",
)


def w9_route_positions(spark, sf):
    """Where a vehicle at a steady speed is along each track's chain of edges, second by second: the edge and the point on it."""
    e = _edges(spark, sf).select("u", "v", "k", "points", geo.line_length(F.col("points")).alias("len"))
    t = tables.truth(spark, sf).select("track_id", "step", F.col("edge_u").alias("u"), F.col("edge_v").alias("v"), F.lit(0).alias("k"))
    return rounded(sequence.positions(t.join(e, ["u", "v", "k"]), 30.0), 4)


W9 = tables.with_views(
    """+ r AS (SELECT track_id, step, u, v, k, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS len FROM truth JOIN edges ON u = edge_u AND v = edge_v AND k = 0 JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v),
c AS (SELECT *, sum(len) OVER (PARTITION BY track_id ORDER BY step) AS hi, sum(len) OVER (PARTITION BY track_id) AS total FROM r),
s AS (SELECT track_id, CAST(i AS INT) AS tick, i * 30.0::DOUBLE AS along FROM (SELECT DISTINCT track_id, total FROM c), range(100000) g(i) WHERE i * 30.0 <= total),
p AS (SELECT s.track_id, tick, along, c.* EXCLUDE (track_id), row_number() OVER (PARTITION BY s.track_id, tick ORDER BY step) AS rn FROM s JOIN c ON c.track_id = s.track_id AND s.along <= c.hi)
SELECT track_id, tick, u, v, k, round(along, 4) AS along, round(x0 + (along - hi + len) / len * (x1 - x0), 4) AS x, round(y0 + (along - hi + len) / len * (y1 - y0), 4) AS y FROM p WHERE rn = 1""",
    "truth", "edges", "nodes",
)

PLANS = [
    Plan(g7_validation, G7, "g7_u2_u3_validation"), Plan(w7_step_violations, W7, "w7_f9_step_violations"), Plan(g8_track_durations, G8T), Plan(g8_case_durations, G8C), Plan(g3_complexity, G3, "g3_g4_complexity"), Plan(w9_route_positions, W9, "w9_s6_route_positions"),
]

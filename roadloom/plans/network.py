"""Queries over the road network and candidates; each with independent SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import features as X
from roadloom.functions import scalars as S
from roadloom.operators import circuits, decode, geo, graph, levels, sequence, training
from roadloom.plans.tools import Plan, rounded
from roadloom.sources import files, tables
from roadloom.sources.shared import stored

_NINE = X.start_weights(54)
_MATCHED = X.start_weights(56, restart=1)


def _featured(spark, sf):
    e = tables.edges(spark, sf)
    cols = [F.col(c) for c in ("length", "bearing", "maxspeed", "layer", "lanes", "oneway", "tunnel", "bridge")]
    return e.withColumn("f", X.edge_features(*cols, (F.col("u") % 5) / S.d(4)))


_F9 = ["least(length / 500, 1)", "((bearing % 360) + 360) % 360 / 360", "greatest(0, least(1, (maxspeed - 10) / 110))", "greatest(0, least(1, (layer + 3) / 8.0::DOUBLE))", "least(1, lanes / 8.0::DOUBLE)", "oneway", "tunnel", "bridge", "(u % 5) / 4.0::DOUBLE"]
_FE = "SELECT u, v, k, " + ", ".join(f"CAST({e} AS DOUBLE) AS f{i}" for i, e in enumerate(_F9)) + " FROM edges"


def b10_edge_features(spark, sf):
    return rounded(_featured(spark, sf).select("u", "v", "k", *[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(9)]))


B10 = tables.with_views("SELECT u, v, k, " + ", ".join(f"round(f{i}, 6) AS f{i}" for i in range(9)) + f" FROM ({_FE})", "edges")


def b11_transition_features(spark, sf):
    e = tables.edges(spark, sf)
    a, b = e.alias("a"), e.alias("b")
    turn = a.join(b, F.col("a.v") == F.col("b.u")).where("not (a.u = b.v and a.v = b.u)")
    f = X.transition_features(F.col("a.layer"), F.col("b.layer"), F.col("a.maxspeed"), F.col("b.maxspeed"), F.col("a.u") % 30 * S.d(10), F.col("a.bearing"), F.col("b.bearing"))
    turn = turn.select(F.col("a.u").alias("u"), F.col("a.v").alias("v"), F.col("a.k").alias("k"), F.col("b.v").alias("w"), F.col("b.k").alias("k2"), f.alias("f"))
    return rounded(turn.select("u", "v", "k", "w", "k2", *[F.get("f", F.lit(i)).alias(f"t{i}") for i in range(4)]))


B11 = tables.with_views(
    """SELECT a.u, a.v, a.k, b.v AS w, b.k AS k2, round(least(abs(b.layer - a.layer) / 3.0::DOUBLE, 1), 6) AS t0, round(least(abs(b.maxspeed - a.maxspeed) / 100, 1), 6) AS t1,
  round(least((a.u % 30) * 10 / 150.0::DOUBLE, 1), 6) AS t2, round(least(abs(b.bearing - a.bearing) % 360, 360 - abs(b.bearing - a.bearing) % 360) / 180, 6) AS t3
FROM edges a JOIN edges b ON a.v = b.u WHERE NOT (a.u = b.v AND a.v = b.u)""",
    "edges",
)


def m2_product_circuit(spark, sf):
    z = X.product_circuit(F.col("f"), _NINE, 9, 2, [0, 3, 6])
    return rounded(_featured(spark, sf).select("u", "v", "k", z.alias("z"), S.probability(z).alias("p")))


def _product_sql(w: list[float], wires: int, layers: int, read: list[int]) -> str:
    """Nested selects, one for each rotation of the spheres of the wires read."""
    sql = "SELECT u, v, k, f0, f3, f6, " + ", ".join(f"0.0::DOUBLE AS x{q}, 0.0::DOUBLE AS y{q}, 1.0::DOUBLE AS z{q}" for q in read) + f" FROM ({_FE})"

    def turn(sql: str, a: str, b: str, c: str, angle) -> str:
        cols = [f"cos({angle(q)}) * {a}{q} {'+' if a == 'x' and b == 'z' else '-'} sin({angle(q)}) * {b}{q} AS {a}{q}, cos({angle(q)}) * {b}{q} {'-' if a == 'x' and b == 'z' else '+'} sin({angle(q)}) * {a}{q} AS {b}{q}, {c}{q}" for q in read]
        return f"SELECT u, v, k, f0, f3, f6, {', '.join(cols)} FROM ({sql})"

    for layer in range(layers):
        at = {q: 3 * (layer * wires + q) for q in read}
        sql = turn(sql, "x", "z", "y", lambda q: f"f{q} * pi()")
        sql = turn(sql, "x", "y", "z", lambda q, at=at: f"({w[at[q]]!r}::DOUBLE)")
        sql = turn(sql, "x", "z", "y", lambda q, at=at: f"({w[at[q] + 1]!r}::DOUBLE)")
        sql = turn(sql, "x", "y", "z", lambda q, at=at: f"({w[at[q] + 2]!r}::DOUBLE)")
    mean = "(" + " + ".join(f"z{q}" for q in read) + f") / {len(read)}"
    return f"SELECT u, v, k, round({mean}, 6) AS z, round(greatest(1e-9, least(1, (({mean}) + 1) / 2)), 6) AS p FROM ({sql})"


M2 = tables.with_views(_product_sql(_NINE, 9, 2, [0, 3, 6]), "edges")


def m4_matched_mlp(spark, sf):
    return rounded(_featured(spark, sf).select("u", "v", "k", X.mlp_score(F.col("f"), _MATCHED, 9, 5).alias("score")))


def _mlp_sql(w: list[float], n: int, h: int) -> str:
    hidden = [f"{w[(n + 1) * h + j]!r} * tanh({w[n * h + j]!r} + " + " + ".join(f"f{i} * {w[i * h + j]!r}" for i in range(n)) + ")" for j in range(h)]
    return f"SELECT u, v, k, round(1 / (1 + exp(-({w[(n + 2) * h]!r} + {' + '.join(hidden)}))), 6) AS score FROM ({_FE})"


M4 = tables.with_views(_mlp_sql(_MATCHED, 9, 5), "edges")


def m1_circuit(spark, sf):
    """Scores of the distinct feature rows, joined back: edges share them."""
    e = _featured(spark, sf)
    distinct = e.select("f").distinct().withColumn("z", circuits.scorer(_NINE, 9, 2, [0, 3, 6])(F.col("f")))
    return rounded(e.join(distinct, "f").select("u", "v", "k", "z", S.probability(F.col("z")).alias("p")))


def _pieces(spark, sf):
    return geo.segments(geo.with_points(tables.edges(spark, sf), tables.nodes(spark, sf)))


def _candidates(spark, sf, fixes=None, **options):
    p = tables.pings(spark, sf) if fixes is None else fixes
    return geo.candidates(p, _pieces(spark, sf), **options)


def j1_candidates(spark, sf):
    """Ten nearest edges within 60 m of each localised fix (else the ten nearest of all), with projection and spatial emission."""
    c = _candidates(spark, sf, top=10)
    scale = X.quality_scale(F.col("hdop"), F.col("sat_count"), F.lit(False))
    emit = X.spatial_log_prob(F.col("dist"), scale)
    return rounded(c.select("event_id", "u", "v", "k", "rank", "fallback", "px", "py", "arc", "dist", emit.alias("emission")), 4)


_CAND = """+ s AS (SELECT u, v, k, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v),
d AS (SELECT event_id, hdop, sat_count, obs_x, obs_y, u, v, k, x0, y0, x1, y1,
  greatest(0, least(1, ((obs_x - x0) * (x1 - x0) + (obs_y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS t FROM pings CROSS JOIN s WHERE obs_x IS NOT NULL),
q AS (SELECT *, x0 + t * (x1 - x0) AS px, y0 + t * (y1 - y0) AS py, t * sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS arc FROM d),
e AS (SELECT *, sqrt((obs_x - px) ** 2 + (obs_y - py) ** 2) AS dist FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, u, v, k) AS rank, min(dist) OVER (PARTITION BY event_id) > 60 AS fallback FROM e),
c AS (SELECT * FROM n WHERE (dist <= 60 OR fallback) AND rank <= 10)"""

#: All candidates: within 60 m, else the ten nearest.
CANDIDATES_SQL = _CAND.replace("e AS (", "e AS MATERIALIZED (") + ", c10 AS MATERIALIZED (SELECT * FROM n WHERE dist <= 60 OR (fallback AND rank <= 10))"

J1 = tables.with_views(
    _CAND
    + """ SELECT event_id, u, v, k, CAST(rank AS INT) AS rank, fallback, round(px, 4) AS px, round(py, 4) AS py, round(arc, 4) AS arc, round(dist, 4) AS dist,
  round(-0.5 * (dist / (45 * greatest(0.75, least(3, hdop / 1.5)) * CASE WHEN sat_count < 5 THEN 1.35 ELSE 1.0 END)) ** 2, 4) AS emission FROM c""",
    "pings", "edges",
)


def f8_match_classes(spark, sf):
    """How each fix's second candidate stands to its first."""
    c = _candidates(spark, sf, top=2).select("event_id", "u", "v", "k", "rank")
    a, b = c.where("rank = 2").alias("a"), c.where("rank = 1").alias("b")
    kinds = graph.match_class(*[tuple(F.col(f"{s}.{x}") for x in "uvk") for s in "ab"])
    return a.join(b, "event_id").select("event_id", *[x.alias(n) for n, x in kinds.items()]).groupBy(*kinds).agg(F.count("*").alias("n"))


F8 = tables.with_views(
    _CAND
    + """, m AS (SELECT a.u = b.u AND a.v = b.v AND a.k = b.k AS exact, a.u = b.u AND a.v = b.v AS carriageway, a.u = b.v AND a.v = b.u AS reverse,
    (a.u = b.u AND a.v = b.v) OR (a.u = b.v AND a.v = b.u) AS physical, (a.u = b.u AND a.v = b.v) OR a.u = b.v OR a.v = b.u AS relaxed
  FROM c a JOIN c b ON a.event_id = b.event_id AND a.rank = 2 AND b.rank = 1)
SELECT exact, carriageway, reverse, physical, relaxed, count(*) AS n FROM m GROUP BY ALL""",
    "pings", "edges",
)


def r1_hub_routes(spark, sf):
    """The shortest way from each fix's true edge to the next fix's, on streets of many lengths, by hub labels where the network has small separators; null where none leads there."""
    t = tables.truth(spark, sf)
    at = sequence.Window.partitionBy("track_id").orderBy("t_s", "event_id")
    wanted = t.select(F.col("event_id"), F.col("edge_v").alias("src"), F.lead("edge_u").over(at).alias("dst")).where("dst is not null")
    wanted = stored(wanted, "wanted")
    found = graph.labelled_routes(tables.streets(spark, sf), wanted, core=64)
    return wanted.join(found, ["src", "dst"], "left").select("event_id", "src", "dst", "dist")


# A table by key holds the shortest way known to each pair; a round goes on from what became shorter.
R1H = tables.with_views(
    """+ st AS (SELECT u, v, min(length) AS length FROM streets GROUP BY u, v),
sp(src, dst, dist) USING KEY (src, dst) AS (
  SELECT node_id, node_id, 0.0::DOUBLE FROM (SELECT u AS node_id FROM st UNION SELECT v FROM st)
  UNION SELECT sp.src, st.v, min(sp.dist + st.length) FROM sp JOIN st ON st.u = sp.dst LEFT JOIN recurring.sp r ON r.src = sp.src AND r.dst = st.v
  WHERE sp.dist + st.length < coalesce(r.dist, 1e300) GROUP BY sp.src, st.v),
w AS (SELECT event_id, edge_v AS src, lead(edge_u) OVER (PARTITION BY track_id ORDER BY t_s, event_id) AS dst FROM truth)
SELECT event_id, w.src, w.dst, dist FROM w LEFT JOIN sp ON sp.src = w.src AND sp.dst = w.dst WHERE w.dst IS NOT NULL""",
    "truth", "streets",
)


def r1_routes(spark, sf):
    return graph.routes(tables.edges(spark, sf), 200.0)


R1 = tables.with_views(
    """+ l AS (SELECT u, v, min(length) AS length FROM edges GROUP BY u, v),
r AS (SELECT node_id AS src, node_id AS dst, 0.0::DOUBLE AS dist FROM (SELECT u AS node_id FROM edges UNION SELECT v FROM edges)
  UNION SELECT r.src, l.v, r.dist + l.length FROM r JOIN l ON l.u = r.dst WHERE r.dist + l.length <= 200)
SELECT src, dst, min(dist) AS dist FROM r GROUP BY src, dst""",
    "edges",
)


def r3_components(spark, sf):
    """Of the tunnels and bridges only, which fall into several components."""
    return graph.components(tables.edges(spark, sf).where("layer <> 0"))


R3 = tables.with_views(
    """+ b AS (SELECT u AS a, v AS b FROM edges WHERE layer <> 0 UNION SELECT v, u FROM edges WHERE layer <> 0),
r AS (SELECT a AS node_id, a AS other FROM b UNION SELECT r.node_id, b.b FROM r JOIN b ON b.a = r.other)
SELECT node_id, min(other) AS component FROM r GROUP BY node_id""",
    "edges",
)


def r5_degrees(spark, sf):
    return graph.degrees(tables.edges(spark, sf))


R5 = tables.with_views(
    """SELECT n AS node_id, count(*) AS degree, count(DISTINCT o) AS neighbours, count(DISTINCT o) >= 3 AS junction FROM (SELECT u AS n, v AS o FROM edges UNION ALL SELECT v, u FROM edges) GROUP BY n""", "edges"
)


def r6_pruned_nodes(spark, sf):
    """Nodes left when slow edges go."""
    e = tables.edges(spark, sf).where("maxspeed >= 90")
    return graph.without_isolates(tables.nodes(spark, sf), e).select("node_id", "x", "y")


R6 = tables.with_views("SELECT node_id, x, y FROM nodes WHERE node_id IN (SELECT u FROM edges WHERE maxspeed >= 90 UNION SELECT v FROM edges WHERE maxspeed >= 90)", "edges")


def r7_first_exit(spark, sf):
    e = tables.edges(spark, sf)
    return graph.first_exit(e, F.col("maxspeed") < 90)


R7 = tables.with_views(
    """+ e AS (SELECT u, v, k, maxspeed < 90 AS inside FROM edges),
r AS (SELECT DISTINCT u AS node, 1 AS steps FROM e WHERE NOT inside UNION SELECT e.u, r.steps + 1 FROM e JOIN r ON e.v = r.node WHERE e.inside AND r.steps < 20)
SELECT u, v, k, CAST(m.steps AS INT) AS steps FROM e LEFT JOIN (SELECT node, min(steps) AS steps FROM r GROUP BY node) m ON m.node = e.v WHERE inside""",
    "edges",
)


def g21_level_transitions(spark, sf):
    return rounded(graph.level_transitions(tables.edges(spark, sf)))


G21 = tables.with_views(
    """+ t AS (SELECT a.layer AS f, b.layer AS t, count(*) AS n FROM edges a JOIN edges b ON a.v = b.u GROUP BY 1, 2),
l AS (SELECT DISTINCT layer FROM edges),
c AS (SELECT a.layer AS f, b.layer AS t, coalesce(n, 0) + 0.05::DOUBLE + CASE WHEN a.layer = b.layer THEN 2 ELSE 0 END AS c FROM l a CROSS JOIN l b LEFT JOIN t ON t.f = a.layer AND t.t = b.layer)
SELECT f AS from_level, t AS to_level, round(c / sum(c) OVER (PARTITION BY f), 6) AS p FROM c""",
    "edges",
)


def j16_one_sided(spark, sf):
    return graph.one_sided(tables.edges(spark, sf)).select("u", "v", "k")


J16 = tables.with_views("SELECT u, v, k FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges b WHERE b.u = e.v AND b.v = e.u)", "edges")


def g2_graph_audit(spark, sf):
    """Counts of one network and whether it passes: tunnels below ground, lengths positive, speeds in range."""
    e = tables.edges(spark, sf)
    return rounded(
        e.agg(
            F.count("*").alias("edges"), F.count_if(F.expr("tunnel = 1")).alias("tunnels"), F.count_if(F.expr("bridge = 1")).alias("bridges"), F.count_if(F.expr("oneway = 1")).alias("one_ways"),
            F.count_distinct("u", "v").alias("pairs"), F.avg("length").alias("mean_length"), (F.sum(F.when(F.col("tunnel") == 1, F.col("length")).otherwise(0.0)) / F.sum("length")).alias("tunnel_share"),
            F.bool_and(F.expr("(tunnel = 0 or layer < 0) and (bridge = 0 or layer > 0) and length > 0 and maxspeed between 5 and 130")).alias("passed"),
        )
    )


G2 = tables.with_views(
    """SELECT count(*) AS edges, count(*) FILTER (tunnel = 1) AS tunnels, count(*) FILTER (bridge = 1) AS bridges, count(*) FILTER (oneway = 1) AS one_ways,
  (SELECT count(*) FROM (SELECT DISTINCT u, v FROM edges)) AS pairs, round(avg(length), 6) AS mean_length, round(coalesce(sum(length) FILTER (tunnel = 1), 0) / sum(length), 6) AS tunnel_share,
  bool_and((tunnel = 0 OR layer < 0) AND (bridge = 0 OR layer > 0) AND length > 0 AND maxspeed BETWEEN 5 AND 130) AS passed FROM edges""",
    "edges",
)


def k6_route_vertices(spark, sf):
    e = geo.with_points(tables.edges(spark, sf), tables.nodes(spark, sf)).withColumn("route_id", S.edge_text(F.col("u"), F.col("v"), F.col("k")))
    return files.route_vertices(e)


K6 = tables.with_views(
    """SELECT u || '_' || v || '_' || k AS route_id, CAST(i AS INT) AS vertex, n.x, n.y FROM edges CROSS JOIN (VALUES (0), (1)) w(i) JOIN nodes n ON n.node_id = CASE WHEN i = 0 THEN u ELSE v END""", "edges"
)


def k5_route_features(spark, sf):
    e = geo.with_points(tables.edges(spark, sf), tables.nodes(spark, sf)).withColumn("route_id", S.edge_text(F.col("u"), F.col("v"), F.col("k")))
    return files.route_features(e)


def q2_level_filter(spark, sf):
    p = sequence.boundaries(tables.pings(spark, sf))
    e = tables.edges(spark, sf)
    pieces = _pieces(spark, sf).join(e.select("u", "v", "k", "layer", ((F.col("tunnel") == 1) | (F.col("layer") < 0)).alias("below")), ["u", "v", "k"])
    out = levels.kalman_levels(p, pieces, graph.level_transitions(e))
    return rounded(out.select("event_id", "ekf_x", "ekf_y", "vx", "vy", F.aggregate(F.map_values("beliefs"), S.d(0), lambda a, v: F.greatest(a, v)).alias("belief")), 4)


# Every noise is the same along x and y, so a covariance is three numbers: of place, of place and speed, of speed.
Q2 = tables.with_views(
    """+ t AS (SELECT a.layer AS f, b.layer AS t, count(*) AS n FROM edges a JOIN edges b ON a.v = b.u GROUP BY 1, 2),
l AS (SELECT DISTINCT layer FROM edges),
c AS (SELECT a.layer AS f, b.layer AS t, coalesce(n, 0) + 0.05::DOUBLE + CASE WHEN a.layer = b.layer THEN 2 ELSE 0 END AS c FROM l a CROSS JOIN l b LEFT JOIN t ON t.f = a.layer AND t.t = b.layer),
tp AS (SELECT f, t, c / sum(c) OVER (PARTITION BY f) AS p FROM c),
turn AS (SELECT list(col ORDER BY t) AS cols, (SELECT list(layer ORDER BY layer) FROM l) AS ls FROM (SELECT t, list(p ORDER BY f) AS col FROM tp GROUP BY t)),
pc AS MATERIALIZED (SELECT u, v, k, layer, tunnel = 1 OR layer < 0 AS below, a.x AS x0, a.y AS y0, b.x - a.x AS dx, b.y - a.y AS dy FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v),
mid AS (SELECT avg(x0 + dx / 2) AS mx, avg(y0 + dy / 2) AS my FROM pc),
s0 AS (SELECT *, coalesce(t_s <= lag(t_s) OVER (PARTITION BY track_id ORDER BY t_s, event_id), true) AS bd FROM pings),
s1 AS (SELECT *, sum(CAST(bd AS INT)) OVER (PARTITION BY track_id ORDER BY t_s, event_id) AS segment, coalesce(hdop, 1.5) AS hd, coalesce(sat_count, 7) AS sat FROM s0),
s2 AS MATERIALIZED (SELECT track_id, segment, event_id, t_s, obs_x, obs_y, row_number() OVER (PARTITION BY track_id, segment ORDER BY t_s, event_id) AS step,
  greatest(6.0::DOUBLE, 7.5::DOUBLE * greatest(0.5, hd)) * CASE WHEN sat < 5 THEN 1.5::DOUBLE ELSE 1 END AS sg, 1 / (1 + exp(-greatest(-20, least(20, 0.8::DOUBLE * (hd - 2) + 0.45::DOUBLE * (6 - sat))))) AS worse FROM s1),
k(track_id, segment, event_id, step, t_s, x, y, vx, vy, p, q, r, b) AS (
  SELECT DISTINCT ON (track_id, segment) track_id, segment, CAST(NULL AS BIGINT), 0::BIGINT, CAST(NULL AS DOUBLE), CASE WHEN obs_x IS NULL OR obs_y IS NULL THEN mx ELSE obs_x END, CASE WHEN obs_x IS NULL OR obs_y IS NULL THEN my ELSE obs_y END,
    0.0::DOUBLE, 0.0::DOUBLE, 2500.0::DOUBLE, 0.0::DOUBLE, 400.0::DOUBLE, list_transform(ls, lambda i: 1.0::DOUBLE / len(ls)) FROM s2, mid, turn WHERE step = 1
  UNION ALL
  SELECT track_id, segment, event_id, step, t_s, x + g1 * (px - x), y + g1 * (py - y), vx + g2 * (px - x), vy + g2 * (py - y), (1 - g1) * p, (1 - g1) * q, r - g2 * q, b FROM (
    SELECT *, p / (p + rs * rs) AS g1, q / (p + rs * rs) AS g2 FROM (
      SELECT *, 18 + 35 * (1 - list_max(b)) AS rs, list_sum(list_transform(here, lambda h: b[h.i] * h.n.qx)) / list_sum(list_transform(here, lambda h: b[h.i])) AS px,
        list_sum(list_transform(here, lambda h: b[h.i] * h.n.qy)) / list_sum(list_transform(here, lambda h: b[h.i])) AS py FROM (
        SELECT * EXCLUDE (w), list_transform(w, lambda z: z / list_sum(w)) AS b,
          list_transform(list_filter(range(1, len(ls) + 1), lambda i: len(list_filter(near, lambda n: n.layer = ls[i])) > 0), lambda i: {'i': i, 'n': list_filter(near, lambda n: n.layer = ls[i])[1]}) AS here FROM (
          SELECT *, list_transform(cols, lambda col, i: list_sum(list_transform(col, lambda f, j: f * bb[j])) * (0.000001::DOUBLE + coalesce(list_sum(list_transform(list_filter(near, lambda n: n.layer = ls[i]),
            lambda n: exp(-0.5 * (n.dist / greatest(20.0, sqrt(p))) ** 2) * greatest(CASE WHEN n.below THEN 0.2::DOUBLE + 0.8::DOUBLE * worse ELSE 1 - 0.65::DOUBLE * worse END, 0.05))), 0.0))) AS w FROM (
            SELECT track_id, segment, event_id, step, t_s, x, y, vx, vy, p, q, r, bb, worse, cols, ls, list({'layer': layer, 'below': below, 'dist': dist, 'qx': qx, 'qy': qy} ORDER BY dist, u, v, k) AS near FROM (
              SELECT *, min(dist) OVER (PARTITION BY track_id, segment) > 60 AS far, row_number() OVER (PARTITION BY track_id, segment ORDER BY dist, u, v, k) AS rn FROM (
                SELECT *, sqrt((qx - x) ** 2 + (qy - y) ** 2) AS dist FROM (
                  SELECT *, x0 + tt * dx AS qx, y0 + tt * dy AS qy FROM (
                    SELECT *, greatest(0, least(1, ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy))) AS tt FROM (
                      SELECT track_id, segment, event_id, step, t_s, x + h1 * (ox - x) AS x, y + h1 * (oy - y) AS y, vx + h2 * (ox - x) AS vx, vy + h2 * (oy - y) AS vy, (1 - h1) * p AS p, (1 - h1) * q AS q, r - h2 * q AS r, bb, worse, cols, ls FROM (
                        SELECT *, CASE WHEN seen THEN p / (p + sg * sg) ELSE 0 END AS h1, CASE WHEN seen THEN q / (p + sg * sg) ELSE 0 END AS h2, CASE WHEN seen THEN obs_x ELSE x END AS ox, CASE WHEN seen THEN obs_y ELSE y END AS oy FROM (
                          SELECT track_id, segment, event_id, step, t_s, x + vx * dt AS x, y + vy * dt AS y, vx, vy, p + 2 * q * dt + r * dt * dt + dt ** 4 AS p, q + r * dt + 2 * dt ** 3 AS q, r + 4 * dt * dt AS r, bb, worse, sg, obs_x, obs_y, obs_x IS NOT NULL AND obs_y IS NOT NULL AS seen, cols, ls FROM (
                            SELECT s2.track_id, s2.segment, s2.event_id, s2.step, s2.t_s, x, y, vx, vy, p, q, r, b AS bb, worse, sg, obs_x, obs_y, cols, ls, CASE WHEN k.t_s IS NULL THEN 1.0::DOUBLE ELSE greatest(0.25, least(30.0::DOUBLE, s2.t_s - k.t_s)) END AS dt
                            FROM k JOIN s2 ON s2.track_id = k.track_id AND s2.segment = k.segment AND s2.step = k.step + 1 CROSS JOIN turn)))) CROSS JOIN pc)))) WHERE dist <= 60 OR (far AND rn <= 10)
            GROUP BY ALL))))))
SELECT event_id, round(x, 4) AS ekf_x, round(y, 4) AS ekf_y, round(vx, 4) AS vx, round(vy, 4) AS vy, round(list_max(b), 4) AS belief FROM k WHERE step > 0""",
    "pings", "nodes", "edges",
)


PLANS = [
    Plan(b10_edge_features, B10), Plan(b11_transition_features, B11), Plan(m2_product_circuit, M2), Plan(m4_matched_mlp, M4), Plan(m1_circuit), Plan(j1_candidates, J1, "j1_j2_candidates"),
    Plan(f8_match_classes, F8), Plan(r1_routes, R1), Plan(r1_hub_routes, R1H), Plan(r3_components, R3), Plan(r5_degrees, R5), Plan(r6_pruned_nodes, R6), Plan(r7_first_exit, R7), Plan(g21_level_transitions, G21), Plan(j16_one_sided, J16),
    Plan(g2_graph_audit, G2), Plan(k6_route_vertices, K6), Plan(k5_route_features), Plan(q2_level_filter, Q2),
]

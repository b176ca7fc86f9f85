"""Queries that decode tracks in all modes, with recursive SQL for the modes that SQL can score."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import features as X
from roadloom.functions import scalars as S
from roadloom.operators import aggregates, circuits, decode, geo, graph, learners, levels, modes, sequence, training
from roadloom.plans.fixes import IMPUTED_SQL
from roadloom.plans.tools import Plan, rounded
from roadloom.sources import tables
from roadloom.sources.shared import shared_dir, stored
from roadloom.streaming import decoding

_CIRCUIT, _FROZEN, _MATCHED = X.start_weights(54), X.start_weights(54, restart=2), X.start_weights(56, restart=1, scale=0.5)
_TURNS, _MATCHED_TURNS = X.start_weights(24, restart=1), X.start_weights(25, restart=2, scale=0.5)


def _step_lists(spark, sf, fixes=None, told=None):
    """Effective fixes as steps of track segments, one row each, with their candidates as an array (geo.near_lists) that carries the edges' attributes."""
    fixes = tables.pings(spark, sf) if fixes is None else fixes
    p = sequence.displacement(sequence.boundaries(sequence.impute(fixes)), "eff_x", "eff_y").where("eff_x is not null")
    either = F.col("imputed") | F.coalesce(F.lag("imputed").over(sequence.track()), F.lit(False))
    at = F.row_number().over(sequence.Window.partitionBy("track_id", "segment").orderBy(*sequence.ORDER))
    p = p.withColumns({"reliability": X.direction_reliability(F.col("hdop"), F.col("sat_count"), F.col("moved"), either), "step": at, "traffic": S.traffic_regime(F.col("ts"))[1]})
    p = p if told is None else p.join(told, "event_id", "left")
    e = stored(geo.with_points(tables.edges(spark, sf), tables.nodes(spark, sf)).withColumn("line_length", geo.line_length(F.col("points"))), "lines")
    pieces = geo.segments(e).join(e.select("u", "v", "k", *_CARRIED), ["u", "v", "k"])
    return geo.candidate_lists(p, pieces, x="eff_x", y="eff_y", carry=_CARRIED)


def steps(spark, sf, fixes=None, told=None):
    """Candidates of effective fixes, as steps of track segments, with what emissions and transitions need."""
    lists = _step_lists(spark, sf, fixes, told)
    c = geo.flattened(lists, [n for n in lists.columns if n != "near"], carry=_CARRIED)
    c = c.withColumns({"f_layer": F.col("layer"), "f_speed": F.col("maxspeed"), "f_bearing": F.col("bearing")})
    c = geo.with_tangent(c, "points", "arc", "line_length").withColumn("scale", X.quality_scale(F.col("hdop"), F.col("sat_count"), F.col("imputed")))
    edge = (F.col("u") * 1_000_000_000 + F.col("v") * 10 + F.col("k")).cast("long")
    f = X.edge_features(*[F.col(n) for n in _ATTRIBUTES], F.col("traffic"))
    return c.withColumns({"emit": X.spatial_log_prob(F.col("dist"), F.col("scale")), "edge": edge, "ox": F.col("eff_x"), "oy": F.col("eff_y"), "f": f}).drop("points")


def _told(spark, sf):
    """Fixes of the tracks whose true edges are told, and (by event_id) those edges."""
    t = tables.truth(spark, sf)
    fixes = t.select("event_id", "track_id", "ts", "t_s", F.col("at_x").alias("obs_x"), F.col("at_y").alias("obs_y"), "hdop", "sat_count")
    told = graph.true_edges(t.select("event_id", "node_text", "next_text", "edge_key"), tables.edges(spark, sf), F.col("node_text"), F.col("next_text"), F.col("edge_key"))
    return fixes, told.where("u is not null").select("event_id", *[F.col(c).alias(f"__t{c}") for c in geo.EDGE])


def _is_true(edge):
    return F.coalesce((edge("u") == F.col("__tu")) & (edge("v") == F.col("__tv")) & (edge("k") == F.col("__tk")), F.lit(False))


def true_steps(spark, sf):
    """steps of the tracks whose true edges are told, and is_true: whether a candidate is the true edge, parallel key included."""
    c = steps(spark, sf, *_told(spark, sf))
    return c.withColumn("is_true", _is_true(F.col)).drop("__tu", "__tv", "__tk")


def true_lists(spark, sf):
    """The steps of true_steps, one row each, with `near`: their candidates by distance and edge, as an array, each with is_true."""
    lists = _step_lists(spark, sf, *_told(spark, sf))
    near = F.transform("near", lambda n: F.struct(*[n[c].alias(c) for c in ("dist", "u", "v", "k", *_ATTRIBUTES)], _is_true(lambda c: n[c]).alias("is_true")))
    return lists.withColumn("near", near).drop("__tu", "__tv", "__tk")


_ATTRIBUTES = ("length", "bearing", "maxspeed", "layer", "lanes", "oneway", "tunnel", "bridge")
_CARRIED = ("points", "line_length", *_ATTRIBUTES)


def _levels(spark, sf, c):
    """c with the filtered position's distance from each candidate edge and the belief in its level."""
    e = tables.edges(spark, sf)
    pieces = stored(geo.segments(geo.with_points(e, tables.nodes(spark, sf))), "pieces")
    below = pieces.join(e.select("u", "v", "k", "layer", ((F.col("tunnel") == 1) | (F.col("layer") < 0)).alias("below")), ["u", "v", "k"])
    ekf = stored(levels.kalman_levels(sequence.boundaries(tables.pings(spark, sf)), below, graph.level_transitions(e)), "levels")
    held = c.join(ekf.select("event_id", "ekf_x", "ekf_y", "beliefs"), "event_id")
    # The nearest of an edge's pieces.
    near = geo._projected(held.select("event_id", "u", "v", "k", "ekf_x", "ekf_y").join(pieces, ["u", "v", "k"]), "ekf_x", "ekf_y").groupBy("event_id", "u", "v", "k").agg(F.min("dist").alias("level_dist"))
    return held.join(near, ["event_id", "u", "v", "k"]).withColumn("belief", F.try_element_at("beliefs", F.col("f_layer").cast("int"))).drop("beliefs")


#: What decoding in the classical mode reads of the steps.
_PLAIN = ("track_id", "segment", "step", "event_id", "edge", "u", "v", "arc", "line_length", "ox", "oy", "tx", "ty", "moved", "reliability", "emit")


def _decoded(spark, sf, c, beam=None, modes=None, transitions=None, factors=None):
    """c decoded; transitions adds the modes' potentials to the pairs."""
    hops = stored(graph.routes_between(tables.edges(spark, sf), decode.node_pairs(c)), "hops")
    return decode.viterbi_by_step(c, hops, beam, modes, transitions, factors)


def q3_viterbi(spark, sf):
    return rounded(_decoded(spark, sf, stored(steps(spark, sf).select(*_PLAIN), "steps")), 4)


def _models(**learned):
    return modes.Models(_CIRCUIT, _FROZEN, _MATCHED, _TURNS, _MATCHED_TURNS, **learned)


def nearest_of_both(spark, sf):
    """track_id, event_id, good, bad: the nine features of each fix's nearest fast edge and of its nearest slow one, of fixes that have both: a truth that features can tell."""
    lists = _step_lists(spark, sf)
    first = lambda cond: F.get(F.filter("near", cond), F.lit(0))
    both = lists.select("track_id", "event_id", "traffic", first(lambda n: n["maxspeed"] >= 70).alias("g"), first(lambda n: n["maxspeed"] < 70).alias("b")).where("g is not null and b is not null")
    f = lambda n: X.edge_features(*[F.col(f"{n}.{c}") for c in _ATTRIBUTES], F.col("traffic"))
    return both.select("track_id", "event_id", f("g").alias("good"), f("b").alias("bad"))


def examples(spark, sf):
    """Fix-level examples of the true edges: every fix's true candidate and up to four others, with nine features."""
    features = lambda n: X.edge_features(*[n[c] for c in _ATTRIBUTES], F.col("traffic"))
    return training.supervised_of(true_lists(spark, sf), "event_id", features)


def j4_every_fix(spark, sf):
    """Every fix decoded: also those before a track's first position, which could be on any edge."""
    c = stored(steps(spark, sf).select(*_PLAIN), "steps")
    path = _decoded(spark, sf, c).join(c.select("event_id", "step").distinct(), "event_id")
    p = sequence.boundaries(sequence.impute(tables.pings(spark, sf)))
    at = sequence.Window.partitionBy("track_id", "segment").orderBy(*sequence.ORDER)
    lost = p.withColumn("step", F.row_number().over(at)).where("eff_x is null or eff_y is null").select("track_id", "segment", "event_id", "step")
    edges = tables.edges(spark, sf).select((F.col("u") * 1_000_000_000 + F.col("v") * 10 + F.col("k")).cast("long").alias("edge"), "u", "v")
    return rounded(decode.with_leading(stored(path, "path"), stored(lost, "lost"), stored(edges, "edges")), 4)


def learned_models(spark, sf):
    """The network, the kernel machine and the reservoir's head that the examples teach, as scorers of a feature array."""
    rows = stored(examples(spark, sf).select("features", "label", "group"), "examples")
    # Fewer rounds and kernels than m6 and m7 try: each round is a pass over all examples.
    network, _ = learners.tuned_network(rows, rounds=15, rate=0.1)
    kernel, _ = learners.tuned_kernel_machine(rows, size=32, rounds=8, kernels=learners.KERNELS[1:3])
    cell = learners.Reservoir(9)
    head = cell.fit(cell.sequences(rows))
    return _models(mlp=network.column, svm=kernel.column, lstm=modes.batched(cell.recall(head.tolist())))


def q3_modes(spark, sf):
    """Every fix decoded in all thirteen modes, with a beam of 30; the learners have learned from the tracks whose true edges are told."""
    m, every = learned_models(spark, sf), list(modes.MODES)
    c = _levels(spark, sf, stored(steps(spark, sf), "steps"))
    c = stored(modes.emissions(c, m, sorted({modes.MODES[n][0] for n in every})), "emissions")
    kinds = sorted({modes.MODES[n][1] for n in every})
    return rounded(_decoded(spark, sf, c, 30, modes.columns(every), lambda pairs: modes.transitions(pairs, m, kinds)), 4)


def q3_sql_modes(spark, sf):
    """The two modes with learned factors that SQL can score, without a beam: feature prior, and matched networks in emission and transition."""
    m, some = _models(), ["hmm_extra", "classical_matched"]
    c = stored(modes.emissions(stored(steps(spark, sf), "steps"), m, ["context", "matched"]), "emissions")
    factors = {"potential_plain": None, "potential_matched": lambda f: X.mlp_scores(f, m.matched_transition, 4, 4)}
    return rounded(_decoded(spark, sf, c, modes=modes.columns(some), transitions=lambda pairs: modes.transitions(pairs, m, ["plain", "matched"]), factors=factors), 4)


_F9 = ["least(length / 500, 1)", "((bearing % 360) + 360) % 360 / 360", "greatest(0, least(1, (maxspeed - 10) / 110))", "greatest(0, least(1, (layer + 3) / 8.0::DOUBLE))", "least(1, lanes / 8.0::DOUBLE)", "oneway", "tunnel", "bridge", "traffic"]


def _network_sql(x: list[str], w: list[float], n: int, h: int) -> str:
    hidden = [f"{w[(n + 1) * h + j]!r} * tanh({w[n * h + j]!r} + " + " + ".join(f"({x[i]}) * {w[i * h + j]!r}" for i in range(n)) + ")" for j in range(h)]
    return f"(1 / (1 + exp(-({w[(n + 2) * h]!r} + {' + '.join(hidden)}))))"


_CONTEXT = f"greatest(1e-9, least(1, 0.25 + 0.75 * ({' + '.join(f'({f})' for f in _F9[2:])}) / 7))"
_EMIT = {
    "classical": "sp",
    "hmm_extra": f"sp + ln({_CONTEXT})",
    "classical_matched": f"ln(greatest(1e-12, least(1, exp(sp) / (2 * pi() * 45 ** 2) * greatest(1e-9, least(1, {_network_sql(_F9, _MATCHED, 9, 5)})))))",
}
_T4 = ["least(abs(b.layer - a.layer) / 3.0::DOUBLE, 1)", "least(abs(b.maxspeed - a.maxspeed) / 100, 1)", "least(route / 150, 1)", "least(abs(b.bearing - a.bearing) % 360, 360 - abs(b.bearing - a.bearing) % 360) / 180"]
_FACTOR = {"classical": "1", "hmm_extra": "1", "classical_matched": _network_sql(["t0", "t1", "t2", "t3"], _MATCHED_TURNS, 4, 4)}

_STEPS_SQL = """, g0 AS (SELECT f.* EXCLUDE (t1, x1, y1), o.hdop, o.sat_count, o.ts, coalesce(f.t_s <= lag(f.t_s) OVER w, true) AS bd, coalesce(sqrt((f.x - lag(f.x) OVER w) ** 2 + (f.y - lag(f.y) OVER w) ** 2), 0) AS moved, coalesce(lag(f.imputed) OVER w, false) AS li
  FROM f JOIN o USING (event_id) WINDOW w AS (PARTITION BY f.track_id ORDER BY f.t_s, f.event_id)),
g1 AS (SELECT *, CAST(sum(CAST(bd AS INT)) OVER (PARTITION BY track_id ORDER BY t_s, event_id) AS BIGINT) AS segment FROM g0),
g2 AS (SELECT *, row_number() OVER (PARTITION BY track_id, segment ORDER BY t_s, event_id) AS step, exp(-greatest(greatest(hdop, 0.5) - 1, 0) / 3) * greatest(0, least(1, sat_count / 8.0::DOUBLE)) * least(1, moved / 8) * CASE WHEN imputed OR li THEN 0.25 ELSE 1.0 END AS rel,
  greatest(CASE WHEN imputed THEN 2.5 ELSE 0 END, greatest(0.75, least(3.0, greatest(hdop, 0.5) / 1.5::DOUBLE)) * CASE WHEN sat_count < 5 THEN 1.35::DOUBLE ELSE 1.0::DOUBLE END) AS scale,
  CASE WHEN hour(ts) BETWEEN 6 AND 9 THEN 1.0::DOUBLE WHEN hour(ts) BETWEEN 15 AND 18 THEN 0.9 WHEN hour(ts) BETWEEN 10 AND 14 THEN 0.4 WHEN hour(ts) BETWEEN 19 AND 21 THEN 0.2 ELSE 0 END AS traffic FROM g1 WHERE x IS NOT NULL),
ed AS (SELECT edges.*, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, CAST(u AS BIGINT) * 1000000000 + v * 10 + k AS edge FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v),
cd AS (SELECT g2.*, ed.*, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS t FROM g2 CROSS JOIN ed),
ce AS (SELECT *, sqrt((x - (x0 + t * (x1 - x0))) ** 2 + (y - (y0 + t * (y1 - y0))) ** 2) AS dist, t * 50 AS arc FROM cd),
cf AS (SELECT *, min(dist) OVER (PARTITION BY event_id) > 60 AS fb, row_number() OVER (PARTITION BY event_id ORDER BY dist, u, v, k) AS rank FROM ce),
cg AS MATERIALIZED (SELECT *, -0.5 * (dist / (scale * 45)) ** 2 AS sp FROM cf WHERE dist <= 60 OR (fb AND rank <= 10)),
bf AS (SELECT u AS src, u AS dst, 0 AS hops FROM edges UNION SELECT v, v, 0 FROM edges UNION SELECT bf.src, edges.v, hops + 1 FROM bf JOIN edges ON edges.u = bf.dst WHERE hops < 99),
hp AS MATERIALIZED (SELECT src, dst, min(hops) * 50.0::DOUBLE AS hop FROM bf GROUP BY src, dst),
p0 AS (SELECT b.track_id, b.segment, b.step, a.edge AS ea, b.edge AS eb, CASE WHEN a.edge = b.edge THEN greatest(b.arc - a.arc, 0) ELSE greatest(50 - a.arc, 0) + hop + b.arc END AS route, b.moved, b.rel,
  CASE WHEN a.edge = b.edge THEN exp(-b.rel * greatest(a.arc - b.arc, 0) / 50) ELSE 1 END AS back, b.x - a.x AS dx, b.y - a.y AS dy, (b.x1 - b.x0) / 50 AS tx, (b.y1 - b.y0) / 50 AS ty, a.layer AS la, b.layer AS lb, a.maxspeed AS sa, b.maxspeed AS sb, a.bearing AS ba, b.bearing AS bb
  FROM cg a JOIN cg b ON a.track_id = b.track_id AND a.segment = b.segment AND b.step = a.step + 1 LEFT JOIN hp ON hp.src = a.v AND hp.dst = b.u),
p1 AS MATERIALIZED (SELECT track_id, segment, step, ea, eb, least(abs(lb - la) / 3.0::DOUBLE, 1) AS t0, least(abs(sb - sa) / 100, 1) AS t1, least(route / 150, 1) AS t2, least(abs(bb - ba) % 360, 360 - abs(bb - ba) % 360) / 180 AS t3,
  exp(-abs(route - moved) / 50) * back * CASE WHEN rel <= 0 OR sqrt(dx * dx + dy * dy) <= 1e-9 THEN 1 ELSE exp(-0.5 * rel * (acos(greatest(-1, least(1, (dx * tx + dy * ty) / sqrt(dx * dx + dy * dy)))) / radians(45)) ** 2) END AS base FROM p0 WHERE route IS NOT NULL)"""
BASE_SQL = IMPUTED_SQL + _STEPS_SQL

#: The same over the tracks whose true edges are told; is_true marks the true candidate.
TRUE_SQL = (
    """+ o AS (SELECT event_id, track_id, ts, t_s, hdop, sat_count FROM truth),
f AS (SELECT event_id, track_id, t_s, at_x AS x, at_y AS y, false AS imputed, 0 AS t1, 0 AS x1, 0 AS y1 FROM truth)"""
    + _STEPS_SQL
    + """, te AS (SELECT event_id AS te_id, u AS tu, v AS tv, k AS tk FROM truth JOIN edges ON u = CAST(CAST(node_text AS DOUBLE) AS BIGINT) AND CAST(v AS VARCHAR) = next_text AND k = CAST(TRY_CAST(edge_key AS DOUBLE) AS INT)),
ct AS MATERIALIZED (SELECT cg.*, te_id IS NOT NULL AS is_true FROM cg LEFT JOIN te ON te_id = event_id AND tu = u AND tv = v AND tk = k)"""
)


def _decode_sql(n: int, mode: str, beam: int | None = None) -> str:
    """The recursion of one mode: forwards with the best predecessor of each state, starting anew where no state is reached, then back from each stretch's best end."""
    columns = "event_id, track_id, segment, step, edge, score, ptr, broken, anchor"
    best = lambda rows: rows if beam is None else f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY track_id, segment ORDER BY round(score, 8) DESC, edge) AS place FROM ({rows})) WHERE place <= {beam}"
    first = best(f"SELECT event_id, track_id, segment, step, edge, emit AS score, CAST(NULL AS BIGINT) AS ptr, false AS broken, step AS anchor FROM c{n} WHERE step = 1")
    on = best(f"""SELECT event_id, track_id, segment, step, edge, CASE WHEN ok THEN val ELSE emit END AS score, CASE WHEN ok THEN ptr END AS ptr, NOT ok AS broken, CASE WHEN ok THEN anchor ELSE step END AS anchor FROM (
    SELECT *, row_number() OVER (PARTITION BY track_id, segment, edge ORDER BY round(val, 8) DESC NULLS LAST, ptr) AS rn, bool_or(val IS NOT NULL) OVER (PARTITION BY track_id, segment) AS ok FROM (
      SELECT c.*, w.edge AS ptr, w.anchor, w.score + lp + c.emit AS val FROM w{n} w JOIN c{n} c ON c.track_id = w.track_id AND c.segment = w.segment AND c.step = w.step + 1
      LEFT JOIN r{n} r ON r.track_id = c.track_id AND r.segment = c.segment AND r.step = c.step AND r.ea = w.edge AND r.eb = c.edge)) WHERE rn = 1 AND (val IS NOT NULL OR NOT ok)""")
    return f"""c{n} AS MATERIALIZED (SELECT event_id, track_id, segment, step, edge, {_EMIT[mode]} AS emit FROM cg),
r{n} AS MATERIALIZED (SELECT track_id, segment, step, ea, eb, ln(greatest(1e-9, least(1, base * {_FACTOR[mode]}))) AS lp FROM p1),
w{n} AS (
  {first}
  UNION ALL
  {on}),
v{n} AS MATERIALIZED (SELECT * FROM w{n}),
e{n} AS (SELECT *, row_number() OVER (PARTITION BY track_id, segment, anchor ORDER BY step DESC, round(score, 8) DESC, edge) AS rn FROM v{n}),
b{n} AS (
  SELECT event_id, track_id, segment, step, edge, score, ptr, broken FROM e{n} WHERE rn = 1
  UNION ALL SELECT v.event_id, v.track_id, v.segment, v.step, v.edge, v.score, v.ptr, v.broken FROM b{n} JOIN v{n} v ON v.track_id = b{n}.track_id AND v.segment = b{n}.segment AND v.step = b{n}.step - 1 AND v.edge = b{n}.ptr)"""


Q3 = tables.with_views(BASE_SQL + ", " + _decode_sql(1, "classical") + " SELECT track_id, segment, event_id, edge, round(score, 4) AS score, broken FROM b1", "pings", "edges", "nodes")
# All edges are candidates of a fix without a position; steps from or to one go by nodes alone.
_EVERY_SQL = (
    IMPUTED_SQL
    + _STEPS_SQL.replace("FROM g1 WHERE x IS NOT NULL)", "FROM g1)")
    .replace("FROM g2 CROSS JOIN ed)", "FROM g2 CROSS JOIN ed WHERE x IS NOT NULL)")
    .replace("FROM cf WHERE dist <= 60 OR (fb AND rank <= 10))", "FROM cf WHERE dist <= 60 OR (fb AND rank <= 10) UNION ALL SELECT g2.*, ed.*, NULL, NULL, NULL, NULL, NULL, ln(0.000001::DOUBLE) FROM g2 CROSS JOIN ed WHERE x IS NULL)")
    .replace("CASE WHEN a.edge = b.edge THEN greatest(b.arc - a.arc, 0) ELSE", "CASE WHEN a.x IS NULL OR b.x IS NULL THEN CASE WHEN a.edge = b.edge THEN b.moved ELSE hop END WHEN a.edge = b.edge THEN greatest(b.arc - a.arc, 0) ELSE")
    .replace("CASE WHEN a.edge = b.edge THEN exp(", "CASE WHEN a.edge = b.edge AND a.x IS NOT NULL AND b.x IS NOT NULL THEN exp(")
)
J4Q = tables.with_views(_EVERY_SQL + ", " + _decode_sql(1, "classical") + " SELECT track_id, segment, event_id, edge, round(score, 4) AS score, broken FROM b1", "pings", "edges", "nodes")
Q3M = tables.with_views(
    BASE_SQL + ", " + _decode_sql(1, "hmm_extra") + ", " + _decode_sql(2, "classical_matched")
    + " SELECT 'hmm_extra' AS mode, track_id, segment, event_id, edge, round(score, 4) AS score, broken FROM b1 UNION ALL SELECT 'classical_matched', track_id, segment, event_id, edge, round(score, 4), broken FROM b2",
    "pings", "edges", "nodes",
)


def t4_resumed_decode(spark, sf):
    """Every fix decoded with a beam of 30 as a stream of steps, in two runs: the second goes on from the states of the first."""
    c = stored(steps(spark, sf), "steps")
    hops = stored(graph.routes_between(tables.edges(spark, sf), decode.node_pairs(c)), "hops")
    every = stored(decoding.trellis_steps_by_step(c, hops), "trellis-steps")
    folder = shared_dir(spark, "resumed-decode")
    for part in (F.col("step") % 3 > 0, F.col("step") % 3 == 0):
        every.where(part).write.mode("append").parquet(f"{folder}/steps")
        out = decoding.resume(spark, folder, beam=30)
    return rounded(out, 4)


T4 = tables.with_views(BASE_SQL + ", " + _decode_sql(1, "classical", 30) + " SELECT track_id, segment, event_id, edge, round(score, 4) AS score, broken FROM b1", "pings", "edges", "nodes")


def q7_emissions(spark, sf):
    """The emissions of every candidate that have a closed form."""
    c = modes.emissions(steps(spark, sf), _models(), ["context", "matched", "product"])
    return rounded(c.select("event_id", "edge", "emit_spatial", "emit_context", "emit_matched", "emit_product", F.size("f").alias("features")), 6)


def _product_sql(source: str, w: list[float], wires: int, layers: int, read: list[int]) -> str:
    """source plus wire_x, wire_y and wire_z of each wire read: nested selects, one for each rotation of the wires' spheres."""
    sql = "SELECT *, " + ", ".join(f"{_F9[q]} AS wire_a{q}, 0.0::DOUBLE AS wire_x{q}, 0.0::DOUBLE AS wire_y{q}, 1.0::DOUBLE AS wire_z{q}" for q in read) + f" FROM {source}"

    def turn(sql: str, a: str, b: str, angle) -> str:
        """From a towards b."""
        cols = [f"cos({angle(q)}) * wire_{a}{q} - sin({angle(q)}) * wire_{b}{q} AS wire_{a}{q}, sin({angle(q)}) * wire_{a}{q} + cos({angle(q)}) * wire_{b}{q} AS wire_{b}{q}" for q in read]
        return f"SELECT * REPLACE ({', '.join(cols)}) FROM ({sql})"

    for layer in range(layers):
        by = lambda i, layer=layer: lambda q: f"({w[3 * (layer * wires + q) + i]!r}::DOUBLE)"
        sql = turn(sql, "z", "x", lambda q: f"wire_a{q} * pi()")
        sql = turn(turn(turn(sql, "x", "y", by(0)), "z", "x", by(1)), "x", "y", by(2))
    return sql


_PRODUCT = "ln(greatest(1e-12, least(1, exp(sp) / (2 * pi() * 45 ** 2) * greatest(1e-9, least(1, ((wire_z0 + wire_z3 + wire_z6) / 3 + 1) / 2)))))"
Q7 = tables.with_views(
    BASE_SQL
    + f" SELECT event_id, edge, round(sp, 6) AS emit_spatial, round({_EMIT['hmm_extra']}, 6) AS emit_context, round({_EMIT['classical_matched']}, 6) AS emit_matched, round({_PRODUCT}, 6) AS emit_product, CAST(9 AS INT) AS features FROM ({_product_sql('cg', _CIRCUIT, 9, 2, [0, 3, 6])})",
    "pings", "edges", "nodes",
)


def q8_confidence_dips(spark, sf):
    """Where the best matched score of a fix's candidates dips below a threshold, and how far the window has grown."""
    c = steps(spark, sf).withColumn("p", X.mlp_score(F.col("f"), _MATCHED, 9, 5))
    best = c.groupBy("track_id", "event_id", "step", "t_s", "boundary").agg(F.max("p").alias("score"))
    best = stored(best, "best-scores")
    cut = aggregates.percentiles(best, [], {"cut": ("score", 0.6)}).first()[0]
    out = modes.dips(best, float(cut) if cut is not None else 0.0)
    return out.select("event_id", "ambiguity", "window")


Q8 = tables.with_views(
    BASE_SQL
    + f""", m AS (SELECT track_id, event_id, step, any_value(bd) AS bd, max({_network_sql(_F9, _MATCHED, 9, 5)}) AS score FROM cg GROUP BY 1, 2, 3),
a AS (SELECT *, score <= (SELECT quantile_cont(score, 0.6) FROM m) AS am FROM m),
r AS (SELECT *, sum(CASE WHEN NOT am OR bd THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY step) AS run FROM a)
SELECT event_id, am AS ambiguity, CAST(CASE WHEN am THEN least(120, 20 + sum(CAST(am AS INT)) OVER (PARTITION BY track_id, run ORDER BY step)) ELSE 20 END AS INT) AS "window" FROM r""",
    "pings", "edges", "nodes",
)


def l2_transition_pairs(spark, sf):
    """The true step between two fixes' edges beside up to three reachable others that are nearest the next fix: four features each."""
    c = true_steps(spark, sf).select("track_id", "segment", "step", "event_id", "edge", "u", "v", "dist", "arc", "line_length", "f_layer", "f_speed", "f_bearing", "is_true")
    c = stored(c, "true-steps")
    # Only steps from a true candidate are asked for.
    ways = graph.routes_between(tables.edges(spark, sf), decode.node_pairs(c, c.where("is_true")))
    out = training.transition_pairs(c, stored(ways, "hops"))
    return rounded(out.select("event_id", "place", *[F.get(n, F.lit(i)).alias(f"{n}{i}") for n in ("true_f", "f") for i in range(4)]), 4)


L2 = tables.with_views(
    TRUE_SQL
    + """, tr AS MATERIALIZED (SELECT * FROM ct WHERE is_true),
q0 AS (SELECT b.event_id, b.edge, b.dist, b.is_true AS good, CASE WHEN a.edge = b.edge THEN greatest(b.arc - a.arc, 0) ELSE greatest(50 - a.arc, 0) + hop + b.arc END AS route, least(abs(b.layer - a.layer) / 3.0::DOUBLE, 1) AS f0, least(abs(b.maxspeed - a.maxspeed) / 100, 1) AS f1,
  least(abs(b.bearing - a.bearing) % 360, 360 - abs(b.bearing - a.bearing) % 360) / 180 AS f3 FROM tr a JOIN ct b ON a.track_id = b.track_id AND a.segment = b.segment AND b.step = a.step + 1 LEFT JOIN hp ON hp.src = a.v AND hp.dst = b.u),
q1 AS (SELECT *, least(route / 150, 1) AS f2 FROM q0 WHERE route IS NOT NULL), g AS (SELECT * FROM q1 WHERE good),
n AS (SELECT q1.*, row_number() OVER (PARTITION BY event_id ORDER BY dist, edge) AS place FROM q1 WHERE NOT good)
SELECT n.event_id, CAST(place AS INT) AS place, round(g.f0, 4) AS true_f0, round(g.f1, 4) AS true_f1, round(g.f2, 4) AS true_f2, round(g.f3, 4) AS true_f3, round(n.f0, 4) AS f0, round(n.f1, 4) AS f1, round(n.f2, 4) AS f2, round(n.f3, 4) AS f3 FROM n JOIN g USING (event_id) WHERE place <= 3""",
    "truth", "edges", "nodes",
)


def m3_transition_circuit(spark, sf):
    """The entangled transition circuit over every turn of the network, on distinct features."""
    e = tables.edges(spark, sf)
    a, b = e.alias("a"), e.alias("b")
    f = X.transition_features(F.col("a.layer"), F.col("b.layer"), F.col("a.maxspeed"), F.col("b.maxspeed"), F.col("a.u") % 30 * S.d(10), F.col("a.bearing"), F.col("b.bearing"))
    turn = a.join(b, F.col("a.v") == F.col("b.u")).select(F.col("a.u").alias("u"), F.col("a.v").alias("v"), F.col("a.k").alias("k"), F.col("b.v").alias("w"), F.col("b.k").alias("k2"), f.alias("f"))
    rows = turn.select("f").distinct().withColumns({"z": circuits.scorer(_TURNS, 4, 2, [0, 2])(F.col("f")), "free": X.product_circuit(F.col("f"), _TURNS, 4, 2, [0, 2]), "matched": X.mlp_score(F.col("f"), _MATCHED_TURNS, 4, 4)})
    return rounded(turn.join(rows, "f").select("u", "v", "k", "w", "k2", S.probability(F.col("z")).alias("p"), "free", "matched"))


def m4_matched_turns(spark, sf):
    """The 4 - 4 - 1 network over every turn."""
    return m3_transition_circuit(spark, sf).select("u", "v", "k", "w", "k2", "matched")


M4T = tables.with_views(
    f"""+ t AS (SELECT a.u, a.v, a.k, b.v AS w, b.k AS k2, least(abs(b.layer - a.layer) / 3.0::DOUBLE, 1) AS t0, least(abs(b.maxspeed - a.maxspeed) / 100, 1) AS t1, least((a.u % 30) * 10 / 150.0::DOUBLE, 1) AS t2,
  least(abs(b.bearing - a.bearing) % 360, 360 - abs(b.bearing - a.bearing) % 360) / 180 AS t3 FROM edges a JOIN edges b ON a.v = b.u)
SELECT u, v, k, w, k2, round({_network_sql(["t0", "t1", "t2", "t3"], _MATCHED_TURNS, 4, 4)}, 6) AS matched FROM t""",
    "edges",
)

PLANS = [
    Plan(q3_viterbi, Q3), Plan(q3_sql_modes, Q3M, "q3_matched_modes"), Plan(q3_modes), Plan(t4_resumed_decode, T4), Plan(j4_every_fix, J4Q), Plan(q7_emissions, Q7), Plan(q8_confidence_dips, Q8), Plan(l2_transition_pairs, L2), Plan(m3_transition_circuit), Plan(m4_matched_turns, M4T),
]

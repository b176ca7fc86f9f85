"""Queries over fixes: coercions, features, windows, imputation, quality mixes; each with independent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import features as X
from roadloom.functions import scalars as S
from roadloom.operators import aggregates, sequence
from roadloom.plans.tools import Plan, rounded
from roadloom.sources import tables
from roadloom.streaming.fixes import windowed_quality

_FLAG = """CASE WHEN try_cast(lower(trim({0})) AS DOUBLE) IS NOT NULL
  THEN isfinite(try_cast(lower(trim({0})) AS DOUBLE)) AND try_cast(lower(trim({0})) AS DOUBLE) <> 0
  ELSE coalesce(lower(trim({0})) IN ('true', 'yes', 'y', 'on'), false) END"""
_K = "json_extract_string(props, '$.k')"


def b1_coercions(spark, sf):
    e = tables.read(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    given = lambda c: F.when(k.isNotNull(), c)  # noqa: E731  nothing is no number, and gets no default
    word = F.when(F.col("event_id") % 5 == 0, " Yes ").when(F.col("event_id") % 5 == 1, "1.0").when(F.col("event_id") % 5 == 2, "inf").when(F.col("event_id") % 5 == 3, "no").when(F.col("event_id") % 10 == 4, "On").otherwise("t")
    return rounded(
        e.select(
            "event_id", S.flag(k).alias("k_flag"), S.flag(word).alias("word_flag"), S.flag(F.col("event_type")).alias("type_flag"),
            S.number(word, -1).alias("word_number"), given(S.integer(F.round(k.try_cast("double")), -1)).alias("k_int"), given(F.coalesce(k.try_cast("double"), S.first_number(k, -1))).alias("first_number"),
            S.node_id(F.concat(F.col("user_id").cast("string"), F.lit(".0"))).alias("node"), S.edge_text(F.col("user_id"), F.col("event_id"), F.lit(0)).alias("edge"),
        )
    )


_WORD = "CASE event_id % 5 WHEN 0 THEN ' Yes ' WHEN 1 THEN '1.0' WHEN 2 THEN 'inf' WHEN 3 THEN 'no' ELSE CASE WHEN event_id % 10 = 4 THEN 'On' ELSE 't' END END"
B1 = f"""SELECT event_id, {_FLAG.format(_K)} AS k_flag, {_FLAG.format(f"({_WORD})")} AS word_flag, {_FLAG.format("event_type")} AS type_flag,
  round(coalesce(try_cast(trim({_WORD}) AS DOUBLE), -1), 6) AS word_number, CAST({_K} AS INT) AS k_int,
  CAST({_K} AS DOUBLE) AS first_number, CAST(user_id AS VARCHAR) AS node, user_id || '_' || event_id || '_0' AS edge FROM events"""


def b13_time_features(spark, sf):
    p = tables.pings(spark, sf)
    name, value = S.traffic_regime(F.col("ts"))
    day, month = S.calendar(F.col("ts"))
    tunnel = F.col("quality_state") == "view"
    return rounded(
        p.select(
            "event_id", name.alias("regime"), value.alias("regime_value"), day.alias("day"), month.alias("month"), S.noise_sigma(tunnel, value + 1).alias("sigma"),
            S.degradation(F.col("hdop"), F.col("sat_count")).alias("degradation"), X.quality_scale(F.col("hdop"), F.col("sat_count"), F.col("obs_x").isNull()).alias("scale"),
        )
    )


B13 = tables.with_views(
    """SELECT event_id, regime, v AS regime_value, round((isodow - 1) / 6.0::DOUBLE, 6) AS day, round((mon - 1) / 11.0::DOUBLE, 6) AS month,
  round(CASE WHEN quality_state = 'view' THEN 45 ELSE 10 END * (v + 1), 6) AS sigma,
  round(1 / (1 + exp(-greatest(-20, least(20, 0.8::DOUBLE * (hdop - 2) + 0.45::DOUBLE * (6 - sat_count))))), 6) AS degradation,
  round(CASE WHEN obs_x IS NULL THEN greatest(2.5, q) ELSE q END, 6) AS scale
FROM (SELECT *, dayofweek(ts) AS dow, isodow(ts) AS isodow, month(ts) AS mon, regime_of AS regime,
    CASE regime_of WHEN 'AM_PEAK' THEN 1.0::DOUBLE WHEN 'PM_PEAK' THEN 0.9::DOUBLE WHEN 'MIDDAY_NORMAL' THEN 0.4::DOUBLE WHEN 'EVENING_NORMAL' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS v,
    greatest(0.75, least(3.0, greatest(hdop, 0.5) / 1.5::DOUBLE)) * CASE WHEN sat_count < 5 THEN 1.35::DOUBLE ELSE 1.0::DOUBLE END AS q
  FROM (SELECT *, CASE WHEN hour(ts) BETWEEN 6 AND 9 THEN 'AM_PEAK' WHEN hour(ts) BETWEEN 15 AND 18 THEN 'PM_PEAK' WHEN hour(ts) BETWEEN 10 AND 14 THEN 'MIDDAY_NORMAL'
    WHEN hour(ts) BETWEEN 19 AND 21 THEN 'EVENING_NORMAL' ELSE 'OFF_PEAK_NIGHT' END AS regime_of FROM pings))""",
    "pings",
)


def f1_truck_filter(spark, sf):
    """Parts as edges: half of them matched with an authority's road, whose fields count only then."""
    p = tables.read(spark, sf, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    edge = {
        "highway": F.when(key % 19 == 0, "motorway construction").otherwise(F.col("p_type")), "construction": F.when(key % 23 == 0, "minor").when(key % 23 == 1, "No"), "status": F.when(size % 5 == 0, "Proposed").otherwise("open"),
        "access": F.when(size % 7 == 0, "Private road").when(size % 11 == 0, "no").otherwise("yes"), "vehicle": F.when(size % 13 == 0, "no"), "motor_vehicle": F.when(size % 17 == 0, "private"), "hgv": F.when(key % 29 == 0, "management only"),
        "matched": F.when(key % 2 == 0, "1.0").otherwise("0"), "road_status": F.when(key % 6 == 0, "Under Construction"), "road_access": F.when(key % 10 == 1, "private").when(key % 10 == 2, "PRIVATE"),
        "trafficable": F.when(key % 9 == 0, "4WD").when(key % 9 == 1, "2WD"),
    }
    return p.where(S.truck_allowed(edge)).select("p_partkey", "p_type", "p_size")


F1 = """SELECT p_partkey, p_type, p_size FROM part WHERE p_partkey % 19 <> 0 AND lower(p_type) NOT LIKE '%construction%' AND p_partkey % 23 <> 0 AND p_size % 5 <> 0 AND p_size % 7 <> 0 AND p_size % 11 <> 0
  AND p_size % 13 <> 0 AND p_size % 17 <> 0 AND p_partkey % 29 <> 0 AND NOT (p_partkey % 2 = 0 AND (p_partkey % 6 = 0 OR p_partkey % 10 = 2 OR p_partkey % 9 = 0))"""


def g1_quality_mix(spark, sf):
    return rounded(aggregates.quality_mix(tables.pings(spark, sf), "quality_state"))


G1 = tables.with_views(
    """SELECT quality_state,
  round(100 * avg(CASE WHEN sat_count >= 8 AND hdop <= 1.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS healthy_pct,
  round(100 * avg(CASE WHEN sat_count BETWEEN 5 AND 7 AND hdop > 1.5 AND hdop <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS moderate_pct,
  round(100 * avg(CASE WHEN sat_count BETWEEN 2 AND 4 AND hdop > 3 AND hdop <= 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS degraded_pct,
  round(100 * avg(CASE WHEN sat_count <= 1 OR hdop > 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS blackout_pct,
  round(quantile_cont(hdop, 0.5), 6) AS hdop_p50, round(quantile_cont(hdop, 0.9), 6) AS hdop_p90, round(quantile_cont(hdop, 0.95), 6) AS hdop_p95,
  round(quantile_cont(CAST(sat_count AS DOUBLE), 0.1), 6) AS sat_p10, round(quantile_cont(CAST(sat_count AS DOUBLE), 0.5), 6) AS sat_p50, round(quantile_cont(CAST(sat_count AS DOUBLE), 0.9), 6) AS sat_p90
FROM pings GROUP BY quality_state""",
    "pings",
)

_W = "(PARTITION BY track_id ORDER BY t_s, event_id)"


def w1_boundaries(spark, sf):
    return sequence.boundaries(tables.pings(spark, sf)).select("event_id", "boundary", "segment")


W1 = tables.with_views(
    f"""SELECT event_id, b AS boundary, CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) OVER {_W} AS BIGINT) AS segment
FROM (SELECT *, coalesce(t_s <= lag(t_s) OVER {_W}, true) AS b FROM pings)""",
    "pings",
)


def w2_displacement(spark, sf):
    moved = sequence.displacement(sequence.impute(tables.pings(spark, sf)), "eff_x", "eff_y")
    either = F.col("imputed") | F.coalesce(F.lag("imputed").over(sequence.track()), F.lit(False))
    held = moved.withColumn("reliability", X.direction_reliability(F.col("hdop"), F.col("sat_count"), F.col("moved"), either))
    return rounded(held.select("event_id", "eff_x", "eff_y", "imputed", "moved", "reliability"), 4)


# One step of the recursion is one fix of every track; the state is the last two effective positions.
IMPUTED_SQL = f"""+ o AS (SELECT *, row_number() OVER {_W} AS rn FROM pings),
f AS (
  SELECT track_id, rn, event_id, t_s, obs_x AS x, obs_y AS y, false AS imputed, NULL::DOUBLE AS t1, NULL::DOUBLE AS x1, NULL::DOUBLE AS y1 FROM o WHERE rn = 1
  UNION ALL
  SELECT o.track_id, o.rn, o.event_id, o.t_s,
    CASE WHEN o.obs_x IS NULL AND f.x IS NOT NULL THEN f.x + coalesce((f.x - f.x1) / least(30, greatest(0.25, f.t_s - f.t1)), 0) * least(30, greatest(0.25, o.t_s - f.t_s)) ELSE o.obs_x END,
    CASE WHEN o.obs_y IS NULL AND f.y IS NOT NULL THEN f.y + coalesce((f.y - f.y1) / least(30, greatest(0.25, f.t_s - f.t1)), 0) * least(30, greatest(0.25, o.t_s - f.t_s)) ELSE o.obs_y END,
    o.obs_x IS NULL AND f.x IS NOT NULL, f.t_s, f.x, f.y
  FROM f JOIN o ON o.track_id = f.track_id AND o.rn = f.rn + 1)"""

W2 = tables.with_views(
    IMPUTED_SQL
    + f""" SELECT event_id, round(x, 4) AS eff_x, round(y, 4) AS eff_y, imputed, round(m, 4) AS moved,
  round(greatest(0, least(1, exp(-greatest(hdop - 1, 0) / 3) * least(1, sat_count / 8.0::DOUBLE) * least(1, m / 8) * CASE WHEN imputed OR li THEN 0.25 ELSE 1.0 END)), 4) AS reliability
FROM (SELECT f.*, o.hdop, o.sat_count, coalesce(sqrt((f.x - lag(f.x) OVER w) ** 2 + (f.y - lag(f.y) OVER w) ** 2), 0) AS m, coalesce(lag(f.imputed) OVER w, false) AS li
  FROM f JOIN o USING (event_id) WINDOW w AS (PARTITION BY f.track_id ORDER BY f.t_s, f.event_id))""",
    "pings",
)


def w4_missing_runs(spark, sf):
    return rounded(sequence.runs(tables.pings(spark, sf), F.col("obs_x").isNull()))


W4 = tables.with_views(
    f"""SELECT track_id, round(min(t_s), 6) AS first_s, round(max(t_s), 6) AS last_s, count(*) AS length
FROM (SELECT *, sum(CASE WHEN obs_x IS NULL THEN 0 ELSE 1 END) OVER {_W} AS g FROM pings) WHERE obs_x IS NULL GROUP BY track_id, g""",
    "pings",
)


def w5_rising_edges(spark, sf):
    return sequence.rising_edges(tables.pings(spark, sf), F.col("obs_x").isNull())


W5 = tables.with_views(
    f"""SELECT track_id, CAST(sum(CASE WHEN m AND NOT lm THEN 1 ELSE 0 END) AS BIGINT) AS rises
FROM (SELECT track_id, obs_x IS NULL AS m, lag(obs_x IS NULL) OVER {_W} AS lm FROM pings) GROUP BY track_id""",
    "pings",
)


def w6_look_ahead(spark, sf):
    return sequence.look_ahead(tables.pings(spark, sf), F.col("obs_x").isNull(), F.col("sat_count") >= 8).select("event_id", "recovered")


W6 = tables.with_views(
    f"""SELECT event_id, coalesce(ok, false) AS recovered FROM (SELECT event_id, obs_x, lag(obs_x IS NULL) OVER {_W} AS lm,
  bool_or(sat_count >= 8) OVER (PARTITION BY track_id ORDER BY t_s, event_id ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS ok FROM pings)
WHERE lm AND obs_x IS NOT NULL""",
    "pings",
)


def w7_motion_checks(spark, sf):
    return rounded(sequence.motion_checks(tables.pings(spark, sf), 1.0, 0.01), 4)


W7 = tables.with_views(
    f"""SELECT track_id, count(*) AS fixes, count(*) FILTER (abs(g - 1) > 1e-6) AS cadence_breaks, count(*) FILTER (s > g * 0.01) AS speed_breaks, round(max(t_s) - min(t_s), 4) AS span_s
FROM (SELECT track_id, t_s, t_s - lag(t_s) OVER {_W} AS g, sqrt((true_x - lag(true_x) OVER {_W}) ** 2 + (true_y - lag(true_y) OVER {_W}) ** 2) AS s FROM pings) GROUP BY track_id""",
    "pings",
)


def w11_even_sample(spark, sf):
    return sequence.even_sample(tables.pings(spark, sf), 14).select("track_id", "event_id")


W11 = tables.with_views(
    f"""SELECT track_id, event_id FROM (SELECT *, row_number() OVER {_W} - 1 AS n, count(*) OVER (PARTITION BY track_id) AS c FROM pings)
WHERE n IN (SELECT CAST(floor(i * (c - 1) / 13.0::DOUBLE) AS BIGINT) FROM range(14) r(i))""",
    "pings",
)


def g8_blackout_stats(spark, sf):
    gaps = sequence.runs(tables.pings(spark, sf), F.col("obs_x").isNull()).withColumn("lasting", F.col("last_s") - F.col("first_s"))
    each = gaps.groupBy("track_id").agg(F.sum("length").alias("lost"), F.count("*").alias("gaps"), F.max("lasting").alias("longest"))
    summary = each.agg(F.count("*").alias("tracks"), F.avg("lost").alias("mean_lost"), F.avg("gaps").alias("mean_gaps"), F.max("longest").alias("longest_s"))
    return rounded(aggregates.with_percentiles(summary, each, [], {"median_lost": ("lost", 0.5), "p95_lost": ("lost", 0.95)}), 4)


G8 = tables.with_views(
    f"""SELECT count(*) AS tracks, round(avg(lost), 4) AS mean_lost, round(median(lost), 4) AS median_lost, round(quantile_cont(CAST(lost AS DOUBLE), 0.95), 4) AS p95_lost, round(avg(gaps), 4) AS mean_gaps, round(max(longest), 4) AS longest_s
FROM (SELECT track_id, sum(n) AS lost, count(*) AS gaps, max(l) AS longest FROM (SELECT track_id, count(*) AS n, max(t_s) - min(t_s) AS l
  FROM (SELECT *, sum(CASE WHEN obs_x IS NULL THEN 0 ELSE 1 END) OVER {_W} AS g FROM pings) WHERE obs_x IS NULL GROUP BY track_id, g) GROUP BY track_id)""",
    "pings",
)


def g10_error_summary(spark, sf):
    p = tables.pings(spark, sf).withColumn("err", F.col("true_x") - F.col("true_y"))
    return rounded(aggregates.error_summary(p, "err", "quality_state"), 4)


G10 = tables.with_views(
    """SELECT quality_state, count(*) AS n, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(quantile_cont(abs(e), 0.5), 4) AS p50,
  round(quantile_cont(abs(e), 0.9), 4) AS p90, round(quantile_cont(abs(e), 0.95), 4) AS p95 FROM (SELECT quality_state, true_x - true_y AS e FROM pings) GROUP BY quality_state""",
    "pings",
)


def g15_contrast(spark, sf):
    p, lost = tables.pings(spark, sf), F.col("obs_x").isNull()
    return rounded(p.groupBy("track_id").agg(F.avg(F.when(lost, F.col("hdop"))).alias("lost_hdop"), F.avg(F.when(~lost, F.col("hdop"))).alias("seen_hdop"), F.count_if(lost).alias("lost"), F.count_distinct("quality_state").alias("states")))


G15 = tables.with_views(
    """SELECT track_id, round(avg(hdop) FILTER (obs_x IS NULL), 6) AS lost_hdop, round(avg(hdop) FILTER (obs_x IS NOT NULL), 6) AS seen_hdop,
  count(*) FILTER (obs_x IS NULL) AS lost, count(DISTINCT quality_state) AS states FROM pings GROUP BY track_id""",
    "pings",
)


def g19_threshold(spark, sf):
    p = tables.pings(spark, sf).select("quality_state", (F.col("true_x") / 10).alias("score"), (F.col("hdop") > 5).cast("int").alias("label"))
    return rounded(aggregates.best_threshold(aggregates.threshold_curve(p, "score", "label", "quality_state"), "quality_state"))


G19 = tables.with_views(
    """+ r AS (SELECT quality_state AS g, true_x / 10 AS s, CASE WHEN hdop > 5 THEN 1 ELSE 0 END AS y FROM pings),
s AS (SELECT g, s, sum(y) AS pos, count(*) - sum(y) AS neg FROM r GROUP BY g, s),
c AS (SELECT g, coalesce((s + lead(s) OVER w) / 2, s) AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS (PARTITION BY g ORDER BY s)
  UNION ALL SELECT g, min(s) - 1e-9, 0, 0 FROM s GROUP BY g),
t AS (SELECT g, sum(pos) AS p, sum(neg) AS q FROM s GROUP BY g),
b AS (SELECT c.g, threshold, 0.5 * (tp / greatest(1, p) + (q - fp) / greatest(1, q)) AS ba FROM c JOIN t ON c.g = t.g)
SELECT g AS quality_state, round(first(threshold ORDER BY ba DESC, threshold), 6) AS threshold, round(max(ba), 6) AS balanced_accuracy FROM b GROUP BY g""",
    "pings",
)


def g5_value_counts(spark, sf):
    """How often each state comes, and its share."""
    counts = tables.truth(spark, sf).groupBy("state").agg(F.count("*").alias("fixes"))
    every = counts.agg(F.sum("fixes").alias("all"))
    return rounded(counts.crossJoin(F.broadcast(every)).select("state", "fixes", (F.col("fixes") / F.col("all")).alias("share")))


G5 = tables.with_views("SELECT state, count(*) AS fixes, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM truth GROUP BY state", "truth")


def f9_records(spark, sf):
    """Records that lack what a reader needs, apart from those that have it; `require` raises on the first."""
    t = tables.truth(spark, sf).select("event_id", F.when(F.col("event_id") % 6 > 0, F.col("edge_v")).alias("to"), F.when(F.col("event_id") % 10 > 0, F.col("hdop")).alias("score"))
    return t.withColumn("valid", S.complete("to", "score")).groupBy("valid").agg(F.count("*").alias("records"))


F9 = tables.with_views("SELECT event_id % 6 > 0 AND event_id % 10 > 0 AS valid, count(*) AS records FROM truth GROUP BY 1", "truth")


def ext_windowed_quality(spark, sf):
    p = tables.pings(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed_quality(p)
    return rounded(out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "fixes", "blackout_pct"))


EXT_W = tables.with_views(
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS fixes,
  round(100 * avg(CASE WHEN sat_count <= 1 OR hdop > 8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS blackout_pct FROM pings GROUP BY 1""",
    "pings",
)

PLANS = [
    Plan(b1_coercions, B1), Plan(b13_time_features, B13), Plan(f1_truck_filter, F1), Plan(g1_quality_mix, G1), Plan(w1_boundaries, W1), Plan(w2_displacement, W2, "q1_w2_w3_imputed_motion"),
    Plan(w4_missing_runs, W4), Plan(w5_rising_edges, W5), Plan(w6_look_ahead, W6), Plan(w7_motion_checks, W7), Plan(w11_even_sample, W11), Plan(g8_blackout_stats, G8),
    Plan(g10_error_summary, G10), Plan(g15_contrast, G15), Plan(g19_threshold, G19), Plan(ext_windowed_quality, EXT_W), Plan(g5_value_counts, G5), Plan(f9_records, F9),
]

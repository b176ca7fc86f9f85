"""Validation of trajectories against their network: identities, links, geometry, cadence, speeds, coverage; durations in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import scalars as S
from roadloom.functions.scalars import d
from roadloom.operators import graph
from roadloom.operators.aggregates import with_percentiles
from roadloom.sources.shared import stored

#: Metres a second that a truck drives at most, by how much it may be over a limit, how fast that may change, and the least shares of tunnels and bridges used.
MOST_SPEED, SPEED_ERROR, MOST_ACCELERATION, LEAST_COVERAGE = 25.0, 0.05, 0.10, 0.50
#: Order of a track's fixes.
STEPS = ("step", "event_id")


def _track() -> Window:
    return Window.partitionBy("track_id").orderBy(*STEPS)


def checked(truth: DataFrame, edges: DataFrame) -> DataFrame:
    """truth (track_id, step, event_id, edge_u, edge_v, edge_key, node_text, next_text, at_x, at_y, speed, path, stamp) with one flag a check.

    edges: u, v, k, length, maxspeed, points. A fix is compared with the next one of its track, but its speed with that of the last fix before it that has an edge.
    A step between edges that do not touch is invalid when the shortest way between them is longer than the path grew, or there is none.
    """
    # An edge brings what is asked of it: joined again by u, v, k, all fixes without an edge would be one key.
    held = graph.true_edges(truth, edges, F.col("edge_u"), F.col("edge_v"), F.col("edge_key"), carry=("maxspeed", "points"))
    valid = F.col("u").isNotNull()
    # Distance to a polyline: to the nearest of its pieces.
    apart = F.aggregate(
        F.slice("points", 2, F.size("points") - 1),
        F.struct(F.get("points", F.lit(0)).alias("p"), d(1e18).alias("n")),
        lambda s, q: F.struct(q.alias("p"), F.least(s["n"], _point_to_piece(F.col("at_x"), F.col("at_y"), s["p"], q)).alias("n")),
        lambda s: s["n"],
    )
    limit = F.least(d(MOST_SPEED), S.speed_mps(F.col("maxspeed").cast("string")))
    last_speed = F.last(F.when(valid, F.col("speed")), True).over(_track().rowsBetween(Window.unboundedPreceding, -1))
    nxt = lambda c: F.lead(c).over(_track())
    held = held.withColumns({f"next_{c}": nxt(c) for c in ("u", "v", "k", "stamp", "path", "true_layer", "true_tunnel")} | {"has_next": nxt("event_id").isNotNull(), "last_speed": last_speed})
    grew, dt = F.col("next_path") - F.col("path"), F.col("next_stamp") - F.col("stamp")
    held = held.withColumns({"grew": grew, "dt": dt})
    bad = F.col("speed").isNull() | F.isnan("speed") | (F.col("speed") < 0) | (F.col("speed") > limit + SPEED_ERROR)
    moved = valid & F.col("next_u").isNotNull() & ~((F.col("u") == F.col("next_u")) & (F.col("v") == F.col("next_v")) & (F.col("k") == F.col("next_k"))) & (F.col("v") != F.col("next_u"))
    held = stored(
        held.select(
            "track_id", *[c for c in STEPS if c != "track_id"], "u", "v", "k", "true_layer", "true_tunnel", "next_true_layer", "next_true_tunnel", "grew", F.col("next_u").alias("to"), "state", "hdop", "sat_count", "has_next",
            (~valid).alias("invalid_edge"), ((S.node_id(F.col("node_text")) != F.col("edge_u").cast("string")) | (S.node_id(F.col("next_text")) != F.col("edge_v").cast("string"))).alias("invalid_link"),
            (valid & (apart > 1e-5)).alias("off_edge"), (valid & bad).alias("too_fast"), F.coalesce(valid & (F.abs(F.col("speed") - F.col("last_speed")) > MOST_ACCELERATION), F.lit(False)).alias("jerk"),
            (F.col("has_next") & (F.col("dt").isNull() | (F.abs(F.col("dt") - 1) > 1e-9))).alias("off_cadence"),
            (F.col("has_next") & (F.col("grew").isNull() | (F.col("grew") < -1e-9) | F.coalesce(F.abs(F.col("grew") - F.col("speed") * F.col("dt")) > 1e-4, F.lit(True)))).alias("off_path"), moved.alias("moved"),
        ),
        "checked",
    )
    asked = held.where("moved").agg(F.max("grew")).first()[0]
    if asked is None:
        return held.withColumn("broken", F.lit(False)).drop("grew", "to", "moved")
    ways = graph.routes(edges, max(float(asked), 0.0) + 1e-3)
    # Only steps between edges that do not touch ask for a way; the others, many of them without an edge on either side, are not joined.
    steps = held.where("moved").join(ways.select(F.col("src").alias("v"), F.col("dst").alias("to"), F.col("dist").alias("way")), ["v", "to"], "left")
    steps = steps.withColumn("broken", F.col("way").isNull() | (F.col("way") > F.col("grew") + 1e-3)).drop("way")
    return steps.unionByName(held.where("not moved").withColumn("broken", F.lit(False))).drop("grew", "to", "moved")


def _point_to_piece(px: Column, py: Column, p: Column, q: Column) -> Column:
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    t = F.coalesce(S.clip(((px - p["x"]) * dx + (py - p["y"]) * dy) / F.nullif(dx * dx + dy * dy, d(0)), 0, 1), d(0))
    return F.hypot(px - p["x"] - t * dx, py - p["y"] - t * dy)


def exits(rows: DataFrame, ahead: int = 10) -> DataFrame:
    """Fixes in a tunnel whose next one is outside, with whether a recovery or portal state, and an open fix, come within the next `ahead`."""
    soon = _track().rowsBetween(1, ahead)
    state = F.lower(F.coalesce("state", F.lit(""))).rlike("recovery|portal")
    held = rows.withColumns({"recovered": F.max(state).over(soon), "open_after": F.max(F.col("true_tunnel") == 0).over(soon)})
    return held.where("true_tunnel = 1 and next_true_tunnel = 0")


def _percent(part: Column, whole: Column) -> Column:
    return d(100) * part / F.greatest(whole, F.lit(1))


def validate(truth: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts, contrasts and coverage for a case, and whether it passes. edges: u, v, k, length, layer, tunnel, bridge, maxspeed, points, road_class."""
    rows = stored(checked(truth, edges.select("u", "v", "k", "length", "maxspeed", "points")), "validated")
    counts = rows.agg(
        F.count_distinct("track_id").alias("tracks"), F.count("*").alias("fixes"),
        *[F.count_if(c).alias(n) for c, n in (("invalid_edge", "invalid_edges"), ("invalid_link", "invalid_fix_links"), ("broken", "invalid_sequence_links"), ("off_edge", "invalid_true_geometry"), ("off_path", "invalid_path_distance"), ("too_fast", "speed_limit_violations"), ("jerk", "acceleration_violations"), ("off_cadence", "cadence_violations"))],
        *[F.avg(F.when(F.col("true_tunnel") == t, F.col(c))).alias(f"{n}_{c}_mean") for t, n in ((1, "tunnel"), (0, "open")) for c in ("hdop", "sat_count")],
    )
    tracks = rows.groupBy("track_id").agg((F.count_distinct("true_layer") > 1).alias("several"), (F.max("true_tunnel") == 1).alias("under")).agg(F.count_if("several").alias("multilevel_tracks"), F.count_if("under").alias("tunnel_tracks"))
    left = exits(rows).agg(F.count("*").alias("tunnel_exits"), F.count_if("recovered").alias("recovered_exits"), F.count_if("open_after").alias("open_after_exit"))
    # What the network has, and how much of it the tracks use.
    used = rows.where("u is not null").select("u", "v", "k").distinct().withColumn("used", F.lit(1))
    held = edges.join(used, ["u", "v", "k"], "left").withColumns({"under": S.tunnel_edge(F.col("tunnel"), F.col("layer")), "over": S.bridge_edge(F.col("bridge"), F.col("layer"))})
    share = lambda cond: F.when(F.count_if(cond) > 0, _percent(F.count_if(cond & F.col("used").isNotNull()), F.count_if(cond)))
    cover = held.agg(
        _percent(F.count("used"), F.count("*")).alias("edge_coverage_pct"), share(F.col("under")).alias("tunnel_coverage_pct"), share(F.col("over")).alias("bridge_coverage_pct"),
        _percent(F.count_distinct(F.when(F.col("used").isNotNull(), F.col("road_class"))), F.count_distinct("road_class")).alias("class_coverage_pct"), F.array_join(F.sort_array(F.collect_set("layer")), ",").alias("graph_levels"), F.max("under").alias("__under"),
    )
    # Subset test: no level of the network is missing from the tracks.
    unseen = edges.select("layer").distinct().join(rows.select(F.col("true_layer").alias("layer")).distinct(), "layer", "left_anti").agg((F.count("*") == 0).alias("level_coverage_passed"))
    into, out = edges.select(F.col("v").alias("n"), F.col("layer").alias("a")).distinct(), edges.select(F.col("u").alias("n"), F.col("layer").alias("b")).distinct()
    feasible = into.join(out, "n").select("a", "b").distinct()
    seen = rows.where("has_next").select(F.col("true_layer").alias("a"), F.col("next_true_layer").alias("b")).distinct()
    turns = feasible.join(seen.withColumn("s", F.lit(1)), ["a", "b"], "left").agg(_percent(F.count("s"), F.count("*")).alias("level_transition_coverage_pct"))
    out = counts
    for one in (tracks, left, cover, unseen, turns):  # one row each
        out = out.crossJoin(F.broadcast(one))
    contrast = ~F.col("__under") | F.coalesce((F.col("tunnel_hdop_mean") > F.col("open_hdop_mean")) & (F.col("tunnel_sat_count_mean") < F.col("open_sat_count_mean")), F.lit(False))
    clean = [F.col(c) == 0 for c in ("invalid_edges", "invalid_fix_links", "invalid_sequence_links", "invalid_true_geometry", "invalid_path_distance", "speed_limit_violations", "acceleration_violations", "cadence_violations")]
    passed = contrast & F.col("level_coverage_passed") & (~F.col("__under") | ((F.col("tunnel_tracks") > 0) & (F.col("tunnel_exits") > 0))) & (F.col("recovered_exits") == F.col("tunnel_exits")) & (F.col("open_after_exit") == F.col("tunnel_exits"))
    enough = [F.coalesce(F.col(c) >= 100 * LEAST_COVERAGE, F.lit(True)) for c in ("tunnel_coverage_pct", "bridge_coverage_pct")]
    for c in (*clean, *enough):
        passed = passed & c
    return out.withColumns({"quality_contrast_passed": contrast, "passed": passed}).drop("__under")


def durations(truth: DataFrame, long_s: float = 120.0) -> DataFrame:
    """Per track: fixes, duration, path, interval, shares of tunnel and blackout fixes, blackout runs in seconds, entries into portals."""
    low = F.lower(F.coalesce("state", F.lit("")))
    held = truth.withColumns({"dark": low.contains("blackout"), "portal": low.contains("portal").cast("int"), "n": F.row_number().over(_track())})
    island = F.col("n") - F.row_number().over(Window.partitionBy("track_id", "dark").orderBy(*STEPS))
    held = held.withColumns({"island": island, "rises": F.col("portal") - F.lag("portal").over(_track())})
    run = held.where("dark").groupBy("track_id", "island").agg(F.count("*").alias("length")).groupBy("track_id").agg(F.count("*").alias("runs"), F.max("length").alias("longest"), F.avg("length").alias("mean_run"))
    order = F.struct(*STEPS)
    each = held.groupBy("track_id").agg(
        F.count("*").alias("n_fixes"), (F.max_by("stamp", order) - F.min_by("stamp", order)).alias("duration_s"), (F.max_by("path", order) - F.min_by("path", order)).alias("distance_m"),
        F.avg((F.col("true_tunnel") == 1).cast("double")).alias("tunnel_fix_fraction"), F.avg(F.col("dark").cast("double")).alias("blackout_fix_fraction"), F.count_if(F.col("rises") == 1).alias("n_portal_transitions"),
    )
    each = each.join(run, "track_id", "left").withColumn("fix_interval_s", F.col("duration_s") / F.greatest(F.col("n_fixes") - 1, F.lit(1)))
    seconds = lambda c: F.coalesce(F.col(c) * F.col("fix_interval_s"), d(0))
    each = each.withColumns({"n_blackout_intervals": F.coalesce("runs", F.lit(0)), "max_blackout_interval_s": seconds("longest"), "mean_blackout_interval_s": seconds("mean_run")}).drop("runs", "longest", "mean_run")
    return each.withColumn("long_blackout", F.col("max_blackout_interval_s") >= long_s)


def duration_summary(each: DataFrame) -> DataFrame:
    """One row for the case, over its tracks."""
    mean = lambda c: F.avg(c).alias(f"{c}_mean")
    summary = each.agg(
        F.count_distinct("track_id").alias("n_tracks"), mean("n_fixes"), mean("duration_s"), mean("distance_m"), mean("fix_interval_s"), mean("tunnel_fix_fraction"), mean("blackout_fix_fraction"),
        mean("n_blackout_intervals"), mean("max_blackout_interval_s"), mean("mean_blackout_interval_s"), mean("n_portal_transitions"),
        (d(100) * F.avg(F.col("long_blackout").cast("double"))).alias("long_blackout_pct"),
    )
    return with_percentiles(summary, each, [], {"duration_s_median": ("duration_s", 0.5), "max_blackout_interval_s_p95": ("max_blackout_interval_s", 0.95)})

"""Fusion of a road network with another survey's roads: matching by geometry and attributes, fused attributes, insertion of what is missing.

Lines are arrays of points; overlaps are exact: the part of a straight piece within a distance of another one is an interval, as what lies near
a piece is convex. Intervals of one piece are merged, so that cover by several roads counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import scalars as S
from roadloom.functions.scalars import clip, d
from roadloom.operators import geo
from roadloom.operators.fuzzy import best_match
from roadloom.sources.shared import stored

#: Metres that count as the same line, that a match may be apart, that ends may be snapped over, and the share that is covered.
NEAR, APART, SNAP, APPROACH_SNAP, COVERED = 8.0, 50.0, 30.0, 100.0, 0.80


def fused_attributes(layers: Column, tunnels: Column, bridges: Column, one_ways: Column, speeds: Column, lanes: Column, highway: Column, confident: Column, kind: Column, road_speed: Column, road_lanes: Column) -> dict[str, Column]:
    """One value each of an edge's attributes, which are arrays of texts, and of its matched road's, which count where the match is confident."""
    level = S.all_numbers(layers)
    low, high = F.array_min(level), F.array_max(level)
    layer = F.when(low < 0, low).when(high > 0, high).otherwise(F.coalesce(F.get(level, F.lit(0)), d(0))).cast("int")
    sure = F.coalesce(confident, F.lit(False))
    kind = F.when(sure, F.upper(kind))
    tunnel = S.any_flag(tunnels) | (layer < 0) | F.coalesce(kind == "TUNNEL", F.lit(False))
    bridge = ~tunnel & (S.any_flag(bridges) | (layer > 0) | F.coalesce(kind == "BRIDGE", F.lit(False)))
    better = lambda own, road: F.coalesce(F.when(sure & (road > 0), road.cast("double")), F.get(S.all_numbers(own), F.lit(0)))
    return {
        "layer": F.when(tunnel, F.least(layer, F.lit(-1))).when(bridge, F.greatest(layer, F.lit(1))).otherwise(layer),
        "maxspeed": F.coalesce(better(speeds, road_speed), d(60)),
        "lanes": F.coalesce(better(lanes, road_lanes), d(1)).cast("int"),
        "tunnel": tunnel.cast("int"),
        "bridge": bridge.cast("int"),
        "oneway": S.any_flag(one_ways).cast("int"),
        "highway_idx": F.when(F.lower(highway).contains("motorway"), d(1)).otherwise(d(0.5)),
    }


def pieces(lines: DataFrame, key: str) -> DataFrame:
    """key, piece, x0, y0, x1, y1, len of each straight piece of lines (key, points); pieces of no length are left out."""
    ends = F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.struct(F.get("points", i - 1).alias("p"), F.get("points", i).alias("q")))
    flat = lines.where(F.size("points") > 1).select(key, F.posexplode(ends).alias("piece", "s")).select(key, "piece", F.col("s.p.x").alias("x0"), F.col("s.p.y").alias("y0"), F.col("s.q.x").alias("x1"), F.col("s.q.y").alias("y1"))
    return flat.withColumn("len", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).where("len > 0")


def near_pairs(a: DataFrame, b: DataFrame, key_a: str, key_b: str, reach: float) -> DataFrame:
    """Pairs of pieces (columns of b with suffix _b) whose boxes are within reach: an equi-join on grid cells, each pair once."""
    size = 2 * reach
    span = lambda c, by: geo._cells(F.least(f"{c}0", f"{c}1") - by, F.greatest(f"{c}0", f"{c}1") + by, size)
    left = a.withColumn("cx", F.explode(span("x", reach))).withColumn("cy", F.explode(span("y", reach)))
    right = b.withColumn("cx", F.explode(span("x", 0.0))).withColumn("cy", F.explode(span("y", 0.0)))
    right = right.withColumnsRenamed({c: f"{c}_b" for c in ("piece", "x0", "y0", "x1", "y1", "len")})
    both = left.join(right, ["cx", "cy"])
    close = [(F.least(f"{c}0", f"{c}1") - reach <= F.greatest(f"{c}0_b", f"{c}1_b")) & (F.least(f"{c}0_b", f"{c}1_b") - reach <= F.greatest(f"{c}0", f"{c}1")) for c in "xy"]
    return both.where(close[0] & close[1]).drop("cx", "cy").dropDuplicates([key_a, "piece", key_b, "piece_b"])


def _ends(suffix: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{c}{suffix}") for c in ("x0", "y0", "x1", "y1"))


def with_inside(rows: DataFrame, a: str, b: str, out: str, r: float) -> DataFrame:
    """rows plus `out`: the interval of 0..1 along piece a (columns with suffix a) that is within r of piece b, as a struct (low, high); null where none is.

    What lies near a piece is a box and two discs, whose union is convex: the interval runs from the least to the greatest of theirs. Each
    step is a projection of its own, so that no expression is worked out twice.
    """
    c = F.col
    x0, y0, x1, y1 = _ends(a)
    p0, q0, p1, q1 = _ends(b)
    held = rows.withColumns({"_ax": x1 - x0, "_ay": y1 - y0, "_bx": p1 - p0, "_by": q1 - q0, "_fx": x0 - p0, "_fy": y0 - q0, "_gx": x0 - p1, "_gy": y0 - q1})
    held = held.withColumns({"_l": F.hypot("_bx", "_by"), "_s": c("_ax") * c("_ax") + c("_ay") * c("_ay")})
    dot = lambda p, q: c(f"{p}x") * c(f"{q}x") + c(f"{p}y") * c(f"{q}y")
    cross = lambda p, q: c(f"{p}y") * c(f"{q}x") - c(f"{p}x") * c(f"{q}y")
    # Along and across piece b: where a starts and how fast it goes; and for the discs at b's ends the terms of a square equation.
    held = held.withColumns(
        {"_u": dot("_f", "_b") / c("_l"), "_m": dot("_a", "_b") / c("_l"), "_w": cross("_f", "_b") / c("_l"), "_n": cross("_a", "_b") / c("_l"), "_h0": dot("_f", "_a"), "_r0": dot("_f", "_f") - d(r * r), "_h1": dot("_g", "_a"), "_r1": dot("_g", "_g") - d(r * r)}
    )
    held = held.withColumns({f"_k{i}": c(f"_h{i}") * c(f"_h{i}") - c("_s") * c(f"_r{i}") for i in (0, 1)})

    def between(start: Column, slope: Column, low: Column, high: Column) -> dict[str, Column]:
        s, e = (low - start) / F.nullif(slope, d(0)), (high - start) / F.nullif(slope, d(0))
        flat, level = F.abs(slope) < d(1e-12), (start >= low) & (start <= high)
        return {"l": F.when(flat, F.when(level, d(0))).otherwise(F.least(s, e)), "h": F.when(flat, F.when(level, d(1))).otherwise(F.greatest(s, e))}

    along, across = between(c("_u"), c("_m"), d(0), c("_l")), between(c("_w"), c("_n"), d(-r), d(r))
    held = held.withColumns({f"_{n}{k}": v for n, part in (("p", along), ("q", across)) for k, v in part.items()} | {f"_t{i}": F.when(c(f"_k{i}") >= 0, F.sqrt(c(f"_k{i}"))) for i in (0, 1)})
    box = c("_pl").isNotNull() & c("_ql").isNotNull()
    held = held.withColumns(
        {"_l0": F.when(box, F.greatest(d(0), "_pl", "_ql")), "_e0": F.when(box, F.least(d(1), "_ph", "_qh"))}
        | {f"_l{i + 1}": F.when(c(f"_t{i}").isNotNull(), F.greatest(d(0), (-c(f"_h{i}") - c(f"_t{i}")) / c("_s"))) for i in (0, 1)}
        | {f"_e{i + 1}": F.when(c(f"_t{i}").isNotNull(), F.least(d(1), (-c(f"_h{i}") + c(f"_t{i}")) / c("_s"))) for i in (0, 1)}
    )
    low = F.least(*[F.when(c(f"_l{i}") <= c(f"_e{i}"), c(f"_l{i}")) for i in range(3)])
    high = F.greatest(*[F.when(c(f"_l{i}") <= c(f"_e{i}"), c(f"_e{i}")) for i in range(3)])
    held = held.withColumns({"_low": low, "_high": high})
    held = held.withColumn(out, F.when(c("_low").isNotNull(), F.struct(c("_low").alias("low"), c("_high").alias("high"))))
    return held.select(*rows.columns, out)


def with_distance(rows: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """rows plus `out`: the distance of two straight pieces, 0 where they cross, else the least of each end's distance to the other."""
    ends = {"a": _ends(a), "b": _ends(b)}
    points = {"_0": ("a", 0, "b"), "_1": ("a", 2, "b"), "_2": ("b", 0, "a"), "_3": ("b", 2, "a")}  # an end, and the piece that it is measured from
    held = rows.withColumns({f"_{n}{k}": ends[n][i + 2] - ends[n][i] for n in ends for i, k in ((0, "x"), (1, "y"))})
    place = lambda p, i, of: (ends[p][i] - ends[of][0], ends[p][i + 1] - ends[of][1])
    held = held.withColumns({f"{n}{k}": v for n, (p, i, of) in points.items() for k, v in zip("xy", place(p, i, of), strict=True)})
    col = F.col
    held = held.withColumns(
        {f"{n}t": clip((col(f"{n}x") * col(f"_{of}x") + col(f"{n}y") * col(f"_{of}y")) / (col(f"_{of}x") * col(f"_{of}x") + col(f"_{of}y") * col(f"_{of}y")), 0, 1) for n, (_, _, of) in points.items()}
        | {f"{n}c": col(f"_{of}x") * col(f"{n}y") - col(f"_{of}y") * col(f"{n}x") for n, (_, _, of) in points.items()}
    )
    least = F.least(*[F.hypot(col(f"{n}x") - col(f"{n}t") * col(f"_{of}x"), col(f"{n}y") - col(f"{n}t") * col(f"_{of}y")) for n, (_, _, of) in points.items()])
    held = held.withColumn(out, F.when((col("_0c") * col("_1c") < 0) & (col("_2c") * col("_3c") < 0), d(0)).otherwise(least))
    return held.select(*rows.columns, out)


def covered(rows: DataFrame, keys: list[str], interval: str = "near", length: str = "len") -> DataFrame:
    """keys, length: how much of each piece (its keys) its intervals cover together."""
    w = Window.partitionBy(*keys).orderBy(f"{interval}.low", f"{interval}.high").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.where(F.col(interval).isNotNull()).withColumn("__before", F.greatest(F.coalesce(F.max(f"{interval}.high").over(w), d(0)), F.col(f"{interval}.low")))
    return held.groupBy(*keys).agg(F.sum(F.greatest(F.col(f"{interval}.high") - F.col("__before"), d(0)) * F.col(length)).alias("covered"))


def overlap_scores(a: DataFrame, b: DataFrame, key_a: str, key_b: str, apart: float = APART, near: float = NEAR) -> DataFrame:
    """key_a, key_b, distance, overlap of lines (key, points) at most `apart` metres from each other.

    overlap is 0.65 of the larger and 0.35 of the lesser share of either line that lies within `near` metres of the other.
    """
    pa, pb = stored(pieces(a, key_a), "fusion-a"), stored(pieces(b, key_b), "fusion-b")
    both = near_pairs(pa, pb, key_a, key_b, apart)
    both = with_inside(with_inside(with_distance(stored(both, "fusion-near"), "", "_b", "dist"), "", "_b", "near", near), "_b", "", "near_b", near)
    both = stored(both.select(key_a, key_b, "piece", "piece_b", "len", "len_b", "dist", "near", "near_b"), "fusion-pairs")
    close = both.groupBy(key_a, key_b).agg(F.min("dist").alias("distance")).where(F.col("distance") <= apart)
    out = close
    for of, key, interval, length, name in ((pa, key_a, "near", "len", "share_a"), (pb, key_b, "near_b", "len_b", "share_b")):
        piece = "piece" if key == key_a else "piece_b"
        total = of.groupBy(key).agg(F.sum("len").alias("__total"))
        part = covered(both, [key_a, key_b, piece], interval, length).groupBy(key_a, key_b).agg(F.sum("covered").alias("__part"))
        out = out.join(part, [key_a, key_b], "left").join(total, key).withColumn(name, F.coalesce(F.col("__part"), d(0)) / F.col("__total")).drop("__part", "__total")
    score = clip(d(0.65) * F.greatest("share_a", "share_b") + d(0.35) * F.least("share_a", "share_b"), 0, 1)
    return out.select(key_a, key_b, "distance", score.alias("overlap"))


def match_roads(edges: DataFrame, roads: DataFrame, apart: float = APART, accept: float = 0.50, margin: float = 0.03) -> DataFrame:
    """The best road of each edge, scored by overlap, distance, name, direction and subtype, and whether to trust it.

    edges: edge, points, name, subtype, oneway (boolean), bearing. roads: road, points, name, kind, one_way (text), direction; only roads in use.
    A match is accepted from a score of 0.5 on with an overlap of 15 % or within 15 m; it is confident if no other comes within the margin
    and, for tunnels and bridges, the overlap or the name and direction speak for it. Edges without a road near keep a row with no road.
    """
    scored = overlap_scores(edges.select("edge", "points"), roads.select("road", "points"), "edge", "road", apart)
    side = edges.select("edge", S.name_tokens(F.col("name")).alias("ta"), F.col("subtype").alias("sa"), F.col("oneway").alias("oa"), F.col("bearing").alias("ba"))
    bearing = S.mean_bearing(F.col("points"))
    turned = F.when(F.upper(F.trim("direction")) == "TO FROM", F.pmod(bearing + 180, d(360))).otherwise(bearing)
    other = roads.select("road", S.name_tokens(F.col("name")).alias("tb"), F.upper(F.trim("kind")).alias("kind"), S.one_way(F.col("one_way")).alias("ob"), turned.alias("bb"))
    held = scored.join(side, "edge").join(other, "road")
    parts = {
        "overlap": F.col("overlap"),
        "distance": F.greatest(d(0), 1 - F.col("distance") / d(apart)),
        "name": S.name_similarity(F.col("ta"), F.col("tb")),
        "direction": S.direction_similarity(F.col("oa"), F.col("ob"), F.col("ba"), F.col("bb")),
        "subtype": S.subtype_similarity(F.col("sa"), F.col("kind")),
    }
    held = held.select("edge", "road", "kind", F.col("distance").alias("apart"), *[c.alias(n) for n, c in parts.items()])
    best = best_match(held, {n: F.col(n) for n in parts}, "edge", "road", F.col("apart"), accept, margin)
    top = best.join(held, ["edge", "road"])
    accepted = F.col("accepted") & ((F.col("overlap") >= 0.15) | (F.col("apart") <= 15))
    vertical = ~F.coalesce(F.col("kind").isin("TUNNEL", "BRIDGE"), F.lit(False)) | (F.col("overlap") >= 0.15) | ((F.col("name") >= 0.75) & (F.col("direction") >= 0.5))
    top = top.select(
        "edge", "road", "score", "margin", "candidates", "overlap", F.col("apart").alias("distance"), F.col("name").alias("name_score"), F.col("direction").alias("direction_score"), F.col("subtype").alias("subtype_score"),
        accepted.alias("accepted"), (accepted & ~F.col("ambiguous") & vertical).alias("confident"), (F.col("ambiguous") | ~vertical).alias("ambiguous"),
    )
    return edges.select("edge").join(top, "edge", "left").withColumn("method", F.when(F.col("road").isNull(), "no_candidate_within_50m").otherwise("overlap_name_direction_subtype_v1"))


def coverage(lines: DataFrame, others: DataFrame, key: str, near: float = NEAR) -> DataFrame:
    """key, share: how much of each line lies within `near` metres of any of the others (other, points), counted once."""
    own, present = stored(pieces(lines, key), "cover-own"), stored(pieces(others, "other"), "cover-others")
    both = with_inside(stored(near_pairs(own, present, key, "other", near), "cover-near"), "", "_b", "near", near)
    part = covered(both, [key, "piece"]).groupBy(key).agg(F.sum("covered").alias("__part"))
    total = own.groupBy(key).agg(F.sum("len").alias("__total"))
    return total.join(part, key, "left").select(key, (F.coalesce("__part", d(0)) / F.col("__total")).alias("share"))


def connectors(roads: DataFrame, most: int = 10) -> DataFrame:
    """Tunnels, and roads and ramps that bear a tunnel's name, have "tunnel" in it and are few of that name; roads: name, kind."""
    kind, name = F.upper(F.trim("kind")), F.upper(F.trim("name"))
    held = roads.withColumns({"__kind": kind, "__name": name})
    names = held.where("__kind = 'TUNNEL'").where(~F.col("__name").isin("", "NONE", "NAN")).select("__name").distinct()
    ways = held.where(F.col("__kind").isin("ROAD", "RAMP")).join(names, "__name", "left_semi")
    few = ways.groupBy("__name").agg(F.count("*").alias("n")).where(F.col("__name").contains("TUNNEL") & (F.col("n") <= most)).select("__name")
    return held.where("__kind = 'TUNNEL'").unionByName(ways.join(few, "__name", "left_semi")).drop("__kind", "__name")


def missing_tunnels(edges: DataFrame, nodes: DataFrame, roads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new nodes, new edges) for tunnels of the survey that the network lacks, with their named approaches.

    edges: u, v, layer, tunnel, points; nodes: node_id, x, y; roads: road, points, kind, name, one_way, direction, speed, lane_count and the texts of in_use.
    A tunnel counts as present when 80 % of it lies near existing tunnels. Loose ends are snapped to the nearest node within 30 m (100 m in
    a component with an approach); a component without any snapped end is left out. Roads that are not one way come in both directions.
    """
    local = connectors(roads.where(S.in_use(F.col("status"), F.col("access"), F.col("trafficable"))))
    local = stored(local.withColumn("kind", F.upper(F.trim("kind"))).where(F.size("points") > 1), "tunnel-roads")
    present = edges.where((F.col("tunnel") == 1) | (F.col("layer") < 0)).select(F.concat_ws("_", "u", "v", "k").alias("other"), "points")
    known = coverage(local.where("kind = 'TUNNEL'").select("road", "points"), present, "road").where(F.col("share") >= COVERED).select("road")
    end = lambda i: F.struct(F.round(F.element_at("points", i)["x"], 3).alias("x"), F.round(F.element_at("points", i)["y"], 3).alias("y"))
    features = stored(local.join(known, "road", "left_anti").withColumns({"a": end(1), "b": end(-1)}), "tunnel-features")

    # Components of the features' ends, by number of end.
    ends = features.select(F.col("a").alias("p")).union(features.select("b")).groupBy("p").agg(F.count("*").alias("degree"))
    ends = stored(ends.withColumn("end", F.xxhash64("p.x", "p.y")), "tunnel-ends")
    joined = features.select(F.xxhash64("a.x", "a.y").alias("u"), F.xxhash64("b.x", "b.y").alias("v"), F.lit(0).alias("k"), "kind")
    from roadloom.operators.graph import components

    part = components(joined).withColumnRenamed("node_id", "end")
    ways = joined.where("kind <> 'TUNNEL'").join(part, joined["u"] == part["end"]).select("component").distinct().withColumn("cap", d(APPROACH_SNAP))
    ends = stored(ends.join(part, "end").join(ways, "component", "left").withColumn("cap", F.coalesce("cap", d(SNAP))), "tunnel-capped")
    near = nearest_node(ends.where("degree = 1").select("end", F.col("p.x").alias("x"), F.col("p.y").alias("y")), nodes, "end", APPROACH_SNAP)
    ends = ends.join(near, "end", "left").withColumn("snapped", F.coalesce((F.col("degree") == 1) & (F.col("dist") <= F.col("cap")), F.lit(False)))
    ends = ends.withColumn("snaps", F.sum(F.col("snapped").cast("int")).over(Window.partitionBy("component")))
    made = F.concat(F.lit("tunnel_"), F.format_string("%.3f", F.col("p.x")), F.lit("_"), F.format_string("%.3f", F.col("p.y")))
    at = lambda c: F.when(F.col("snapped"), F.col(f"node_{c}")).otherwise(F.col(f"p.{c}"))
    ends = stored(ends.where("snaps > 0").select("end", F.when(F.col("snapped"), F.col("node_id").cast("string")).otherwise(made).alias("node"), at("x").alias("x"), at("y").alias("y"), "snapped", "dist", "cap"), "tunnel-nodes")

    side = lambda s: ends.select(*[F.col(c).alias(f"{s}_{c}") for c in ends.columns])
    held = features.join(side("a"), F.xxhash64("a.x", "a.y") == F.col("a_end")).join(side("b"), F.xxhash64("b.x", "b.y") == F.col("b_end")).where("a_node <> b_node")
    point = lambda s: F.struct(F.col(f"{s}_x").alias("x"), F.col(f"{s}_y").alias("y"))
    moved = F.concat(F.array(point("a")), F.slice("points", 2, F.size("points") - 2), F.array(point("b")))
    single = F.coalesce(S.one_way(F.col("one_way")), F.lit(False))
    back = single & (F.upper(F.trim("direction")) == "TO FROM")
    held = held.withColumns({"moved": moved, "single": single, "back": back})
    ways = F.when(F.col("single"), F.array(F.col("back"))).otherwise(F.array(F.lit(False), F.lit(True)))
    out = held.select("*", F.explode(ways).alias("turned"))
    pick = lambda c: (F.when(F.col("turned"), F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")), F.when(F.col("turned"), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")))
    points = F.when(F.col("turned"), F.reverse("moved")).otherwise(F.col("moved"))
    under = F.col("kind") == "TUNNEL"
    (u, v), (snap_u, snap_v) = pick("node"), pick("snapped")
    new = out.select(
        u.alias("u"), v.alias("v"), "road", "name", F.when(under, "motorway").otherwise("motorway_link").alias("highway"), points.alias("points"), geo.line_length(points).alias("length"), S.mean_bearing(points).alias("bearing"),
        F.when(under, -1).otherwise(0).alias("layer"), under.cast("int").alias("tunnel"), F.coalesce(F.when(F.col("speed") > 0, F.col("speed")), d(80)).alias("maxspeed"),
        F.coalesce(F.when(F.col("lane_count") > 0, F.col("lane_count")), F.lit(3)).cast("int").alias("lanes"), "single", (F.col("turned") & ~F.col("single")).alias("reversed"), snap_u.alias("start_snapped"), snap_v.alias("end_snapped"),
    )
    return ends.where("not snapped").select(F.col("node").alias("node_id"), "x", "y"), new


def nearest_node(points: DataFrame, nodes: DataFrame, key: str, reach: float) -> DataFrame:
    """key, node_id, node_x, node_y, dist of the nearest node within reach (ties: the least id): an equi-join on grid cells."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    cell = lambda c: F.floor(F.col(c) / d(reach))
    left = points.select("*", F.explode(around).alias("o")).withColumns({"cx": cell("x") + F.col("o.i"), "cy": cell("y") + F.col("o.j")}).drop("o")
    right = nodes.select("node_id", F.col("x").alias("node_x"), F.col("y").alias("node_y"), cell("x").alias("cx"), cell("y").alias("cy"))
    both = left.join(right, ["cx", "cy"]).withColumn("dist", F.hypot(F.col("x") - F.col("node_x"), F.col("y") - F.col("node_y"))).where(F.col("dist") <= reach)
    best = Window.partitionBy(key).orderBy("dist", "node_id")
    return both.withColumn("__r", F.row_number().over(best)).where("__r = 1").select(key, "node_id", "node_x", "node_y", "dist")

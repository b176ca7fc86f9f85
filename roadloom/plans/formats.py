"""Round trips through files: what is written and read back must be what the tables hold; each with SQL over the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.functions import features as X
from roadloom.functions import scalars as S
from roadloom.operators import geo
from roadloom.plans.tools import Plan, rounded
from roadloom.sources import files, json_array, paths, tables
from roadloom.sources.shared import shared_dir, stored


def a6_graphml(spark, sf):
    """The network written as GraphML and read back, flags coerced."""
    e = tables.edges(spark, sf).withColumn("name", F.concat(F.lit("A & B <"), F.col("u"), F.lit(">")))
    path = shared_dir(spark, "graphml")
    files.write_graphml(tables.nodes(spark, sf).select("node_id", "x", "y"), e.select("u", "v", "k", "length", "layer", F.when(F.col("tunnel") == 1, "T").otherwise("no").alias("tunnel"), "oneway", "name"), path)
    nodes, edges = files.read_graphml_tolerant(spark, path)
    start = nodes.select(F.col("node_id").alias("u"), F.col("x").try_cast("double").alias("x"))
    return edges.join(start, "u").select("u", "v", "k", F.col("length").try_cast("double").alias("length"), F.col("layer").try_cast("int").alias("layer"), "tunnel", "oneway", "name", "x")


A6 = tables.with_views("SELECT CAST(u AS VARCHAR) AS u, CAST(v AS VARCHAR) AS v, k, length, layer, tunnel = 1 AS tunnel, oneway = 1 AS oneway, 'A & B <' || u || '>' AS name, x FROM edges JOIN nodes ON node_id = u", "edges", "nodes")


def a8_trajectories(spark, sf):
    """Trajectories as CSV, ids kept as text and missing positions as null."""
    path = shared_dir(spark, "csv")
    t = tables.truth(spark, sf)
    files.write_trajectories(t.select("event_id", F.format_string("%06d", "track_id").alias("truck_id"), "step", "edge_key", "node_text", "obs_x", "hdop", "state"), path)
    return rounded(files.read_table(spark, path, "event_id long, truck_id string, step int, edge_key string, node_text string, obs_x double, hdop double, state string"))


A8 = tables.with_views("SELECT event_id, printf('%06d', track_id) AS truck_id, CAST(step AS INT) AS step, edge_key, node_text, round(obs_x, 6) AS obs_x, round(hdop, 6) AS hdop, state FROM truth", "truth")


_CARRIED = ("speed_limit", "bearing", "is_tunnel", "layer", "line_length")


def a10_candidates(spark, sf):
    """Nested candidate sets as JSON; fixes without candidates keep a row."""
    p = tables.pings(spark, sf).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("obs_x").alias("x"), F.col("obs_y").alias("y"))
    e = geo.with_points(tables.edges(spark, sf), tables.nodes(spark, sf))
    e = stored(e.withColumns({"speed_limit": F.col("maxspeed").cast("int"), "bearing": F.pmod("bearing", S.d(360)), "is_tunnel": F.when(F.col("tunnel") == 1, "yes").otherwise("no"), "line_length": F.col("length")}), "lines")
    pieces = geo.segments(e).join(e.select(*geo.EDGE, *_CARRIED), [*geo.EDGE])
    path = shared_dir(spark, "json")
    files.write_candidates(geo.candidate_lists(p, pieces, carry=_CARRIED, x="x", y="y", keep_empty=True, top=2), path)
    out = files.read_candidate_lines(spark, path)
    return rounded(out.select("event_id", "timestamp", "candidate_index", F.array_join("edge_id", "_").alias("edge"), "dist_m", "speed_limit", "bearing", "is_tunnel", "layer", "edge_offset_m"), 4)


A10 = tables.with_views(
    """+ q AS (SELECT * FROM pings), s AS (SELECT edges.*, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v),
d AS (SELECT event_id, s.*, greatest(0, least(1, ((obs_x - x0) * (x1 - x0) + (obs_y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS g, obs_x, obs_y FROM q JOIN s ON obs_x IS NOT NULL),
e AS (SELECT *, sqrt((obs_x - (x0 + g * (x1 - x0))) ** 2 + (obs_y - (y0 + g * (y1 - y0))) ** 2) AS dist FROM d), n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, u, v, k) AS rank FROM e)
SELECT q.event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, CAST(rank - 1 AS INT) AS candidate_index, u || '_' || v || '_' || k AS edge, round(dist, 4) AS dist_m, CAST(maxspeed AS INT) AS speed_limit, bearing % 360 AS bearing,
  CASE WHEN u IS NULL THEN NULL WHEN tunnel = 1 THEN 'yes' ELSE 'no' END AS is_tunnel, layer, round(g * 50, 4) AS edge_offset_m FROM q LEFT JOIN n ON n.event_id = q.event_id AND rank <= 2""",
    "pings", "edges", "nodes",
)


def a4_geojson(spark, sf):
    """Lines as GeoJSON features, found in their folder by preference, and read back."""
    r = tables.roads(spark, sf)
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    path = shared_dir(spark, "vector")
    files.write_features(r.select(F.col("road").cast("string").alias("route_id"), F.array(at("ax", "ay"), at("bx", "by_"), at("cx", "cy")).alias("points")), f"{path}/roads.geojson")
    out = files.read_features(spark, files.vector_source(spark, path, ["streets.geojson", "roads.geojson"]), "route_id string")
    return rounded(out.select("route_id", F.size("points").alias("points"), geo.line_length(F.col("points")).alias("length"), S.mean_bearing(F.col("points")).alias("bearing")), 4)


A4 = tables.with_views(
    """SELECT CAST(road AS VARCHAR) AS route_id, CAST(3 AS INT) AS points, round(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) + sqrt((cx - bx) ** 2 + (cy - by_) ** 2), 4) AS length, round((degrees(atan2(cx - ax, cy - ay)) + 360) % 360, 4) AS bearing FROM roads""",
    "roads",
)


def a4_shapefile(spark, sf):
    """Lines and their attributes as shapefiles, one a partition, found in their folder and read back in slices of records."""
    r = tables.roads(spark, sf)
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    path = shared_dir(spark, "shapes")
    lines = F.array(F.array(at("ax", "ay"), at("bx", "by_"), at("cx", "cy")))
    files.write_shapefile(r.select("road", "name", "kind", "speed", F.col("lane_count").alias("lanes"), (F.col("status") == "Operational").alias("in_use"), lines.alias("lines")), path)
    out = files.read_shapefile(spark, path, records=50)
    points = F.get("lines", F.lit(0))
    return rounded(out.select("road", "name", "kind", "speed", "lanes", "in_use", F.size(points).alias("points"), geo.line_length(points).alias("length"), S.mean_bearing(points).alias("bearing")), 4)


A4S = tables.with_views(
    """SELECT road, name, kind, speed, CAST(lane_count AS BIGINT) AS lanes, status = 'Operational' AS in_use, CAST(3 AS INT) AS points, round(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) + sqrt((cx - bx) ** 2 + (cy - by_) ** 2), 4) AS length,
  round((degrees(atan2(cx - ax, cy - ay)) + 360) % 360, 4) AS bearing FROM roads""",
    "roads",
)


def a10_json_array(spark, sf):
    """Tracks as JSON files of one array each, with nested steps and texts full of brackets, read back in slices of a few kilobytes."""
    t = tables.truth(spark, sf)
    step = F.struct("step", "event_id", F.col("obs_x").alias("x"), F.concat(F.lit('["'), "state", F.lit('\\"},{')).alias("note"))
    each = t.groupBy("track_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    path = shared_dir(spark, "arrays")
    json_array.write(each.repartition(3, "track_id"), path)
    out = json_array.read(spark, path, "track_id long, steps array<struct<step:int,event_id:long,x:double,note:string>>", slice_bytes=4096)
    return rounded(out.select("track_id", F.explode("steps").alias("s")).select("track_id", "s.step", "s.event_id", "s.x", "s.note"))


A10J = tables.with_views(r'''SELECT track_id, CAST(step AS INT) AS step, event_id, round(obs_x, 6) AS x, '["' || state || '\"},{' AS note FROM truth''', "truth")


def a11_weights(spark, sf):
    """Weights stored and read back, checked for name and shape: a model for each quality state, its start weights scaled by the state's mean dilution."""
    path = shared_dir(spark, "weights")
    means = tables.pings(spark, sf).groupBy("quality_state").agg(F.avg("hdop").alias("m")).collect()  # a handful of states
    found = []
    for r in means:
        files.write_weights(spark, f"{path}/{r[0]}", r[0], [w * r[1] for w in X.start_weights(54)], [2, 9, 3])
        found += [(r[0], i, w) for i, w in enumerate(files.read_weights(spark, f"{path}/{r[0]}", r[0], [2, 9, 3]))]
    return rounded(spark.createDataFrame(found, "quality_state string, place int, weight double"))


A11 = tables.with_views(
    """+ m AS (SELECT quality_state, avg(hdop) AS m FROM pings GROUP BY 1)
SELECT quality_state, CAST(i - 1 AS INT) AS place, round(m * 0.05::DOUBLE * sin(2 * pi() * ((i * 0.6180339887498949::DOUBLE) - floor(i * 0.6180339887498949::DOUBLE))), 6) AS weight FROM m, range(1, 55) r(i)""",
    "pings",
)


def k7_cases(spark, sf):
    """Frames of several cases, one of which lacks a column, as one table by case."""
    t = tables.truth(spark, sf).select("event_id", "track_id", "state", "hdop")
    both = files.union_cases({"north_vic": t.where("track_id % 3 = 0"), "south_nsw": t.where("track_id % 3 = 1").drop("hdop"), "west_vic": t.where("track_id % 3 = 2")})
    path = shared_dir(spark, "cases")
    files.write_cases(both.repartition("case_name"), path)
    out = files.read_cases(spark, path).groupBy("case_name", paths.crs_of(F.col("case_name").cast("string")).alias("crs"))
    return rounded(out.agg(F.count("*").alias("rows"), F.count("hdop").alias("hdops"), F.count_distinct("state").alias("states"), (F.count_distinct("source_file") >= 1).alias("named")))


K7 = tables.with_views(
    """SELECT CASE track_id % 3 WHEN 0 THEN 'north_vic' WHEN 1 THEN 'south_nsw' ELSE 'west_vic' END AS case_name, CASE track_id % 3 WHEN 1 THEN 'EPSG:7856' ELSE 'EPSG:7855' END AS crs, count(*) AS rows,
  count(hdop) FILTER (track_id % 3 <> 1) AS hdops, count(DISTINCT state) AS states, true AS named FROM truth GROUP BY 1, 2""",
    "truth",
)


def k8_resumed(spark, sf):
    """A computation in steps that is cut off after the first and then goes on: steps that were stored are not run again."""
    t, folder, ran = tables.truth(spark, sf), shared_dir(spark, "resumed"), []

    def compute(step):
        if len(ran) == 1:
            ran.append("cut off")
            raise RuntimeError("cut off")
        ran.append(step)
        return t.where(F.col("track_id") % 3 == int(step)).groupBy("track_id").agg(F.count("*").alias("fixes"), F.lit(step).alias("step"))

    try:
        files.resumable(spark, folder, "v1", ["0", "1", "2"], compute)
    except RuntimeError:
        pass
    out = files.resumable(spark, folder, "v1", ["0", "1", "2"], compute)
    return out.withColumn("ran", F.lit(",".join(ran)))


K8 = tables.with_views("SELECT track_id, count(*) AS fixes, CAST(track_id % 3 AS VARCHAR) AS step, '0,cut off,1,2' AS ran FROM truth GROUP BY track_id", "truth")


def a12_freshness(spark, sf):
    """Whether an artifact made from the tracks is newer than all its sources, and its rows, which only a fresh one gives."""
    path, t = shared_dir(spark, "fresh"), tables.truth(spark, sf)
    t.select("event_id", "track_id").write.parquet(f"{path}/source")
    spark.read.parquet(f"{path}/source").groupBy("track_id").count().write.parquet(f"{path}/artifact")
    t.select("event_id", "state").write.parquet(f"{path}/changed")
    rows = spark.read.parquet(f"{path}/artifact").count()
    told = [(n, files.is_fresh(spark, f"{path}/artifact", [f"{path}/{n}"])) for n in ("source", "changed", "absent")]
    return spark.createDataFrame([(n, fresh, rows if fresh else None) for n, fresh in told], "source string, fresh boolean, rows long")


A12 = tables.with_views("""SELECT source, fresh, CASE WHEN fresh THEN (SELECT count(DISTINCT track_id) FROM truth) END AS rows FROM (VALUES ('source', true), ('changed', false), ('absent', false)) t(source, fresh)""", "truth")

PLANS = [
    Plan(a6_graphml, A6, "a6_a7_k1_graphml"), Plan(a8_trajectories, A8, "a8_a9_k2_trajectories"), Plan(a10_candidates, A10, "a10_b20_k3_candidates"), Plan(a4_geojson, A4, "a4_a5_k5_geojson"), Plan(a4_shapefile, A4S), Plan(a10_json_array, A10J), Plan(a11_weights, A11, "a11_k4_m10_weights"),
    Plan(k7_cases, K7, "k7_k9_b24_u1_cases"), Plan(k8_resumed, K8, "k8_q10_resumed"), Plan(a12_freshness, A12),
]

"""Scans and sinks: GraphML, trajectory CSV, GeoJSON, nested candidate JSON, weights, route exports, consolidated tables, resumable steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.functions.scalars import LENIENT_TEXTS, flag, node_id
from roadloom.sources import json_array, shapefile

_DATA = "array<struct<_VALUE:string,_key:string>>"
_GRAPHML = {
    "node": f"_id string, data {_DATA}",
    "edge": f"_source string, _target string, _id string, data {_DATA}",
    "key": "_id string, `_attr.name` string, _for string",
}

#: Ids of trajectories are text whatever they look like.
TRAJECTORY = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("truck_id", "case_name")]
    + [T.StructField("timestamp", T.IntegerType()), T.StructField("actual_time", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("day_of_week", "month_of_year")]
    + [T.StructField("regime", T.StringType()), T.StructField("time_qubit_val", T.DoubleType())]
    + [T.StructField(c, T.StringType()) for c in ("node_id", "next_node_id", "edge_u", "edge_v", "edge_key", "edge_osmid")]
    + [T.StructField(c, T.DoubleType()) for c in ("obs_x", "obs_y", "true_x", "true_y", "true_path_distance_m", "true_speed_mps", "hdop")]
    + [T.StructField("sat_count", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("quality_state", "quality_profile_calibration_status")]
    + [T.StructField(c, T.IntegerType()) for c in ("position_error_calibrated", "true_layer", "true_tunnel", "true_bridge", "true_oneway", "true_truck_eligible")]
    + [T.StructField("true_bearing", T.DoubleType())]
)


def _graphml(spark: SparkSession, path: str, tag: str) -> DataFrame:
    # The newer parser reads a file as one document and stops where its first element ends: of a part that holds elements alone it gives one.
    return spark.read.format("xml").option("rowTag", tag).option("useLegacyXMLParser", True).schema(_GRAPHML[tag]).load(path)


def graphml_keys(spark: SparkSession, path: str, of: str) -> dict[str, str]:
    """Key id -> attribute name. A GraphML header has a few dozen keys."""
    return {r[0]: r[1] for r in _graphml(spark, path, "key").where(F.col("_for").isin(of, "all")).select("_id", F.col("`_attr.name`")).collect()}


def _attributes(keys: dict[str, str]) -> list[Column]:
    by_key = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast(_DATA)), lambda d: F.struct(d["_key"], d["_VALUE"])))
    return [F.try_element_at(by_key, F.lit(k)).alias(name) for k, name in sorted(keys.items(), key=lambda x: x[1])]


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges); ids are text, attributes stay text, and simple graphs have key 0."""
    nodes = _graphml(spark, path, "node").select(node_id(F.col("_id")).alias("node_id"), *_attributes(graphml_keys(spark, path, "node")))
    edges = _graphml(spark, path, "edge").select(
        node_id(F.col("_source")).alias("u"), node_id(F.col("_target")).alias("v"), F.coalesce(F.col("_id").try_cast("int"), F.lit(0)).alias("k"), *_attributes(graphml_keys(spark, path, "edge"))
    )
    return nodes, edges


def read_graphml_tolerant(spark: SparkSession, path: str, flags: tuple[str, ...] = ("oneway", "reversed", "tunnel", "bridge")) -> tuple[DataFrame, DataFrame]:
    """read_graphml with the edges' flag-like attributes as booleans, "t" counting as true too; a flag that an edge lacks is false."""
    nodes, edges = read_graphml(spark, path)
    return nodes, edges.withColumns({c: flag(F.col(c), LENIENT_TEXTS) for c in flags if c in edges.columns})


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One GraphML graph as text parts in order: header, nodes (node_id and attributes), edges (u, v, k and attributes), end; joined, the parts are one file.

    Missing values are left out. Every part holds whole elements, so that they can be read side by side.
    """
    keys = {"node": [c for c in nodes.columns if c != "node_id"], "edge": [c for c in edges.columns if c not in ("u", "v", "k")]}
    ident = {"node": {c: f"n{i}" for i, c in enumerate(keys["node"])}, "edge": {c: f"e{i}" for i, c in enumerate(keys["edge"])}}

    def data(of: str) -> Column:
        each = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f'<data key="{i}">'), _escaped(F.col(f"`{c}`").cast("string")), F.lit("</data>"))) for c, i in ident[of].items()]
        return F.concat_ws("", *each)

    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + "".join(f'<key id="{i}" for="{of}" attr.name="{c}" attr.type="string"/>' for of in ident for c, i in ident[of].items()) + '<graph edgedefault="directed">'
    text = lambda c: _escaped(F.col(c).cast("string"))
    node = F.concat(F.lit('<node id="'), text("node_id"), F.lit('">'), data("node"), F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), text("u"), F.lit('" target="'), text("v"), F.lit('" id="'), text("k"), F.lit('">'), data("edge"), F.lit("</edge>"))
    spark = nodes.sparkSession
    lines = spark.createDataFrame([(0, head), (3, "</graph></graphml>")], "part int, line string")
    lines = lines.union(nodes.select(F.lit(1), node)).union(edges.select(F.lit(2), edge))
    lines.orderBy("part", "line").select("line").write.text(path)


def write_trajectories(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """CSV by an explicit schema: ids stay text whatever they look like."""
    return spark.read.schema(ddl).option("header", True).csv(path)


def write_weights(spark: SparkSession, path: str, name: str, weights: list[float], shape: list[int]) -> None:
    """Weights of a model as one row: name, shape, values."""
    spark.createDataFrame([(name, shape, [float(w) for w in weights])], "name string, shape array<int>, weights array<double>").write.parquet(path)


def read_weights(spark: SparkSession, path: str, name: str, shape: list[int]) -> list[float]:
    """The weights of a model, of the wanted shape and finite; anything else raises, as a model must never run on other weights than its own."""
    row = spark.read.parquet(path).where(F.col("name") == name).first()
    if row is None or list(row["shape"]) != list(shape):
        raise ValueError(f"no weights {name} of shape {shape}")
    size = 1
    for n in shape:
        size *= n
    if len(row["weights"]) != size or any(w != w or abs(w) == float("inf") for w in row["weights"]):
        raise ValueError(f"weights {name} are incomplete")
    return list(row["weights"])


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """CSV with text ids; NaN positions become null, so that one kind of missing is left."""
    df = spark.read.schema(TRAJECTORY).option("header", True).csv(path)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("obs_x", "obs_y", "hdop")})


def read_geojson(spark: SparkSession, path: str, properties: str, slice_bytes: int = 32 << 20) -> DataFrame:
    """One row a feature of a collection, which is read in slices: the properties (of the given DDL) and the coordinates of a LineString."""
    feature = f"properties struct<{properties}>, geometry struct<type:string,coordinates:array<array<double>>>"
    raw = json_array.read(spark, path, feature, "features", slice_bytes)
    return raw.select("properties.*", F.col("geometry.coordinates").alias("coordinates"))


def read_shapefile(spark: SparkSession, path: str, records: int = 100_000) -> DataFrame:
    """record, shape, lines and the table's columns of a .shp or a folder of them, in slices of records."""
    spark.dataSource.register(shapefile.ShapefileSource)
    return spark.read.format("shapefile").option("records", records).load(path)


def write_shapefile(df: DataFrame, path: str) -> None:
    """df (lines array<array<struct<x,y>>> and plain columns) as a folder of shapefiles, one a partition."""
    df.sparkSession.dataSource.register(shapefile.ShapefileSource)
    df.write.format("shapefile").mode("append").save(path)


CANDIDATE = "array<struct<edge_id:array<string>,dist_m:double,speed_limit:int,bearing:double,is_tunnel:string,layer:int,edge_x:double,edge_y:double,edge_offset_m:double,edge_length_m:double>>"
#: Fixes of one file of candidate sets.
SET_ROWS = 200_000


def read_candidates(spark: SparkSession, path: str, slice_bytes: int = 32 << 20) -> DataFrame:
    """Nested candidate sets of a file that is one array, read in slices: one row a candidate; fixes without candidates keep a row. ping_index is the fix's offset in its file."""
    raw = json_array.read(spark, path, f"timestamp string, original_coords array<double>, projected_coords array<double>, candidates {CANDIDATE}", slice_bytes=slice_bytes)
    listed = raw.withColumnRenamed("at", "ping_index")
    return listed.select("source_file", "ping_index", "timestamp", "original_coords", "projected_coords", F.posexplode_outer("candidates").alias("candidate_index", "c")).select("*", "c.*").drop("c")


def write_candidates(lists: DataFrame, path: str) -> None:
    """Nested candidate sets, a JSON object a fix and line. lists: event_id, timestamp, x, y and `near`, the fix's candidates in their order, as geo.candidate_lists
    gives them with speed_limit, bearing, is_tunnel, layer and line_length carried; a fix without gets an empty set. No row is shuffled. Files are compressed, as names
    and digits repeat; one is read by one task, so none has more than SET_ROWS fixes."""

    def entry(c: Column) -> Column:
        return F.struct(
            F.array(*[c[n].cast("string") for n in ("u", "v", "k")]).alias("edge_id"), c["dist"].alias("dist_m"), *[c[n].alias(n) for n in ("speed_limit", "bearing", "is_tunnel", "layer")],
            c["px"].alias("edge_x"), c["py"].alias("edge_y"), c["arc"].alias("edge_offset_m"), c["line_length"].alias("edge_length_m"),
        )

    xy = F.array("x", "y")
    held = lists.select("event_id", "timestamp", xy.alias("original_coords"), xy.alias("projected_coords"), F.coalesce(F.transform("near", entry), F.array().cast(CANDIDATE)).alias("candidates"))
    held.write.option("maxRecordsPerFile", SET_ROWS).json(path, compression="gzip")


def read_candidate_lines(spark: SparkSession, path: str) -> DataFrame:
    """What write_candidates wrote, one row a candidate; fixes without candidates keep a row."""
    raw = spark.read.schema(f"event_id long, timestamp string, original_coords array<double>, projected_coords array<double>, candidates {CANDIDATE}").json(path)
    return raw.select("event_id", "timestamp", "original_coords", F.posexplode_outer("candidates").alias("candidate_index", "c")).select("*", "c.*").drop("c")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """case_name, name and value (text) of the overrides of a profile file: an object by case, or one with that under `profiles`."""
    raw = spark.read.text(path, wholetext=True)  # a few lines for each case
    kind = "map<string,map<string,string>>"
    own = F.try_element_at(F.from_json("value", "map<string,string>"), F.lit("profiles"))
    cases = F.from_json(F.coalesce(own, F.col("value")), kind)
    return raw.select(F.explode(cases).alias("case_name", "p")).select("case_name", F.explode("p").alias("name", "value"))


def read_thresholds(spark: SparkSession, folder: str, cases: list[str]) -> DataFrame:
    """case_name and threshold from a file <case>.json each; raises for a case without one."""
    raw = spark.read.schema("threshold double").json(folder, multiLine=True)
    found = raw.where("threshold is not null").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("case_name"), "threshold").where(F.col("case_name").isin(cases))
    there = {r[0] for r in found.select("case_name").collect()}
    if missing := sorted(set(cases) - there):
        raise FileNotFoundError(f"no threshold for {missing} in {folder}")
    return found


def write_features(routes: DataFrame, path: str) -> None:
    """GeoJSON features, one a line."""
    route_features(routes).select("feature").write.text(path)


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """GeoJSON features, one a line: the properties (of the given DDL) and the points of a LineString."""
    raw = spark.read.schema(f"properties struct<{properties}>, geometry struct<type:string,coordinates:array<array<double>>>").json(path)
    point = F.transform("geometry.coordinates", lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y")))
    return raw.where("geometry.type = 'LineString'").select("properties.*", point.alias("points"))


def vector_source(spark: SparkSession, folder: str, names: list[str]) -> str:
    """The first of the named files that a folder has, else its first GeoJSON file, else its first shapefile; raises where there is none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    there = sorted(f.getPath().getName() for f in (fs.listStatus(root) if fs.exists(root) else []))
    other = [n for end in ((".geojson", ".json"), (".shp",)) for n in there if n.lower().endswith(end)]
    for name in [*names, *other]:
        if name in there:
            return f"{folder.rstrip('/')}/{name}"
    raise FileNotFoundError(f"no vector file in {folder}")


def read_cases(spark: SparkSession, path: str, case: str = "case_name") -> DataFrame:
    """All cases as one table, with each row's case and file."""
    return spark.read.parquet(path).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def union_cases(frames: dict[str, DataFrame]) -> DataFrame:
    """Frames of several cases as one, with the case; columns that a frame lacks are null."""
    out = None
    for case, df in frames.items():
        df = df.withColumn("case_name", F.lit(case))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def resumable(spark: SparkSession, folder: str, signature: str, steps: list[str], compute) -> DataFrame:
    """Runs named steps one after the other, each stored under a folder of the signature (of code and settings); steps that are there already are not run again.

    A step counts only when its write was committed, so a run that was cut off goes on where it was.
    """
    out = None
    for step in steps:
        path = f"{folder.rstrip('/')}/{signature}/{step}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            compute(step).write.mode("overwrite").parquet(path)
        part = spark.read.parquet(path)
        out = part if out is None else out.unionByName(part)
    return out


def write_cases(df: DataFrame, path: str, case: str = "case_name") -> None:
    """One table for all cases; a case's rows share its folder."""
    df.write.partitionBy(case).parquet(path)


def route_features(routes: DataFrame) -> DataFrame:
    """GeoJSON features, as text, of routes (route_id, points array<struct<x,y>>)."""
    coordinates = F.transform("points", lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))
    return routes.select("route_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("route_id").alias("properties"), geometry.alias("geometry"))).alias("feature"))


def route_vertices(routes: DataFrame) -> DataFrame:
    """One row a vertex, in order."""
    return routes.select("route_id", F.posexplode("points").alias("vertex", "p")).select("route_id", "vertex", "p.x", "p.y")


def is_fresh(spark: SparkSession, artifact: str, sources: list[str]) -> bool:
    """Whether the artifact is there and no source is missing or newer, by file times."""

    def newest(path: str):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        return spark.read.format("binaryFile").load(path).agg(F.max("modificationTime")).first()[0]

    made = newest(artifact)
    return made is not None and all((t := newest(s)) is not None and t <= made for s in sources)


def require_fresh(spark: SparkSession, artifact: str, sources: list[str]) -> None:
    """Raises unless the artifact exists and no source is missing or newer."""
    if not is_fresh(spark, artifact, sources):
        raise ValueError(f"{artifact} is missing or older than one of {sources}")

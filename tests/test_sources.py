"""Shapefiles and JSON arrays read in slices: what is read is what was written, however it is cut."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from roadloom.sources import files, json_array, shapefile


@pytest.fixture(scope="module")
def shapes(spark):
    spark.dataSource.register(shapefile.ShapefileSource)
    return spark


def test_shapefile_round_trip(shapes, tmp_path):
    rows = [(i, f"Straße {i}" if i % 3 else None, i * 0.1 if i % 4 else None, i % 2 == 0 if i % 5 else None, [[(float(i), 1.0), (2.5, -3.0)], [(0.1, 0.2), (3.0, 4.0), (5.0, 6.0)]][: i % 3] or None) for i in range(50)]
    df = shapes.createDataFrame(rows, "id long, name string, width double, open boolean, lines array<array<struct<x:double,y:double>>>").repartition(3)
    path = f"file://{tmp_path}/roads"
    df.write.format("shapefile").mode("append").save(path)
    with open(f"{tmp_path}/roads/part-never-committed.shp", "wb") as f:
        f.write(b"not a shapefile")
    for records in (7, 100_000):
        back = shapes.read.format("shapefile").option("records", records).load(path)
        assert dict(back.dtypes)["id"] == "bigint" and dict(back.dtypes)["width"] == "double"
        assert back.rdd.getNumPartitions() == (sum(-(-n // 7) for n in [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]) if records == 7 else 3)
        got = sorted((r.id, r.name, r.width, r.open, [[tuple(p) for p in part] for part in r.lines] if r.lines else None) for r in back.collect())
        assert got == [(i, n, w, o, [[tuple(p) for p in part] for part in ls] if ls else None) for i, n, w, o, ls in rows]


def test_shapefile_of_points_heights_and_deleted_rows(shapes, tmp_path):
    """A file as other programs write it: points and a line with heights, capital endings, a code page, a deleted record."""
    contents = [struct.pack("<i2d", 1, 3.0, 4.0), struct.pack("<i4d2i", 13, 0, 0, 1, 1, 1, 2) + struct.pack("<i4d", 0, 0.0, 0.0, 1.0, 1.0) + struct.pack("<2d2d", 0, 9, 9, 9), struct.pack("<i2d", 1, 5.0, 6.0), struct.pack("<i", 0)]
    shp, shx = bytearray(), bytearray()
    for i, c in enumerate(contents, 1):
        shx += struct.pack(">2i", (100 + len(shp)) // 2, len(c) // 2)
        shp += struct.pack(">2i", i, len(c) // 2) + c
    head = struct.pack(">i20xi", 9994, 50) + struct.pack("<2i8d", 1000, 1, *[0.0] * 8)
    fields = struct.pack("<11sc4xBB14x", b"NAME", b"C", 6, 0) + struct.pack("<11sc4xBB14x", b"LANES", b"N", 4, 0) + struct.pack("<11sc4xBB14x", b"SPEED", b"N", 6, 1)
    table = struct.pack("<B3BIHH20x", 3, 99, 1, 1, 4, 32 + 96 + 1, 17) + fields + b"\r"
    rows = [b" caf\xe9     2  50.5", b" plain ****      ", b"*gone     1   1.0", b"          3      "]
    for end, data in ((".SHP", head + shp), (".SHX", head + shx), (".DBF", table + b"".join(r[:17].ljust(17) for r in rows)), (".CPG", b"latin-1")):
        (tmp_path / f"ROADS{end}").write_bytes(bytes(data))
    got = shapes.read.format("shapefile").load(f"{tmp_path}/ROADS.SHP").orderBy("record").collect()
    assert [(r.record, r.shape, r.NAME, r.LANES, r.SPEED) for r in got] == [(0, 1, "café", 2, 50.5), (1, 13, "plain", None, None), (3, 0, None, 3, None)]
    assert [[[tuple(p) for p in part] for part in r.lines] if r.lines else None for r in got] == [[[(3.0, 4.0)]], [[(0.0, 0.0), (1.0, 1.0)]], None]


def test_shapefile_refuses_what_it_cannot_hold(shapes, tmp_path):
    with pytest.raises(Exception, match="254"):
        shapes.createDataFrame([("x" * 300, None)], "name string, lines array<array<struct<x:double,y:double>>>").write.format("shapefile").mode("append").save(f"{tmp_path}/a")
    with pytest.raises(Exception, match="ten bytes"):
        shapes.createDataFrame([(1, None)], "a_very_long_name long, lines array<array<struct<x:double,y:double>>>").write.format("shapefile").mode("append").save(f"{tmp_path}/b")


ELEMENTS = [{"id": i, "text": t, "deep": {"a": [[1, 2], [3]], "b": "]},{["}} for i, t in enumerate(["", "a,b", 'say "no"', "back\\slash\\", "\\\\\"[", "ü" * 40, "}{][", "\n\t", "features", None])]


@pytest.mark.parametrize("size", [5, 50, 1 << 20])
def test_json_array_cut_anywhere(spark, tmp_path, size):
    text = json.dumps(ELEMENTS, indent=1, ensure_ascii=False)
    if size < 7:
        text = json.dumps(ELEMENTS[2:4], ensure_ascii=False)
    (tmp_path / "a.json").write_text(text, encoding="utf-8")
    got = json_array.read(spark, f"file://{tmp_path}/a.json", "id int, text string, deep struct<a:array<array<int>>,b:string>", slice_bytes=size).orderBy("at").collect()
    want = json.loads(text)
    assert [(r.id, r.text, r.deep.a, r.deep.b) for r in got] == [(e["id"], e["text"], e["deep"]["a"], e["deep"]["b"]) for e in want]


@pytest.mark.parametrize("size", [16, 1 << 20])
def test_json_member_array(spark, tmp_path, size):
    whole = {"type": "features", "features ": [1], "crs": {"features": [9]}, "name": 'a "features": [', "features": [{"id": 1}, {"id": 2, "features": [3]}, {"id": 3}], "after": [{"id": 4}]}
    (tmp_path / "c.json").write_text(json.dumps(whole))
    assert [r.id for r in json_array.read(spark, f"file://{tmp_path}/c.json", "id int", "features", size).orderBy("at").collect()] == [1, 2, 3]


def test_ends_of_slices_add_up():
    """Any cut of a text, into the smallest slices, too, gives the state and depth of the whole."""
    data = json.dumps(ELEMENTS, ensure_ascii=False).encode()
    for size in (1, 2, 3, 5):
        state, depth = json_array.OUTSIDE, 0
        for i in range(0, len(data), size):
            state, change = json_array.crossed(data[i : i + size], state)
            depth += change
            assert (state, depth) == json_array.crossed(data[: i + size], json_array.OUTSIDE)


def test_json_arrays_written_and_read(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit('x"\\'), "id")).alias("t")).repartition(4)
    json_array.write(df, f"file://{tmp_path}/many")
    back = json_array.read(spark, f"file://{tmp_path}/many", "id long, t string", slice_bytes=500)
    assert sorted(tuple(r) for r in back.select("id", "t").collect()) == sorted(tuple(r) for r in df.collect())
    json_array.write(df.where("id < 0"), f"file://{tmp_path}/none")
    assert json_array.read(spark, f"file://{tmp_path}/none", "id long").count() == 0


def test_profiles_and_thresholds(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"profiles": {"north": {"hdop": 1.5, "note": "x"}, "south": {"hdop": 2}}}))
    (tmp_path / "q.json").write_text(json.dumps({"north": {"hdop": 3.5}}))
    read = lambda n: {(r.case_name, r.name): r.value for r in files.read_profiles(spark, f"{tmp_path}/{n}.json").collect()}
    assert read("p") == {("north", "hdop"): "1.5", ("north", "note"): "x", ("south", "hdop"): "2"} and read("q") == {("north", "hdop"): "3.5"}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "north.json").write_text('{"threshold": 0.25}')
    assert [tuple(r) for r in files.read_thresholds(spark, f"{tmp_path}/t", ["north"]).collect()] == [("north", 0.25)]
    with pytest.raises(FileNotFoundError, match="south"):
        files.read_thresholds(spark, f"{tmp_path}/t", ["north", "south"])


def test_graphml_of_many_parts_keeps_every_element(spark, tmp_path):
    """Only the first part has a header, and only the last one an end: none but a single part is a document of its own."""
    def element(i):
        return f'<node id="{i}"><data key="n0">{i}.5</data></node>' if i < 40 else f'<edge source="{i - 40}" target="{i - 39}" id="0"><data key="e0">A &amp;lt; {i}</data></edge>'

    head = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="n0" for="node" attr.name="x" attr.type="string"/><key id="e0" for="edge" attr.name="name" attr.type="string"/><graph edgedefault="directed">'
    lines = [head, *map(element, range(70)), "</graph></graphml>"]
    for part, at in enumerate(range(0, len(lines), 18)):
        (tmp_path / f"part-{part}.txt").write_text("\n".join(lines[at : at + 18]) + "\n")
    nodes, edges = files.read_graphml(spark, f"file://{tmp_path}")
    assert sorted((r.node_id, r.x) for r in nodes.collect()) == sorted((str(i), f"{i}.5") for i in range(40))
    assert sorted((r.u, r.v, r.name) for r in edges.collect()) == sorted((str(i), str(i + 1), f"A &lt; {i + 40}") for i in range(30))


def test_small_slices_of_a_json_array_read_little_and_share_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text("[" + ",".join(json.dumps({"i": i, "t": "x" * 60}) for i in range(4000)) + "]")
    rows = json_array.read(spark, f"file://{tmp_path}/a.json", "i long, t string", slice_bytes=256)
    assert sorted(r.i for r in rows.select("i").collect()) == list(range(4000))
    assert rows.rdd.getNumPartitions() <= max(4, 4 * spark.sparkContext.defaultParallelism)

    class File:
        data, read = (tmp_path / "a.json").read_bytes(), 0

        def size(self):
            return len(self.data)

        def read_at(self, n, at):
            File.read += len(self.data[at : at + n])
            return self.data[at : at + n]

    marks = json_array.Marks(File(), 1, 257, json_array.OUTSIDE, 1, 256)
    assert len(list(json_array.elements(marks, 1, 0, 257, 1))) == 4 and File.read <= 1024


def test_candidate_sets_are_written_where_they_are_made(spark, tmp_path):
    """The sets of a fix stay in their partition and order, and their files are compressed; a fix without candidates has an empty one."""
    near = "array<struct<dist:double,u:long,v:long,k:int,px:double,py:double,arc:double,speed_limit:int,bearing:double,is_tunnel:string,layer:int,line_length:double>>"
    one = lambda i, u: (float(i), u, u + 1, 0, 1.5, 2.5, 3.5, 60, 90.0, "no", 0, 50.0)
    rows = [(i, "2024-01-01 00:00:00", None, None, None) if i % 5 == 0 else (i, "2024-01-01 00:00:00", 1.0, 2.0, [one(i, 9), one(i, 3)]) for i in range(40)]
    files.write_candidates(spark.createDataFrame(rows, f"event_id long, timestamp string, x double, y double, near {near}").repartition(3), f"file://{tmp_path}/sets")
    assert len(list((tmp_path / "sets").glob("part-*.json.gz"))) == 3
    got = sorted((r.event_id, r.candidate_index, r.edge_id, r.dist_m, r.edge_offset_m) for r in files.read_candidate_lines(spark, f"file://{tmp_path}/sets").collect() if r.edge_id)
    assert got == [(i, at, [str(u), str(u + 1), "0"], float(i), 3.5) for i in range(40) if i % 5 for at, u in enumerate((9, 3))]
    assert sorted(r.event_id for r in files.read_candidate_lines(spark, f"file://{tmp_path}/sets").where("edge_id is null").collect()) == list(range(0, 40, 5))

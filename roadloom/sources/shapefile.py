"""Shapefiles as a Spark data source: read in slices of records, written as one file set a partition.

    spark.dataSource.register(ShapefileSource)
    spark.read.format("shapefile").load(folder)          # or one .shp
    df.write.format("shapefile").mode("append").save(folder)

A slice reads its part of the index (.shx), which tells the bytes of its records in the .shp, and its rows of the table (.dbf), whose records all
have one length; no task reads a whole file. Columns: record (the number in its file, from 0), shape (the type's code), lines (parts of points;
one point is one part of one point; null for a null shape), and the table's columns. Records marked as deleted in the table are left out.
Text is in the code page that the .cpg names, UTF-8 without one.

A folder that this source wrote counts by its lists of files that were committed; any other by its .shp files. Tables are of one form in a folder.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: Fixed values of the format: shape codes, header and record sizes, field types.
NULL, POINT, LINE, POLYGON = 0, 1, 3, 5
HEADER, INDEX_ROW, DBF_HEADER, DBF_FIELD = 100, 8, 32, 32
LISTS = "_committed"
_POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])
SHAPE = [StructField("record", LongType()), StructField("shape", IntegerType()), StructField("lines", ArrayType(ArrayType(_POINT)))]
#: Widths of written fields: text, whole numbers, numbers.
WIDTHS = {StringType: (b"C", 254), LongType: (b"N", 20), IntegerType: (b"N", 11), DoubleType: (b"F", 25), BooleanType: (b"L", 1)}


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The .shp files of a path, in order."""
    where, at = _at(path)
    if where.get_file_info(at).type == fs.FileType.File:
        return [at]
    found = [i.path for i in where.get_file_info(fs.FileSelector(at))]
    lists = [f for f in found if f.rsplit("/", 1)[-1].startswith(LISTS)]
    if lists:
        names = []
        for f in lists:
            with where.open_input_stream(f) as s:
                names += json.loads(s.read())
        return sorted(f"{at.rstrip('/')}/{n}" for n in names)
    return sorted(f for f in found if f.lower().endswith(".shp"))


def _read(where: fs.FileSystem, path: str, start: int, size: int) -> bytes:
    with where.open_input_file(path) as f:
        return f.read_at(size, start)


def _beside(where: fs.FileSystem, shp: str, end: str) -> str:
    """The companion of a .shp, its ending in small or capital letters."""
    path = shp[:-4] + end
    return path if where.get_file_info(path).type == fs.FileType.File else shp[:-4] + end.upper()


@dataclass
class Field:
    name: str
    kind: str
    size: int
    decimals: int

    @property
    def type(self):
        if self.kind in "NF":
            return LongType() if self.kind == "N" and not self.decimals else DoubleType()
        return BooleanType() if self.kind == "L" else StringType()

    def value(self, raw: bytes, page: str):
        text = raw.decode(page, "replace").rstrip(" \0")
        if self.kind in "NF":
            text = text.strip()
            if not text or text.strip("*") == "":
                return None
            return int(text) if isinstance(self.type, LongType) and text.lstrip("+-").isdigit() else float(text) if not isinstance(self.type, LongType) else int(float(text))
        if self.kind == "L":
            return {"T": True, "Y": True, "F": False, "N": False}.get(text.strip().upper())
        return text or None


def _table(where: fs.FileSystem, dbf: str) -> tuple[int, int, int, list[Field]]:
    """(records, bytes before them, bytes of each, fields)."""
    head = _read(where, dbf, 0, DBF_HEADER)
    n, start, size = struct.unpack("<IHH", head[4:12])
    raw, fields = _read(where, dbf, DBF_HEADER, start - DBF_HEADER), []
    for i in range(0, len(raw) - DBF_FIELD + 1, DBF_FIELD):
        if raw[i] == 0x0D:
            break
        fields.append(Field(raw[i : i + 11].split(b"\0")[0].decode(), chr(raw[i + 11]), raw[i + 16], raw[i + 17]))
    return n, start, size, fields


def _shape(content: bytes) -> tuple[int, list | None]:
    """(code, parts) of one record's content. Heights and measures, which follow the points, are not read."""
    (code,) = struct.unpack_from("<i", content)
    plain = code % 10
    if plain == NULL:
        return code, None
    if plain == POINT:
        return code, [[struct.unpack_from("<2d", content, 4)]]
    if plain == 8:  # several points, each a part
        (n,) = struct.unpack_from("<i", content, 36)
        return code, [[tuple(p)] for p in np.frombuffer(content, "<f8", 2 * n, 40).reshape(-1, 2).tolist()]
    parts, n = struct.unpack_from("<2i", content, 36)
    cuts = [*struct.unpack_from(f"<{parts}i", content, 44), n]
    points = [tuple(p) for p in np.frombuffer(content, "<f8", 2 * n, 44 + 4 * parts).reshape(-1, 2).tolist()]
    return code, [points[a:b] for a, b in zip(cuts, cuts[1:])]


@dataclass
class Slice(InputPartition):
    path: str
    first: int
    last: int


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, records: int):
        self.path, self.names, self.records = path, schema.names, records

    def partitions(self) -> list[Slice]:
        where, _ = _at(self.path)
        out = []
        for shp in _files(self.path):
            n = (where.get_file_info(_beside(where, shp, ".shx")).size - HEADER) // INDEX_ROW
            out += [Slice(shp, i, min(i + self.records, n)) for i in range(0, n, self.records)]
        return out

    def read(self, part: Slice | None) -> Iterator[tuple]:
        if part is None:
            return
        where, _ = _at(self.path)
        index = np.frombuffer(_read(where, _beside(where, part.path, ".shx"), HEADER + INDEX_ROW * part.first, INDEX_ROW * (part.last - part.first)), ">i4").reshape(-1, 2).astype(np.int64) * 2
        dbf = _beside(where, part.path, ".dbf")
        _, start, size, fields = _table(where, dbf)
        rows = _read(where, dbf, start + size * part.first, size * (part.last - part.first))
        cpg = where.get_file_info(_beside(where, part.path, ".cpg"))
        page = _read(where, cpg.path, 0, 64).decode().strip() if cpg.type == fs.FileType.File else "utf-8"
        wanted = [(f, at) for f, at in zip(fields, np.cumsum([1, *[f.size for f in fields]]).tolist())]
        with where.open_input_file(part.path) as f:
            for i, (offset, length) in enumerate(index.tolist()):
                row = rows[i * size : (i + 1) * size]
                if row[:1] == b"*":
                    continue
                code, lines = _shape(f.read_at(length, offset + 8))
                yield (part.first + i, code, lines, *(c.value(row[at : at + c.size], page) for c, at in wanted))


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ShapefileWriter(DataSourceWriter):
    """Each task writes files of its own name; a commit lists those that count."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema
        if "lines" not in schema.names:
            raise ValueError("a shapefile needs a column `lines`")
        self.columns = [f for f in schema if f.name not in ("record", "shape", "lines")]
        if bad := [f.name for f in self.columns if type(f.dataType) not in WIDTHS or len(f.name.encode()) > 10]:
            raise ValueError(f"names of at most ten bytes and plain values only: {bad}")

    def _text(self, value, field: StructField) -> bytes:
        _, size = WIDTHS[type(field.dataType)]
        if isinstance(field.dataType, BooleanType):
            return b"?" if value is None else b"T" if value else b"F"
        if value is None:
            return b" " * size
        raw = (value if isinstance(value, str) else repr(value)).encode()
        if len(raw) > size:
            raise ValueError(f"{field.name} holds {len(raw)} bytes, a shapefile {size}")
        return raw.ljust(size) if isinstance(value, str) else raw.rjust(size)

    def write(self, rows: Iterator) -> Written:
        where, at = _at(self.path)
        where.create_dir(at)
        name = f"part-{uuid.uuid4().hex}"
        shp, shx, dbf, n = bytearray(), bytearray(), bytearray(), 0
        low, high = np.full(2, np.inf), np.full(2, -np.inf)
        for row in rows:
            held = row.asDict()
            if lines := held["lines"]:
                points = np.array([[p["x"], p["y"]] for part in lines for p in part], dtype="<f8").reshape(-1, 2)
                low, high = np.minimum(low, points.min(axis=0)), np.maximum(high, points.max(axis=0))
                cuts = np.cumsum([0, *[len(p) for p in lines[:-1]]]).astype("<i4")
                content = struct.pack("<i4d2i", LINE, *points.min(axis=0), *points.max(axis=0), len(lines), len(points)) + cuts.tobytes() + points.tobytes()
            else:
                content = struct.pack("<i", NULL)
            shx += struct.pack(">2i", (HEADER + len(shp)) // 2, len(content) // 2)
            n += 1
            shp += struct.pack(">2i", n, len(content) // 2) + content
            dbf += b" " + b"".join(self._text(held[f.name], f) for f in self.columns)
        box = (*low, *high) if n and np.isfinite(low).all() else (0.0,) * 4

        def head(size: int) -> bytes:
            return struct.pack(">i20x", 9994) + struct.pack(">i", (HEADER + size) // 2) + struct.pack("<2i8d", 1000, LINE, *box, 0, 0, 0, 0)

        fields = b"".join(struct.pack("<11sc4xBB14x", f.name.encode(), kind, size, 0) for f in self.columns for kind, size in [WIDTHS[type(f.dataType)]])
        table = struct.pack("<B3BIHH20x", 3, 126, 1, 1, n, DBF_HEADER + len(fields) + 1, 1 + sum(WIDTHS[type(f.dataType)][1] for f in self.columns)) + fields + b"\r"
        for end, data in ((".shp", head(len(shp)) + shp), (".shx", head(len(shx)) + shx), (".dbf", table + dbf + b"\x1a"), (".cpg", b"UTF-8")):
            with where.open_output_stream(f"{at.rstrip('/')}/{name}{end}") as f:
                f.write(bytes(data))
        return Written([f"{name}.shp"])

    def commit(self, messages: list[Written | None]) -> None:
        where, at = _at(self.path)
        where.create_dir(at)
        with where.open_output_stream(f"{at.rstrip('/')}/{LISTS}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files that no list names do not count."""


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> StructType:
        where, _ = _at(self.options["path"])
        files = _files(self.options["path"])
        fields = _table(where, _beside(where, files[0], ".dbf"))[3] if files else []
        return StructType([*SHAPE, *[StructField(f.name, f.type) for f in fields]])

    def reader(self, schema: StructType) -> ShapefileReader:
        return ShapefileReader(self.options["path"], schema, int(self.options.get("records", 100_000)))

    def writer(self, schema: StructType, overwrite: bool) -> ShapefileWriter:
        if overwrite:
            raise ValueError("shapefiles are only appended to a folder")
        return ShapefileWriter(self.options["path"], schema)

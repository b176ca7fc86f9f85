"""JSON files of one long array, read in slices of bytes.

A slice cannot know by itself whether it starts inside a text, or how deep. So each slice first tells, for either way that it may start, how it
ends and by how much the depth changes; these few numbers of each slice are summed up in order, which gives every slice its true
start. Then each slice reads the elements that begin in it, the last one beyond its end if need be. An array that is a member of the
file's one object (`features` of a collection) is found in between: the slice that holds the member's name tells where it begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ways to be: outside a text, inside one, inside one after a backslash.
OUTSIDE, TEXT, ESCAPED = 0, 1, 2
_WHOLE = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
_REST = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*', re.DOTALL)
_MARKS = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"|["\[\]{},]', re.DOTALL)


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _after_text(data: bytes, state: int) -> int:
    """Where the text that the data starts in has ended; beyond the data where it has not."""
    if state == OUTSIDE:
        return 0
    end = _REST.match(data, 1 if state == ESCAPED else 0).end() if len(data) >= state - 1 else 0
    return end + 1 if end < len(data) and data[end : end + 1] == b'"' else len(data) + 1


def crossed(data: bytes, state: int) -> tuple[int, int]:
    """(state at the end, change of depth) of data that starts in a state."""
    if not data:
        return state, 0
    start = _after_text(data, state)
    if start > len(data):
        tail = data[1:] if state == ESCAPED else data
        slashes = len(tail) - len(tail.rstrip(b"\\"))
        return (ESCAPED if slashes % 2 else TEXT), 0
    plain = _WHOLE.sub(b"", data[start:])
    cut = plain.find(b'"')
    state = OUTSIDE
    if cut >= 0:
        tail, plain = plain[cut + 1 :], plain[:cut]
        state = ESCAPED if (len(tail) - len(tail.rstrip(b"\\"))) % 2 else TEXT
    return state, plain.count(b"[") + plain.count(b"{") - plain.count(b"]") - plain.count(b"}")


class Marks:
    """Marks of a file from an offset on: (offset, mark, depth before it), texts as a whole; more of the file is read as it is asked for, twice as much each time."""

    def __init__(self, f, start: int, end: int, state: int, depth: int, more: int = 1 << 20):
        self.f, self.base, self.depth, self.more = f, start, depth, more
        self.data = f.read_at(end - start, start)
        self.size = f.size()
        while (skip := _after_text(self.data, state)) > len(self.data) and self._grow():
            pass
        self.pos = skip

    def _grow(self) -> bool:
        new = self.f.read_at(min(self.more, self.size - self.base - len(self.data)), self.base + len(self.data))
        self.data += new
        self.more = max(self.more, min(2 * self.more, 1 << 20))
        return bool(new)

    def __iter__(self) -> Iterator[tuple[int, bytes, int]]:
        while True:
            m = _MARKS.search(self.data, self.pos)
            if m is None or m.group() == b'"':  # a text that goes on beyond what has been read
                if m is not None:
                    self.pos = m.start()
                if not self._grow():
                    return
                continue
            self.pos = m.end()
            mark = m.group()
            yield self.base + m.start(), mark, self.depth
            self.depth += (mark in (b"[", b"{")) - (mark in (b"]", b"}"))

    def text(self, start: int, end: int) -> bytes:
        return self.data[start - self.base : end - self.base]


def array_start(marks: Marks, end: int, member: str | None) -> int | None:
    """Offset after the bracket that opens the array, if that, or the member's name before it, lies before `end`."""
    named = False
    for at, mark, depth in marks:
        if at >= end and not named:
            return None
        if member is None:
            return at + 1 if mark == b"[" and depth == 0 else None
        if named and mark == b"[" and depth == 1:
            return at + 1
        named = depth == 1 and mark == f'"{member}"'.encode() and marks_colon(marks, at + len(mark))
    return None


def marks_colon(marks: Marks, at: int) -> bool:
    """Whether a colon follows: a name, not a value."""
    while not (rest := marks.text(at, at + 64).lstrip()) and marks._grow():
        pass
    return rest.startswith(b":")


def elements(marks: Marks, first: int, start: int, end: int, depth: int) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of the elements of an array that begins at `first`, `depth` deep, whose border before them (a bracket or comma) lies from `start` on and before `end`."""
    begin = first if start < first <= end else None
    for at, mark, own in marks:
        if at < first or own > depth or mark not in (b",", b"]"):
            continue
        if begin is not None and (text := marks.text(begin, at).strip()):
            yield begin, text
        if mark == b"]" or at >= end:
            return
        begin = at + 1


def read(spark: SparkSession, path: str, schema: str, member: str | None = None, slice_bytes: int = 32 << 20) -> DataFrame:
    """One row an element of the arrays in a file or folder: source_file, at (its offset there) and the fields of the schema (DDL).

    member: the array is this member of the file's object. Elements that are no objects, or do not fit the schema, give null fields, as `from_json` does.
    """
    where, root = _at(path)
    info = where.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else [i for i in where.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]
    slices = [(f.path, a, min(a + slice_bytes, f.size)) for f in sorted(found, key=lambda f: f.path) for a in range(0, f.size, slice_bytes)]
    uri = path
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def run(todo: list[tuple], columns: str, work, out: str) -> DataFrame:
        """work(open file, *row) for each row; neighbours share a task where there are more rows than `tasks`."""
        names = [c.split(" ")[0] for c in out.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}

        def each(batches):
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    store, _ = _at(uri)
                    with store.open_input_file(row[0]) as f:
                        rows = []
                        for r in work(f, *row):
                            rows.append((row[0], *r))
                            if len(rows) == 5000:
                                yield batch(rows)
                                rows = []
                        yield batch(rows)

        def batch(rows):
            columns = zip(*rows) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, kinds[k.split(" ")[1]]) for c, k in zip(columns, out.split(", "))], names)

        todo_df = spark.createDataFrame(todo, columns).repartitionByRange(min(len(todo), tasks), "file", "a") if todo else spark.createDataFrame([], columns)
        return todo_df.mapInArrow(each, out)

    def cross(f, _, a, b):
        data = f.read_at(b - a, a)
        yield (a, b, *(x for s in (OUTSIDE, TEXT, ESCAPED) for x in crossed(data, s)))

    told = run(slices, "file string, a long, b long", cross, "file string, a long, b long, s0 int, d0 long, s1 int, d1 long, s2 int, d2 long").collect()
    entry, now = {}, None
    for r in sorted(told, key=lambda r: (r.file, r.a)):
        state, depth = (OUTSIDE, 0) if r.file != now else (state, depth)
        now = r.file
        entry[r.file, r.a] = (r.file, r.a, r.b, state, depth)
        state, depth = r[3 + 2 * state], depth + r[4 + 2 * state]
    placed = [e for e in entry.values() if e[4] <= (1 if member else 0)]

    def locate(f, _, a, b, state, depth):
        at = array_start(Marks(f, a, b, state, depth, 1 << 16), b, member)
        if at is not None:
            yield (at,)

    starts: dict[str, int] = {}
    for r in run(placed, "file string, a long, b long, state int, depth long", locate, "file string, at long").collect():
        starts[r.file] = min(r["at"], starts.get(r.file, r["at"]))
    inner = 2 if member else 1
    wanted = [(*e, starts[e[0]]) for e in entry.values() if e[0] in starts and e[2] >= starts[e[0]]]

    def parse(f, _, a, b, state, depth, first):
        for at, text in elements(Marks(f, a, b, state, depth, b - a), first, a, b, inner):
            yield at, text.decode()

    rows = run(wanted, "file string, a long, b long, state int, depth long, first long", parse, "file string, at long, element string")
    return rows.select(F.element_at(F.split("file", "/"), -1).alias("source_file"), "at", F.from_json("element", schema).alias("e")).select("source_file", "at", "e.*")


def write(df: DataFrame, path: str) -> None:
    """A folder of files of one array each, with an element a row."""

    def arrays(batches):
        held, first = None, True
        for b in batches:
            texts = b.column(0).to_pylist()
            out = ["["] if first and texts else []
            for t in texts:
                if held is not None:
                    out.append(held + ",")
                held, first = t, False
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[", "]"] if first else [held, "]"], pa.string())], ["value"])

    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(arrays, "value string").write.text(path)

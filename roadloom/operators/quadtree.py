"""A quadtree of the plane whose cells are split by counts, and nearest edges found by descending it.

Cells are numbered along a Morton curve. A cell is split while it holds more than its share of all places, so the number of
cells is bounded by the share and the depth, whatever the table: a tree is some hundred kilobytes and is broadcast.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.scalars import d
from roadloom.sources.shared import stored

#: A cell is split while it holds more than one part in SHARE of all places, and more than LEAST of them.
SHARE, LEAST, DEPTH = 1024, 20_000, 20
#: Places that go down a tree at once.
AT_ONCE = 500
EDGE = ("u", "v", "k")
PIECE = ["u", "v", "k", "piece", "x0", "y0", "x1", "y1", "offset", "len"]


class Quadtree:
    """Cells as arrays: corner, side, place of the first of four children (0 for a leaf) and number among the leaves."""

    def __init__(self, x: float, y: float, side: float, inner: set[tuple[int, int]], depth: int = DEPTH):
        self.origin, self.side, self.depth = np.array([x, y]), side, depth
        cells, child, i = [(0, 0, x, y)], [], 0
        while i < len(cells):
            level, code, cx, cy = cells[i]
            if (level, code) in inner:
                child.append(len(cells))
                half = side / 2 ** (level + 1)
                cells += [(level + 1, code << 2 | q, cx + half * (q & 1), cy + half * (q >> 1)) for q in range(4)]
            else:
                child.append(0)
            i += 1
        self.child = np.array(child)
        level, code = np.array([c[0] for c in cells]), np.array([c[1] for c in cells], dtype=np.int64)
        self.low = np.array([c[2:] for c in cells], dtype=float)
        self.high = self.low + (side / 2.0**level)[:, None]
        leaves = np.flatnonzero(self.child == 0)
        starts = code[leaves] << 2 * (depth - level[leaves])
        self.leaves = leaves[np.argsort(starts)]
        self.starts = np.sort(starts)
        self.leaf_number = np.full(len(cells), -1)
        self.leaf_number[self.leaves] = np.arange(len(leaves))

    def __len__(self) -> int:
        return len(self.leaves)

    def clamped(self, places: np.ndarray) -> np.ndarray:
        return np.clip(places, self.origin, self.origin + self.side)

    def leaf_of(self, places: np.ndarray) -> np.ndarray:
        """Leaf of each place (x, y); a place outside belongs to the leaf of the nearest place inside."""
        at = np.clip(np.floor((places - self.origin) / self.side * 2**self.depth), 0, 2**self.depth - 1).astype(np.int64)
        code = np.zeros(len(at), np.int64)
        for bit in range(self.depth):
            code |= (at[:, 0] >> bit & 1) << 2 * bit | (at[:, 1] >> bit & 1) << 2 * bit + 1
        return np.searchsorted(self.starts, code, "right") - 1

    def touched(self, low: np.ndarray, high: np.ndarray, grown: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) wherever a row's box meets a leaf that is grown by `grown` of its side; boxes outside meet the leaves that face them."""
        low, high = self.clamped(low), self.clamped(high)
        row, cell, rows, leaves = np.arange(len(low)), np.zeros(len(low), np.int64), [], []
        while len(row):
            edge = (self.high[cell] - self.low[cell]) * grown
            meets = ((low[row] <= self.high[cell] + edge) & (high[row] >= self.low[cell] - edge)).all(axis=1)
            row, cell = row[meets], cell[meets]
            leaf = self.child[cell] == 0
            rows.append(row[leaf])
            leaves.append(self.leaf_number[cell[leaf]])
            row, cell = np.repeat(row[~leaf], 4), (self.child[cell[~leaf]][:, None] + np.arange(4)).ravel()
        return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(leaves or [np.zeros(0, int)])


def _spread(v: Column) -> Column:
    """The bits of v at every second place."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _code(x: Column, y: Column, origin: tuple[float, float], side: float, depth: int) -> Column:
    at = [F.least(F.greatest(F.floor((c - d(o)) / d(side) * d(2**depth)), F.lit(0)), F.lit(2**depth - 1)).cast("long") for c, o in ((x, origin[0]), (y, origin[1]))]
    return _spread(at[0]).bitwiseOR(F.shiftleft(_spread(at[1]), 1))


def split(places: DataFrame, x: Column, y: Column, share: int = SHARE, least: int = LEAST, depth: int = DEPTH) -> Quadtree | None:
    """The tree of a table of places; None for none. Only cells that are split come to the driver, `share` a level at most."""
    held = places.select(x.cast("double").alias("x"), y.cast("double").alias("y")).where("x is not null and y is not null")
    n, x0, y0, x1, y1 = held.agg(F.count("*"), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if not n:
        return None
    side, most = max(x1 - x0, y1 - y0, 1e-6), max(least, n // share)
    if n <= most:
        return Quadtree(x0, y0, side, set(), depth)
    finest = held.groupBy(_code(F.col("x"), F.col("y"), (x0, y0), side, depth).alias("code")).agg(F.count("*").alias("n"))
    above = F.explode(F.expr(f"transform(sequence(0, {depth - 1}), l -> struct(l as level, shiftrightunsigned(code, cast(2 * ({depth} - l) as int)) as code))"))
    crowded = finest.select(above.alias("c"), "n").groupBy("c.level", "c.code").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    return Quadtree(x0, y0, side, {(r[0], r[1]) for r in crowded.select("level", "code").collect()}, depth)


def local_tree(places: np.ndarray, most: int = 8, depth: int = 24) -> Quadtree:
    """The tree of places in one task's memory."""
    low = places.min(axis=0)
    side = max(float((places.max(axis=0) - low).max()), 1e-6)
    at = np.clip(np.floor((places - low) / side * 2**depth), 0, 2**depth - 1).astype(np.int64)
    code = np.zeros(len(at), np.int64)
    for bit in range(depth):
        code |= (at[:, 0] >> bit & 1) << 2 * bit | (at[:, 1] >> bit & 1) << 2 * bit + 1
    inner, left = set(), code
    for level in range(depth):
        cells, back, n = np.unique(left >> 2 * (depth - level), return_inverse=True, return_counts=True)
        crowded = n > most
        if not crowded.any():
            break
        inner |= {(level, int(c)) for c in cells[crowded]}
        left = left[crowded[back]]
    return Quadtree(*low, side, inner, depth)


class Boxes:
    """The tree's cells with the box and the number of what lies in them, for descents from the nearest box on, or of many places together."""

    def __init__(self, tree: Quadtree, leaf: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray):
        """leaf, box and count of rows that are summed into the cells above."""
        self.tree = tree
        cells = len(tree.child)
        self.low, self.high, self.count = np.full((cells, 2), np.inf), np.full((cells, 2), -np.inf), np.zeros(cells, np.int64)
        at = tree.leaves[leaf]
        np.minimum.at(self.low, at, low)
        np.maximum.at(self.high, at, high)
        np.add.at(self.count, at, count)
        for cell in range(cells - 1, -1, -1):  # children come after their cell
            if c := tree.child[cell]:
                self.low[cell], self.high[cell] = self.low[c : c + 4].min(axis=0), self.high[c : c + 4].max(axis=0)
                self.count[cell] = self.count[c : c + 4].sum()
        self.held = np.isfinite(self.low[:, 0])  # a cell can hold pieces without any edge's first

    def _near(self, cells, x: float, y: float) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low[cells] - (x, y), (x, y) - self.high[cells]), 0)
        return np.hypot(gap[..., 0], gap[..., 1])

    def descend(self, x: float, y: float, bound):
        """Leaves in order of their boxes' distance, while that is within bound(), which what is found may lower."""
        heap = [(0.0, 0)] if self.held[0] else []
        while heap:
            near, cell = heapq.heappop(heap)
            if near > bound():
                return
            c = int(self.tree.child[cell])
            if not c:
                yield int(self.tree.leaf_number[cell]), cell
                continue
            four = [i for i in range(c, c + 4) if self.held[i]]
            for i, n in zip(four, self._near(four, x, y)):
                if n <= bound():
                    heapq.heappush(heap, (float(n), i))

    def reached(self, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, distance of the leaf's box) of the leaves that can hold one of the k nearest of each place: no farther than the least distance within which k are certain.

        All places go down the tree together, a level a step; what is beyond a place's bound is left out at every level.
        """
        start = len(places) if self.held[0] else 0
        row, cell, bound = np.arange(start), np.zeros(start, np.int64), np.full(len(places), np.inf)
        while True:
            inner = self.tree.child[cell] > 0
            below = (self.tree.child[cell[inner]][:, None] + np.arange(4)).ravel()
            row, cell = np.concatenate([row[~inner], np.repeat(row[inner], 4)]), np.concatenate([cell[~inner], below])
            held = self.held[cell]
            row, cell = row[held], cell[held]
            at = places[row]
            near = np.hypot(*np.maximum(np.maximum(self.low[cell] - at, at - self.high[cell]), 0).T)
            far = np.hypot(*np.maximum(np.abs(self.low[cell] - at), np.abs(self.high[cell] - at)).T)
            order = np.lexsort((far, row))
            certain = _running(row[order], self.count[cell[order]]) >= k
            np.minimum.at(bound, row[order][certain], far[order][certain])
            close = near <= bound[row]
            row, cell, near = row[close], cell[close], near[close]
            if not inner.any():
                return row, self.tree.leaf_number[cell], near


def _running(row: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Running sums of n that start again with each row; rows lie together."""
    total = np.cumsum(n)
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, int)
    return total - np.repeat(total[first] - n[first], np.diff(np.append(first, len(row))))


class Pieces:
    """Straight pieces of edges in one task, in a tree of their own. `measured` counts the pieces that searches looked at."""

    def __init__(self, p: pd.DataFrame):
        p = p.sort_values(["u", "v", "k", "piece"], kind="stable")
        self.a, self.b = p[["x0", "y0"]].to_numpy(float), p[["x1", "y1"]].to_numpy(float)
        self.offset, self.length = p["offset"].to_numpy(float), p["len"].to_numpy(float)
        self.id = p[["u", "v", "k"]].to_numpy()
        self.edge = p.groupby(["u", "v", "k"]).ngroup().to_numpy()
        self.measured = 0
        new = np.concatenate(([True], self.edge[1:] != self.edge[:-1]))  # an edge counts where its first piece lies
        tree = local_tree((self.a + self.b) / 2)
        leaf = tree.leaf_of((self.a + self.b) / 2)
        self.order = np.argsort(leaf, kind="stable")
        self.ends = np.searchsorted(leaf[self.order], np.arange(len(tree) + 1))
        self.rows = np.split(self.order, self.ends[1:-1])
        self.boxes = Boxes(tree, leaf, np.minimum(self.a, self.b), np.maximum(self.a, self.b), new.astype(int))

    def nearest(self, x: float, y: float, k: int) -> list[tuple]:
        """(u, v, k, px, py, arc, dist) of the k nearest edges and of all that are as near as the last of them."""
        best: dict[int, tuple] = {}
        least = float("inf")

        def bound() -> float:
            return least

        for leaf, _ in self.boxes.descend(x, y, bound):
            at = self.rows[leaf]
            self.measured += len(at)
            a, v = self.a[at], self.b[at] - self.a[at]
            n = (v * v).sum(axis=1)
            t = np.clip(((np.array([x, y]) - a) * v).sum(axis=1) / np.where(n > 0, n, 1), 0, 1)
            q = a + t[:, None] * v
            dist = np.hypot(q[:, 0] - x, q[:, 1] - y)
            for i, r, s, p in zip(at.tolist(), dist.tolist(), t.tolist(), q.tolist()):
                e = int(self.edge[i])
                if e not in best or (r, i) < best[e][:2]:
                    best[e] = (r, i, s, p)
            if len(best) >= k:
                least = sorted(f[0] for f in best.values())[k - 1]
        return [(*self.id[i].tolist(), *p, float(self.offset[i] + s * self.length[i]), r) for r, i, s, p in best.values() if r <= least]

    def _measured(self, places: np.ndarray, row: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, piece, distance, share of the piece, x, y) of the pieces in the leaves that each row reaches."""
        sizes = self.ends[leaf + 1] - self.ends[leaf]
        of = np.repeat(row, sizes)
        piece = self.order[np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes - self.ends[leaf], sizes)]
        self.measured += len(of)
        a, v = self.a[piece], self.b[piece] - self.a[piece]
        n = (v * v).sum(axis=1)
        t = np.clip(((places[of] - a) * v).sum(axis=1) / np.where(n > 0, n, 1), 0, 1)
        q = a + t[:, None] * v
        return of, piece, np.hypot(q[:, 0] - places[of, 0], q[:, 1] - places[of, 1]), t, q[:, 0], q[:, 1]

    def _best(self, found: tuple[np.ndarray, ...], rows: int, k: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """What is found of each row and edge at its nearest piece, by row and distance, and each row's k-th distance."""
        order = np.lexsort((found[1], found[2], self.edge[found[1]], found[0]))
        row, edge = found[0][order], self.edge[found[1][order]]
        order = order[np.concatenate(([True], (row[1:] != row[:-1]) | (edge[1:] != edge[:-1])))] if len(order) else order
        order = order[np.lexsort((found[2][order], found[0][order]))]
        found, least = tuple(c[order] for c in found), np.full(rows, np.inf)
        kth = _running(found[0], np.ones(len(order), int)) == k
        least[found[0][kth]] = found[2][kth]
        return found, least

    def nearest_of_all(self, places: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """`nearest` of many places at once: (row, u, v, k, px, py, arc, dist).

        Every place is measured against its nearest leaves with k edges first; of the others only those count that are no farther than the k-th edge found there.
        """
        row, leaf, near = self.boxes.reached(places, k)
        order = np.lexsort((near, row))
        row, leaf, near = row[order], leaf[order], near[order]
        n = self.boxes.count[self.boxes.tree.leaves[leaf]]
        first = _running(row, n) - n < k
        found = self._measured(places, row[first], leaf[first])
        _, least = self._best(found, len(places), k)
        more = ~first & (near <= least[row])
        rest = self._measured(places, row[more], leaf[more])
        found, least = self._best(tuple(np.concatenate(c) for c in zip(found, rest)), len(places), k)
        row, piece, dist, t, px, py = (c[found[2] <= least[found[0]]] for c in found)
        return row, *self.id[piece].T, px, py, self.offset[piece] + t * self.length[piece], dist


def dealt(work: DataFrame, tree_rows: DataFrame, by: str, per_task: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with a column `part`: the rows of work of one `by` in parts of about per_task, the rows of the other once for each part.

    Only rows of cells where there is work are kept. Parts are told by counts alone, so that no cell is one task.
    """
    parts = work.groupBy(by).agg(F.ceil(F.count("*") / F.lit(per_task)).cast("int").alias("parts"))
    spread = work.join(F.broadcast(parts), by).withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "parts").cast("int")).drop("parts")
    copies = tree_rows.join(F.broadcast(parts), by).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return spread, copies


def nearest_edges(fixes: DataFrame, pieces: DataFrame, k: int, x: str = "obs_x", y: str = "obs_y", key: str = "event_id", share: int = SHARE, least: int = LEAST, per_task: int = 50_000) -> DataFrame:
    """fixes with each one's k nearest edges (u, v, k, px, py, arc, dist, rank), wherever they are; rank goes by distance and edge.

    Pieces lie in the leaves of a tree split by their counts. Fixes go down it together, but for boxes beyond the distance within which k edges
    are certain; in each leaf that a fix reaches, it goes down the leaf's own tree in the same way, so that it is measured against
    a few pieces more than k, whatever the network. Fixes of one leaf are dealt over tasks.
    Fixes that repeat key and place are one fix; those without a position have no rows.
    """
    spark = fixes.sparkSession
    tree = split(pieces, (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, share, least)
    places = fixes.where(f"{x} is not null and {y} is not null").select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).distinct()
    found_schema = f"id {dict(fixes.dtypes)[key]}, x double, y double, u {dict(pieces.dtypes)['u']}, v {dict(pieces.dtypes)['v']}, k {dict(pieces.dtypes)['k']}, px double, py double, arc double, dist double"
    if tree is None:
        none = spark.createDataFrame([], found_schema + ", rank int")
        return _named(fixes, none, key, x, y)
    held = spark.sparkContext.broadcast(tree)

    @F.pandas_udf("int")
    def leaf_of(px: pd.Series, py: pd.Series) -> pd.Series:
        return pd.Series(held.value.leaf_of(np.column_stack([px, py])).astype(np.int32))

    laid = stored(pieces.select(*PIECE).withColumn("leaf", leaf_of((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)), "tree-pieces")
    # Boxes and counts of the leaves, as many rows as the tree has leaves. An edge counts where its first piece lies.
    sums = laid.groupBy("leaf").agg(*[f(g(f"{c}0", f"{c}1")).alias(n) for c in "xy" for f, g, n in ((F.min, F.least, f"{c}a"), (F.max, F.greatest, f"{c}b"))], F.count_if(F.col("piece") == 0).alias("edges")).toPandas()
    boxes = spark.sparkContext.broadcast(Boxes(tree, sums["leaf"].to_numpy(), sums[["xa", "ya"]].to_numpy(), sums[["xb", "yb"]].to_numpy(), sums["edges"].to_numpy()))

    @F.pandas_udf("array<int>")
    def leaves_for(px: pd.Series, py: pd.Series) -> pd.Series:
        places, out = np.column_stack([px, py]).astype(float).reshape(-1, 2), []
        for i in range(0, len(places), AT_ONCE):
            some = places[i : i + AT_ONCE]
            row, leaf, _ = boxes.value.reached(some, k)
            order = np.argsort(row, kind="stable")
            out += np.split(leaf[order], np.searchsorted(row[order], np.arange(1, len(some))))
        return pd.Series(out, dtype=object)

    asked = stored(places.withColumn("leaf", F.explode(leaves_for("x", "y"))), "tree-asked")
    spread, copies = dealt(asked, laid, "leaf", per_task)
    rows = copies.unionByName(spread.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    rows = rows.repartition("leaf", "part").sortWithinPartitions("leaf", "part", F.asc_nulls_first("asks"))

    def search(batches):
        now, own, table = None, [], None
        for b in batches:
            cell = list(zip(b.column("leaf").to_pylist(), b.column("part").to_pylist()))
            cuts = [0, *[i for i in range(1, len(cell)) if cell[i] != cell[i - 1]], len(cell)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if cell[i] != now:
                    now, own, table = cell[i], [], None
                part = b.slice(i, j - i)
                n = part.column("asks").null_count
                if n:
                    own.append(part.slice(0, n).select(PIECE).to_pandas())
                if n == len(part):
                    continue
                if table is None:
                    table, own = Pieces(pd.concat(own)), []
                asks = part.slice(n)
                for at in range(0, len(asks), AT_ONCE):
                    some = asks.slice(at, AT_ONCE)
                    row, *out = table.nearest_of_all(np.column_stack([some.column(c).to_numpy() for c in ("x", "y")]), k)
                    told = some.select(["id", "x", "y"]).take(pa.array(row))
                    kinds = [*(some.schema.field(c).type for c in EDGE), *[pa.float64()] * 4]
                    yield pa.RecordBatch.from_arrays([*told.columns, *(pa.array(c).cast(t) for c, t in zip(out, kinds))], ["id", "x", "y", *EDGE, "px", "py", "arc", "dist"])

    found = rows.mapInArrow(search, found_schema)
    # An edge with pieces in several leaves counts by its nearest.
    best = found.groupBy("id", "x", "y", *EDGE).agg(F.min_by(F.struct("px", "py", "arc", "dist"), F.struct("dist", "arc")).alias("b")).select("id", "x", "y", *EDGE, "b.*")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("id", "x", "y").orderBy("dist", *EDGE))).where(F.col("rank") <= k)
    return _named(fixes, ranked, key, x, y)


def _named(fixes: DataFrame, ranked: DataFrame, key: str, x: str, y: str) -> DataFrame:
    found = ranked.withColumnsRenamed({"id": "__id", "x": "__x", "y": "__y"})
    same = fixes[key].eqNullSafe(found["__id"]) & (fixes[x] == found["__x"]) & (fixes[y] == found["__y"])
    return fixes.join(found, same).select(*[fixes[c] for c in fixes.columns], *EDGE, "px", "py", "arc", "dist", "rank")

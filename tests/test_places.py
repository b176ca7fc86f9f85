"""The quadtree, nearest edges and the level filter against plain searches over the whole network."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadloom.operators import geo, levels, quadtree

RNG = np.random.default_rng(8)
PIECES = "u long, v long, k int, x0 double, y0 double, x1 double, y1 double, layer int, below boolean"


def bent_edges(n, size=4000.0):
    """Edges of one to three pieces, most of them in one corner."""
    rows = []
    for i in range(n):
        low = RNG.random(2) * (size / 40 if i % 3 else size)
        at = [low, *(low + np.cumsum(RNG.normal(0, 40, (RNG.integers(1, 4), 2)), axis=0))]
        rows.append((i, i + 1, int(i % 2), [tuple(map(float, p)) for p in at]))
    return rows


def pieces_of(spark, edges):
    return geo.segments(spark.createDataFrame(edges, "u long, v long, k int, points array<struct<x:double,y:double>>"))


def measured(x, y, x0, y0, x1, y1):
    vx, vy = x1 - x0, y1 - y0
    n = vx * vx + vy * vy
    t = min(max(((x - x0) * vx + (y - y0) * vy) / n, 0), 1) if n else 0.0
    return float(np.hypot(x0 + t * vx - x, y0 + t * vy - y)), (x0 + t * vx, y0 + t * vy)


def nearest(edges, x, y, k):
    out = []
    for u, v, key, at in edges:
        out.append((min(measured(x, y, *p, *q)[0] for p, q in zip(at, at[1:])), u, v, key))
    return sorted(out)[:k]


@pytest.mark.parametrize(("least", "per_task"), [(20_000, 50_000), (20, 7)])
def test_nearest_edges_of_places_anywhere(spark, least, per_task):
    edges = bent_edges(400)
    places = [(i, *map(float, RNG.random(2) * 9000 - 2500)) for i in range(60)] + [(60, 1.0, 1.0)] * 2 + [(61, None, 1.0), (None, 3.0, 4.0)]
    fixes = spark.createDataFrame(places, "event_id long, obs_x double, obs_y double")
    got = quadtree.nearest_edges(fixes, pieces_of(spark, edges), 10, least=least, per_task=per_task).orderBy("event_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r.event_id, []).append((r.dist, r.u, r.v, r.k))
    assert 61 not in by and len(by[60]) == 20
    for i, x, y in places[:60]:
        assert [f[1:] for f in by[i]] == [f[1:] for f in nearest(edges, x, y, 10)]
        assert [f[0] for f in by[i]] == pytest.approx([f[0] for f in nearest(edges, x, y, 10)])


def test_nearest_edges_of_an_empty_or_small_network(spark):
    fixes = spark.createDataFrame([(1, 0.0, 0.0)], "event_id long, obs_x double, obs_y double")
    edges = bent_edges(3)
    assert quadtree.nearest_edges(fixes, pieces_of(spark, edges), 10).count() == 3
    assert quadtree.nearest_edges(fixes, pieces_of(spark, edges).where("u < 0"), 10).count() == 0


def test_what_is_measured_grows_with_the_logarithm(spark):
    def share(n):
        at = RNG.random((n, 2)) * 100 * np.sqrt(n)
        p = pd.DataFrame({"u": range(n), "v": 0, "k": 0, "piece": 0, "x0": at[:, 0], "y0": at[:, 1], "x1": at[:, 0] + 30, "y1": at[:, 1], "offset": 0.0, "len": 30.0})
        table = quadtree.Pieces(p)
        for x, y in RNG.random((50, 2)) * 100 * np.sqrt(n):
            table.nearest(x, y, 10)
        return table.measured / 50

    few, many = share(1000), share(64_000)
    assert many < 2 * few < 200


def test_cells_are_split_by_counts_and_stay_few(spark):
    places = np.concatenate([RNG.random((3000, 2)), RNG.random((1000, 2)) * 1e5, np.full((4000, 2), 777.0)])
    df = spark.createDataFrame(pd.DataFrame(places, columns=["x", "y"]))
    tree = quadtree.split(df, F.col("x"), F.col("y"), share=16, least=10)
    n = np.bincount(tree.leaf_of(places), minlength=len(tree))
    assert len(tree) < 16 * 3 * quadtree.DEPTH and n.sum() == 8000
    assert sorted(n)[-1] == 4000 and sorted(n)[-2] <= 500  # one place cannot be split
    row, leaf = tree.touched(places, places)
    assert set(zip(range(8000), tree.leaf_of(places))) <= set(zip(row, leaf))


def plain_filter(rows, network, order, turn, middle, radius=60.0, k=10):
    """The filter's rule fix by fix in plain matrices, against every piece of the network."""
    s = None
    out = []
    H, I4, I2 = np.array([[1.0, 0, 0, 0], [0, 1, 0, 0]]), np.eye(4), np.eye(2)
    for t, ox, oy, hdop, sat, worse in rows:
        z = None if ox is None or oy is None else np.array([ox, oy])
        if s is None:
            s, P, b, dt = np.array([*(middle if z is None else z), 0.0, 0.0]), np.diag([2500.0, 2500, 400, 400]), np.full(len(order), 1 / len(order)), 1.0
        else:
            dt = min(max(t - last, 0.25), 30.0)
        last = t
        A = np.array([[1, 0, dt, 0], [0, 1, 0, dt], [0, 0, 1, 0], [0, 0, 0, 1.0]])
        G = np.array([[dt * dt / 2, 0], [0, dt * dt / 2], [dt, 0], [0, dt]])
        s, P = A @ s, A @ P @ A.T + 4 * G @ G.T

        def update(s, P, z, sigma):
            K = P @ H.T @ np.linalg.inv(H @ P @ H.T + sigma**2 * I2)
            return s + K @ (z - H @ s), (I4 - K @ H) @ P

        if z is not None:
            s, P = update(s, P, z, max(6.0, 7.5 * max(0.5, hdop)) * (1.5 if sat < 5 else 1))
        near = {}
        for u, v, key, x0, y0, x1, y1, layer, below in sorted(network, key=lambda p: p[:7]):
            dist, q = measured(s[0], s[1], x0, y0, x1, y1)
            if (u, v, key) not in near or dist < near[u, v, key][0]:
                near[u, v, key] = (dist, q, layer, below)
        near = sorted(near.values(), key=lambda f: f[0])
        near = [f for f in near if f[0] <= radius] or near[:k]
        sigma = max(20.0, np.sqrt(max(P[0, 0], P[1, 1])))
        seen = np.full(len(order), 1e-6)
        for dist, _, layer, below in near:
            seen[order.index(layer)] += np.exp(-0.5 * (dist / sigma) ** 2) * max(0.05, 0.2 + 0.8 * worse if below else 1 - 0.65 * worse)
        b = (b @ turn) * seen
        b = b / b.sum()
        pull, weight = np.zeros(2), 0.0
        for i, layer in enumerate(order):
            own = [f for f in near if f[2] == layer]
            if own:
                pull, weight = pull + b[i] * np.array(own[0][1]), weight + b[i]
        s, P = update(s, P, pull / weight, 18 + 35 * (1 - b.max()))
        out.append((*s, *b))
    return out


def network(n=260):
    rows = []
    for i in range(n):
        x, y = map(float, RNG.random(2) * 1500)
        rows.append((i, i + 1, 0, x, y, x + 60, y + float(RNG.normal(0, 20)), int(i % 3) - 1, i % 3 == 0))
        if i % 4 == 0:
            rows.append((i, i + 1, 0, x + 60, y, x + 60, y + 50, int(i % 3) - 1, i % 3 == 0))
    return rows


@pytest.mark.parametrize("least", [20_000, 60])
def test_filter_in_tiles_is_the_filter_on_the_whole_network(spark, least):
    """Tracks across tiles, one that strays far from its fixes and from all roads, one without any position, one that begins without."""
    from roadloom.functions.scalars import degradation, number

    roads = network()
    tracks = {
        1: [(float(i), 20.0 * i, 900.0 - 7 * i, 1.2, 8) for i in range(40)],
        2: [(0.0, 30.0, 30.0, 1.0, 9), (4.0, 280.0, 30.0, 1.0, 9), (8.0, 600.0, 40.0, 1.0, 9), *[(8.0 + 5 * i, None, None, 9.0, 2) for i in range(1, 14)]],
        3: [(0.0, None, None, 2.0, 4), (3.0, None, 5.0, None, None)],
        4: [(0.0, None, 1.0, 2.0, 4), (1.0, 9000.0, -4000.0, 1.0, 8), (31.0, 700.0, 700.0, 1.0, 8)],
    }
    turn = {(-1, -1): 0.8, (-1, 0): 0.1, (-1, 1): 0.1, (0, -1): 0.2, (0, 0): 0.6, (0, 1): 0.2, (1, -1): 0.3, (1, 0): 0.3, (1, 1): 0.4}
    rows = [(k, 1, 100 * k + i, *f) for k, fixes in tracks.items() for i, f in enumerate(fixes)]
    fixes = spark.createDataFrame(rows, "track_id long, segment long, event_id long, t_s double, obs_x double, obs_y double, hdop double, sat_count int").repartition(3)
    worse = {r.event_id: r.w for r in fixes.select("event_id", degradation(number(F.col("hdop"), 1.5), number(F.col("sat_count"), 7)).alias("w")).collect()}
    got = levels.kalman_levels(fixes, spark.createDataFrame(roads, PIECES), spark.createDataFrame([(*k, p) for k, p in turn.items()], "from_level int, to_level int, p double"), least=least, share=1000, per_task=5)
    got = {r.event_id: r for r in got.collect()}
    assert len(got) == len(rows)
    middle = np.mean([((r[3] + r[5]) / 2, (r[4] + r[6]) / 2) for r in roads], axis=0)
    matrix = np.array([[turn[a, b] for b in (-1, 0, 1)] for a in (-1, 0, 1)])
    for k, own in tracks.items():
        want = plain_filter([(t, x, y, 1.5 if h is None else h, 7 if s is None else s, worse[100 * k + i]) for i, (t, x, y, h, s) in enumerate(own)], roads, [-1, 0, 1], matrix, middle)
        for i, w in enumerate(want):
            r = got[100 * k + i]
            assert (r.ekf_x, r.ekf_y, r.vx, r.vy, *(r.beliefs[v] for v in (-1, 0, 1))) == pytest.approx(w, rel=1e-9, abs=1e-9)


def test_filter_without_a_network_or_fixes(spark):
    fixes = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 0.0, 1.0, 8)], "track_id long, segment long, event_id long, t_s double, obs_x double, obs_y double, hdop double, sat_count int")
    roads, turns = spark.createDataFrame(network(5), PIECES), spark.createDataFrame([(0, 0, 1.0)], "from_level int, to_level int, p double")
    assert levels.kalman_levels(fixes, roads.where("u < 0"), turns).count() == 0
    assert levels.kalman_levels(fixes.where("event_id < 0"), roads, turns).count() == 0


def test_a_cell_of_roads_is_gathered_once():
    """Many states pass a cell: what is near it is kept, and the rows are those of measuring every piece."""
    rng = np.random.default_rng(3)
    a = rng.random((200, 2)) * 600
    b = a + rng.random((200, 2)) * 40
    p = pd.DataFrame({"u": np.arange(200) // 2, "v": 0, "k": 0, "x0": a[:, 0], "y0": a[:, 1], "x1": b[:, 0], "y1": b[:, 1], "level": 0, "below": False})
    roads = levels.Roads(p, 60.0)
    for x, y in rng.random((300, 2)) * 600:
        got, every = roads.within(x, y), roads.nearest(x, y, 200)
        near = every[1] <= 60
        assert (got is None) == (not near.any()) and (got is None or got[0].tolist() == every[0][near].tolist())
    assert 0 < len(roads.around) <= 100


def test_support_and_run_rates_make_no_rows_of_candidates(spark, monkeypatch):
    from pathlib import Path

    from roadloom.plans import scoring

    sf = "/root/testdata/sf0.001"
    if not Path(sf).is_dir():
        pytest.skip("tables are not here")

    def never(*_, **__):
        raise AssertionError("candidates became rows")

    monkeypatch.setattr(geo, "flattened", never)
    assert scoring.s13_candidate_support(spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()
    assert scoring.g12_run_rates(spark, sf).count() > 0


def test_missed_fixes_are_those_without_lists(spark):
    pieces = pieces_of(spark, bent_edges(200))
    fixes = spark.createDataFrame([(i, *map(float, RNG.random(2) * 4000)) for i in range(500)] + [(500, None, 1.0)], "event_id long, obs_x double, obs_y double")
    want = {r.event_id for r in geo.near_lists(fixes, pieces).where(F.size("near") == 0).collect()}
    got = geo.near_lists(fixes, pieces, missed=True)
    assert got.columns == fixes.columns and {r.event_id for r in got.collect()} == want and 0 < len(want) < 500


def test_unlocalised_fixes_are_not_laid_beside_every_edge(spark):
    edges = spark.createDataFrame([(i % 700, i % 900 + 1, i % 3) for i in range(3000)], "u long, v long, k int")
    fixes = spark.createDataFrame([(i, None if i % 2 else 1.0, 2.0) for i in range(20)] + [(1, None, None)], "event_id long, obs_x double, obs_y double")
    out = geo.unlocalised(fixes, edges)
    got = {r.event_id: (r.candidates, *r["first"], *r["last"]) for r in out.collect()}
    ids = sorted(tuple(r) for r in edges.collect())
    assert got == {i: (3000 * (2 if i == 1 else 1), *ids[0], *ids[-1]) for i in range(1, 20, 2)}
    assert "Cartesian" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and plan.index("NestedLoop") < plan.index("HashAggregate")


@pytest.mark.parametrize("k", [1, 3, 10, 500])
def test_many_places_at_once_find_what_each_finds(k):
    at = np.round(RNG.random((300, 2)) * 3000)
    two = np.repeat(np.arange(300), 2)  # edges of two pieces each, some of them doubled: ties
    p = pd.DataFrame({"u": two % 280, "v": 1, "k": two // 280, "piece": np.tile([0, 1], 300)})
    ends = np.stack([at, at + (40, 0), at + (40, 0), at + (40, 900)], axis=1)[np.where(np.arange(300) < 280, np.arange(300), np.arange(300) - 280)].reshape(600, 2, 2)
    p = p.assign(x0=ends[:, 0, 0], y0=ends[:, 0, 1], x1=ends[:, 1, 0], y1=ends[:, 1, 1], offset=p.piece * 40.0, len=np.where(p.piece == 0, 40.0, 900.0))
    table = quadtree.Pieces(p)
    places = np.concatenate([RNG.random((40, 2)) * 3000, RNG.normal(0, 1e6, (40, 2)), at[:5]])
    row, *out = table.nearest_of_all(places, k)
    for i, (x, y) in enumerate(places):
        got = sorted(zip(*(c[row == i].tolist() for c in out)))
        want = sorted(table.nearest(x, y, k))
        assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose(got, want, rtol=1e-12, atol=1e-9)
    table.measured = 0
    table.nearest_of_all(places, k)
    many, table.measured = table.measured, 0
    for x, y in places:
        table.nearest(x, y, k)
    assert many < 6 * table.measured

"""Operators against brute force and hand-made cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadloom.functions import features as X
from roadloom.functions import scalars as S
from roadloom.operators import aggregates, circuits, decode, fusion, geo, graph, learners, levels, modes, scenario, sequence, stats, training, validation
from roadloom.operators.fuzzy import best_match
from roadloom.sources import files, paths

FIX = "track_id long, event_id long, t_s double, obs_x double, obs_y double"


def test_flags_as_the_two_spellings_have_them(spark):
    texts = ["on", " ON ", "off", "t", "T", "1", "0.0", "yes", "y", "nan", "-inf", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.a, r.b) for r in rows.select("i", S.flag(F.col("t")).alias("a"), S.flag(F.col("t"), S.LENIENT_TEXTS).alias("b")).collect()}
    want = [True, True, False, False, False, True, False, True, True, False, False, False, False]
    assert [got[i][0] for i in range(len(texts))] == want and [i for i in range(len(texts)) if got[i][1] != want[i]] == [3, 4]


def test_node_ids_of_many_digits(spark):
    texts = ["123", "123.0", " 7.00 ", "007", "1e3", "1.5", "4000000000000012.0", "9007199254740993", "9007199254740993.0", "n1", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.node_id(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == ["123", "123", "7", "7", "1000", "1.5", "4000000000000012", "9007199254740993", "9007199254740993", "n1", None]


def test_scores_that_differ_in_last_bits_are_ties(spark):
    rows = spark.createDataFrame([(1, 10, 0.3, 0.0, 0.2), (1, 11, 0.1 + 0.2, 0.0, 0.2), (2, 20, 0.3, 1e-13, 0.2), (2, 21, 0.3, 0.0, 0.2), (3, 30, 0.3, 5.0, 0.2), (3, 31, 0.4, 5.0, 0.2)], "e int, r int, o double, apart double, n double")
    assert 0.1 + 0.2 > 0.3
    parts = {"overlap": F.col("o"), "distance": F.lit(0.0), "name": F.col("n"), "direction": F.lit(0.0), "subtype": F.lit(0.0)}
    got = best_match(rows, parts, "e", "r", F.col("apart")).collect()
    assert sorted((r.e, r.r) for r in got) == [(1, 10), (2, 20), (3, 31)]


def filled(rows):
    """One track, fix by fix: the rule as it is told."""
    out = []
    for t, x, y in rows:
        imputed = False
        if (x is None or y is None) and out and None not in out[-1][1:3]:
            t1, x1, y1, _ = out[-1]
            vx = vy = 0.0
            if len(out) > 1 and None not in out[-2][1:3]:
                dt = min(max(t1 - out[-2][0], 0.25), 30)
                vx, vy = (x1 - out[-2][1]) / dt, (y1 - out[-2][2]) / dt
            step = min(max(t - t1, 0.25), 30)
            x, y, imputed = x1 + vx * step if x is None else x, y1 + vy * step if y is None else y, True
        out.append((t, x, y, imputed))
    return out


def test_imputation_of_random_tracks_with_repeated_and_null_ids(spark):
    rng = np.random.default_rng(2)
    tracks = {k: [(float(t), *(None if rng.random() < 0.4 else float(v) for v in rng.integers(0, 90, 2))) for t in np.cumsum(rng.integers(1, 50, 40))] for k in range(6)}
    rows = [(k, [5, None, i][i % 3], *r) for k, fixes in tracks.items() for i, r in enumerate(fixes)]
    got = sequence.impute(spark.createDataFrame(rows, FIX).repartition(3)).orderBy("track_id", "t_s").collect()
    want = [(k, *r) for k in tracks for r in filled(tracks[k])]
    assert len(got) == len(rows)
    for g, (k, t, x, y, imputed) in zip(got, want, strict=True):
        assert (g.track_id, g.t_s, g.imputed) == (k, t, imputed)
        assert (g.eff_x, g.eff_y) == (pytest.approx(x) if x is not None else None, pytest.approx(y) if y is not None else None)


def test_imputation_in_pieces_is_that_of_the_whole():
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.random(60) * 9)
    x, y = (np.where(rng.random(60) < 0.5, np.nan, rng.random(60)) for _ in range(2))
    new = np.arange(60) == 0
    whole = sequence.fill(t, x.copy(), y.copy(), new, None)
    parts, state = [], None
    for a, b in ((0, 1), (1, 2), (2, 17), (17, 60)):
        fx, fy, im, state = sequence.fill(t[a:b], x[a:b].copy(), y[a:b].copy(), new[a:b], state)
        parts.append((fx, fy, im))
    for k in range(3):
        assert np.array_equal(np.concatenate([p[k] for p in parts]), whole[k], equal_nan=k < 2)


def test_streamed_imputation_gives_the_table_form(spark, tmp_path):
    from roadloom.streaming.fixes import impute_stream

    rows = [(k, 10 * k + i, float(i), None if i % 3 == 2 else float(i * i), float(i)) for k in range(3) for i in range(9)]
    df = spark.createDataFrame(rows, FIX)
    for part, keep in (("a", "t_s < 4"), ("b", "t_s >= 4")):
        df.where(keep).coalesce(1).write.parquet(f"{tmp_path}/data/{part}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/data/*")
    query = impute_stream(stream).writeStream.format("memory").queryName("filled").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/check").start()
    query.awaitTermination(120)
    got = {r.event_id: (r.eff_x, r.eff_y, r.imputed) for r in spark.table("filled").collect()}
    assert got == {r.event_id: (r.eff_x, r.eff_y, r.imputed) for r in sequence.impute(df).collect()}


def grid_edges(spark, n):
    rows = [(i * n + j, i * n + j + 1, 0, j * 10.0, i * 10.0, (j + 1) * 10.0, i * 10.0) for i in range(n) for j in range(n - 1)]
    rows += [(u, v, 1, x0, y0 + 3, x1, y1 + 4) for u, v, _, x0, y0, x1, y1 in rows[:6]]
    return rows, spark.createDataFrame([(*r[:3], 0, *r[3:], math.hypot(r[5] - r[3], r[6] - r[4]), 0.0) for r in rows], "u long, v long, k int, piece int, x0 double, y0 double, x1 double, y1 double, len double, offset double")


def apart(x, y, e):
    _, _, _, x0, y0, x1, y1 = e
    t = max(0, min(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2)))
    return math.hypot(x - x0 - t * (x1 - x0), y - y0 - t * (y1 - y0))


def test_nearest_edges_at_any_distance(spark):
    edges, pieces = grid_edges(spark, 8)
    rng = np.random.default_rng(1)
    points = [(i, 0, float(i), float(x), float(y)) for i, (x, y) in enumerate([*rng.random((10, 2)) * 80, (500, 500), (-9000, 40), (1e7, -1e7), (35, 4000)])] + [(99, 0, 0.0, None, 1.0)]
    fixes = spark.createDataFrame([(t, i, s, x, y) for i, t, s, x, y in points], FIX)
    near = {}
    for r in geo.candidates(fixes, pieces, radius=4.0, fallback_k=5, keep_empty=True).collect():
        near.setdefault(r.event_id, []).append((r["rank"], r.u, r.v, r.k, r.dist))
    assert near.pop(99) == [(None, None, None, None, None)]  # no position: kept, without an edge
    for i, _, _, x, y in points[:-1]:
        want = sorted((apart(x, y, e), *e[:3]) for e in edges)
        want = [w for w in want if w[0] <= 4.0] or want[:5]
        got = sorted(near[i])
        assert [g[4] for g in got] == pytest.approx([w[0] for w in want], rel=1e-9)
        assert {g[1:4] for g in got if g[4] < want[-1][0] - 1e-6} == {w[1:] for w in want if w[0] < want[-1][0] - 1e-6}


def test_overlap_of_lines_against_fine_sampling(spark):
    rng = np.random.default_rng(4)
    lines = {k: np.cumsum(np.vstack([rng.random((1, 2)) * 30, rng.normal(0, 12, (4, 2))]), axis=0) for k in range(14)}
    df = lambda ids, key: spark.createDataFrame([(k, [(float(x), float(y)) for x, y in lines[k]]) for k in ids], f"{key} int, points array<struct<x:double,y:double>>")
    got = {(r.a, r.b): (r.distance, r.overlap) for r in fusion.overlap_scores(df(range(7), "a"), df(range(7, 14), "b"), "a", "b").collect()}

    def sampled(p, n=400):
        return np.vstack([p[i] + np.linspace(0, 1, n, endpoint=False)[:, None] * (p[i + 1] - p[i]) for i in range(len(p) - 1)]), np.concatenate([np.full(n, np.hypot(*(p[i + 1] - p[i])) / n) for i in range(len(p) - 1)])

    def to_line(q, p):
        best = np.full(len(q), np.inf)
        for a, b in zip(p[:-1], p[1:], strict=True):
            t = np.clip(((q - a) @ (b - a)) / ((b - a) @ (b - a)), 0, 1)
            best = np.minimum(best, np.hypot(*(q - a - t[:, None] * (b - a)).T))
        return best

    assert len(got) > 20
    for (a, b), (distance, overlap) in got.items():
        (qa, wa), (qb, wb) = sampled(lines[a]), sampled(lines[b])
        da, db = to_line(qa, lines[b]), to_line(qb, lines[a])
        sa, sb = wa[da <= 8].sum() / wa.sum(), wb[db <= 8].sum() / wb.sum()
        assert distance == pytest.approx(min(da.min(), db.min()), abs=0.2)
        assert overlap == pytest.approx(0.65 * max(sa, sb) + 0.35 * min(sa, sb), abs=0.01)


def test_potentials_of_pairs_by_hand(spark):
    """A reversal on one edge, a step over a hop, and one without a way."""
    row = "track_id long, segment long, step int, edge long, u long, v long, arc double, line_length double, ox double, oy double, tx double, ty double, moved double, reliability double"
    cands = [(1, 1, 1, 1, 0, 1, 30.0, 50.0, 30.0, 0.0, 1.0, 0.0, 0.0, 0.5), (1, 1, 2, 1, 0, 1, 10.0, 50.0, 10.0, 0.0, 1.0, 0.0, 20.0, 0.5), (1, 1, 2, 2, 2, 3, 5.0, 50.0, 10.0, 0.0, 0.0, 1.0, 20.0, 0.5), (1, 1, 2, 3, 8, 9, 5.0, 50.0, 10.0, 0.0, 1.0, 0.0, 20.0, 0.5)]
    hops = spark.createDataFrame([(1, 2, 15.0)], "src long, dst long, dist double")
    got = {r.edge_b: (r.route, r.potential) for r in decode.pair_potentials(spark.createDataFrame(cands, row), hops).collect()}
    course = lambda degrees: math.exp(-0.5 * 0.5 * (degrees / 45) ** 2)
    assert got[1] == (0.0, pytest.approx(math.exp(-20 / 50) * math.exp(-0.5 * 20 / 50) * course(180)))
    assert got[2] == (40.0, pytest.approx(math.exp(-20 / 50) * course(90)))
    assert got[3] == (None, 0.0)


def test_decoding_of_streamed_segments_and_its_beam(spark):
    rng = np.random.default_rng(5)
    steps = [(t, 1, s, 100 * t + s, e, float(rng.normal())) for t in range(5) for s in range(1, 9) for e in range(6)]
    pairs = [(t, 1, s, a, b, float(rng.random()) if rng.random() < 0.7 else 0.0) for t in range(5) for s in range(2, 9) for a in range(6) for b in range(6)]
    cands = spark.createDataFrame(steps, "track_id long, segment long, step int, event_id long, edge long, emit double").repartition(4)
    links = spark.createDataFrame(pairs, "track_id long, segment long, step int, edge_a long, edge_b long, potential double").repartition(4)
    for beam in (None, 2):
        got = sorted((r.track_id, r.event_id, r.edge, round(r.score, 9), r.broken) for r in decode.viterbi(cands, links, beam).collect())
        want = []
        for t in range(5):
            emit, pot = {(s, e): v for k, _, s, _, e, v in steps if k == t}, {(s, a, b): v for k, _, s, a, b, v in pairs if k == t}
            now, back, kept = {e: emit[1, e] for e in range(6)}, {}, []
            for s in range(1, 9):
                if s > 1:
                    now = {b: max(((now[a] + math.log(pot[s, a, b]) + emit[s, b], -a) for a in now if pot[s, a, b] > 0), default=None) for b in range(6)}
                    now = {b: v for b, v in now.items() if v}
                    back |= {(s, b): -v[1] for b, v in now.items()}
                    now = {b: v[0] for b, v in now.items()}
                if beam:
                    now = dict(sorted(now.items(), key=lambda x: (-x[1], x[0]))[:beam])
                kept.append(now)
            at = min(kept[-1], key=lambda e: (-kept[-1][e], e))
            for s in range(8, 0, -1):
                want.append((t, 100 * t + s, at, round(kept[s - 1][at], 9), False))
                at = back.get((s, at))
        assert got == sorted(want)


def test_level_filter_by_hand():
    """One fix on a straight road of level 0, another of level -1 beside it: numbers from the rule, worked out step by step."""
    roads = levels.Roads(pd.DataFrame({"x0": [0.0, 0.0], "y0": [0.0, 30.0], "x1": [100.0, 100.0], "y1": [0.0, 30.0], "level": [0, -1], "below": [False, True]}), 60.0)
    rows = pd.DataFrame({"t_s": [0.0], "obs_x": [50.0], "obs_y": [10.0], "hdop": [2.0], "sat_count": [4], "degraded": [0.3]})
    turn = np.array([[0.8, 0.2], [0.1, 0.9]])
    got = levels.level_filter(rows, roads, [-1, 0], turn)[0]
    var = 2500 + 400 + 4.0 * 0.25  # moved on for a second
    gps = max(6, 7.5 * 2.0) * 1.5
    var = var * gps**2 / (var + gps**2)
    sigma = max(20.0, math.sqrt(var))
    near = np.array([1e-6 + math.exp(-0.5 * (20 / sigma) ** 2) * (0.2 + 0.8 * 0.3), 1e-6 + math.exp(-0.5 * (10 / sigma) ** 2) * (1 - 0.65 * 0.3)])
    belief = np.array([0.5, 0.5]) @ turn * near
    belief /= belief.sum()
    road = 18 + 35 * (1 - belief.max())
    y = 10 + (belief[0] * 30 - 10) * var / (var + road**2)
    assert got[4:] == pytest.approx(belief) and got[0] == pytest.approx(50) and got[1] == pytest.approx(y)


def test_filter_takes_the_nearest_piece_of_an_edge_and_the_nearest_edges_beyond_its_radius():
    p = pd.DataFrame({"u": [1, 1, 2, 3], "v": [2, 2, 3, 4], "k": 0, "x0": [0.0, 10.0, 500.0, 900.0], "y0": 0.0, "x1": [10.0, 20.0, 510.0, 910.0], "y1": 0.0, "level": 0, "below": False})
    at, dist, _ = levels.Roads(p, 60.0).near(12.0, 5.0)
    assert at.tolist() == [1] and dist.tolist() == [5.0]
    at, dist, _ = levels.Roads(p, 60.0).near(700.0, 0.0, k=2)
    assert at.tolist() == [2, 3] and dist.tolist() == [190.0, 200.0]


def test_missing_hdop_counts_as_one_and_a_half(spark):
    pieces = spark.createDataFrame([(1, 2, 0, 0.0, 0.0, 100.0, 0.0, 0, False)], "u long, v long, k int, x0 double, y0 double, x1 double, y1 double, layer int, below boolean")
    turns = spark.createDataFrame([(0, 0, 1.0)], "from_level int, to_level int, p double")
    fix = "track_id long, segment long, event_id long, t_s double, obs_x double, obs_y double, hdop double, sat_count int"
    rows = [(t, 1, 10 * t + i, float(i), 10.0 * i, 3.0, None if t == 1 else 1.5, None if t == 1 else 7) for t in (1, 2) for i in range(3)]
    got = {r.event_id: (r.ekf_x, r.ekf_y) for r in levels.kalman_levels(spark.createDataFrame(rows, fix), pieces, turns).collect()}
    assert len(got) == 6 and all(got[10 + i] == pytest.approx(got[20 + i]) for i in range(3))


def test_thirteen_modes_and_their_parts():
    assert len(modes.MODES) == 13 and {m for m, (_, t) in modes.MODES.items() if t != "plain"} == {"quantum", "qts_only", "classical_matched", "level_ekf_hmm_quantum"}
    assert modes.MODES["quantum"][0] == modes.MODES["qmm_entanglement"][0] and modes.MODES["qts_only"][0] == modes.MODES["classical"][0]


def test_dips_grow_and_fall_back(spark):
    scores = [0.9, 0.1, 0.1, 0.9, 0.1] + [0.1] * 120
    rows = [(1, i, i == 0, s) for i, s in enumerate(scores)] + [(2, 0, True, None), (2, 1, False, 0.9)]
    got = {(r.track_id, r.step): (r.ambiguity, r.window) for r in modes.dips(spark.createDataFrame(rows, "track_id int, step int, boundary boolean, score double"), 0.5).collect()}
    assert [got[1, i] for i in range(5)] == [(False, 20), (True, 21), (True, 22), (False, 20), (True, 21)]
    assert got[1, 124] == (True, 120) and got[2, 0] == (True, 21) and got[2, 1] == (False, 20)


def test_scores_by_hand(spark):
    """One edge's matched score and product circuit, with weights that make them simple."""
    w = [0.0] * 25
    w[0], w[20], w[24] = 1.0, 2.0, -0.5  # the first hidden unit sees the first input alone
    z = X.mlp_score(F.array(*[F.lit(0.3)] * 4), w, 4, 4)
    quarter = X.product_circuit(F.array(F.lit(0.25)), [0.1, math.pi / 2, 0.2, 0.0, 0.0, 0.0], 1, 2, [0])
    free = X.product_circuit(F.array(F.lit(0.25)), [0.0] * 6, 1, 2, [0])
    r = spark.range(1).select(z.alias("z"), quarter.alias("q"), free.alias("f")).first()
    assert r.z == pytest.approx(1 / (1 + math.exp(0.5 - 2 * math.tanh(0.3))))
    assert r.f == pytest.approx(math.cos(math.pi / 2), abs=1e-12)  # two turns of 45 degrees
    assert r.q == pytest.approx(circuits.expectation(np.array([[0.25]]), np.array([[[0.1, math.pi / 2, 0.2]], [[0.0, 0.0, 0.0]]]), [0], entangle=False)[0])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1000])
def test_percentiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    values = {g: np.round(rng.normal(size=n), 1 if g else 9) for g in (0, 1)}
    rows = [(g, float(v), float(-v) if v > 0 else None) for g in values for v in values[g]]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    wanted = {f"{c}{p}": (c, p / 100) for c in "ab" for p in (0, 10, 50, 90, 95, 100)}
    for r in aggregates.percentiles(df, ["g"], wanted, accuracy=100).collect():
        a, b = values[r.g], -values[r.g][values[r.g] > 0]
        for name, (c, p) in wanted.items():
            v = a if c == "a" else b
            assert r[name] == (pytest.approx(np.percentile(v, 100 * p)) if len(v) else None), (n, name)


def test_threshold_curve_against_every_threshold(spark):
    rng = np.random.default_rng(6)
    rows = [(int(g), float(np.round(rng.random(), 2)), int(rng.random() < 0.4)) for g in (0, 1) for _ in range(300)]
    got = {(r.g, round(r.threshold, 9)): (r.tp, r.tn, r.fp, r.fn) for r in aggregates.threshold_curve(spark.createDataFrame(rows, "g int, s double, y int"), "s", "y", "g", ranges=8).collect()}
    for g in (0, 1):
        s, y = np.array([r[1] for r in rows if r[0] == g]), np.array([r[2] for r in rows if r[0] == g])
        u = np.unique(s)
        for t in [u[0] - 1e-9, *((u[:-1] + u[1:]) / 2), u[-1]]:
            p = s <= t
            assert got[g, round(float(t), 9)] == ((p & (y == 1)).sum(), (~p & (y == 0)).sum(), (p & (y == 0)).sum(), (~p & (y == 1)).sum())


def test_median_of_pair_averages_without_all_pairs():
    rng = np.random.default_rng(12)
    for n in (1, 2, 3, 4, 7, 40, 41, 90):
        for x in (rng.normal(size=n), np.round(rng.normal(size=n), 1), np.zeros(n)):
            i, j = np.triu_indices(n)
            for few in (1, 5, 1 << 20):
                assert stats.walsh_median(x, few) == pytest.approx(np.median((x[i] + x[j]) / 2), abs=1e-9)


def test_learners_tell_easy_classes_apart(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(a), float(b)], int(a * a + b * b < 0.7), str(i % 15)) for i, (a, b) in enumerate(rng.uniform(-1.2, 1.2, (600, 2)))]
    df = spark.createDataFrame(rows, "event_id int, features array<double>, label int, group string")
    net, nets = learners.tuned_network(df, rounds=40, networks=[((16,), 1e-4), ((8, 4), 1e-3), ((16,), 10.0)])
    kernel, kernels = learners.tuned_kernel_machine(df, size=64, rounds=20, kernels=[(1.0, None), (5.0, 0.5)])
    assert max(t[2] for t in nets) > 0.85 and max(t[2] for t in kernels) > 0.85
    assert nets[2][2] < nets[0][2]  # a penalty that leaves nothing to learn with
    x = np.array([r[1] for r in rows])
    got = df.select("event_id", net.column(F.col("features")).alias("n"), kernel.column(F.col("features")).alias("k")).orderBy("event_id").collect()
    assert [r.n for r in got] == pytest.approx(net.score(x), rel=1e-9) and [r.k for r in got] == pytest.approx(kernel.score(x), rel=1e-9)
    held = df.where("label = 1").count() / 600
    assert 0.2 < held < 0.8 and np.mean((net.score(x) > 0.5) == np.array([r[2] for r in rows])) > 0.85
    cell = learners.Reservoir(2)
    seq = df.select(F.array("features", "features").alias("sequence"), (F.get("features", F.lit(0)) > 0).cast("double").alias("label"))
    head = cell.fit(seq)
    x = np.array([[r[1], r[1]] for r in rows])
    p = np.hstack([cell.encode(x), np.ones((len(x), 1))]) @ head
    design = np.hstack([cell.encode(x), np.ones((len(x), 1))])
    y = np.array([r[1][0] > 0 for r in rows], float)
    penalty = 1e-3 * np.diag([1.0] * 12 + [0.0])
    assert head == pytest.approx(np.linalg.solve(design.T @ design + penalty, design.T @ y)) and ((p > 0.5) == (y > 0.5)).mean() > 0.9


def test_gradient_of_a_network_is_that_of_its_loss():
    rng = np.random.default_rng(2)
    net = learners.Network.drawn([3, 5, 4, 1], 1)
    x, y, weight = rng.normal(size=(20, 3)), rng.integers(0, 2, 20).astype(float), rng.random(20)

    def loss(w):
        p = learners.Network(net.layers, w).score(x)
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())

    g = net.gradient(x, y, weight)
    for i in range(0, len(g), 3):
        step = np.zeros(len(g))
        step[i] = 1e-6
        assert g[i] == pytest.approx((loss(net.weights + step) - loss(net.weights - step)) / 2e-6, abs=1e-5)


def test_ranker_keeps_the_best_start():
    rng = np.random.default_rng(0)
    good, bad = rng.random((200, 3)) + [0.5, 0, 0], rng.random((200, 3))
    score, slope = lambda x, w: np.tanh(x @ w), lambda x, w: (1 - np.tanh(x @ w) ** 2)[:, None] * x
    w, loss, restart = training.train_best_ranker(good, bad, 3, score, slope)
    assert loss < 0.2 and 0 <= restart < 5 and w[0] > 0.3
    with pytest.raises(ValueError):
        training.train_best_ranker(bad, bad, 3, score, slope)


def test_cases_store_the_weights_that_they_learned(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(c, i, [float(v) for v in rng.random(3) + [c, 0, 0]], [float(v) for v in rng.random(3)]) for c in (0, 1) for i in range(120)]
    pairs = spark.createDataFrame([*rows, *[(2, i, r[3], r[3]) for i, r in enumerate(rows[:50])]], "c long, key long, good array<double>, bad array<double>")
    score, slope = lambda x, w: np.tanh(x @ w), lambda x, w: (1 - np.tanh(x @ w) ** 2)[:, None] * x
    got = {r[0]: r for r in training.calibrated(pairs, "c", 3, score, slope, f"file://{tmp_path}")}
    assert got[1][4] and got[1][3] < 0.2 and got[1][1] == 120 and got[2][2:] == (None, None, False)  # the same on both sides: nothing to learn
    assert len(files.read_weights(spark, f"file://{tmp_path}/1", "1", [3])) == 3


def test_cases_learn_from_every_pair(spark, tmp_path):
    """Pairs beyond any sample's size count, and so does each copy of a pair."""
    rng = np.random.default_rng(5)
    some = [([float(v) for v in rng.random(3) + [0.5, 0, 0]], [float(v) for v in rng.random(3)]) for _ in range(40)]
    pairs = spark.createDataFrame([("a", i, *some[i % 40]) for i in range(3000)] + [("b", 1, *some[0])], "c string, key long, good array<double>, bad array<double>")
    score, slope = lambda x, w: np.tanh(x @ w), lambda x, w: (1 - np.tanh(x @ w) ** 2)[:, None] * x
    got = {r[0]: r for r in training.calibrated(pairs, "c", 3, score, slope, f"file://{tmp_path}")}
    assert got["a"][1] == 3000 and got["a"][4] and got["b"][1] == 1 and got["b"][4]
    w = np.array(files.read_weights(spark, f"file://{tmp_path}/a", "a", [3]))
    held = [r.key % 40 for r in training.split_groups(pairs.where("c = 'a'"), "key", 1 / 3).where("holdout").collect()]
    loss = [max(0, 0.2 - score(np.array(x), w) + score(np.array(y), w)) for x, y in some]
    assert got["a"][3] == pytest.approx(np.mean([loss[i] for i in held])) and 900 < len(held) < 1100


def test_gradient_scan_against_differences(spark):
    got = {(r.wires, r.layers): r for r in circuits.gradient_scan(spark, [2, 3], [1, 2], samples=6, seed=4).collect()}
    for (n, m), r in got.items():
        rng, x, g = np.random.default_rng(4 + 13 * n + m), np.random.default_rng(4).uniform(0, 1, (1, n)), []
        for _ in range(6):
            w = rng.uniform(0, 2 * np.pi, (m, n, 3))
            v = w.copy()
            v[0, 0, 0] += 1e-5
            g.append((circuits.expectation(x, v, [0], blocks_reencode=False)[0] - circuits.expectation(x, w, [0], blocks_reencode=False)[0]) / 1e-5)
        assert r.variance == pytest.approx(np.var(g), abs=1e-4) and r.mean_abs == pytest.approx(np.mean(np.abs(g)), abs=1e-4)


def test_bootstrap_interval_against_plain_draws(spark):
    gains = np.random.default_rng(5).normal(1, 1, 9)
    df = spark.createDataFrame([("a", float(g)) for g in gains] + [("b", 2.0)] * 4, "c string, x double")
    got = {r.c: (r.low, r.high) for r in stats.bootstrap_interval(df, "x", "c", draws=200).collect()}
    rng, x = np.random.default_rng(0), np.sort(gains)
    i, j = np.triu_indices(9)
    drawn = [np.median((d[i] + d[j]) / 2) for d in (x[rng.integers(0, 9, 9)] for _ in range(200))]
    assert got["a"] == pytest.approx(tuple(np.percentile(drawn, [2.5, 97.5]))) and got["b"] == (2.0, 2.0)


def test_signal_states(spark):
    rows = [(t, s, float(s), 0.0, int(20 <= s < 60), 10.0, 1.0) for t in range(8) for s in range(140)]
    out = scenario.observe(spark.createDataFrame(rows, "track_id long, step int, true_x double, true_y double, tunnel int, speed double, multiplier double").repartition(3)).collect()
    again = scenario.observe(spark.createDataFrame(rows, "track_id long, step int, true_x double, true_y double, tunnel int, speed double, multiplier double").repartition(5)).collect()
    key = lambda r: (r.track_id, r.step)
    assert sorted(map(tuple, out), key=lambda r: r[:2]) == sorted(map(tuple, again), key=lambda r: r[:2])
    bounds = {"tunnel_blackout": (8.5, 10.5, 0, 1), "tunnel_degraded": (3.2, 8.0, 2, 5), "tunnel_moderate": (1.6, 3.0, 5, 6), "post_tunnel_recovery": (1.2, 3.0, 4, 9), "portal_degraded": (3.2, 8.0, 2, 4), "portal_blackout": (8.5, 10.5, 0, 1), "portal_moderate": (1.6, 3.0, 5, 6), "open_sky": (0.7, 1.5, 8, 12)}
    for r in sorted(out, key=key):
        lo, hi, few, many = bounds[r.state]
        assert lo <= r.hdop <= hi and few <= r.sat_count <= many and r.state.startswith("tunnel") == (r.tunnel == 1)
        assert (r.obs_x is not None) or "blackout" in r.state
    first_out = [r for r in out if r.step == 60]
    assert {r.state for r in first_out} == {"post_tunnel_recovery"} and {r.state for r in out} >= {"tunnel_blackout", "open_sky"}
    # A recovery ends with its time or its distance, whichever is used up first.
    for t in range(8):
        run = [r.step for r in out if r.track_id == t and r.state == "post_tunnel_recovery"]
        assert run == [] or sorted(run) == list(range(60, 60 + len(run))) and len(run) <= 40


def test_walks_never_turn_straight_back(spark):
    rows = [(i, j, 0, 0) for i in range(5) for j in ((i + 1) % 5, (i - 1) % 5)]
    edges = spark.createDataFrame(rows, "u long, v long, k int, layer int")
    starts = spark.createDataFrame([(t, 0, 1, 0, 0) for t in range(4)], "track_id long, u long, v long, k int, layer int")
    got = sorted(map(tuple, scenario.walks(starts, edges, 7).collect()))
    assert got == [(t, s, s % 5, (s + 1) % 5, 0) for t in range(4) for s in range(7)]


def test_lists_cut_to_their_first_are_the_first_of_the_whole(spark):
    net = geo.segments(geo.with_points(spark.createDataFrame([(i, i + 1, k) for i in range(30) for k in (0, 1)], "u long, v long, k int"), spark.createDataFrame([(i, 10.0 * i, float(i % 3)) for i in range(31)], "node_id long, x double, y double")))
    fixes = spark.createDataFrame([(i, i * 9.7, 3.0 if i % 6 else 500.0) for i in range(30)] + [(30, None, None)], "event_id long, obs_x double, obs_y double")
    plain = lambda lists: {r.event_id: r.near and [(n.u, n.v, n.k, n.dist) for n in r.near] for r in lists.collect()}
    whole, cut = plain(geo.candidate_lists(fixes, net, 25.0, keep_empty=True)), plain(geo.candidate_lists(fixes, net, 25.0, keep_empty=True, top=3))
    assert len(cut) == 31 and cut[30] is None and min(len(n) for n in whole.values() if n) > 3 and cut == {i: n and n[:3] for i, n in whole.items()}


def test_validation_of_a_small_track(spark):
    edges = spark.createDataFrame([(1, 2, 0, 10.0, "60"), (2, 3, 0, 10.0, "60"), (3, 4, 0, 10.0, "60")], "u long, v long, k int, length double, maxspeed string")
    nodes = spark.createDataFrame([(i, 10.0 * (i - 1), 0.0) for i in range(1, 5)], "node_id long, x double, y double")
    lines = geo.with_points(edges, nodes)
    row = "track_id long, step int, event_id long, edge_u long, edge_v long, edge_key string, node_text string, next_text string, at_x double, at_y double, speed double, path double, stamp double, true_layer int, true_tunnel int, state string, hdop double, sat_count int"
    fixes = [
        (1, 1, 1, 1, 2, "0", "1.0", "2", 5.0, 0.0, 15.0, 0.0, 1.0, 0, 1, "tunnel_blackout", 1.0, 9),
        (1, 2, 2, 3, 4, "0", "3", "4", 20.0, 0.0, 15.0, 15.0, 2.0, 0, 0, "post_tunnel_recovery", 1.0, 9),  # by way of 2 - 3: 10 m
        (1, 3, 3, 3, 4, "x", "3", "4", 28.0, 0.0, 40.0, 23.0, 3.5, 0, 0, "open_sky", 1.0, 9),  # no such edge, late, wrong path
        (1, 4, 4, 1, 2, "0.0", "7", "2", 5.0, 1.0, 15.2, 24.0, 4.5, 0, 0, "open_sky", 1.0, 9),  # wrong node, off the line, faster than the last valid one
    ]
    got = {r.event_id: r for r in validation.checked(spark.createDataFrame(fixes, row), lines).collect()}
    flags = ("invalid_edge", "invalid_link", "off_edge", "too_fast", "jerk", "off_cadence", "off_path", "broken")
    assert [[f for f in flags if got[i][f]] for i in (1, 2, 3, 4)] == [[], ["off_cadence", "off_path"], ["invalid_edge", "off_path"], ["invalid_link", "off_edge", "jerk"]]
    assert [(r.recovered, r.open_after) for r in validation.exits(validation.checked(spark.createDataFrame(fixes, row), lines)).collect()] == [(True, True)]


def test_fixes_without_an_edge_are_not_one_task(spark, monkeypatch):
    """They meet the network by the ends they state, and no join brings them together by an edge that they all lack."""
    lines = geo.with_points(spark.createDataFrame([(1, 2, 0, 10.0, "60"), (3, 4, 0, 10.0, "60")], "u long, v long, k int, length double, maxspeed string"), spark.createDataFrame([(i, 10.0 * i, 0.0) for i in range(1, 5)], "node_id long, x double, y double"))
    row = "track_id long, step int, event_id long, edge_u long, edge_v long, edge_key string, node_text string, next_text string, at_x double, at_y double, speed double, path double, stamp double, true_layer int, true_tunnel int, state string, hdop double, sat_count int"
    ends = [(3, 4), (1, 2)] + [(100 + i, 200 + i) for i in range(400)]  # one step between edges that do not touch, the rest on no edge
    fixes = [(i // 2, i % 2, i, u, v, "0", str(u), str(v), 15.0, 0.0, 10.0, 10.0 * i, float(i), 0, 0, "open_sky", 1.0, 9) for i, (u, v) in enumerate(ends)]
    kept, stored = [], validation.stored
    monkeypatch.setattr(validation, "stored", lambda df, label: kept.append(df) or stored(df, label))
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = validation.checked(spark.createDataFrame(fixes, row), lines)
        assert kept[0]._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
        lost = out.where("invalid_edge").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in lost) == 400 and len(lost) > 1
        assert [(r.event_id, r.broken) for r in out.where("broken or not invalid_edge").orderBy("event_id").collect()] == [(0, True), (1, False)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_files_and_paths(spark, tmp_path):
    with pytest.raises(ValueError):
        paths.crs("Somewhere_QLD")
    assert paths.crs("Some_Tunnel_VIC") == "EPSG:7855" and paths.case_path("s3://b/", "A_NSW", "candidates") == "s3://b/candidates/A_NSW_candidates.json"
    assert paths.first_folder([None, "a", "b"], lambda f: f == "b") == "b" and paths.first_folder(["", "a"], lambda f: False) == "a"
    with pytest.raises(FileNotFoundError):
        files.vector_source(spark, f"file://{tmp_path}", ["x.geojson"])
    base = f"file://{tmp_path}/w"
    files.write_weights(spark, base, "m", [0.5, 1.0], [2])
    assert files.read_weights(spark, base, "m", [2]) == [0.5, 1.0]
    for name, shape in (("m", [1, 2]), ("n", [2])):
        with pytest.raises(ValueError):
            files.read_weights(spark, base, name, shape)
    with pytest.raises(ValueError):
        files.require_fresh(spark, f"file://{tmp_path}/none", [base])
    collection = tmp_path / "c.geojson"
    collection.write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "LineString", "coordinates": [[0, 1], [2, 3.5]]}}]}')
    assert [(r.name, r.coordinates) for r in files.read_geojson(spark, f"file://{collection}", "name string").collect()] == [("a", [[0.0, 1.0], [2.0, 3.5]])]
    nested = tmp_path / "n.json"
    nested.write_text('[{"timestamp": "t", "original_coords": [1, 2], "projected_coords": [null, null], "candidates": []}, {"timestamp": "u", "candidates": [{"edge_id": ["1", "2", "0"], "dist_m": 3.5, "layer": -1}]}]')
    assert [(r.timestamp, r.dist_m, r.layer) for r in files.read_candidates(spark, f"file://{nested}").orderBy("ping_index").collect()] == [("t", None, None), ("u", 3.5, -1)]


def test_trajectories_keep_ids_as_text_and_one_kind_of_missing(spark, tmp_path):
    names = [f.name for f in files.TRAJECTORY.fields]
    row = dict.fromkeys(names, "") | {"truck_id": "007", "timestamp": "3", "node_id": "12.0", "obs_x": "NaN", "obs_y": "5.5", "hdop": "1.2", "quality_state": "open_sky"}
    (tmp_path / "t.csv").write_text(",".join(names) + "\n" + ",".join(row[n] for n in names) + "\n")
    r = files.read_trajectories(spark, f"file://{tmp_path}/t.csv").first()
    assert (r.truck_id, r.timestamp, r.node_id, r.obs_x, r.obs_y, r.edge_key) == ("007", 3, "12.0", None, 5.5, None)


def test_wrong_times_and_incomplete_records_raise(spark):
    rows = spark.createDataFrame([("2024-01-02T03:04:05", 1), (None, 2)], "t string, n int")
    assert [str(r[0]) for r in rows.select(S.moment(F.col("t"))).collect()] == ["2024-01-02 03:04:05", "None"]
    for bad in (rows.select(S.moment(F.concat("t", F.lit("x")))), rows.select(S.require(["t", "n"], F.lit("fine")))):
        with pytest.raises(Exception, match="not a time|lacks one"):
            bad.collect()


def test_routes_end_although_sums_differ_in_their_last_bits(spark):
    rng = np.random.default_rng(9)
    edges = [(i, (i + s) % 12, 0, float(rng.random())) for i in range(12) for s in (1, 5)]
    got = {(r.src, r.dst): r.dist for r in graph.routes(spark.createDataFrame(edges, "u long, v long, k int, length double"), 2.0).collect()}
    best = np.full((12, 12), np.inf)
    np.fill_diagonal(best, 0)
    for u, v, _, n in edges:
        best[u, v] = min(best[u, v], n)
    for m in range(12):
        best = np.minimum(best, best[:, [m]] + best[[m]])
    assert got == {(u, v): pytest.approx(best[u, v]) for u in range(12) for v in range(12) if best[u, v] <= 2.0}


def test_learners_keep_rows_that_repeat_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [([float(a), float(b)], int(a + b < 0.1), str(i % 15)) for i, (a, b) in enumerate(np.round(rng.uniform(-1, 1, (200, 2)), 1))]
    df, kept = spark.createDataFrame(rows, "features array<double>, label int, group string"), []
    plain = learners.stored

    def stored(held, label):
        out = plain(held, label)
        kept.append(out.count())
        return out

    monkeypatch.setattr(learners, "stored", stored)
    many = df.crossJoin(spark.range(30))
    for fit in (lambda t: learners.tuned_network(t, rounds=10, networks=[((4,), 1e-4)]), lambda t: learners.tuned_kernel_machine(t, size=16, rounds=40, kernels=[(1.0, None)])):
        (_, once), (_, often) = fit(df), fit(many)
        assert once[0][2] == pytest.approx(often[0][2], abs=0.05)
    assert kept[0] == kept[1] <= 200 and kept[2] == kept[3] == kept[0]

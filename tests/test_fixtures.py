"""Hand-derived values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadloom.functions import features as X
from roadloom.functions import scalars as S
from roadloom.operators import circuits, decode, geo, graph, sequence, stats, training


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_features_and_scalars(spark):
    f = X.edge_features(F.lit(100), F.lit(0), F.lit(100), F.lit(-1), F.lit(2), F.lit(0), F.lit(1), F.lit(0), F.lit(0.5))
    assert one(spark, f)[0] == pytest.approx([0.2, 0, 0.818182, 0.25, 0.25, 0, 1, 0, 0.5], abs=1e-6)
    t = X.transition_features(F.lit(-1.0), F.lit(0.0), F.lit(100.0), F.lit(30.0), F.lit(210.0), F.lit(0.0), F.lit(0.0))
    assert one(spark, t)[0] == pytest.approx([1 / 3, 0.7, 1, 0], abs=1e-6)
    assert one(spark, S.degradation(F.lit(1.5), F.lit(7)))[0] == pytest.approx(0.299433, abs=1e-6)
    assert X.start_weights(3) == pytest.approx([-0.033775, 0.049809, -0.039680], abs=1e-6)
    ts = F.lit("2026-05-26 08:30:00").cast("timestamp")
    assert one(spark, *S.traffic_regime(ts), *S.calendar(ts)) == ("AM_PEAK", 1.0, 1 / 6, 4 / 11)
    assert one(spark, *[S.flag(F.lit(v)) for v in ("1.0", "nan", "inf", "Yes", "maybe", None)]) == (True, False, False, True, False, False)
    assert one(spark, S.speed_mps(F.lit("30 mph")))[0] == pytest.approx(30 * 1.609344 / 3.6)


def fixes(spark, xs):
    return spark.createDataFrame([(1, i, float(i), x, x) for i, x in enumerate(xs)], "track_id long, event_id long, t_s double, obs_x double, obs_y double")


@pytest.mark.parametrize(
    ("xs", "want"),
    [([0.0, 10.0, None, None, 40.0], [0, 10, 20, 30, 40]), ([None, 10.0, None], [None, 10, 10]), ([0.0, 10.0, None, 25.0, None, None], [0, 10, 20, 25, 30, 35])],
)
def test_imputation(spark, xs, want):
    rows = sequence.impute(fixes(spark, xs)).orderBy("event_id").collect()
    assert [r.eff_x for r in rows] == want


def test_statistics(spark):
    tests = spark.createDataFrame([("f", 0, 0.01), ("f", 1, 0.04), ("f", 2, 0.03)], "g string, i int, p double")
    assert [round(r.p_holm, 6) for r in stats.holm(tests, "p", "g").orderBy("i").collect()] == [0.03, 0.06, 0.06]
    gains = spark.createDataFrame([("a", v) for v in (1.0, -2.0, 3.0, 4.0)], "g string, x double")
    assert stats.rank_biserial(gains, "x", "g").first().rank_biserial == pytest.approx(0.6)
    assert stats.hodges_lehmann(gains, "x", "g").first().hodges_lehmann == 1.5
    # All 16 sign patterns of ranks 1..4, counted.
    assert stats.exact_wilcoxon_p(np.array([1.0, -2.0, 3.0, 4.0])) == pytest.approx(2 * 3 / 16)
    assert stats.exact_wilcoxon_p(np.zeros(3)) == 1.0


def test_circuit_against_matrices():
    """Three wires, full matrices."""
    rng = np.random.default_rng(1)
    x, w = rng.random((4, 3)), rng.normal(size=(2, 3, 3))
    on = lambda m, q: np.kron(np.kron(np.eye(2**q), m), np.eye(2 ** (2 - q)))

    def cnot(c, t):
        m = np.zeros((8, 8))
        for i in range(8):
            m[i ^ (1 << (2 - t)) if i >> (2 - c) & 1 else i, i] = 1
        return m

    want = []
    for row in x:
        s = np.eye(8)[0].astype(complex)
        for layer in range(2):
            for q in range(3):
                a = np.pi * row[q] / 2
                s = on(np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]), q) @ s
            for q in range(3):
                s = on(circuits._rot(*w[layer, q]), q) @ s
            for q in range(3):
                s = cnot(q, (q + 1) % 3) @ s
        p = abs(s) ** 2
        want.append(np.mean([sum(p[i] * (1 - 2 * (i >> (2 - q) & 1)) for i in range(8)) for q in (0, 2)]))
    assert circuits.expectation(x, w, [0, 2]) == pytest.approx(want)
    step = 1e-5
    v = w.copy()
    v[1, 2, 0] += step
    slope = (circuits.expectation(x, v, [0, 2]) - circuits.expectation(x, w, [0, 2])) / step
    assert circuits.gradient(x, w, [0, 2])[:, 15] == pytest.approx(slope, abs=1e-4)


def test_product_circuit_is_the_circuit_without_entanglement(spark):
    w = X.start_weights(54, scale=0.7)
    f = [0.1 * i for i in range(9)]
    z = one(spark, X.product_circuit(F.array(*[F.lit(v) for v in f]), w, 9, 2, [0, 3, 6]))[0]
    assert z == pytest.approx(circuits.expectation(np.array([f]), np.array(w).reshape(2, 9, 3), [0, 3, 6], entangle=False)[0])


def test_path_against_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(20):
        steps = pd.DataFrame([(s, s + 100, e, rng.normal()) for s in range(1, 6) for e in (1, 2, 3)], columns=["step", "event_id", "edge", "emit"])
        pairs = pd.DataFrame([(s, a, b, rng.random() if rng.random() < 0.8 or a == b else 0.0) for s in range(2, 6) for a in (1, 2, 3) for b in (1, 2, 3)], columns=["step", "edge_a", "edge_b", "potential"])
        emit, pot = steps.set_index(["step", "edge"]).emit.to_dict(), pairs.set_index(["step", "edge_a", "edge_b"]).potential.to_dict()
        best, stack = -math.inf, [((e,), emit[1, e]) for e in (1, 2, 3)]
        while stack:
            path, score = stack.pop()
            if len(path) == 5:
                best = max(best, score)
                continue
            s = len(path) + 1
            stack += [((*path, e), score + math.log(pot[s, path[-1], e]) + emit[s, e]) for e in (1, 2, 3) if pot[s, path[-1], e] > 0]
        got = decode.best_path(steps, pairs, None)
        assert got[-1][2] == pytest.approx(best) and not any(g[3] for g in got)


def test_path_starts_anew_where_nothing_is_reached():
    steps = pd.DataFrame([(1, 1, 1, 0.0), (2, 2, 2, 0.0), (3, 3, 2, 0.0)], columns=["step", "event_id", "edge", "emit"])
    pairs = pd.DataFrame([(3, 2, 2, 1.0)], columns=["step", "edge_a", "edge_b", "potential"])
    assert [(e, b) for _, e, _, b in decode.best_path(steps, pairs, 30)] == [(1, False), (2, True), (2, False)]


def test_wkt_projection_and_routes(spark):
    edges = spark.createDataFrame([(1, 2, 0, 20.0, "LINESTRING (0 0, 10 0, 10 10)"), (2, 3, 0, 5.0, None), (2, 3, 1, 4.0, None)], "u long, v long, k int, length double, wkt string")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0), (3, 10.0, 15.0)], "node_id long, x double, y double")
    pieces = geo.segments(geo.with_points(edges, nodes, "wkt"))
    fix = spark.createDataFrame([(7, 12.0, 4.0)], "event_id long, obs_x double, obs_y double")
    near = geo.candidates(fix, pieces, radius=3.0).first()
    assert (near.u, near.px, near.py, near.arc, near.dist) == (1, 10.0, 4.0, 14.0, 2.0)
    got = {(r.src, r.dst): r.dist for r in graph.routes(edges, 100.0).collect()}
    assert got[1, 3] == 24.0 and (3, 1) not in got and (1, 3) not in {(r.src, r.dst) for r in graph.routes(edges, 20.0).collect()}


def test_training_ranks():
    rng = np.random.default_rng(0)
    good, bad = rng.random((200, 3)) + [0.5, 0, 0], rng.random((200, 3))
    score = lambda x, w: np.tanh(x @ w)
    slope = lambda x, w: (1 - np.tanh(x @ w) ** 2)[:, None] * x
    w, loss = training.train_ranker(good, bad, np.zeros(3), score, slope)
    assert w[0] > 0.3 and loss < 0.2

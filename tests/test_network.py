"""Routes and decoding beyond any fixed bound."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.operators import decode, geo, graph, hubs, training
from roadloom.plans import decoding
from roadloom.sources.shared import stored


def test_routes_between_have_no_bound_and_miss_only_unreachable_pairs(spark):
    edges = spark.createDataFrame([(i, i + 1, 0, 700.0) for i in range(6)] + [(0, 1, 1, 900.0), (9, 8, 0, 5.0)], "u long, v long, k long, length double")
    pairs = spark.createDataFrame([(0, 1), (0, 6), (3, 3), (6, 0), (0, 8), (77, 0)], "src long, dst long")
    want = {(0, 1, 700.0), (0, 6, 4200.0), (3, 3, 0.0)}
    assert {tuple(r) for r in graph.routes_between(edges, pairs).collect()} == want
    assert {tuple(r) for r in graph.routes_between(edges, pairs, most_links=3).collect()} == want  # by joins
    assert {(r.src, r.dst) for r in graph.reachable(edges, pairs).collect() if r.reachable} == {(a, b) for a, b, _ in want}


def test_viterbi_goes_on_over_long_routes_and_keeps_every_candidate(spark):
    sf = "/root/testdata/sf0.001"
    steps = stored(decoding.steps(spark, sf), "steps")
    assert steps.agg(F.max("rank")).first()[0] > 8
    row = "track_id long, segment long, step int, edge long, u long, v long, arc double, line_length double, ox double, oy double, tx double, ty double, moved double, reliability double"
    two = [(1, 0, 1, 1, 0, 1, 50.0, 50.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), (1, 0, 2, 2, 2, 3, 0.0, 50.0, 650.0, 0.0, 1.0, 0.0, 650.0, 0.0)]
    cands = spark.createDataFrame(two, row)
    edges = spark.createDataFrame([(0, 1, 0, 50.0), (1, 2, 0, 700.0), (2, 3, 0, 50.0)], "u long, v long, k long, length double")
    got = decode.pair_potentials(cands, graph.routes_between(edges, decode.node_pairs(cands))).first()
    assert got.route == 700.0 and math.isclose(got.potential, math.exp(-1))


def test_wilcoxon_takes_the_reference_number_of_draws(spark, monkeypatch):
    from roadloom.operators import stats
    from roadloom.plans import evaluation

    taken, kept = [], stats.bootstrap_interval
    monkeypatch.setattr(stats, "bootstrap_interval", lambda *a, draws=2000, **k: taken.append(draws) or kept(*a, draws=5, **k))
    evaluation.x1_wilcoxon(spark, "/root/testdata/sf0.001")
    assert taken == [2000]


def test_tangent_and_length_follow_a_polyline(spark):
    line = "array(named_struct('x', 0d, 'y', 0d), named_struct('x', 100d, 'y', 0d), named_struct('x', 100d, 'y', 0d), named_struct('x', 100d, 'y', 50d))"
    rows = spark.sql(f"select {line} points, explode(array(0d, 50d, 100d, 120d, 150d)) arc").withColumn("n", geo.line_length(F.col("points")))
    got = rows.withColumn("t", geo.tangent(F.col("points"), F.col("arc"), F.col("n"))).orderBy("arc").collect()
    half = math.sqrt(0.5)
    assert [r.n for r in got] == [150.0] * 5
    assert all(math.isclose(r.t.tx, x, abs_tol=1e-12) and math.isclose(r.t.ty, y, abs_tol=1e-12) for r, (x, y) in zip(got, [(1, 0), (1, 0), (half, half), (0, 1), (0, 1)], strict=True))
    dot = spark.sql("select array(named_struct('x', 1d, 'y', 1d)) points").select(geo.line_length(F.col("points")).alias("n"), geo.tangent(F.col("points"), F.lit(0.0), F.lit(0.0)).alias("t")).first()
    assert dot.n == 0 and dot.t.tx is None


def dijkstra(links, src):
    out, heap, done = {}, [(0.0, src)], {}
    for a, b, n in links:
        out.setdefault(a, []).append((b, n))
    while heap:
        dist, node = heapq.heappop(heap)
        if node in done:
            continue
        done[node] = dist
        for to, n in out.get(node, ()):
            heapq.heappush(heap, (dist + n, to))
    return done


@pytest.mark.parametrize("core", [1000, 12])
def test_hub_labels_give_all_shortest_distances(spark, core):
    """A grid of uneven lengths with one-way links, parallel links, loops, far links, an island and a dead end."""
    rng = np.random.default_rng(5)
    w = 6
    links = [(a, b, float(rng.integers(1, 90))) for a in range(w * w) for b in (a + 1, a + w, a - 1, a - w) if 0 <= b < w * w and (abs(a - b) == w or a // w == b // w) and rng.random() < 0.8]
    links += [(3, 30, 7.5), (3, 30, 9.0), (35, 0, 400.0), (4, 4, 1.0), (100, 101, 2.0), (101, 100, 3.0), (5, 200, 1.0)]
    df = spark.createDataFrame(links, "src long, dst long, length double")
    nodes = sorted({x for a, b, _ in links for x in (a, b)})
    outward, inward = hubs.labels(df.union(spark.createDataFrame([(7, None, 1.0), (None, 8, 1.0), (9, 10, None)], df.schema)), core=core)
    pairs = spark.createDataFrame([(a, b) for a in nodes for b in nodes], "src long, dst long")
    got = {(r.src, r.dst): r.dist for r in hubs.distances(outward, inward, pairs).collect()}
    want = {(a, b): dist for a in nodes for b, dist in dijkstra(links, a).items()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)


def test_hub_labels_of_few_nodes(spark):
    none = spark.createDataFrame([], "src long, dst long, length double")
    assert hubs.labels(none)[0].count() == 0
    alone = spark.createDataFrame([(1, 1, 5.0)], "src long, dst long, length double")
    outward, inward = hubs.labels(alone)
    assert [tuple(r) for r in hubs.distances(outward, inward, alone.select("src", "dst")).collect()] == [(1, 1, 0.0)]


def test_a_crowded_cell_is_dealt_over_tasks(spark):
    """Nine tenths of the fixes stand in one cell: the rows are those of the undivided join, and no task has them all."""
    pieces = geo.segments(spark.createDataFrame([(i, i + 1, 0, [(50.0 * i, 0.0), (50.0 * i + 50, 3.0)]) for i in range(40)], "u long, v long, k int, points array<struct<x:double,y:double>>"))
    fixes = spark.range(2000).selectExpr("id as event_id", "case when id % 10 > 0 then 70.0 + id % 7 else id % 1900 + 0.5 end as obs_x", "cast(id % 11 as double) as obs_y")
    whole = geo.range_join(fixes, pieces)
    parts = geo.range_join(fixes, pieces, busy=100).withColumn("task", F.spark_partition_id())
    rows = lambda df: sorted((r.event_id, r.u, r.v, r.k, r.dist, r.arc) for r in df.collect())
    assert rows(parts) == rows(whole)
    crowd = fixes.where("obs_x >= 0 and obs_x < 120").count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        parts = geo.range_join(fixes, pieces, busy=100).select("event_id", F.spark_partition_id().alias("task"))
        most = parts.distinct().groupBy("task").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert crowd > 1700 and most < crowd / 3


def test_leading_fixes_without_a_position_are_decoded_as_over_all_edges(spark):
    """The implicit any-edge state against a trellis that holds every edge, on a small network with ties, dead ends and a track that is never seen."""
    rng = np.random.default_rng(9)
    ends = [(int(u), int(v)) for u, v in rng.integers(0, 9, (24, 2)) if u != v]
    edges = [(10 * i + 7, u, v) for i, (u, v) in enumerate(ends)]
    links = [(u, v, 50.0) for u, v in ends]
    hop = {n: dijkstra(links, n) for n in range(9)}
    lost, cands, pairs, every, joined = [], [], [], [], []
    for track, (dark, light) in enumerate([(3, 4), (1, 2), (0, 3), (2, 0), (4, 3)]):
        before: list = []
        for s in range(1, dark + light + 1):
            if s <= dark:
                own = [(e, decode.ANY_EDGE) for e, _, _ in edges]
                lost.append((track, 1, 100 * track + s, s))
            else:
                own = [(int(e), float(-rng.random())) for e in sorted(rng.choice([e for e, _, _ in edges], 4, replace=False))]
                cands += [(track, 1, s, 100 * track + s, e, x) for e, x in own]
            every += [(track, 1, s, 100 * track + s, e, x) for e, x in own]
            for a, _ in before:
                for b, _ in own:
                    (_, _, v), (_, u, _) = (next(x for x in edges if x[0] == e) for e in (a, b))
                    if s <= dark + 1:
                        p = 1.0 if a == b else math.exp(-hop[v][u] / 50) if u in hop[v] else 0.0
                    else:
                        p = 0.0 if (track, s) == (4, 6) else float(rng.random())  # the last track breaks once
                        pairs.append((track, 1, s, a, b, p))
                    joined.append((track, 1, s, a, b, p))
            before = own
    step, pair = "track_id long, segment long, step int, event_id long, edge long, emit double", "track_id long, segment long, step int, edge_a long, edge_b long, potential double"
    seen = spark.createDataFrame(cands, step)
    path = decode.viterbi(seen, spark.createDataFrame(pairs, pair), beam=None).join(seen.select("event_id", "step").distinct(), "event_id")
    got = decode.with_leading(path, spark.createDataFrame(lost, "track_id long, segment long, event_id long, step int"), spark.createDataFrame(edges, "edge long, u long, v long"))
    want = decode.viterbi(spark.createDataFrame(every, step), spark.createDataFrame(joined, pair), beam=None)
    rows = lambda df: sorted((r.track_id, r.event_id, r.edge, round(r.score, 6), r.broken) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) == 22 and any(r[4] for r in rows(got))


def test_pairs_made_step_by_step_decode_to_the_same_rows(spark, monkeypatch):
    import random

    r, rows = random.Random(4), []
    for track in range(6):
        for step in range(1, 9):
            if (track, step) == (3, 5):
                continue  # a step without any candidate
            place, moved, trust = (r.random() * 50, r.random() * 50), r.random() * 40, r.random()  # of the fix
            for edge in sorted(r.sample(range(12), r.randint(1, 5))):
                rows.append((track, track % 2, step, 100 * track + step, edge, r.uniform(-5, 0), edge % 4, edge % 5, r.random() * 50, 50.0, *place, 0.6, 0.8, moved, trust))
    cands = spark.createDataFrame(rows, "track_id long, segment long, step int, event_id long, edge long, emit double, u long, v long, arc double, line_length double, ox double, oy double, tx double, ty double, moved double, reliability double")
    hops = spark.createDataFrame([(s, t, 10.0 * (s + t)) for s in range(5) for t in range(4) if (s * 3 + t) % 4], "src long, dst long, dist double")
    for beam in (None, 2):
        want = sorted(tuple(x) for x in decode.viterbi(cands, decode.pair_potentials(cands, hops), beam).collect())
        assert len(want) == 47 and any(x.broken for x in decode.viterbi_by_step(cands, hops, beam).collect())
        assert sorted(tuple(x) for x in decode.viterbi_by_step(cands, hops, beam).collect()) == want
        with monkeypatch.context() as m:
            m.setattr(decode, "MOST_HOPS", 0)
            assert sorted(tuple(x) for x in decode.viterbi_by_step(cands, hops, beam).collect()) == want
    plan = decode.pairs_by_step(cands, hops)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # candidates move once, pairs never


def test_tangents_in_steps(spark):
    lines = spark.sql("select array(named_struct('x', 0d, 'y', 0d), named_struct('x', 30d, 'y', 40d)) points union all select array(named_struct('x', 0d, 'y', 0d), named_struct('x', 10d, 'y', 0d), named_struct('x', 10d, 'y', 10d)) union all select array(named_struct('x', 1d, 'y', 1d), named_struct('x', 1d, 'y', 1d))")
    rows = lines.withColumn("n", geo.line_length(F.col("points"))).withColumn("arc", F.explode(F.array(*[F.lit(x) for x in (0.0, 9.8, 10.0, 15.0, 50.0)])))
    got = geo.with_tangent(rows, "points", "arc", "n").withColumn("t", geo.tangent(F.col("points"), F.col("arc"), F.col("n"))).collect()
    assert len(got) == 15 and all((g.tx is None and g.t.tx is None and g.ty is None) or (g.tx == pytest.approx(g.t.tx) and g.ty == pytest.approx(g.t.ty)) for g in got)


def test_candidates_stay_beside_their_fix(spark):
    """Bent edges, parallel ones and repeated fixes against brute force; and of the candidates none is sorted, windowed or shuffled: only fixes and pieces are."""
    lines = [(i, i + 1, k, [(40.0 * i, 0.0), (40.0 * i + 20, 15.0 * (i % 3)), (40.0 * i + 40, 0.0)]) for i in range(20) for k in (0, 1)]
    pieces = geo.segments(spark.createDataFrame(lines, "u long, v long, k int, points array<struct<x:double,y:double>>"))
    fixes = spark.range(400).selectExpr("id div 2 as event_id", "(id div 2) * 4.0D + 0.5D as obs_x", "cast((id div 2) % 90 as double) as obs_y")
    own = pieces.collect()

    def apart(x, y, p):
        t = max(0, min(1, ((x - p.x0) * (p.x1 - p.x0) + (y - p.y0) * (p.y1 - p.y0)) / ((p.x1 - p.x0) ** 2 + (p.y1 - p.y0) ** 2)))
        return math.sqrt((x - p.x0 - t * (p.x1 - p.x0)) ** 2 + (y - p.y0 - t * (p.y1 - p.y0)) ** 2)

    lists = geo.near_lists(fixes, pieces.withColumn("name", F.concat("u", "k")), busy=50, carry=("name",))
    got = {r.event_id: [(n.u, n.v, n.k, n.name) for n in r.near] for r in lists.collect()}
    assert lists.count() == len(got) == 200
    for r in fixes.distinct().collect():
        best = {}
        for p in own:
            best[p.u, p.v, p.k] = min(best.get((p.u, p.v, p.k), math.inf), apart(r.obs_x, r.obs_y, p))
        want = sorted((dist, *e) for e, dist in best.items() if dist <= 60)
        assert got[r.event_id] == [(*e, f"{e[0]}{e[2]}") for _, *e in want]
    plan = geo.range_join(fixes, pieces)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("RepartitionByExpression") and "Window" not in plan[: plan.index("MapInArrow")]


def test_pairs_and_examples_of_lists_are_those_of_rows(spark):
    rows = [(e, e % 3, u, u + 1, 0, float((u * 7 + e) % 5), [float(u), float(e)], u == e % 6) for e in range(30) for u in range(1, 6 + e % 3)]
    cands = spark.createDataFrame(rows, "event_id long, track_id long, u long, v long, k int, dist double, f array<double>, is_true boolean")
    lists = cands.groupBy("event_id", "track_id").agg(F.sort_array(F.collect_list(F.struct("dist", "u", "v", "k", "f", "is_true"))).alias("near"))
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 0
    assert same(training.ranking_pairs_of(lists, "event_id"), training.ranking_pairs(cands, F.col("is_true"), "event_id"))
    assert same(training.supervised_of(lists, "event_id", lambda n: n["f"]), training.supervised(cands, F.col("is_true"), "event_id"))


def test_pairs_of_nodes_from_some_candidates_only(spark):
    cands = spark.createDataFrame([(1, 1, s, e, e, e + 10, e == s) for s in (1, 2) for e in range(3)], "track_id long, segment long, step int, edge long, u long, v long, is_true boolean")
    got = {tuple(r) for r in decode.node_pairs(cands, cands.where("is_true")).collect()}
    assert got == {(11, 0), (11, 1), (11, 2)} and len(decode.node_pairs(cands).collect()) == 9


def test_a_network_without_small_separators_is_searched(spark, monkeypatch):
    from roadloom.operators import graph

    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), float(n)) for a, b, n in zip(np.tile(np.arange(120), 6), rng.integers(0, 120, 720), rng.integers(1, 90, 720)) if a != b]
    edges = spark.createDataFrame(rows, "u long, v long, length double")
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 125, (60, 2))], "src long, dst long")
    monkeypatch.setattr(hubs, "CORE", 30)
    assert hubs.labels(graph.links(edges), core=8, dense=16) is None
    got = {tuple(r) for r in graph.labelled_routes(edges, pairs, core=8).collect()}
    assert got == {tuple(r) for r in graph.routes_between(edges, pairs).collect()} and len(got) > 30

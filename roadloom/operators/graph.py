"""Road graph operators: bounded routes, components, degrees, level transitions, match classes."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.scalars import node_id, whole_key
from roadloom.operators import hubs
from roadloom.sources.shared import stored


def links(edges: DataFrame) -> DataFrame:
    """src, dst, length: parallel edges are one link of the least length."""
    return edges.groupBy(F.col("u").alias("src"), F.col("v").alias("dst")).agg(F.min("length").alias("length"))


def routes(edges: DataFrame, bound: float) -> DataFrame:
    """src, dst, dist: shortest directed distances up to `bound`, by doubling: each round joins paths to paths, so
    paths of n links need about log2(n) rounds. It ends when a round finds no new and no shorter path."""
    nodes = edges.select(F.col("u").alias("src")).union(edges.select("v")).distinct()
    itself = nodes.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("dist"))
    best = stored(itself.union(links(edges).where(F.col("length") <= bound)).groupBy("src", "dst").agg(F.min("dist").alias("dist")).withColumn("better", F.lit(True)), "routes")
    while True:
        on = best.select(F.col("src").alias("dst"), F.col("dst").alias("__to"), F.col("dist").alias("__d"))
        longer = best.join(on, "dst").select("src", F.col("__to").alias("dst"), (F.col("dist") + F.col("__d")).alias("dist"), F.lit(None).cast("double").alias("was")).where(F.col("dist") <= bound)
        every = longer.union(best.select("src", "dst", "dist", F.col("dist").alias("was"))).groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("was").alias("was"))
        # Sums of the same links in another order differ in their last bits: that is no shorter path.
        better = F.col("was").isNull() | (F.col("dist") < F.col("was") - 1e-9 * F.col("was"))
        best = stored(every.select("src", "dst", F.when(better, F.col("dist")).otherwise(F.col("was")).alias("dist"), better.alias("better")), "routes")
        if not best.where("better").take(1):
            return best.drop("better")


def shortest(out: dict[int, list[tuple[int, float]]], src: int, wanted: Iterable[int]) -> dict[int, float]:
    """Distances from src to those of the wanted nodes that it reaches, without a bound."""
    left, heap, done, found = set(wanted), [(0.0, src)], set(), {}
    while heap and left:
        dist, node = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        if node in left:
            left.discard(node)
            found[node] = dist
        for to, length in out.get(node, ()):
            if to not in done:
                heapq.heappush(heap, (dist + length, to))
    return found


def routes_between(edges: DataFrame, pairs: DataFrame, most_links: int = 500_000) -> DataFrame:
    """src, dst, dist of the reachable ones of the wanted pairs (src, dst), whatever their distance.

    A network of up to `most_links` links is broadcast and searched once for each src; a larger one gets hub labels, and the pairs join theirs. Both
    give the same rows; labels that are asked more than once are better kept, by `hubs.labels`.
    """
    net = links(edges)
    wanted = pairs.select("src", "dst").distinct()
    if net.count() > most_links:
        return hubs.distances(*hubs.labels(net), wanted)
    return _searched(net, wanted)


#: Links a node of what contracting leaves, beyond which a network that can be searched gets no hub labels.
DENSE = 16


def labelled_routes(edges: DataFrame, pairs: DataFrame, core: int = hubs.CORE, most_links: int = 500_000) -> DataFrame:
    """`routes_between` by hub labels, but for a network without small separators, whose labels would be as many as pairs of nodes: that is searched while it can be broadcast."""
    net = links(edges)
    wanted = pairs.select("src", "dst").distinct()
    held = hubs.labels(net, core=core, dense=DENSE if net.count() <= most_links else None)
    return _searched(net, wanted) if held is None else hubs.distances(*held, wanted)


def _searched(net: DataFrame, wanted: DataFrame) -> DataFrame:
    """src, dst, dist of wanted pairs, by one search of the broadcast network for each src."""
    out: dict[int, list[tuple[int, float]]] = {}
    for r in net.collect():
        out.setdefault(r["src"], []).append((r["dst"], r["length"]))
    held = net.sparkSession.sparkContext.broadcast(out)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        src = pdf["src"].iloc[0]
        return pd.DataFrame([(src, dst, dist) for dst, dist in shortest(held.value, int(src), pdf["dst"].tolist()).items()], columns=["src", "dst", "dist"])

    # A count of its own: the pairs are few bytes, and would be joined to one task.
    parts = int(net.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return wanted.repartition(parts, "src").groupBy("src").applyInPandas(search, "src long, dst long, dist double")


def reachable(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """src, dst and whether any way leads there; every wanted pair keeps a row."""
    ways = routes_between(edges, pairs)
    return pairs.select("src", "dst").distinct().join(ways, ["src", "dst"], "left").select("src", "dst", F.col("dist").isNotNull().alias("reachable"))


def true_edges(fixes: DataFrame, edges: DataFrame, u: Column, v: Column, key: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """fixes plus u, v, k, and the edges' columns that `carry` names, of the edge of exactly this identity (ends as text, key a whole number), null where there is none: never a parallel or a reverse one."""
    known = edges.select(F.col("u").cast("string").alias("__u"), F.col("v").cast("string").alias("__v"), F.col("k").alias("__k"), "u", "v", "k", *carry)
    held = fixes.withColumns({"__tu": node_id(u), "__tv": node_id(v), "__tk": whole_key(key)})
    same = (F.col("__tu") == F.col("__u")) & (F.col("__tv") == F.col("__v")) & (F.col("__tk") == F.col("__k"))
    return held.join(known, same, "left").drop("__tu", "__tv", "__tk", "__u", "__v", "__k")


def components(edges: DataFrame) -> DataFrame:
    """node_id, component: weakly connected components by least node, with pointer jumping."""
    pair = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    both = stored(pair.union(pair.select("b", "a")).distinct(), "wcc-links")
    label = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).select(F.col("a").alias("node_id"), F.col("c").alias("component")), "wcc")
    while True:
        near = both.join(label.withColumnsRenamed({"node_id": "b", "component": "__c"}), "b").groupBy("a").agg(F.min("__c").alias("__c"))
        nxt = label.join(near.withColumnRenamed("a", "node_id"), "node_id").select("node_id", F.least("component", "__c").alias("component"), F.col("component").alias("__before"))
        up = nxt.select(F.col("node_id").alias("component"), F.col("component").alias("__up"))
        nxt = stored(nxt.join(up, "component", "left").select("node_id", F.coalesce("__up", "component").alias("component"), "__before"), "wcc")
        moved = nxt.where("component <> __before").take(1)
        label = nxt.select("node_id", "component")
        if not moved:
            return label


def degrees(edges: DataFrame) -> DataFrame:
    """node_id, degree (in and out together), junction (3 neighbours or more)."""
    ends = edges.select(F.col("u").alias("node_id"), F.col("v").alias("other")).union(edges.select("v", "u"))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"), F.count_distinct("other").alias("neighbours")).withColumn("junction", F.col("neighbours") >= 3)


def without_isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("u").alias("node_id")).union(edges.select("v")).distinct()
    return nodes.join(ends, "node_id", "left_semi")


def level_transitions(edges: DataFrame, smoothing: float = 0.05, diagonal: float = 2.0) -> DataFrame:
    """from_level, to_level, p: turns from edge to edge at their common node, smoothed and normalised by row.

    Edges are counted by (node, level) before they meet, so a busy node costs the square of its levels, not of its edges.
    """
    into = edges.groupBy(F.col("v").alias("node"), F.col("layer").alias("from_level")).agg(F.count("*").alias("a"))
    out = edges.groupBy(F.col("u").alias("node"), F.col("layer").alias("to_level")).agg(F.count("*").alias("b"))
    turns = into.join(out, "node").groupBy("from_level", "to_level").agg(F.sum(F.col("a") * F.col("b")).alias("n"))
    levels = edges.select(F.col("layer").alias("from_level")).distinct()
    every = levels.crossJoin(levels.withColumnRenamed("from_level", "to_level"))  # a handful of levels
    held = every.join(turns, ["from_level", "to_level"], "left")
    count = F.coalesce("n", F.lit(0)) + F.lit(smoothing) + F.when(F.col("from_level") == F.col("to_level"), F.lit(diagonal)).otherwise(F.lit(0.0))
    held = held.withColumn("c", count)
    total = held.groupBy("from_level").agg(F.sum("c").alias("t"))
    return held.join(F.broadcast(total), "from_level").select("from_level", "to_level", (F.col("c") / F.col("t")).alias("p"))


def one_sided(edges: DataFrame) -> DataFrame:
    """Edges that have no edge back."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).distinct()
    return edges.join(back, ["u", "v"], "left_anti")


def first_exit(edges: DataFrame, inside: Column, most: int = 20) -> DataFrame:
    """u, v, k of each edge inside (a tunnel, say), with the fewest further edges until one outside, `most` at most; null beyond."""
    held = stored(edges.select("u", "v", "k", F.coalesce(inside, F.lit(False)).alias("inside")), "exit-edges")
    reach = held.where("not inside").select(F.col("u").alias("node")).distinct().withColumn("steps", F.lit(1))
    found, front = reach, reach
    links_in = held.where("inside").select("u", "v").distinct()
    for s in range(2, most + 1):
        front = links_in.join(front.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node")).distinct().withColumn("steps", F.lit(s))
        front = stored(front.join(found.select("node"), "node", "left_anti"), "exit-front")
        if not front.take(1):
            break
        found = stored(found.union(front), "exit-found")
    return held.where("inside").join(found.withColumnRenamed("node", "v"), "v", "left").select("u", "v", "k", "steps")


def match_class(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> dict[str, Column]:
    """How a matched edge (u, v, k) stands to the true one."""
    carriageway = (a[0] == b[0]) & (a[1] == b[1])
    reverse = (a[0] == b[1]) & (a[1] == b[0])
    return {
        "exact": carriageway & (a[2] == b[2]),
        "carriageway": carriageway,
        "reverse": reverse,
        "physical": carriageway | reverse,
        "relaxed": carriageway | (a[0] == b[1]) | (a[1] == b[0]),
    }


def route_distance(same_edge: Column, arc_a: Column, arc_b: Column, length_a: Column, hop: Column) -> Column:
    """Directed distance between two projected points: forward progress on one edge, else rest + hop + offset; null without a route."""
    return F.when(same_edge, F.greatest(arc_b - arc_a, F.lit(0.0))).otherwise(F.greatest(length_a - arc_a, F.lit(0.0)) + hop + arc_b)


def route_geometry(ids: DataFrame, lines: DataFrame) -> DataFrame:
    """ids (u, v and what to carry along) plus points and `way`: the line of the edge u-v (the least key), else that of v-u, else none."""
    best = lines.groupBy("u", "v").agg(F.min_by("points", "k").alias("points"))
    there = best.select(F.col("u").alias("__u"), F.col("v").alias("__v"), F.col("points").alias("__there"))
    back = best.select(F.col("v").alias("__bu"), F.col("u").alias("__bv"), F.col("points").alias("__back"))
    held = ids.join(there, (F.col("u") == F.col("__u")) & (F.col("v") == F.col("__v")), "left").join(back, (F.col("u") == F.col("__bu")) & (F.col("v") == F.col("__bv")), "left")
    way = F.when(F.col("__there").isNotNull(), "forward").when(F.col("__back").isNotNull(), "reverse")
    return held.withColumns({"points": F.coalesce("__there", "__back"), "way": way}).drop("__u", "__v", "__bu", "__bv", "__there", "__back")


def chosen_layer(path: DataFrame, cands: DataFrame) -> DataFrame:
    """path (event_id, u, v, k) plus the layer that the first candidate equal to the decoded edge states; null where none is equal."""
    first = cands.groupBy("event_id", "u", "v", "k").agg(F.min_by("layer", "rank").alias("layer"))
    return path.join(first, ["event_id", "u", "v", "k"], "left")


def network_audit(nodes: DataFrame, edges: DataFrame, expected_crs: str | None = None, crs: str | None = None, expects_tunnels: bool = False) -> DataFrame:
    """One row of counts of a case's network and whether it passes.

    edges: u, v, k, length, bearing, layer, tunnel, bridge, highway, points (null without a line) and, of fusion, matched, confident, ambiguous, road, method.
    """
    from roadloom.functions import scalars as S
    from roadloom.operators import geo

    side = lambda p, on: nodes.select(F.col("node_id").alias(on), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    held = edges.join(side("u", "u"), "u", "left").join(side("v", "v"), "v", "left")
    forward, backward = geo.ends_apart(F.col("points"), F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy"))
    under, over, layer = S.flag(F.col("tunnel")), S.flag(F.col("bridge")), F.coalesce("layer", F.lit(0))
    flag = lambda c: S.flag(F.col(c))
    missing = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    counts = {
        "edges": F.lit(True), "tunnel_edges": under | (layer < 0), "bridge_edges": over | (layer > 0), "negative_layer_edges": layer < 0, "missing_length_edges": F.col("length").isNull(), "missing_geometry_edges": F.col("points").isNull(),
        "invalid_numeric_edges": ~F.coalesce((F.col("length") > 0) & F.col("bearing").between(0, 360), F.lit(False)), "semantic_conflicts": (under & ((layer >= 0) | over)) | (over & (layer <= 0)),
        "endpoint_mismatches": F.col("points").isNotNull() & ~F.coalesce(forward <= 2, F.lit(False)), "reverse_oriented": F.coalesce((forward > 2) & (backward <= 2), F.lit(False)), "matched_edges": flag("matched"), "confident_edges": flag("confident"),
        "ambiguous_edges": flag("ambiguous"), "missing_provenance": flag("matched") & (missing("road") | missing("method")), "construction_edges": F.lower(F.coalesce("highway", F.lit(""))).contains("construction"),
    }
    every = held.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()])
    lost = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("missing_xy_nodes"))
    whole = components(edges).agg(F.count_distinct("component").alias("weak_components"))
    out = every.crossJoin(F.broadcast(lost)).crossJoin(F.broadcast(whole))  # one row each
    zero = ["missing_xy_nodes", "missing_length_edges", "missing_geometry_edges", "invalid_numeric_edges", "semantic_conflicts", "endpoint_mismatches", "reverse_oriented", "missing_provenance"]
    passed = (F.col("weak_components") == 1) & F.lit(expected_crs == crs)
    for c in zero:
        passed = passed & (F.col(c) == 0)
    return out.withColumn("tunnel_warning", F.lit(expects_tunnels) & (F.col("tunnel_edges") == 0)).withColumn("passed", passed & ~F.col("tunnel_warning"))

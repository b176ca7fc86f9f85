"""Decoded paths against the truth: per-fix diagnostics, accuracy blocks, run rates, candidate audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.scalars import d
from roadloom.operators import graph
from roadloom.operators.aggregates import interval95, with_percentiles

#: Fixed value: metres between levels, for the layer-aware error (a stand-in, as networks carry no heights).
LEVEL_SPACING = 4.5


def candidate_support(lists: DataFrame, radius: float = 60.0) -> DataFrame:
    """lists and what the candidates of each fix offer: count, whether the true edge is among them, within the radius, by fallback only, or there is no position at all.

    lists: one row a fix, with tu, tv, tk (null without a true edge), localised, true_dist, and `near`: its candidates by distance, as an array of dist, u, v, k (null without a position).
    """
    hit = F.exists("near", lambda n: (n["u"] == F.col("tu")) & (n["v"] == F.col("tv")) & (n["k"] == F.col("tk")))
    count = F.when(F.col("near").isNull(), 0).otherwise(F.size("near"))
    return lists.withColumns(
        {
            "candidate_count": count.cast("long"), "candidate_contains_true": F.coalesce(hit, F.lit(False)), "strict_radius_contains_true": F.coalesce(F.col("localised") & (F.col("true_dist") <= radius), F.lit(False)),
            "candidate_fallback_used": F.coalesce(F.col("localised") & (F.get("near", F.lit(0))["dist"] > radius), F.lit(False)), "candidate_unlocalized": ~F.col("localised"),
        }
    )


def per_fix(path: DataFrame) -> DataFrame:
    """One row for each decoded fix that has a true edge: exact, reverse, physical, adjacent and level matches.

    path: u, v, k, layer and tunnel of the decoded edge, those of the true one as tu, tv, tk, tlayer, ttunnel, and what to carry along.
    """
    held = path.where("u is not null and tu is not null")
    for side, layer, tunnel in (("matched", "layer", "tunnel"), ("true", "tlayer", "ttunnel")):
        held = held.withColumns({f"{side}_layer": F.coalesce(layer, F.lit(0)), f"{side}_tunnel": F.col(tunnel) == 1})
    kinds = graph.match_class(tuple(F.col(c) for c in "uvk"), tuple(F.col(c) for c in ("tu", "tv", "tk")))
    held = held.drop("layer", "tunnel", "tlayer", "ttunnel").withColumns(kinds)
    return held.withColumns({"adjacent_nonexact": F.col("relaxed") & ~F.col("physical"), "layer_match": F.col("matched_layer") == F.col("true_layer"), "tunnel_wrong": F.col("matched_tunnel") != F.col("true_tunnel")})


def accuracy_block(rows: DataFrame, error: str, *by: str) -> DataFrame:
    """Percentages of matches, and the error with levels counted as heights."""
    pct = lambda c: d(100) * F.avg(F.col(c).cast("double"))
    rise = F.abs(F.col("matched_layer") - F.col("true_layer")) * d(LEVEL_SPACING)
    return rows.groupBy(*by).agg(
        F.count("*").alias("fixes"), pct("exact").alias("edge_accuracy"), pct("layer_match").alias("z_layer_accuracy"), pct("tunnel_wrong").alias("tunnel_misclass"), pct("relaxed").alias("relaxed_adjacent_accuracy"),
        pct("carriageway").alias("same_carriageway_accuracy"), pct("physical").alias("physical_segment_accuracy"), pct("reverse").alias("reverse_directed_rate"), F.sqrt(F.avg(F.col(error) ** 2 + rise**2)).alias("layer_aware_rmse"),
    )


def impossible_jumps(path: DataFrame, edges: DataFrame, *by: str) -> DataFrame:
    """Steps to another edge that the network does not allow at all. path: by, step, u, v, k in order of step; only the pairs that occur are looked up."""
    w = Window.partitionBy(*by).orderBy("step")
    held = path.withColumns({f"to_{c}": F.lead(c).over(w) for c in "uvk"}).where("to_u is not null and not (u = to_u and v = to_v and k = to_k)")
    ways = graph.routes_between(edges, held.select(F.col("v").alias("src"), F.col("to_u").alias("dst")))
    lost = held.join(ways.select(F.col("src").alias("v"), F.col("dst").alias("to_u")), ["v", "to_u"], "left_anti").groupBy(*by).agg(F.count("*").alias("n"))
    return path.select(*by).distinct().join(lost, list(by), "left").select(*by, F.coalesce("n", F.lit(0)).alias("impossible_jumps"))


def decoder_errors(rows: DataFrame, baseline: str, treatment: str, *by: str) -> DataFrame:
    """RMSE, mean, median and percentiles of two decoders' errors on the same fixes, the gain, and how often the treatment errs less."""
    out, wanted = [], {}
    for c, n in ((baseline, "baseline"), (treatment, "treatment")):
        out += [F.sqrt(F.avg(F.col(c) ** 2)).alias(f"{n}_rmse"), F.avg(c).alias(f"{n}_mae")]
        wanted |= {f"{n}_p{p}": (c, p / 100) for p in (50, 90, 95)}
    held = rows.groupBy(*by).agg(F.count("*").alias("fixes"), *out, F.avg((F.col(treatment) < F.col(baseline)).cast("double")).alias("gain_positive_rate"))
    return with_percentiles(held, rows, list(by), wanted).withColumn("rmse_gain", F.col("baseline_rmse") - F.col("treatment_rmse"))


def run_rates(rows: DataFrame, error: str, *by: str) -> DataFrame:
    """Each run's rates by decoder: accuracy block, oracle recalls, fallbacks, breaks and imputed fixes."""
    pct = lambda c: d(100) * F.avg(F.col(c).cast("double"))
    flags = {"candidate_contains_true": "candidate_oracle_recall", "strict_radius_contains_true": "strict_radius_oracle_recall", "beam_contains_true": "post_beam_oracle_recall", "candidate_fallback_used": "candidate_fallback_rate", "candidate_unlocalized": "candidate_unlocalized_rate", "adjacent_nonexact": "adjacent_nonexact_rate", "position_imputed": "imputed_fix_rate"}
    more = rows.groupBy(*by).agg(*[pct(c).alias(n) for c, n in flags.items() if c in rows.columns], F.sqrt(F.avg(F.col(error) ** 2)).alias("rmse"), *[F.count_if(c).alias(f"{c}s") for c in ("trellis_break", "connectivity_reanchor") if c in rows.columns])
    block = accuracy_block(rows, error, *by)
    return block.join(more, list(by)).withColumn("route_mismatch_rate", d(100) - F.col("edge_accuracy"))


def case_summary(runs: DataFrame, case: str, mode: str, modes: list[str], means: list[str], intervals: list[str]) -> DataFrame:
    """One row a case with a column for each mode and metric: means, and 95 % half widths of some."""
    picks = [*[F.avg(m).alias(f"{m}_mean") for m in means], *[interval95(m).alias(f"{m}_ci95") for m in intervals]]
    return runs.groupBy(case).pivot(mode, modes).agg(*picks)


def audit(pairs: DataFrame) -> DataFrame:
    """Counts of a candidate audit from one row a unit (resolved, valid, hit, negatives), and the oracle recall."""
    usable = F.col("resolved") & F.col("valid")
    return pairs.agg(
        F.count("*").alias("units"), F.count_if("valid").alias("valid_observations"), F.count_if("resolved").alias("resolved_true_edges"), F.count_if(usable).alias("oracle_denominator"), F.count_if(usable & F.col("hit")).alias("oracle_hits"),
        F.coalesce(F.avg(F.when(usable, F.col("hit").cast("double"))), d(0)).alias("oracle_recall"), F.count_if(usable & ~F.col("hit")).alias("skipped_true_not_in_candidates"), F.count_if(usable & F.col("hit") & (F.col("negatives") == 0)).alias("skipped_no_negative"),
        F.count_if(usable & F.col("hit") & (F.col("negatives") > 0)).alias("retained"), F.sum(F.when(usable & F.col("hit"), F.least("negatives", F.lit(4))).otherwise(0)).alias("pairs"),
    )


def candidate_diagnostics(fixes: DataFrame) -> DataFrame:
    """Fixes, those without candidates, neighbouring pairs that both have some, and the spread of the distance to the nearest line. fixes: track_id, place (their order), n (candidates) and near (that distance)."""
    held = fixes.withColumn("before", F.lag("n").over(Window.partitionBy("track_id").orderBy("place")))
    summary = held.agg(
        F.count("*").alias("pings"), F.count_if(F.col("n") == 0).alias("empty_pings"), F.count_if((F.col("n") > 0) & (F.col("before") > 0)).alias("valid_pairs"), F.min("near").alias("nearest_min"), F.max("near").alias("nearest_max")
    )
    return with_percentiles(summary, held, [], {"nearest_median": ("near", 0.5)})

"""Quality mixes, error and accuracy summaries, intervals, threshold curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.scalars import d
from roadloom.sources.shared import stored


def share(condition: Column) -> Column:
    """Percentage of rows where the condition holds; unknown counts as not."""
    return d(100) * F.avg(F.when(F.coalesce(condition, F.lit(False)), d(1)).otherwise(d(0)))


def percentiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]], accuracy: int = 10_000) -> DataFrame:
    """by, and for each name of wanted (column, share) the exact percentile with linear interpolation; null without a value.

    A sketch brackets each percentile, values below a bracket are only counted, and what lies inside one (a few ten-thousandths of the rows, as
    distinct values) is ordered: no group's values come together in one task.
    """
    columns = sorted({c for c, _ in wanted.values()})
    shares = {c: sorted({p for k, p in wanted.values() if k == c}) for c in columns}
    each = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*by, "x.c", "x.v").where("v is not null")
    sketch = None
    for c, ps in shares.items():
        at = [[min(max(p + side * 2 / accuracy, 0.0), 1.0) for p in ps] for side in (-1, 1)]
        one = each.where(F.col("c") == c).groupBy(*by, "c").agg(F.count("*").alias("n"), F.percentile_approx("v", at[0], accuracy).alias("low"), F.percentile_approx("v", at[1], accuracy).alias("high"))
        one = one.select(*by, "c", "n", F.posexplode(F.arrays_zip("low", "high")).alias("i", "z")).select(*by, "c", "n", F.get(F.array(*[F.lit(float(p)) for p in ps]), F.col("i")).alias("p"), "z.low", "z.high")
        sketch = one if sketch is None else sketch.unionByName(one)
    # One row for each group, column and share.
    sketch = stored(sketch.withColumn("rank", F.col("p") * (F.col("n") - 1)), "brackets")
    side = F.when(F.col("v") < F.col("low"), -1).when(F.col("v") > F.col("high"), 1).otherwise(0)
    held = each.join(sketch, [*by, "c"]).withColumn("side", side)
    # Of what lies outside only the value next to the bracket can be asked for: a rank may fall just beside it.
    inside = held.groupBy(*by, "c", "p", "side", F.when(F.col("side") == 0, F.col("v")).alias("v")).agg(F.count("*").alias("k"), F.min("v").alias("__min"), F.max("v").alias("__max"))
    inside = stored(inside.withColumn("v", F.when(F.col("side") < 0, F.col("__max")).otherwise(F.col("__min"))), "inside")
    order = Window.partitionBy(*by, "c", "p").orderBy("side", "v")
    placed = inside.withColumn("upto", F.sum("k").over(order)).join(sketch.select(*by, "c", "p", "rank"), [*by, "c", "p"])
    # Ranks run from 0: a value holds the ranks from upto - k to upto - 1.
    value = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    got = placed.groupBy(*by, "c", "p").agg(value(F.floor("rank")).alias("a"), value(F.ceil("rank")).alias("b"), F.first("rank").alias("rank"))
    got = got.withColumn("q", F.col("a") + (F.col("rank") - F.floor("rank")) * (F.col("b") - F.col("a")))
    return got.groupBy(*by).agg(*[F.max(F.when((F.col("c") == c) & (F.col("p") == p), F.col("q"))).alias(n) for n, (c, p) in wanted.items()])


def with_percentiles(summary: DataFrame, rows: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """A summary by group, or of one row, with the wanted percentiles of its rows."""
    found = percentiles(rows, by, wanted)
    if not by:
        return summary.crossJoin(F.broadcast(found))  # one row each
    found = found.withColumnsRenamed({c: f"__{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return summary.join(found, same, "left").drop(*[f"__{c}" for c in by])


def quality_mix(fixes: DataFrame, *by: str) -> DataFrame:
    """Shares of four classes, which neither cover all fixes nor need to, and exact percentiles."""
    sat, hdop = F.col("sat_count"), F.col("hdop")
    shares = fixes.groupBy(*by).agg(
        share((sat >= 8) & (hdop <= 1.5)).alias("healthy_pct"),
        share(sat.between(5, 7) & (hdop > 1.5) & (hdop <= 3)).alias("moderate_pct"),
        share(sat.between(2, 4) & (hdop > 3) & (hdop <= 8)).alias("degraded_pct"),
        share((sat <= 1) | (hdop > 8) | sat.isNull() | hdop.isNull()).alias("blackout_pct"),
    )
    return shares.join(percentiles(fixes, list(by), {f"{n}_p{p}": (c, p / 100) for n, c, ps in (("hdop", "hdop", (50, 90, 95)), ("sat", "sat_count", (10, 50, 90))) for p in ps}), list(by), "left")


def error_summary(rows: DataFrame, error: str, *by: str) -> DataFrame:
    e = F.col(error)
    held = rows.groupBy(*by).agg(F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    return held.join(percentiles(rows.withColumn("__e", F.abs(e)), list(by), {f"p{p}": ("__e", p / 100) for p in (50, 90, 95)}), list(by), "left")


def interval95(x: str) -> Column:
    """Half width of the normal 95 % interval of a mean; 0 for fewer than two values."""
    return F.when(F.count(x) < 2, d(0)).otherwise(d(1.96) * F.stddev_samp(x) / F.sqrt(F.count(x).cast("double")))


def wide(rows: DataFrame, case: str, metric: str, value: str, metrics: list[str]) -> DataFrame:
    """One column for each of the listed metrics."""
    return rows.groupBy(case).pivot(metric, metrics).agg(F.first(value))


def threshold_curve(rows: DataFrame, score: str, label: str, *by: str, ranges: int = 64) -> DataFrame:
    """For each candidate threshold (below all scores, between neighbours, the largest) the confusion of `score <= threshold`.

    Counts are per distinct score. A group's scores are cut into ranges of about equal size; sums are made within a range and the totals of the ranges
    before are added, so that no window holds a group.
    """
    steps = rows.where(f"{score} is not null and {label} is not null").groupBy(*by, F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label)).alias("pos"), F.count("*").alias("n"))
    steps = stored(steps.withColumn("neg", F.col("n") - F.col("pos")), "steps")
    bounds = steps.groupBy(*by).agg(F.percentile_approx("s", [i / ranges for i in range(1, ranges)], 1000).alias("__b"))
    steps = steps.join(bounds, list(by)) if by else steps.crossJoin(F.broadcast(bounds))  # one row a group; without groups one row
    steps = steps.withColumn("r", F.size(F.filter("__b", lambda b: b < F.col("s")))).drop("__b")
    totals = steps.groupBy(*by, "r").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"), F.min("s").alias("__low"))
    of, before = Window.partitionBy(*by).orderBy("r"), Window.partitionBy(*by).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    totals = totals.select(*by, "r", F.coalesce(F.sum("__p").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("n0"), F.sum("__p").over(every).alias("p"), F.sum("__n").over(every).alias("q"), F.lead("__low").over(of).alias("after"))
    totals = stored(totals, "totals")
    w = Window.partitionBy(*by, "r").orderBy("s")
    held = steps.join(totals, [*by, "r"])
    nxt = F.coalesce(F.lead("s").over(w), F.col("after"))
    held = held.withColumns({"threshold": F.coalesce((F.col("s") + nxt) / 2, F.col("s")), "tp": F.col("p0") + F.sum("pos").over(w), "fp": F.col("n0") + F.sum("neg").over(w)})
    lowest = steps.groupBy(*by).agg(F.min("s").alias("s0"))
    ends = totals.groupBy(*by).agg(F.max("p").alias("p"), F.max("q").alias("q"))
    none = (lowest.join(ends, list(by)) if by else lowest.crossJoin(ends)).select(*by, (F.col("s0") - d(1e-9)).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "p", "q")
    curve = held.select(*by, "threshold", "tp", "fp", "p", "q").union(none)
    curve = curve.withColumns({"fn": F.col("p") - F.col("tp"), "tn": F.col("q") - F.col("fp")})
    sensitivity, specificity = F.col("tp") / F.greatest(F.lit(1), "p"), F.col("tn") / F.greatest(F.lit(1), "q")
    return curve.withColumn("balanced_accuracy", d(0.5) * (sensitivity + specificity)).select(*by, "threshold", "tp", "tn", "fp", "fn", "balanced_accuracy")


def best_threshold(curve: DataFrame, *by: str) -> DataFrame:
    """The threshold of the largest balanced accuracy, the lower on ties."""
    rank = F.struct("balanced_accuracy", -F.col("threshold"))
    return curve.groupBy(*by).agg(F.max_by("threshold", rank).alias("threshold"), F.max("balanced_accuracy").alias("balanced_accuracy"))

"""Queries over paired runs: intervals, wide tables and paired tests; each with independent SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadloom.operators import aggregates, stats
from roadloom.plans.tools import Plan, half_up, half_up_sql, rounded
from roadloom.sources import tables


def _gains(spark, sf):
    return tables.runs(spark, sf).withColumn("gain", F.round(F.col("baseline_rmse") - F.col("treatment_rmse"), 6))


_GAINS = "+ g AS (SELECT *, round(baseline_rmse - treatment_rmse, 6) AS gain FROM runs)"


def g13_case_means(spark, sf):
    r = tables.runs(spark, sf)
    return rounded(r.groupBy("case_name").agg(F.count("*").alias("runs"), *[x for m in ("baseline_rmse", "treatment_rmse") for x in (F.avg(m).alias(m), aggregates.interval95(m).alias(f"{m}_ci95"))]))


G13 = tables.with_views(
    """SELECT case_name, count(*) AS runs, round(avg(baseline_rmse), 6) AS baseline_rmse, round(CASE WHEN count(*) < 2 THEN 0 ELSE 1.96 * stddev_samp(baseline_rmse) / sqrt(count(*)) END, 6) AS baseline_rmse_ci95,
  round(avg(treatment_rmse), 6) AS treatment_rmse, round(CASE WHEN count(*) < 2 THEN 0 ELSE 1.96 * stddev_samp(treatment_rmse) / sqrt(count(*)) END, 6) AS treatment_rmse_ci95 FROM runs GROUP BY case_name""",
    "runs",
)


def g12_wide(spark, sf):
    long = tables.runs(spark, sf).unpivot(["case_name", "run_index"], ["baseline_rmse", "treatment_rmse"], "metric", "value")
    means = long.groupBy("case_name", "metric").agg(F.avg("value").alias("value"))
    return rounded(aggregates.wide(means, "case_name", "metric", "value", ["baseline_rmse", "treatment_rmse"]))


G12 = tables.with_views("SELECT case_name, round(avg(baseline_rmse), 6) AS baseline_rmse, round(avg(treatment_rmse), 6) AS treatment_rmse FROM runs GROUP BY case_name", "runs")


def x3_rank_biserial(spark, sf):
    return rounded(stats.rank_biserial(_gains(spark, sf), "gain", "case_name"))


X3 = tables.with_views(
    _GAINS
    + """, r AS (SELECT case_name, gain, rank() OVER (PARTITION BY case_name ORDER BY abs(gain)) + (count(*) OVER (PARTITION BY case_name, abs(gain)) - 1) / 2.0::DOUBLE AS rk FROM g WHERE gain <> 0),
s AS (SELECT case_name, coalesce(sum(rk) FILTER (gain > 0), 0) AS p, coalesce(sum(rk) FILTER (gain < 0), 0) AS m, count(*) AS n FROM r GROUP BY 1)
SELECT c.case_name, c.n, coalesce(p, 0) AS w_pos, coalesce(m, 0) AS w_neg, coalesce(s.n, 0) AS nonzero, round(CASE WHEN p + m > 0 THEN (p - m) / (p + m) ELSE 0 END, 6) AS rank_biserial
FROM (SELECT case_name, count(gain) AS n FROM g GROUP BY 1) c LEFT JOIN s USING (case_name)""",
    "runs",
)


def x4_hodges_lehmann(spark, sf):
    return rounded(stats.hodges_lehmann(_gains(spark, sf), "gain", "case_name"))


X4 = tables.with_views(
    _GAINS
    + """, n AS (SELECT case_name, gain, row_number() OVER (PARTITION BY case_name ORDER BY gain, run_index) AS i FROM g)
SELECT a.case_name, round(median((a.gain + b.gain) / 2), 6) AS hodges_lehmann FROM n a JOIN n b ON a.case_name = b.case_name AND a.i <= b.i GROUP BY 1""",
    "runs",
)


def x2_holm(spark, sf):
    tests = tables.runs(spark, sf).select("case_name", "run_index", F.round("treatment_rmse", 6).alias("p"))
    return rounded(stats.holm(tests, "p", "case_name"))


X2 = tables.with_views(
    """+ t AS (SELECT case_name, run_index, round(treatment_rmse, 6) AS p FROM runs),
s AS (SELECT *, (count(*) OVER (PARTITION BY case_name) - row_number() OVER (PARTITION BY case_name ORDER BY p, run_index) + 1) * p AS st FROM t)
SELECT case_name, CAST(run_index AS INT) AS run_index, p, round(least(1, max(st) OVER (PARTITION BY case_name ORDER BY p, run_index ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM s""",
    "runs",
)


def x1_wilcoxon(spark, sf):
    g = _gains(spark, sf)
    low = stats.bootstrap_interval(g, "gain", "case_name")
    return rounded(stats.wilcoxon(g, "gain", "case_name").join(low, "case_name"))


def x1_wilcoxon_p(spark, sf):
    """The exact test alone."""
    return rounded(stats.wilcoxon(_gains(spark, sf), "gain", "case_name"))


# Of n untied gains every pattern of signs is as likely: those count whose rank sum is no more than that observed.
X1 = tables.with_views(
    _GAINS
    + """, r AS (SELECT case_name, gain, row_number() OVER (PARTITION BY case_name ORDER BY abs(gain)) AS rk FROM g WHERE gain <> 0),
s AS (SELECT case_name, CAST(count(*) AS INT) AS n, CAST(least(coalesce(sum(rk) FILTER (gain > 0), 0), coalesce(sum(rk) FILTER (gain < 0), 0)) AS INT) AS low FROM r GROUP BY 1),
w AS (SELECT n, low, count(*) AS c FROM (SELECT DISTINCT n, low FROM s) s, range(4096) q(m) WHERE m < 2 ** n AND list_sum(list_transform(range(1, 13), lambda i: CASE WHEN i <= n AND (m >> (i - 1)) & 1 = 1 THEN i ELSE 0 END)) <= low GROUP BY n, low)
SELECT case_name, round(least(1, 2.0::DOUBLE * c / 2 ** s.n), 6) AS p FROM s JOIN w USING (n, low)""",
    "runs",
)


def _modes(spark, sf):
    r = tables.runs(spark, sf).select("case_name", "run_index", F.round("baseline_rmse", 6).alias("plain"), F.round("treatment_rmse", 6).alias("full"))
    return r.withColumn("half", F.round((F.col("plain") + F.col("full")) / 2 + F.sin(F.col("run_index") * 1.0) / 100, 6))


def x6_analysis(spark, sf):
    """All comparisons of an evaluation with their three families of corrected tests."""
    return half_up(stats.analysis(_modes(spark, sf), "case_name", [("plain", "full"), ("plain", "half"), ("half", "full")], ("plain", "full")))


X6 = tables.with_views(
    f"""+ m AS (SELECT case_name, run_index, round(baseline_rmse, 6) AS plain, round(treatment_rmse, 6) AS full_ FROM runs),
h AS (SELECT *, round((plain + full_) / 2 + sin(run_index * 1.0::DOUBLE) / 100, 6) AS half FROM m),
g AS (SELECT case_name, 'plain' AS baseline, 'full' AS treatment, round(plain - full_, 9) AS gain FROM h UNION ALL SELECT case_name, 'plain', 'half', round(plain - half, 9) FROM h UNION ALL SELECT case_name, 'half', 'full', round(half - full_, 9) FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY case_name, baseline, treatment ORDER BY abs(gain)) AS rk FROM g WHERE gain <> 0),
s AS (SELECT case_name, baseline, treatment, CAST(count(*) AS INT) AS n, coalesce(sum(rk) FILTER (gain > 0), 0) AS wp, coalesce(sum(rk) FILTER (gain < 0), 0) AS wn FROM r GROUP BY 1, 2, 3),
l AS (SELECT *, CAST(least(wp, wn) AS INT) AS low FROM s),
w AS (SELECT n, low, count(*) AS c FROM (SELECT DISTINCT n, low FROM l) s, range(4096) q(m) WHERE m < 2 ** n AND list_sum(list_transform(range(1, 13), lambda i: CASE WHEN i <= n AND (m >> (i - 1)) & 1 = 1 THEN i ELSE 0 END)) <= low GROUP BY n, low),
t AS (SELECT l.*, least(1, 2.0::DOUBLE * c / 2 ** l.n) AS p FROM l JOIN w USING (n, low)),
k AS (SELECT *, row_number() OVER (PARTITION BY case_name, baseline, treatment ORDER BY gain) AS i FROM g),
hl AS (SELECT a.case_name, a.baseline, a.treatment, median((a.gain + b.gain) / 2) AS hl FROM k a JOIN k b ON a.case_name = b.case_name AND a.baseline = b.baseline AND a.treatment = b.treatment AND a.i <= b.i GROUP BY 1, 2, 3),
b AS (SELECT case_name, baseline, treatment, count(*) AS n, avg(gain) AS me, median(gain) AS md, avg(CAST(gain > 0 AS DOUBLE)) AS pr FROM g GROUP BY 1, 2, 3),
a AS (SELECT b.*, t.p, low, (wp - wn) / CAST(wp + wn AS DOUBLE) AS rb, hl FROM b JOIN t USING (case_name, baseline, treatment) JOIN hl USING (case_name, baseline, treatment)),
f1 AS (SELECT case_name, baseline, treatment, (count(*) OVER () - row_number() OVER o + 1) * p AS st, row_number() OVER o AS rn FROM a WINDOW o AS (ORDER BY p, case_name, baseline, treatment)),
f2 AS (SELECT case_name, baseline, treatment, (count(*) OVER () - row_number() OVER o + 1) * p AS st, row_number() OVER o AS rn FROM a WHERE baseline = 'plain' AND treatment = 'full' WINDOW o AS (ORDER BY p, case_name, baseline, treatment)),
f3 AS (SELECT case_name, baseline, treatment, (count(*) OVER () - row_number() OVER o + 1) * p AS st, row_number() OVER o AS rn FROM a WHERE baseline <> 'plain' WINDOW o AS (ORDER BY p, case_name, baseline, treatment)),
q AS (SELECT 1 AS f, case_name, baseline, treatment, least(1, max(st) OVER (ORDER BY rn)) AS h FROM f1 UNION ALL SELECT 2, case_name, baseline, treatment, least(1, max(st) OVER (ORDER BY rn)) FROM f2 UNION ALL SELECT 3, case_name, baseline, treatment, least(1, max(st) OVER (ORDER BY rn)) FROM f3),
z AS (SELECT case_name, baseline, treatment, max(h) FILTER (f = 1) AS hf, max(h) FILTER (f = 2) AS hp, max(h) FILTER (f = 3) AS hd FROM q GROUP BY 1, 2, 3)
SELECT case_name, baseline, treatment, a.n, {half_up_sql('me')} AS mean_gain, {half_up_sql('md')} AS median_gain, {half_up_sql('pr')} AS positive_rate, {half_up_sql('p')} AS p, {half_up_sql('low')} AS w, {half_up_sql('rb')} AS rank_biserial, {half_up_sql('hl')} AS hodges_lehmann, {half_up_sql('hf')} AS p_holm_full, {half_up_sql('hp')} AS p_holm_primary,
  {half_up_sql('hd')} AS p_holm_direct, hf < 0.05 AS significant_full, coalesce(hp < 0.05, false) AS significant_primary, coalesce(hd < 0.05, false) AS significant_direct FROM a JOIN z USING (case_name, baseline, treatment)""",
    "runs",
)


PLANS = [
    Plan(g13_case_means, G13, "g13_g14_case_means"), Plan(g12_wide, G12), Plan(x3_rank_biserial, X3), Plan(x4_hodges_lehmann, X4), Plan(x2_holm, X2), Plan(x1_wilcoxon, None, "x1_x4_bootstrap"), Plan(x1_wilcoxon_p, X1, "x1_wilcoxon"), Plan(x6_analysis, X6, "x2_x6_analysis"),
]

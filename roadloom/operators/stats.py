"""Paired non-parametric statistics: Wilcoxon signed ranks, rank-biserial correlation, Hodges-Lehmann, Holm."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.scalars import d


def signed_ranks(rows: DataFrame, gain: str, *by: str) -> DataFrame:
    """rank of |gain| among non-zero gains of a group, ties averaged."""
    size = F.abs(F.col(gain))
    order = Window.partitionBy(*by).orderBy("__a")
    tied = Window.partitionBy(*by, "__a")
    held = rows.where(F.col(gain) != 0).withColumn("__a", size)
    return held.withColumn("rank", F.rank().over(order) + (F.count("*").over(tied) - 1) / d(2)).drop("__a")


def rank_biserial(rows: DataFrame, gain: str, *by: str) -> DataFrame:
    """(W+ - W-) / (W+ + W-), 0 where all gains are 0, with the sums of ranks."""
    g = F.col(gain)
    sums = signed_ranks(rows, gain, *by).groupBy(*by).agg(
        F.sum(F.when(g > 0, F.col("rank")).otherwise(d(0))).alias("w_pos"), F.sum(F.when(g < 0, F.col("rank")).otherwise(d(0))).alias("w_neg"), F.count("*").alias("nonzero")
    )
    groups = rows.groupBy(*by).agg(F.count(g).alias("n"))
    out = groups.join(sums, list(by), "left").na.fill(0, ["w_pos", "w_neg", "nonzero"])
    total = F.col("w_pos") + F.col("w_neg")
    return out.withColumn("rank_biserial", F.when(total > 0, (F.col("w_pos") - F.col("w_neg")) / total).otherwise(d(0)))


def walsh_median(values: np.ndarray, few: int = 1 << 20) -> float:
    """Median of the averages of all pairs i <= j, without making all of them: bisection over counts of pairs narrows an interval down to `few` pairs, which are sorted."""
    x = np.sort(values[~np.isnan(values)])
    n = len(x)
    if n == 0:
        return float("nan")
    pairs, here = n * (n + 1) // 2, np.arange(n)
    wanted = [(pairs - 1) // 2, pairs // 2]  # places of the two middle sums, from 0

    def up_to(s: float) -> np.ndarray:
        """For each i, how many j >= i have x_i + x_j <= s."""
        return np.maximum(np.searchsorted(x, s - x, "right") - here, 0)

    low, high = np.nextafter(2 * x[0], -np.inf), 2 * x[-1]  # sums in (low, high]
    below, above = 0, pairs
    while above - below > few:
        mid = low + (high - low) / 2
        if not low < mid < high:
            return float(high / 2)  # nothing but equal sums is left
        c = int(up_to(mid).sum())
        if c <= wanted[0]:
            low, below = mid, c
        elif c > wanted[1]:
            high, above = mid, c
        else:  # the two middle sums lie on either side
            first, second = x[here[up_to(mid) > 0]] + x[(here + up_to(mid) - 1)[up_to(mid) > 0]], np.array([x[i] + x[i + k] for i, k in enumerate(up_to(mid)) if i + k < n])
            return float((first.max() + second.min()) / 4)
    start, stop = here + up_to(low), here + up_to(high)
    size = stop - start
    i = np.repeat(here, size)
    j = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    sums = np.sort(x[i] + x[j])
    return float((sums[wanted[0] - below] + sums[wanted[1] - below]) / 4)


def hodges_lehmann(rows: DataFrame, gain: str, *by: str) -> DataFrame:
    """Median of the averages of all pairs i <= j of a group; a group's values, not its pairs, are in one task."""
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in by) + ", hodges_lehmann double"

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, walsh_median(pdf[gain].to_numpy(dtype=float))]], columns=[*by, "hodges_lehmann"])

    return rows.where(F.col(gain).isNotNull()).select(*by, gain).groupBy(*by).applyInPandas(one, schema)


def holm(tests: DataFrame, p: str, *by: str) -> DataFrame:
    """Holm-adjusted p of each test of a family; without `by` all tests are one family."""
    order = Window.partitionBy(*by).orderBy(p, *[c for c in tests.columns if c not in (p, *by)])
    step = (F.count("*").over(Window.partitionBy(*by)) - F.row_number().over(order) + 1) * F.col(p)
    held = tests.withColumn("__s", step)
    return held.withColumn("p_holm", F.least(F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0)), d(1))).drop("__s")


def exact_wilcoxon_p(gains: np.ndarray) -> float:
    """Two-sided p of the signed-rank test: exact for up to 50 untied non-zero gains, else normal with the tie correction; 1 if all gains are 0."""
    x = gains[(gains != 0) & ~np.isnan(gains)]
    n = len(x)
    if n == 0:
        return 1.0
    size = np.abs(x)
    order = pd.Series(size).rank().to_numpy()
    low = min(order[x > 0].sum(), order[x < 0].sum())
    if n <= 50 and len(np.unique(size)) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))
    _, ties = np.unique(size, return_counts=True)
    var = n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48
    return float(min(1.0, math.erfc(abs(low - n * (n + 1) / 4) / math.sqrt(2 * var))))


def wilcoxon(rows: DataFrame, gain: str, *by: str) -> DataFrame:
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in by) + ", p double"

    def test(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, exact_wilcoxon_p(pdf[gain].to_numpy(dtype=float))]], columns=[*by, "p"])

    return rows.select(*by, gain).groupBy(*by).applyInPandas(test, schema)


def bootstrap_interval(rows: DataFrame, gain: str, *by: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """95 % percentile bootstrap of the Hodges-Lehmann estimate: a group's values, not its pairs, are in one task."""
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in by) + ", low double, high double"

    def resample(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[gain].dropna().to_numpy(dtype=float))
        rng = np.random.default_rng(seed)
        est = [walsh_median(x[rng.integers(0, len(x), len(x))]) for _ in range(draws)]
        return pd.DataFrame([[*key, *np.percentile(est, [2.5, 97.5])]], columns=[*by, "low", "high"])

    return rows.select(*by, gain).groupBy(*by).applyInPandas(resample, schema)


def holm_family(tests: DataFrame, p: str, member: str, out: str, *order: str) -> DataFrame:
    """tests plus `out`: the Holm-adjusted p within the rows for which `member` holds; null for the others. A family is an evaluation's tests: tens of rows."""
    family = holm(tests.where(member).select(*order, p), p).select(*order, F.col("p_holm").alias(out))
    return tests.join(family, list(order), "left")


def analysis(runs: DataFrame, case: str, comparisons: list[tuple[str, str]], primary: tuple[str, str], alpha: float = 0.05) -> DataFrame:
    """One row for each case and comparison of two columns of runs (baseline, treatment): sizes and signs of the gains, the signed-rank test, and
    Holm's correction within all tests, within the primary comparison and within the comparisons that are not with its baseline."""
    every = F.array(*[F.struct(F.lit(a).alias("baseline"), F.lit(b).alias("treatment"), F.round(F.col(a) - F.col(b), 9).alias("gain")) for a, b in comparisons])
    rows = runs.select(case, F.explode(every).alias("x")).select(case, "x.*").where("gain is not null")
    by = (case, "baseline", "treatment")
    held = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("gain").alias("mean_gain"), F.median("gain").alias("median_gain"), F.avg((F.col("gain") > 0).cast("double")).alias("positive_rate"))
    held = held.join(wilcoxon(rows, "gain", *by), list(by)).join(rank_biserial(rows, "gain", *by).select(*by, F.least("w_pos", "w_neg").alias("w"), "rank_biserial"), list(by)).join(hodges_lehmann(rows, "gain", *by), list(by))
    families = {"p_holm_full": "true", "p_holm_primary": f"baseline = '{primary[0]}' and treatment = '{primary[1]}'", "p_holm_direct": f"baseline <> '{primary[0]}'"}
    for out, member in families.items():
        held = holm_family(held, "p", member, out, *by)
    return held.withColumns({f"significant_{n.removeprefix('p_holm_')}": F.coalesce(F.col(n) < alpha, F.lit(False)) for n in families})

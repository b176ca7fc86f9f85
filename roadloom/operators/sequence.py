"""Window and sequence operators over fixes: boundaries, displacement, runs, look-ahead, causal imputation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.functions.scalars import d
from roadloom.operators import geo

#: Order of a track's fixes.
ORDER = ("t_s", "event_id")


def track(key: str = "track_id") -> Window:
    return Window.partitionBy(key).orderBy(*ORDER)


def boundaries(fixes: DataFrame) -> DataFrame:
    """boundary (first of its track, or time does not increase) and segment (running number in the track)."""
    before = F.lag("t_s").over(track())
    out = fixes.withColumn("boundary", before.isNull() | (F.col("t_s") <= before))
    return out.withColumn("segment", F.sum(F.col("boundary").cast("int")).over(track().rowsBetween(Window.unboundedPreceding, 0)))


def displacement(fixes: DataFrame, x: str = "obs_x", y: str = "obs_y") -> DataFrame:
    """moved: distance from the fix before; 0 where either is missing."""
    dx, dy = F.col(x) - F.lag(x).over(track()), F.col(y) - F.lag(y).over(track())
    return fixes.withColumn("moved", F.coalesce(F.hypot(dx, dy), d(0)))


def runs(fixes: DataFrame, condition: Column) -> DataFrame:
    """One row for each run of consecutive fixes where the condition holds: track_id, first and last time, length."""
    n = F.row_number().over(track())
    held = fixes.withColumn("__c", F.coalesce(condition, F.lit(False)))
    island = n - F.row_number().over(Window.partitionBy("track_id", "__c").orderBy(*ORDER))
    return held.withColumn("__i", island).where("__c").groupBy("track_id", "__i").agg(F.min("t_s").alias("first_s"), F.max("t_s").alias("last_s"), F.count("*").alias("length")).drop("__i")


def rising_edges(fixes: DataFrame, condition: Column) -> DataFrame:
    """How often the condition turns from false to true in each track (not at its first fix)."""
    now = F.coalesce(condition, F.lit(False)).cast("int")
    held = fixes.withColumn("__n", now).withColumn("__d", F.col("__n") - F.lag("__n").over(track()))
    return held.groupBy("track_id").agg(F.sum(F.when(F.col("__d") == 1, 1).otherwise(0)).alias("rises"))


def look_ahead(fixes: DataFrame, leaves: Column, recovers: Column, rows: int = 10) -> DataFrame:
    """Exits from a condition, with whether `recovers` holds at the exit or in the next `rows` fixes."""
    inside = F.coalesce(leaves, F.lit(False)).cast("int")
    held = fixes.withColumn("__in", inside).withColumn("__ok", F.coalesce(recovers, F.lit(False)).cast("int"))
    exits = (F.lag("__in").over(track()) == 1) & (F.col("__in") == 0)
    ahead = F.max("__ok").over(track().rowsBetween(0, rows))
    return held.withColumn("exit", exits).withColumn("recovered", ahead == 1).where("exit").drop("__in", "__ok", "exit")


def motion_checks(fixes: DataFrame, cadence: float, most_speed: float) -> DataFrame:
    """Per track: fixes, gaps that differ from the cadence, steps faster than allowed, and span of time."""
    gap = F.col("t_s") - F.lag("t_s").over(track())
    step = F.hypot(F.col("true_x") - F.lag("true_x").over(track()), F.col("true_y") - F.lag("true_y").over(track()))
    held = fixes.withColumns({"__gap": gap, "__step": step})
    return held.groupBy("track_id").agg(
        F.count("*").alias("fixes"),
        F.count_if(F.abs(F.col("__gap") - cadence) > 1e-6).alias("cadence_breaks"),
        F.count_if(F.col("__step") > F.col("__gap") * most_speed).alias("speed_breaks"),
        (F.max_by("t_s", F.struct(*ORDER)) - F.min_by("t_s", F.struct(*ORDER))).alias("span_s"),
    )


def even_sample(fixes: DataFrame, count: int) -> DataFrame:
    """`count` evenly spaced fixes of each track, first and last included."""
    n, total = F.row_number().over(track()) - 1, F.count("*").over(Window.partitionBy("track_id"))
    # Place i of the sample is floor(i * (total - 1) / (count - 1)).
    picks = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (F.col("__total") - 1) / d(count - 1)))
    return fixes.withColumns({"__n": n, "__total": total}).where(F.array_contains(picks, F.col("__n").cast("long"))).drop("__n", "__total")


def positions(route: DataFrame, speed: float) -> DataFrame:
    """track_id, tick, u, v, k, along, x, y of a vehicle at a steady speed along its edges (track_id, step, u, v, k, points, len; in order of step), from
    the start to the end of its way. A second's edge is the first whose end it has not passed: each edge brings forth its own seconds."""
    order = Window.partitionBy("track_id").orderBy("step")
    held = route.withColumn("high", F.sum("len").over(order)).withColumn("low", F.col("high") - F.col("len"))
    first = F.when(F.row_number().over(order) == 1, F.lit(0)).otherwise(F.floor(F.col("low") / d(speed)) + 1)
    held = held.withColumn("first", first).withColumn("last", F.floor(F.col("high") / d(speed))).where("first <= last")
    each = held.withColumn("tick", F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int")))).withColumn("along", F.col("tick") * d(speed))
    p = geo.point_at(F.col("points"), F.col("along") - F.col("low"))
    return each.select("track_id", "tick", "u", "v", "k", "along", p["x"].alias("x"), p["y"].alias("y"))


def fill(t: np.ndarray, x: np.ndarray, y: np.ndarray, new: np.ndarray, state: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """(x, y, imputed, state) of fixes in order, missing ones filled; new: where a segment begins; state: the last two effective fixes before, (t, x, y) each.

    A missing fix takes the last effective position plus the velocity of the last two (imputed ones count), time steps clipped to 0.25..30 s; after
    one position: hold; after none: it stays missing. Only missing fixes are looped over.
    """
    nothing = (np.nan, np.nan, np.nan)
    (t2, x2, y2), (t1, x1, y1) = state or (nothing, nothing)
    t, x, y, new = np.concatenate(([t2, t1], t)), np.concatenate(([x2, x1], x)), np.concatenate(([y2, y1], y)), np.concatenate(([True, state is None], new))
    first = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))  # where each fix's segment begins
    imputed = np.zeros(len(t), bool)
    for i in (np.flatnonzero(np.isnan(x[2:]) | np.isnan(y[2:])) + 2).tolist():
        if i - 1 < first[i] or np.isnan(x[i - 1]) or np.isnan(y[i - 1]):
            continue
        step = min(max(t[i] - t[i - 1], 0.25), 30.0)
        two = i - 2 >= first[i] and not (np.isnan(x[i - 2]) or np.isnan(y[i - 2]))
        before = min(max(t[i - 1] - t[i - 2], 0.25), 30.0) if two else 1.0
        imputed[i] = True
        for v in (x, y):
            if np.isnan(v[i]):
                v[i] = v[i - 1] + ((v[i - 1] - v[i - 2]) / before * step if two else 0.0)
    last = len(t) - 1
    one = (float(t[last]), float(x[last]), float(y[last]))
    two = (float(t[last - 1]), float(x[last - 1]), float(y[last - 1])) if last - 1 >= first[last] else nothing
    return x[2:], y[2:], imputed[2:], (two, one)


def impute(fixes: DataFrame) -> DataFrame:
    """fixes plus eff_x, eff_y, imputed: causal constant-velocity imputation for each track segment.

    Rows stream through in order of track and time with two positions of state, so a track of any length is never held, and every row comes out once, whatever its id.
    """
    names = fixes.columns
    schema = T.StructType([*fixes.schema.fields, T.StructField("eff_x", T.DoubleType()), T.StructField("eff_y", T.DoubleType()), T.StructField("imputed", T.BooleanType())])

    def run(batches):
        track_before, time_before, state = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            track = b.column(names.index("track_id"))
            t, x, y = (b.column(names.index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for c in ("t_s", "obs_x", "obs_y"))
            same = np.zeros(len(t), bool)
            if len(t) > 1:
                same[1:] = pc.fill_null(pc.equal(track[1:], track[:-1]), False).to_numpy(zero_copy_only=False)
            same[0] = track_before is not None and track[0].as_py() == track_before
            new = ~same | ~(t > np.concatenate(([time_before if time_before is not None else np.nan], t[:-1])))
            ex, ey, imputed, state = fill(t, x, y, new, None if new[0] else state)
            track_before, time_before = track[len(t) - 1].as_py(), t[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ex, from_pandas=True), pa.array(ey, from_pandas=True), pa.array(imputed)], [*names, "eff_x", "eff_y", "imputed"])

    return fixes.repartition("track_id").sortWithinPartitions("track_id", *ORDER).mapInArrow(run, schema)

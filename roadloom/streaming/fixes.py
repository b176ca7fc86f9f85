"""Streams of fixes (an extension): windowed quality mixes with late data, and causal imputation with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadloom.operators.aggregates import share
from roadloom.operators.sequence import fill


def windowed_quality(fixes: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Fixes and shares of blackout by window; works on a stream (event time `ts`) and on a table."""
    dark = (F.col("sat_count") <= 1) | (F.col("hdop") > 8)
    return fixes.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("fixes"), share(dark).alias("blackout_pct")).select("window.start", "fixes", "blackout_pct")


def _impute(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the last two effective positions with their times, as the table form has them. Time that does not increase begins a new segment there too."""
    held = tuple(state.get) if state.exists else None
    for pdf in batches:
        pdf = pdf.sort_values(["t_s", "event_id"])
        t, x, y = (pdf[c].to_numpy(float).copy() for c in ("t_s", "obs_x", "obs_y"))
        before = np.concatenate(([held[3] if held else np.nan], t[:-1]))
        new = ~(t > before)
        ex, ey, imputed, (two, one) = fill(t, x, y, new, None if new[0] else (held[:3], held[3:]))
        held = (*two, *one)
        yield pd.DataFrame({"track_id": key[0], "event_id": pdf["event_id"].to_numpy(), "eff_x": ex, "eff_y": ey, "imputed": imputed})
    if held:
        state.update(held)


def impute_stream(fixes: DataFrame) -> DataFrame:
    """Effective positions as fixes come, with six numbers of state a track. Within a batch fixes are put in order of time."""
    return fixes.groupBy("track_id").applyInPandasWithState(
        _impute, "track_id long, event_id long, eff_x double, eff_y double, imputed boolean", "t2 double, x2 double, y2 double, t1 double, x1 double, y1 double", "append", GroupStateTimeout.NoTimeout
    )

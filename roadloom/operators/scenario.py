"""Made trajectories: directed walks over a network, and the state of the signal along a track.

All draws are hashes of a seed, the track and the step, so that a run can be repeated, in whole or for one track, on any cluster.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.scalars import d
from roadloom.operators.training import _fraction
from roadloom.sources.shared import stored


def walks(starts: DataFrame, edges: DataFrame, steps: int, seed: int = 3, same_level: float = 3.0, other_level: float = 1.5) -> DataFrame:
    """track_id, step, u, v, k: a directed walk for each start (track_id, u, v, k, layer), all tracks a step at a time.

    The next edge is drawn among those that leave the last one's end and do not lead straight back, by weight: edges of the same level weigh more. Edges
    from whose end another leads on are preferred. A walk ends where no edge leaves.
    """
    on = edges.select(F.col("u").alias("__u")).distinct()
    out = stored(edges.select("u", "v", "k", "layer").join(on, F.col("v") == F.col("__u"), "left").select(F.col("u").alias("v"), F.col("v").alias("to"), F.col("k").alias("to_k"), F.col("layer").alias("to_layer"), F.col("__u").isNotNull().alias("leads_on")), "walk-edges")
    now = stored(starts.select("track_id", F.lit(0).alias("step"), "u", "v", "k", "layer"), "walk")
    every = now
    each = Window.partitionBy("track_id")
    order = each.orderBy("to", "to_k")
    for step in range(1, steps):
        options = now.join(out, "v").where("to <> u")
        options = options.withColumn("__any", F.max("leads_on").over(each)).where("leads_on = __any")
        options = options.withColumn("w", F.when(F.col("to_layer") == F.col("layer"), d(same_level)).otherwise(d(other_level)))
        options = options.withColumns({"upto": F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("w").over(each), "draw": _fraction(seed, "track_id", F.lit(step))})
        picked = options.where(F.col("upto") > F.col("draw") * F.col("total")).withColumn("r", F.row_number().over(order)).where("r = 1")
        now = stored(picked.select("track_id", F.lit(step).alias("step"), F.col("v").alias("u"), F.col("to").alias("v"), F.col("to_k").alias("k"), F.col("to_layer").alias("layer")), "walk")
        if not now.take(1):
            break
        every = every.unionByName(now)
    return every.drop("layer")


@dataclass(frozen=True)
class Profile:
    """How a signal behaves; the values of a case may override these."""

    blackout_trigger: float = 0.35
    degraded: float = 0.6
    portal: float = 0.02
    blackout_s: tuple[tuple[float, float], ...] = ((1.0, 9.0),)
    blackout_shares: tuple[float, ...] = (1.0,)
    recovery_s: tuple[tuple[float, float], ...] = ((1.0, 30.0),)
    recovery_m: tuple[tuple[float, float], ...] = ((8.0, 400.0),)
    portal_exit_s: tuple[float, float] = (3.0, 20.0)
    portal_s: tuple[float, float] = (1.0, 9.0)
    open_satellites: tuple[int, int] = (8, 12)
    open_hdop: tuple[float, float] = (0.7, 1.5)
    noise: dict[str, float] = field(default_factory=lambda: {"open": 10.0, "tunnel": 45.0})


def from_ranges(rng: np.random.Generator, ranges, shares, fallback: tuple[float, float]) -> float:
    """A value of one of the ranges, chosen by share."""
    held = [(min(r), max(r)) for r in ranges] or [fallback]
    p = np.array([max(s, 0.0) for s in shares] if shares is not None and len(shares) == len(held) else [1.0] * len(held))
    p = p / p.sum() if p.sum() > 0 else np.full(len(held), 1 / len(held))
    lo, hi = held[int(rng.choice(len(held), p=p))]
    return float(rng.uniform(lo, hi))


class Signal:
    """The state machine of one track's signal: blackouts inside tunnels, recovery after them by time and by distance, impaired stretches at portals.

    A blackout, once begun, lasts its drawn time while the track stays in the tunnel. Leaving a tunnel begins a recovery, which is over as soon as either its
    time or its distance is used up, and an impaired stretch that shows when the recovery is over.
    """

    def __init__(self, profile: Profile, rng: np.random.Generator, interval: float = 1.0):
        self.p, self.rng, self.interval = profile, rng, interval
        self.inside = False
        self.dark = self.portal = 0
        self.seconds = self.metres = self.all_seconds = self.all_metres = 0.0

    def _steps(self, seconds: float) -> int:
        return max(1, int(round(seconds / max(self.interval, 1e-6))))

    def step(self, tunnel: bool, speed: float, multiplier: float) -> tuple[str, float, float, int, bool]:
        """(state, sigma of the noise, hdop, satellites, whether a position is seen)."""
        rng, p = self.rng, self.p
        if self.inside and not tunnel:
            self.all_seconds = self.seconds = from_ranges(rng, p.recovery_s, None, (1.0, 30.0))
            self.all_metres = self.metres = from_ranges(rng, p.recovery_m, None, (8.0, 400.0))
            self.portal = self._steps(rng.uniform(*p.portal_exit_s))
        self.inside = tunnel
        sigma = p.noise["tunnel" if tunnel else "open"] * multiplier
        if tunnel:
            if self.dark <= 0 and rng.random() < p.blackout_trigger:
                self.dark = self._steps(from_ranges(rng, p.blackout_s, p.blackout_shares, (1.0, 9.0)))
            if self.dark > 0:
                self.dark -= 1
                return "tunnel_blackout", 2.5 * sigma, rng.uniform(8.5, 10.5), int(rng.integers(0, 2)), rng.random() >= 0.80
            if rng.random() < p.degraded:
                return "tunnel_degraded", 1.25 * sigma, rng.uniform(3.2, 8.0), int(rng.integers(2, 6)), True
            return "tunnel_moderate", sigma, rng.uniform(1.6, 3.0), int(rng.integers(5, 7)), True
        if self.portal <= 0 and rng.random() < p.portal:
            self.portal = self._steps(rng.uniform(*p.portal_s))
        if self.seconds > 0 and self.metres > 0:
            done = float(np.clip(1 - (self.seconds / max(self.all_seconds, 1e-6) + self.metres / max(self.all_metres, 1e-6)) / 2, 0, 1))
            self.seconds, self.metres = max(0.0, self.seconds - self.interval), max(0.0, self.metres - speed * self.interval)
            low = max(int(np.floor(5 + done)), 4)
            return "post_tunnel_recovery", (22 * (1 - done) + 10 * done) * multiplier, rng.uniform(max(1.4 - 0.3 * done, 1.2), max(3 - 1.5 * done, 1.4)), int(rng.integers(low, max(int(np.ceil(7 + done)), low + 1) + 1)), True
        if self.portal > 0:
            self.portal -= 1
            kind = rng.random()
            if kind < 0.40:
                return "portal_degraded", 1.4 * sigma, rng.uniform(3.2, 8.0), int(rng.integers(2, 5)), True
            if kind < 0.85:
                return "portal_blackout", 2.5 * sigma, rng.uniform(8.5, 10.5), int(rng.integers(0, 2)), rng.random() >= 0.7
            return "portal_moderate", sigma, rng.uniform(1.6, 3.0), int(rng.integers(5, 7)), True
        return "open_sky", sigma, rng.uniform(*p.open_hdop), int(rng.integers(p.open_satellites[0], p.open_satellites[1] + 1)), True


def track_seed(seed: int, track) -> int:
    return int.from_bytes(hashlib.md5(f"{seed}|{track}".encode()).digest()[:8], "big")


def observe(tracks: DataFrame, profile: Profile | None = None, seed: int = 5, interval: float = 1.0) -> DataFrame:
    """tracks (track_id, step, true_x, true_y, tunnel, speed, multiplier) plus state, hdop, sat_count, obs_x, obs_y: one group a track, seeded by it."""
    p = profile or Profile()
    schema = ", ".join(f"`{n}` {t}" for n, t in tracks.dtypes) + ", state string, hdop double, sat_count int, obs_x double, obs_y double"

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(track_seed(seed, key[0]))
        signal, out = Signal(p, rng, interval), []
        pdf = pdf.sort_values("step")
        for x, y, tunnel, speed, multiplier in pdf[["true_x", "true_y", "tunnel", "speed", "multiplier"]].itertuples(index=False):
            state, sigma, hdop, sats, seen = signal.step(bool(tunnel), float(speed), float(multiplier))
            ox, oy = (x + rng.normal(0, sigma), y + rng.normal(0, sigma)) if seen else (None, None)
            out.append((state, hdop, sats, ox, oy))
        return pdf.assign(**dict(zip(("state", "hdop", "sat_count", "obs_x", "obs_y"), zip(*out, strict=True), strict=True)))

    return tracks.groupBy("track_id").applyInPandas(run, schema)

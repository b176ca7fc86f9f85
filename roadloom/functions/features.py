"""Feature vectors, closed-form scorers, emission and transition potentials, as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from roadloom.functions.scalars import clip, d, flag, number

GOLDEN = 0.6180339887498949  # fixed value: the fractional part of the golden ratio


def edge_features(length: Column, bearing: Column, maxspeed: Column, layer: Column, lanes: Column, oneway: Column, tunnel: Column, bridge: Column, traffic: Column) -> Column:
    """Nine features of an edge and a traffic value, each 0 to 1."""
    return F.array(
        F.least(number(length, 0) / d(500), d(1)),
        F.pmod(number(bearing, 0), d(360)) / d(360),
        clip((number(maxspeed, 60) - 10) / d(110), 0, 1),
        clip((number(layer, 0) + 3) / d(8), 0, 1),
        clip(number(lanes, 2) / d(8), 0, 1),
        *[flag(c).cast("double") for c in (oneway, tunnel, bridge)],
        clip(number(traffic, 0), 0, 1),
    )


def transition_features(layer_a: Column, layer_b: Column, speed_a: Column, speed_b: Column, distance: Column, bearing_a: Column, bearing_b: Column) -> Column:
    """Four features of a step from one edge to another."""
    turn = F.pmod(F.abs(bearing_b - bearing_a), d(360))
    return F.array(
        F.least(F.abs(layer_b - layer_a) / d(3), d(1)),
        F.least(F.abs(speed_b - speed_a) / d(100), d(1)),
        F.least(F.coalesce(distance, d(150)) / d(150), d(1)),
        F.least(turn, d(360) - turn) / d(180),
    )


def start_weights(size: int, restart: int = 0, scale: float = 0.05) -> list[float]:
    """Deterministic low-discrepancy start of a training: scale * sin(2 pi frac(i (restart + 1) golden))."""
    return [scale * math.sin(2 * math.pi * ((i * (restart + 1) * GOLDEN) % 1.0)) for i in range(1, size + 1)]


def mlp_score(features: Column, weights: list[float], inputs: int, hidden: int) -> Column:
    """inputs -> hidden tanh -> logistic; weights: first layer by input, its biases, second layer, its bias."""
    first, b1 = weights[: inputs * hidden], weights[inputs * hidden : (inputs + 1) * hidden]
    w2, b2 = weights[(inputs + 1) * hidden : (inputs + 2) * hidden], weights[(inputs + 2) * hidden]
    x = [F.get(features, F.lit(i)) for i in range(inputs)]
    total = d(b2)
    for j in range(hidden):
        total = total + d(w2[j]) * F.tanh(sum((x[i] * d(first[i * hidden + j]) for i in range(inputs)), d(b1[j])))
    return 1 / (1 + F.exp(-total))


def mlp_scores(x: np.ndarray, weights: list[float], inputs: int, hidden: int) -> np.ndarray:
    """mlp_score of the rows of an array."""
    w = np.array(weights)
    first = np.tanh(w[inputs * hidden : (inputs + 1) * hidden] + x @ w[: inputs * hidden].reshape(inputs, hidden))
    return 1 / (1 + np.exp(-(w[(inputs + 2) * hidden] + first @ w[(inputs + 1) * hidden : (inputs + 2) * hidden])))


def product_circuit(features: Column, weights: list[float], wires: int, layers: int, read: list[int]) -> Column:
    """Mean Z expectation over the `read` wires of a circuit without entanglement: a turn by pi * feature before each layer of three-angle rotations.

    Without entanglement each wire is a point on a sphere that rotations turn. Its coordinates are polynomials in the turn's sine s and cosine c,
    whose factors are worked out here, so that the expression grows with the square of the layers and holds no angle but the features'.
    """
    Poly = dict[tuple[int, int], float]  # (power of s, power of c) -> factor

    def plus(*terms: tuple[float, Poly, int, int]) -> Poly:
        """Sum of factor * s^i * c^j * polynomial."""
        out: Poly = {}
        for factor, p, i, j in terms:
            for (a, b), v in p.items():
                out[a + i, b + j] = out.get((a + i, b + j), 0.0) + factor * v
        return out

    def turned(p: Poly, q: Poly, angle: float) -> tuple[Poly, Poly]:
        c, s = math.cos(angle), math.sin(angle)
        return plus((c, p, 0, 0), (-s, q, 0, 0)), plus((s, p, 0, 0), (c, q, 0, 0))

    total = d(0)
    for w in read:
        x, y, z = {}, {}, {(0, 0): 1.0}
        for layer in range(layers):
            x, z = plus((1, x, 0, 1), (1, z, 1, 0)), plus((1, z, 0, 1), (-1, x, 1, 0))
            phi, theta, omega = weights[3 * (layer * wires + w) : 3 * (layer * wires + w) + 3]
            x, y = turned(x, y, phi)
            z, x = turned(z, x, theta)
            x, y = turned(x, y, omega)
        angle = F.get(features, F.lit(w)) * d(math.pi)
        s, c = F.sin(angle), F.cos(angle)
        for (i, j), v in sorted(z.items()):
            term = d(v)
            for f in [s] * i + [c] * j:
                term = term * f
            total = total + term
    return total / d(len(read))


def quality_scale(hdop: Column, satellites: Column, imputed: Column) -> Column:
    scale = clip(F.greatest(number(hdop, 1.5), d(0.5)) / d(1.5), 0.75, 3) * F.when(number(satellites, 7) < 5, d(1.35)).otherwise(d(1))
    return F.when(imputed, F.greatest(scale, d(2.5))).otherwise(scale)


def spatial_log_prob(distance: Column, scale: Column, sigma: float = 45.0) -> Column:
    """log(1e-6) where there is no distance."""
    ratio = distance / (scale * d(sigma))
    return F.coalesce(d(-0.5) * ratio * ratio, d(math.log(1e-6)))


def fused_log_prob(spatial: Column, factor: Column, sigma: float = 45.0, floor: float = 1e-12) -> Column:
    """A learned factor times the Gaussian density, floored."""
    return F.log(clip(F.exp(spatial) / d(2 * math.pi * sigma**2) * factor, floor, 1))


def context_log_prob(spatial: Column, features: Column) -> Column:
    """The spatial term with a prior from the features after the first two."""
    rest = F.slice(features, 3, F.greatest(F.size(features) - 2, F.lit(0)))
    mean = F.aggregate(rest, d(0), lambda a, v: a + v) / F.size(rest)
    return spatial + F.log(clip(d(0.25) + d(0.75) * mean, 1e-9, 1))


def level_log_prob(distance: Column, belief: Column, sigma: float = 45.0) -> Column:
    """Distance from the filtered position, without the fix's quality, and the belief in the edge's level."""
    return d(-0.5) * (distance / d(sigma)) ** 2 + F.log(clip(belief, 1e-12, 1))


def direction_reliability(hdop: Column, satellites: Column, displacement: Column, imputed: Column) -> Column:
    good = F.exp(-F.greatest(F.greatest(number(hdop, 1.5), d(0.5)) - 1, d(0)) / d(3))
    return clip(good * clip(number(satellites, 7) / d(8), 0, 1) * clip(displacement / d(8), 0, 1) * F.when(imputed, d(0.25)).otherwise(d(1)), 0, 1)


def course_potential(dx: Column, dy: Column, tx: Column, ty: Column, reliability: Column) -> Column:
    norm = F.hypot(dx, dy)
    cosine = clip((dx * tx + dy * ty) / F.nullif(norm, d(0)), -1, 1)
    ratio = F.acos(cosine) / d(math.radians(45))
    return F.when((reliability <= 0) | (norm <= 1e-9) | cosine.isNull(), d(1)).otherwise(F.exp(d(-0.5) * reliability * ratio * ratio))


def transition_potential(route: Column, displacement: Column, reverse: Column, course: Column, factor: Column, sigma: float = 50.0) -> Column:
    """0 where there is no route, else clipped to 1e-9..1."""
    mismatch = F.abs(route - F.greatest(displacement, d(0)))
    return F.when(route.isNull(), d(0)).otherwise(clip(F.exp(-mismatch / d(sigma)) * reverse * course * factor, 1e-9, 1))

"""Parzen-estimator search (H11, H12): trials are drawn where good trials are dense
and bad ones are not.

Every parameter lives on the unit interval. A batch looks at the trials so far: the best
share of them are good, the rest bad. Candidates come from the density of the good trials
-- an even prior of one trial's weight and one Epanechnikov kernel per trial, folded back at
the borders -- and each parameter takes the candidate with the highest ratio of the good
density to the bad one. Draws are md5 numbers of (seed, trial, candidate, parameter), so a
study can be repeated anywhere. The trials are few; what they evaluate runs on Spark.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

CANDIDATES = 24          # per trial and parameter
GOOD_SHARE = 0.25
MOST_GOOD = 25


@dataclass
class Trial:
    """``unit``: parameter -> place on the unit interval; ``figures``: the score, then whatever else was measured."""
    number: int
    unit: dict[str, float]
    params: dict
    figures: tuple
    guided: bool

    @property
    def score(self) -> float:
        return self.figures[0]


def uniform(*key) -> float:
    """Value in [0, 1) from the md5 of the parts joined by ``|``."""
    return int(hashlib.md5("|".join(str(k) for k in key).encode()).hexdigest()[:13], 16) / float(16 ** 13)


def from_unit(kind: str, lo, hi, u: float):
    """The parameter's value at ``u``: whole numbers are equally wide, ``logfloat`` is even in the logarithm."""
    if kind == "int":
        return min(hi, lo + int(u * (hi - lo + 1)))
    if kind == "float":
        return lo + u * (hi - lo)
    return math.exp(math.log(lo) + u * (math.log(hi) - math.log(lo)))


def widths(points: Sequence[float]) -> list[float]:
    """Per kernel: the larger distance to its neighbours (the borders are neighbours too), between
    1 / (points + 2), 1 / 100 at least, and 1."""
    order = sorted(range(len(points)), key=lambda i: (points[i], i))
    least = 1.0 / min(100, len(points) + 2)
    out = [0.0] * len(points)
    for at, i in enumerate(order):
        left = points[order[at - 1]] if at else 0.0
        right = points[order[at + 1]] if at + 1 < len(order) else 1.0
        out[i] = min(1.0, max(least, points[i] - left, right - points[i]))
    return out


def fold_back(x: float) -> float:
    """Mirror a point that a kernel threw over a border."""
    return -x if x < 0.0 else 2.0 - x if x > 1.0 else x


def density(x: float, points: Sequence[float], width: Sequence[float]) -> float:
    """Density at ``x`` of the even prior and the folded kernels, each of weight one."""
    total = 1.0
    for m, h in zip(points, width, strict=True):
        for centre in (m, -m, 2.0 - m):
            z = (x - centre) / h
            if abs(z) < 1.0:
                total += 0.75 * (1.0 - z * z) / h
    return total / (len(points) + 1)


def draw_near(points: Sequence[float], width: Sequence[float], *key) -> float:
    """One draw from the same density: pick the prior or a kernel, then the median rule of three for its shape."""
    k = int(uniform(*key, "k") * (len(points) + 1))
    if k == 0:
        return uniform(*key, "x")
    a, b, c = (2.0 * uniform(*key, part) - 1.0 for part in "abc")
    z = b if abs(c) >= abs(a) and abs(c) >= abs(b) else c
    return fold_back(points[k - 1] + width[k - 1] * z)


def split(trials: Sequence[Trial]) -> tuple[list[Trial], list[Trial]]:
    """(good, bad), each in the order of their numbers; equal scores: the earlier trial is the better."""
    n = min(MOST_GOOD, max(1, math.ceil(GOOD_SHARE * len(trials))))
    best = {t.number for t in sorted(trials, key=lambda t: (-t.score, t.number))[:n]}
    ordered = sorted(trials, key=lambda t: t.number)
    return [t for t in ordered if t.number in best], [t for t in ordered if t.number not in best]


def suggest(space: dict, trials: Sequence[Trial], number: int, seed: int, candidates: int = CANDIDATES) -> dict[str, float]:
    """Places of the next trial on the unit intervals; equal ratios: the first candidate."""
    good, bad = split(trials)
    out = {}
    for name in space:
        g, b = [t.unit[name] for t in good], [t.unit[name] for t in bad]
        gw, bw = widths(g), widths(b)
        xs = [draw_near(g, gw, seed, number, j, name) for j in range(candidates)]
        ratio = [density(x, g, gw) / density(x, b, bw) for x in xs]
        out[name] = xs[max(range(candidates), key=lambda j: (ratio[j], -j))]
    return out


def study(space: dict, evaluate: Callable[[list[tuple[int, dict]]], list[tuple]], n_trials: int, startup: int = 10,
          batch: int = 2, seed: int = 42, candidates: int = CANDIDATES) -> list[Trial]:
    """``startup`` even draws, then batches of ``batch`` guided ones. ``evaluate`` takes (number, parameters) of a
    batch and returns one tuple of figures each, the score (higher is better, None: lost) first."""
    trials: list[Trial] = []
    while len(trials) < n_trials:
        at = len(trials)
        guided = at >= startup
        numbers = range(at, min(n_trials, at + batch) if guided else min(n_trials, startup))
        units = [suggest(space, trials, t, seed, candidates) if guided else {name: uniform(seed, t, name) for name in space} for t in numbers]
        params = [{name: from_unit(*space[name], u[name]) for name in space} for u in units]
        for t, u, p, f in zip(numbers, units, params, evaluate(list(zip(numbers, params))), strict=True):
            figures = tuple(f) if f[0] is not None else (-math.inf, *f[1:])
            trials.append(Trial(t, u, p, figures, guided))
    return trials

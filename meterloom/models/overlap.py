"""Which seasons differ enough to be modelled apart: ellipses of use by temperature that don't overlap."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from meterloom.models.filling import median_of_five
from meterloom.models.robust import golden_section


@dataclass
class Ellipse:
    mean: np.ndarray
    cov: np.ndarray


def ellipse(t: np.ndarray, y: np.ndarray, spread: tuple[float, float] = (1.4, 0.89), rounds: int = 3, cut: float = 3.6) -> Ellipse | None:
    """Mean and scaled covariance after dropping points far outside, up to three times; None under three points."""
    order = np.argsort(t, kind="stable")
    x = np.column_stack([t[order], median_of_five(y[order])]) if len(t) else np.zeros((0, 2))
    for _ in range(rounds + 1):
        if len(x) < 3:
            return None
        mean, cov = x.mean(0), np.cov(x.T)
        far = np.einsum("ij,jk,ik->i", x - mean, np.linalg.pinv(cov), x - mean) > cut**2
        if not far.any():
            break
        x = x[~far]
    scale = np.outer(spread, spread)
    return Ellipse(mean, cov * scale)


def overlap(a: Ellipse, b: Ellipse) -> bool:
    """Whether two ellipses share a point: 1 - d' (A / (1 - s) + B / s)^-1 d stays at or over 0 for all s in (0, 1)."""
    d = b.mean - a.mean

    def k(s: float) -> float:
        return 1 - float(d @ np.linalg.pinv(a.cov / (1 - s) + b.cov / s) @ d)

    grid = np.linspace(0.02, 0.98, 25)
    best = grid[int(np.argmin([k(s) for s in grid]))]
    return k(golden_section(k, max(best - 0.04, 1e-6), min(best + 0.04, 1 - 1e-6))) >= 0


def separate_seasons(t: np.ndarray, y: np.ndarray, season: np.ndarray, day_type: np.ndarray) -> dict[str, bool]:
    """For summer, shoulder and winter: whether for each of the other seasons a day type's ellipses are disjoint."""
    fits = {(s, d): ellipse(t[(season == s) & (day_type == d)], y[(season == s) & (day_type == d)]) for s in ("summer", "shoulder", "winter") for d in ("weekday", "weekend")}

    def apart(a: str, b: str) -> bool:
        return any(fits[a, d] is not None and fits[b, d] is not None and not overlap(fits[a, d], fits[b, d]) for d in ("weekday", "weekend"))

    near = {"summer": ["shoulder"], "shoulder": ["summer", "winter"], "winter": ["shoulder"]}
    return {s: all(apart(s, other) for other in near[s]) for s in near}

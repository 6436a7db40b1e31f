"""Haar wavelets, principal components and bisecting k-means in NumPy, for load profiles of one meter."""

from __future__ import annotations

import numpy as np


def haar(x: np.ndarray, levels: int = 5) -> np.ndarray:
    """Wavelet coefficients of rows, coarsest first; odd lengths repeat their last value."""
    details, a = [], x
    for _ in range(levels):
        if a.shape[1] < 2:
            break
        if a.shape[1] % 2:
            a = np.column_stack([a, a[:, -1]])
        details.append((a[:, 0::2] - a[:, 1::2]) / np.sqrt(2))
        a = (a[:, 0::2] + a[:, 1::2]) / np.sqrt(2)
    return np.column_stack([a, *details[::-1]])


def principal(x: np.ndarray, share: float = 0.725) -> np.ndarray:
    """Scores of the first components that together hold `share` of the variance, columns standardised."""
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    part = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
    k = min(int(np.searchsorted(part, share)) + 1, len(s))
    return u[:, :k] * s[:k]


def two_means(x: np.ndarray, rng: np.random.Generator, tries: int = 3, rounds: int = 50) -> np.ndarray:
    """Labels 0 and 1 of the best of a few k-means runs with spread starts."""
    best = None
    for _ in range(tries):
        first = x[rng.integers(len(x))]
        gap = ((x - first) ** 2).sum(1)
        whole = gap.sum()
        second = x[rng.choice(len(x), p=gap / whole)] if whole > 0 else first
        centres = np.stack([first, second])
        for _ in range(rounds):
            apart = ((x - centres[:, None]) ** 2).sum(2)
            label = apart[1] < apart[0]
            n = int(label.sum())
            if not 0 < n < len(x):
                new = np.stack([x.mean(0), centres[1]] if not n else [centres[0], x.mean(0)])
            else:
                new = np.stack([x[~label].sum(0) / (len(x) - n), x[label].sum(0) / n])
            if (np.abs(new - centres) <= 1e-8 + 1e-5 * np.abs(centres)).all():
                break
            centres = new
        inertia = float(((x - centres[label.astype(int)]) ** 2).sum())
        if best is None or inertia < best[0]:
            best = inertia, label.astype(int)
    return best[1]


def bisecting(x: np.ndarray, most: int, rng: np.random.Generator) -> dict[int, np.ndarray]:
    """Labels for every number of clusters from 2 to `most`, the largest cluster being split in two."""
    label, out = np.zeros(len(x), int), {}
    for k in range(2, most + 1):
        size = np.bincount(label)
        target = int(size.argmax())
        rows = np.flatnonzero(label == target)
        if len(rows) < 2:
            break
        half = two_means(x[rows], rng)
        label = label.copy()
        label[rows[half == 1]] = k - 1
        out[k] = label
    return out


def variance_ratio(x: np.ndarray, label: np.ndarray) -> float:
    """Negated ratio of the variance between clusters to that within: smaller is better."""
    ids, at, size = np.unique(label, return_inverse=True, return_counts=True)
    n, k = len(x), len(ids)
    if k < 2 or k >= n:
        return np.inf
    means = np.zeros((k, x.shape[1]))
    np.add.at(means, at, x)
    means /= size[:, None]
    between = (size * ((means - x.mean(0)) ** 2).sum(1)).sum()
    within = ((x - means[at]) ** 2).sum()
    return -np.inf if within == 0 else -(between / (k - 1)) / (within / (n - k))


def merge_small(label: np.ndarray, least: int) -> np.ndarray:
    """Clusters renamed by size, largest 0; those under `least` are -1."""
    ids, n = np.unique(label, return_counts=True)
    order = ids[np.argsort(-n, kind="stable")]
    name = {c: (i if n[ids == c][0] >= least else -1) for i, c in enumerate(order)}
    return np.array([name[c] for c in label])


def cluster_profiles(profiles: np.ndarray, low: int = 2, high: int = 24, tries: int = 3, share: float = 0.725, least: int = 2, seed: int = 0) -> np.ndarray:
    """Labels of rows (days' profiles): wavelets, components, and the best-scored bisecting k-means."""
    if len(profiles) < 3:
        return np.zeros(len(profiles), int)
    x = principal(haar(profiles), share)
    best = (np.inf, np.zeros(len(profiles), int))
    for again in range(tries):
        for k, label in bisecting(x, min(high, len(x) - 1), np.random.default_rng(seed + again)).items():
            if k >= low and (score := variance_ratio(x, label)) < best[0]:
                best = score, label
    return merge_small(best[1], least)

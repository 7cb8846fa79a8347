"""Plain versions of clusterings on whole matrices, which the distributed ones are held against."""

import numpy as np


def average_linkage(distance: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by unweighted average linkage; the first nearest pair merges.

    Each row keeps its nearest other cluster, so a merge looks at one value a row."""
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    n = len(d)
    size, label = np.ones(n), np.arange(n)
    near = d.argmin(1) if n else np.zeros(0, int)
    least = d[np.arange(n), near]
    for _ in range(n - max(k, 1)):
        i = int(np.argmin(least))
        i, j = sorted((i, int(near[i])))
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = d[j] = d[:, j] = np.inf
        size[i] += size[j]
        label[label == label[j]] = label[i]
        # Rows that pointed at the merged pair look again; others may find row i nearer.
        again = np.flatnonzero((near == i) | (near == j) | (np.arange(n) == i) | (np.arange(n) == j))
        near[again] = d[again].argmin(1)
        least[again] = d[again, near[again]]
        closer = (d[:, i] < least) | ((d[:, i] == least) & (i < near))
        near[closer], least[closer] = i, d[closer, i]
    return np.unique(label, return_inverse=True)[1]


def _squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(1)[None], 0)


def kmeans(x: np.ndarray, k: int, seed: int = 0, starts: int = 10, rounds: int = 50) -> np.ndarray:
    """Labels of the best of ``starts`` runs of Lloyd's rounds from k-means++ seeds."""
    rng, best, labels = np.random.default_rng(seed), np.inf, np.zeros(len(x), int)
    for _ in range(starts):
        centre = x[[rng.integers(len(x))]]
        while len(centre) < k:
            d = _squared(x, centre).min(1)
            centre = np.vstack([centre, x[rng.choice(len(x), p=d / d.sum() if d.sum() > 0 else None)]])
        for _ in range(rounds):
            own = _squared(x, centre).argmin(1)
            new = np.array([x[own == c].mean(0) if (own == c).any() else centre[c] for c in range(k)])
            if np.allclose(new, centre):
                break
            centre = new
        cost = ((x - centre[own]) ** 2).sum()
        if cost < best:
            best, labels = cost, own
    return labels


def spectral(affinity: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k-means on the leading eigenvectors of the normalised affinity."""
    root = 1 / np.sqrt(np.maximum(affinity.sum(1), 1e-12))
    _, vectors = np.linalg.eigh(affinity * root[:, None] * root[None])
    return kmeans(vectors[:, -k:] * root[:, None], k, seed)

"""Image kernels over grey pixel arrays, and quad geometry; decoding files is left to the caller."""

from __future__ import annotations

import numpy as np


def sharpness(grey: np.ndarray) -> float:
    """Variance of the Laplacian over the central half."""
    h, w = grey.shape
    g = grey[h // 4 : h - h // 4, w // 4 : w - w // 4].astype(float)
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(lap.var()) if lap.size else 0.0


def motion(previous: np.ndarray | None, grey: np.ndarray) -> float:
    return 0.0 if previous is None else float(np.abs(grey.astype(float) - previous.astype(float)).mean())


def shrink(grey: np.ndarray, side: int = 32) -> np.ndarray:
    """Area means on a side x side grid."""
    rows = np.array_split(np.arange(grey.shape[0]), side)
    cols = np.array_split(np.arange(grey.shape[1]), side)
    return np.array([[grey[np.ix_(r, c)].mean() if len(r) and len(c) else 0.0 for c in cols] for r in rows])


def perceptual_hash(grey: np.ndarray) -> str:
    """16 hex digits: signs of the 8 x 8 lowest cosine coefficients against the median of all but the first."""
    n = np.arange(32)
    basis = np.cos(np.pi * (2 * n[None, :] + 1) * np.arange(8)[:, None] / 64)
    low = (basis @ shrink(grey) @ basis.T).ravel()
    bits = low > np.median(low[1:])
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def order_quad(points: np.ndarray) -> np.ndarray:
    """Corners as top left, top right, bottom right, bottom left."""
    total, apart = points.sum(1), points[:, 1] - points[:, 0]
    return points[[total.argmin(), apart.argmin(), total.argmax(), apart.argmax()]]


def pad_quad(points: np.ndarray, pad: float) -> np.ndarray:
    """Corners moved away from their centre by a factor of 1 + 2 * pad, within 0..1."""
    centre = points.mean(0)
    return np.clip(centre + (points - centre) * (1 + 2 * pad), 0, 1)


def compose(*maps: np.ndarray) -> np.ndarray:
    """One 3 x 3 projective map that does the given ones in turn: pixels are resampled once."""
    out = np.eye(3)
    for m in maps:
        out = m @ out
    return out / out[2, 2]


def project(matrix: np.ndarray, points: np.ndarray) -> np.ndarray:
    p = np.c_[points, np.ones(len(points))] @ matrix.T
    return p[:, :2] / p[:, 2:]

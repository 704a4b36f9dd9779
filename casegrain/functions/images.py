"""Measures of a page image and its preparation, on arrays of grey values."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def blur(grey: np.ndarray) -> float:
    """Variance of the Laplacian: small where no edge is sharp."""
    g = np.pad(grey.astype(float), 1, mode="reflect")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def contrast(grey: np.ndarray) -> float:
    return float(grey.astype(float).std())


def noise(grey: np.ndarray, size: int = 512) -> float:
    """Share of the spectrum's energy outside an eighth of the smaller side, at ``size`` squared."""
    rows, cols = (np.linspace(0, n - 1, size).astype(int) for n in grey.shape)
    power = np.abs(np.fft.fftshift(np.fft.fft2(grey[np.ix_(rows, cols)].astype(float))))
    y, x = np.ogrid[:size, :size]
    far = (y - size / 2) ** 2 + (x - size / 2) ** 2 > (size / 8) ** 2
    return float(min(1.0, max(0.0, power[far].sum() / max(power.sum(), 1e-9))))


def sharpen(grey: np.ndarray) -> np.ndarray:
    """Each pixel against its four neighbours."""
    g = np.pad(grey.astype(float), 1, mode="edge")
    out = 5 * g[1:-1, 1:-1] - g[:-2, 1:-1] - g[2:, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:]
    return np.clip(out, 0, 255).astype(np.uint8)


def stretch(grey: np.ndarray) -> np.ndarray:
    """Grey values spread over the whole range."""
    low, high = np.percentile(grey, [1, 99])
    return np.clip((grey.astype(float) - low) * 255 / max(high - low, 1.0), 0, 255).astype(np.uint8)


#: Preparations by name; more can be added.
STRATEGIES: dict[str, Callable[[np.ndarray], np.ndarray]] = {"gentle": lambda g: g, "standard": stretch, "aggressive": lambda g: sharpen(stretch(g))}


def prepare(grey: np.ndarray, strategy: str) -> np.ndarray:
    if strategy not in STRATEGIES:
        raise ValueError(f"no preparation {strategy!r}; there are {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](grey)

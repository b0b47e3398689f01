"""Lens fits to a calibration table: one row per pixel of a sensor, so they run on the driver."""

from __future__ import annotations

import numpy as np

from .stats import levenberg_marquardt


def brown(across_deg: np.ndarray, along_deg: np.ndarray, f: float, cx: float, cy: float, k: tuple, p: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Image coordinates of directions given by two angles."""
    x, y = np.tan(np.radians(across_deg)), np.tan(np.radians(along_deg))
    r = x * x + y * y
    radial = 1 + r * (k[0] + r * (k[1] + r * k[2]))
    u = x * radial + 2 * p[0] * x * y + p[1] * (r + 2 * x * x)
    v = y * radial + p[0] * (r + 2 * y * y) + 2 * p[1] * x * y
    return f * u + cx, f * v + cy


#: Parameters of each model, in order.
MODELS = {
    "line": ("f", "cx", "k1", "k2", "k3", "p1", "p2"),
    "full": ("f", "cx", "cy", "k1", "k2", "k3", "p1", "p2"),
    "smile": ("f", "cx", "cy", "k1", "k2", "k3", "p1", "p2", "s0", "s1", "s2", "s3", "s4"),
}


def residuals(model: str, values: np.ndarray, across_deg: np.ndarray, along_deg: np.ndarray, pixels: np.ndarray) -> np.ndarray:
    """Misses across and along: a line of pixels lies at 0, or, with smile, on a quartic of the pixel brought to -1..1."""
    q = dict(zip(MODELS[model], values, strict=True))
    u, v = brown(across_deg, along_deg, q["f"], q["cx"], q.get("cy", 0.0), (q["k1"], q["k2"], q["k3"]), (q["p1"], q["p2"]))
    if model == "smile":
        half = (pixels.max() - pixels.min()) / 2 or 1.0
        t = (pixels - pixels.min()) / half - 1
        v = v - np.polynomial.polynomial.polyval(t, [q[f"s{k}"] for k in range(5)])
    return np.concatenate([u - pixels, v])


def fit(model: str, across_deg: np.ndarray, along_deg: np.ndarray, pixels: np.ndarray) -> tuple[dict[str, float], float]:
    """Parameters and root mean square, from a straight-line start."""
    x = np.tan(np.radians(across_deg))
    f, cx = np.polyfit(x, pixels, 1)
    start = np.zeros(len(MODELS[model]))
    start[:2] = f, cx
    got, rms = levenberg_marquardt(lambda v: residuals(model, v, across_deg, along_deg, pixels), start, 300)
    return dict(zip(MODELS[model], map(float, got), strict=True)), rms

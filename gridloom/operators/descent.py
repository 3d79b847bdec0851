"""Minimising a cost whose value and gradient cost one pass over the data.

``minimise`` is a nonlinear conjugate gradient (Polak-Ribiere, never negative) with a line search to the strong Wolfe
conditions: steps are bracketed, then narrowed by cubic interpolation. Only parameters and gradients are on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Cost = Callable[[np.ndarray], tuple[float, np.ndarray]]


def _cubic(a: float, fa: float, da: float, b: float, fb: float, db: float) -> float:
    """Minimum of the cubic through two points with slopes, kept within the middle of the interval."""
    low, high = min(a, b), max(a, b)
    d1 = da + db - 3 * (fa - fb) / (a - b)
    root = d1 * d1 - da * db
    out = 0.5 * (a + b)
    if root >= 0:
        d2 = np.copysign(np.sqrt(root), b - a)
        if db - da + 2 * d2:
            out = b - (b - a) * (db + d2 - d1) / (db - da + 2 * d2)
    edge = 0.1 * (high - low)
    return float(min(max(out, low + edge), high - edge)) if np.isfinite(out) else 0.5 * (a + b)


def line_search(cost: Cost, x: np.ndarray, f0: float, g0: np.ndarray, d: np.ndarray, step: float, c1: float = 1e-4, c2: float = 0.1, most: int = 20) -> tuple[float, float, np.ndarray, int]:
    """A step along d that lowers the cost enough and flattens the slope; (step, cost, gradient, evaluations)."""
    slope0 = float(g0 @ d)
    last = (0.0, f0, slope0, g0)
    best = last
    low = high = None
    used = 0
    while used < most:
        f, g = cost(x + step * d)
        used += 1
        here = (step, f, float(g @ d), g)
        bad = not np.isfinite(f) or f > f0 + c1 * step * slope0
        if not bad and f < best[1]:
            best = here
        if low is None:
            if bad or (used > 1 and f >= last[1]):
                low, high = last, here
            elif abs(here[2]) <= -c2 * slope0:
                return step, f, g, used
            elif here[2] >= 0:
                low, high = here, last
            else:
                last, step = here, 2.5 * step
                continue
        elif bad or f >= low[1]:
            high = here
        elif abs(here[2]) <= -c2 * slope0:
            return step, f, g, used
        else:
            if here[2] * (high[0] - low[0]) >= 0:
                high = low
            low = here
        if abs(high[0] - low[0]) < 1e-14:
            break
        step = _cubic(*low[:3], *high[:3]) if np.isfinite(high[1]) else 0.5 * (low[0] + high[0])
    return best[0], best[1], best[3], used


def minimise(cost: Cost, x: np.ndarray, iterations: int = 50, tolerance: float = 1e-9) -> tuple[np.ndarray, list[float], int]:
    """The parameters, the cost after each iteration (never rising), and how many passes were made."""
    f, g = cost(x)
    d, costs, used = -g, [f], 1
    step = 1 / (1 + float(np.sqrt(g @ g)))
    for _ in range(iterations):
        slope = float(g @ d)
        if slope >= 0:
            d, slope = -g, -float(g @ g)
        if slope > -tolerance * tolerance:
            break
        t, f_new, g_new, n = line_search(cost, x, f, g, d, step)
        used += n
        if t == 0:
            if np.allclose(d, -g):
                break
            d = -g
            continue
        x = x + t * d
        beta = max(0.0, float(g_new @ (g_new - g)) / max(float(g @ g), 1e-300))
        d = -g_new + beta * d
        moved = f - f_new
        f, g = f_new, g_new
        costs.append(f)
        step = min(1.0, 1.01 * 2 * max(moved, 1e-300) / max(-float(g @ d), 1e-300)) if float(g @ d) < 0 else t
        if moved <= tolerance * (abs(f) + tolerance):
            break
    return x, costs, used


def numeric_gradient(cost: Callable[[np.ndarray], float], x: np.ndarray, h: float = 1e-4) -> np.ndarray:
    """Central differences."""
    out = np.empty_like(x, dtype=float)
    for k in range(x.size):
        e = np.zeros_like(x, dtype=float)
        e.flat[k] = h
        out.flat[k] = (cost(x + e) - cost(x - e)) / (2 * h)
    return out


def numeric_gradients(costs: Callable[[list[np.ndarray]], list[float]], x: np.ndarray, h: float = 1e-4) -> np.ndarray:
    """Central differences where one call takes all points, that is one pass over the data."""
    moved = [x + s * h * e for e in np.eye(x.size) for s in (1, -1)]
    c = np.array(costs(moved)).reshape(-1, 2)
    return (c[:, 0] - c[:, 1]) / (2 * h)

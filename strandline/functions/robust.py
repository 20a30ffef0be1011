"""Robust fits on numpy arrays, from their published definitions: Huber regression, power law, saturation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

TUNING = 1.345
MAD_TO_SIGMA = 1 / 0.6745
LEAST_SCALE = 1e-6


@dataclass(frozen=True)
class Line:
    slope: float
    intercept: float
    scale: float
    rmse: float
    downweighted: float
    n: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.slope * np.asarray(x, dtype=float) + self.intercept


def mad(r: np.ndarray) -> float:
    return float(np.median(np.abs(r - np.median(r))))


def auto_scale(r: np.ndarray) -> float:
    return max(TUNING * mad(r) * MAD_TO_SIGMA, LEAST_SCALE)


def huber_weights(r: np.ndarray, scale: float) -> np.ndarray:
    return np.minimum(1.0, scale / np.maximum(np.abs(r), 1e-300))


def huber_loss(r: np.ndarray, scale: float) -> float:
    a = np.abs(r)
    return float(np.where(a <= scale, a * a, 2 * scale * a - scale * scale).sum())


def _solve(design: np.ndarray, y: np.ndarray, scale: float | None, rounds: int = 60) -> np.ndarray:
    """Least squares, then reweighted to the Huber optimum at a fixed scale (from the first residuals if not given)."""
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    f = auto_scale(y - design @ beta) if scale is None else scale
    for _ in range(rounds):
        root = np.sqrt(huber_weights(y - design @ beta, f))
        new = np.linalg.lstsq(design * root[:, None], y * root, rcond=None)[0]
        done = np.allclose(new, beta, rtol=1e-12, atol=1e-14)
        beta = new
        if done:
            break
    return np.append(beta, f)


def huber_line(x: np.ndarray, y: np.ndarray, scale: float | None = None) -> Line:
    """Robust line; x is centred first, since day numbers are large. Raises ValueError below two rows."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    if len(x) < 2:
        raise ValueError("a line needs two rows")
    middle = x.mean()
    slope, level, f = _solve(np.column_stack([x - middle, np.ones(len(x))]), y, scale)
    r = y - (slope * (x - middle) + level)
    return Line(float(slope), float(level - slope * middle), float(f), float(np.sqrt(np.mean(r * r))), float(np.mean(np.abs(r) > f)), len(x))


def _search(loss: Callable[[float], float], low: float, high: float, points: int = 25, rounds: int = 45) -> float:
    """Minimum of a smooth function: the best of a grid, refined by golden section around it."""
    grid = np.linspace(low, high, points)
    k = int(np.argmin([loss(g) for g in grid]))
    a, b = grid[max(0, k - 1)], grid[min(points - 1, k + 1)]
    ratio = (np.sqrt(5) - 1) / 2
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = loss(c), loss(d)
    for _ in range(rounds):
        if fc <= fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = loss(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = loss(d)
    return float((a + b) / 2)


def _bent(r: np.ndarray, scale: float) -> tuple[np.ndarray, float]:
    """Residuals cut at the scale, whose sums the Huber loss drives to zero, and the loss itself."""
    cut = np.minimum(np.maximum(r, -scale), scale)
    return cut, float(cut @ (2 * r - cut))


def _best_share(r: np.ndarray, move: np.ndarray, scale: float) -> float:
    """The share of a move of all residuals by which the Huber loss falls most: where its slope, made of lines, is zero."""
    moved = move != 0
    ends = np.concatenate([(r[moved] - scale) / move[moved], (r[moved] + scale) / move[moved]])
    ends = np.sort(ends[ends > 0])
    fall = lambda share: float(_bent(r - share * move, scale)[0] @ move)
    low, high = 0, len(ends)
    while low < high:
        k = (low + high) // 2
        low, high = (k + 1, high) if fall(ends[k]) > 0 else (low, k)
    at, end = ends[low - 1] if low else 0.0, ends[low] if low < len(ends) else None
    here = fall(at)
    if end is None or here <= 0:
        return float(at)
    return float(at + (end - at) * here / (here - fall(end)))


def _even(x: np.ndarray) -> float:
    """The mean square up to which a spread of ``x`` is that of rounding."""
    return (1e-13 * max(float(x.max()), -float(x.min()))) ** 2


def _huber(x: np.ndarray | None, y: np.ndarray, a: float, c: float, scale: float, rounds: int = 200) -> tuple[float, float]:
    """(a, c) of the least Huber loss of y - (a * x + c) at a fixed scale, from a start; without ``x`` only c moves.

    The loss is a parabola as long as every row stays on its side of the scale: a step goes to the minimum of the parabola
    at hand, and the search ends at that minimum once no row has changed sides. Of a step that does not lower the loss the
    best share is taken. Where the rows within the scale tell no line, reweighting gives the direction.
    """
    r = y - c if x is None else y - (a * x + c)
    even = 0.0 if x is None else _even(x)
    cut, loss = _bent(r, scale)
    for _ in range(rounds):
        inner = (cut == r).astype(float)
        n, middle, spread, off = inner.sum(), 0.0, 0.0, x
        if x is not None and n >= 2:
            middle = inner @ x / n
            off = x - middle
            spread = (inner * off) @ off
        whole = bool(n) if x is None else n >= 2 and spread > n * even
        if not whole:
            weights = huber_weights(r, scale)
            da, dc = (0.0, cut.sum() / weights.sum()) if x is None else _weighted_line(x, r, weights)
        elif x is None:
            da, dc = 0.0, cut.sum() / n
        else:
            da = cut @ off / spread
            dc = cut.sum() / n - da * middle
        move = dc if x is None else da * x + dc
        to = r - move
        to_cut, to_loss = _bent(to, scale)
        if not whole or to_loss >= loss:
            share, whole = _best_share(r, move + np.zeros(len(r)), scale), False
            da, dc, to = share * da, share * dc, r - share * move
            to_cut, to_loss = _bent(to, scale)
            if not to_loss < loss:
                break
        a, c = a + da, c + dc
        settled = whole and np.array_equal(to_cut == to, cut == r) and np.array_equal(to > scale, r > scale)
        r, cut, loss = to, to_cut, to_loss
        if settled:
            break
    return a, c


def _weighted_line(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    root = np.sqrt(weights)
    a, c = np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]) * root[:, None], y * root, rcond=None)[0]
    return float(a), float(c)


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, level) of least squares; of equal x the least solution."""
    n = len(x)
    middle, mean = x.sum() / n, y.sum() / n
    off = x - middle
    spread = off @ off
    if spread <= n * _even(x):
        return _weighted_line(x, y, np.ones(n))
    slope = float(off @ (y - mean) / spread)
    return slope, float(mean - slope * middle)


def _least(x: np.ndarray, y: np.ndarray, scale: float | None, start: tuple[float, float] | None = None) -> tuple[float, float, float]:
    """(slope, level, scale) of the Huber optimum at a fixed scale (from the residuals of least squares if not given).

    An infinite scale is least squares. The optimum does not depend on the ``start``.
    """
    if scale is None or np.isinf(scale) or start is None:
        start = _line(x, y)
        if scale is None:
            scale = auto_scale(y - (start[0] * x + start[1]))
        if np.isinf(scale):
            return *start, scale
    return *_huber(x, y, *start, scale), scale


class _Shapes:
    """Robust fits of y = amplitude * shape + offset, amplitude in [0, ceiling], for one shape after another.

    Neighbouring shapes have neighbouring optima, so each fit starts from the last one.
    """

    def __init__(self, y: np.ndarray, scale: float | None, ceiling: float = np.inf):
        self.y, self.scale, self.ceiling = y, scale, ceiling
        self.last: tuple[float, float] | None = None

    def fit(self, shape: np.ndarray) -> tuple[float, float, float]:
        a, c, f = _least(shape, self.y, self.scale, self.last)
        self.last = a, c
        if not 0 <= a <= self.ceiling:
            a = min(max(a, 0.0), self.ceiling)
            rest = self.y - a * shape
            c = rest.sum() / len(rest)
            c = c if np.isinf(f) else _huber(None, rest, 0.0, c, f)[1]
        return float(a), float(c), float(f)

    def loss(self, shape: np.ndarray) -> float:
        a, c, f = self.fit(shape)
        r = self.y - (a * shape + c)
        return float(r @ r) if np.isinf(f) else _bent(r, f)[1]


def _shape_search(shape: Callable[[float], np.ndarray], y: np.ndarray, low: float, high: float, points: int, ceiling: float = np.inf) -> tuple[float, float, float]:
    """(amplitude, parameter, offset) of the best shape: by least squares, which give the scale, then robust at that scale."""
    plain = _Shapes(y, np.inf, ceiling)
    square = shape(_search(lambda q: plain.loss(shape(q)), low, high, points))
    a, c, _ = plain.fit(square)
    robust = _Shapes(y, auto_scale(y - (a * square + c)), ceiling)
    best = _search(lambda q: robust.loss(shape(q)), low, high, points)
    a, c, _ = robust.fit(shape(best))
    return a, best, c


def power_law(hours: np.ndarray, y: np.ndarray, exponent: float | None = None) -> tuple[float, float, float]:
    """(a, p, c) of y = a * t^p + c with 0.3 <= p <= 1.5 and a >= 0; for a given p the rest is a linear robust fit."""
    t = np.maximum(np.asarray(hours, dtype=float), 1e-3)
    y = np.asarray(y, dtype=float)
    if exponent is None:
        return _shape_search(lambda p: t**p, y, 0.3, 1.5, 25)
    a, c, _ = _Shapes(y, None).fit(t**exponent)
    return a, float(exponent), c


def saturation(days: np.ndarray, y: np.ndarray, ceiling: float = 50.0, fastest: float = 5.0) -> tuple[float, float, float]:
    """(A, k, C) of y = A * (1 - exp(-k * (x - x0))) + C with 0 <= A <= 50 and k >= 0, x0 the first day."""
    x = np.asarray(days, dtype=float) - float(days[0])
    y = np.asarray(y, dtype=float)
    a, q, c = _shape_search(lambda q: 1 - np.exp(-np.exp(q) * x), y, np.log(1e-5), np.log(fastest), 41, ceiling)
    return a, float(np.exp(q)), c


def line_crossing(m1: float, b1: float, m2: float, b2: float, earliest: float, latest: float, limit: float = 50.0) -> tuple[float, float] | None:
    """Where two lines meet, if within the days allowed and below the value limit."""
    if abs(m1 - m2) < 1e-12:
        return None
    root = (b2 - b1) / (m1 - m2)
    value = m2 * root + b2
    return (root, value) if earliest <= root <= latest and -limit < value < limit else None


def curve_crossing(curve: Callable, trend: Callable, start: float, days: float = 90.0, limit: float = 50.0) -> tuple[float, float] | None:
    """First crossing on a daily scan from ``start``, refined by bisection."""
    grid = np.linspace(start, start + days, 91)
    gap = np.asarray(curve(grid)) - np.asarray(trend(grid))
    for k in range(len(grid)):
        if gap[k] == 0:
            root = grid[k]
        elif k + 1 < len(grid) and gap[k] * gap[k + 1] < 0:
            a, b = grid[k], grid[k + 1]
            for _ in range(40):
                middle = (a + b) / 2
                at = float(np.asarray(curve(np.array([middle]))).item() - np.asarray(trend(np.array([middle]))).item())
                a, b = (middle, b) if at * gap[k] > 0 else (a, middle)
            root = (a + b) / 2
        else:
            continue
        value = float(np.asarray(trend(np.array([root]))).item())
        return (float(root), value) if -limit < value < limit else None
    return None

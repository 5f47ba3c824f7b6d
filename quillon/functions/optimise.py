"""Minimisers of smooth functions of a few parameters, beside the quasi-Newton one of the models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Values of as many functions as there are rows; the second argument names the functions.
Many = Callable[[np.ndarray, np.ndarray], np.ndarray]


def derivatives(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, value: np.ndarray, h: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Gradients (B, m) and Hessians (B, m, m) of f at the rows of x by symmetric differences; value is f(x)."""
    b, m = x.shape
    step = np.eye(m) * h
    up, down = (np.stack([f(x + sign * e) for e in step], 1) for sign in (1, -1))
    grad, hess = (up - down) / (2 * h), np.empty((b, m, m))
    for i in range(m):
        hess[:, i, i] = (up[:, i] - 2 * value + down[:, i]) / h**2
        for j in range(i):
            both = f(x + step[i] + step[j]) + f(x - step[i] - step[j])
            hess[:, i, j] = hess[:, j, i] = (both - up[:, i] - down[:, i] - up[:, j] - down[:, j] + 2 * value) / (2 * h**2)
    return grad, hess


def trust_region(f: Many, x: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minima (x, value, reached) of f from the rows of x, all at once, within low and high.

    Newton steps whose curvatures are made positive and raised by a damping of each row's own, which
    falls when the function does and rises when it does not. A row has settled when its step is small, and takes
    no further part.
    """
    x = np.clip(x, low, high)
    every = np.arange(len(x))
    value, damp, reached = f(x, every), np.full(len(x), 1e-3), np.zeros(len(x), bool)
    for _ in range(rounds):
        at = np.flatnonzero(~reached & (damp < 1e8))
        if not len(at):
            break
        here, was, lift = x[at], value[at], damp[at]
        grad, hess = derivatives(lambda y: f(y, at), here, was)  # noqa: B023
        size, axes = np.linalg.eigh(hess)
        turned = np.einsum("bji,bj->bi", axes, grad)
        size = np.abs(size) + lift[:, None] * (1 + np.abs(size))
        step = -np.einsum("bij,bj->bi", axes, turned / size)
        step *= np.minimum(1, 2 / np.maximum(np.abs(step).max(1), 1e-12))[:, None]
        new = np.clip(here + step, low, high)
        there = f(new, at)
        better = there <= was + 1e-9
        reached[at] = better & (np.abs(new - here).max(1) < 1e-5)
        x[at], value[at] = np.where(better[:, None], new, here), np.where(better, there, was)
        damp[at] = np.clip(np.where(better, lift / 5, lift * 8), 1e-9, 1e9)
    return x, value, reached


def simplex(f: Callable[[np.ndarray], float], x: np.ndarray, rounds: int = 4000, size: float = 0.3, tolerance: float = 1e-10) -> tuple[np.ndarray, bool]:
    """Minimum of f by reflecting, stretching and shrinking a simplex; needs no derivatives."""
    points = [x, *(x + size * e for e in np.eye(len(x)))]
    corner = sorted(((f(p), tuple(p)) for p in points))
    for _ in range(rounds):
        spread = max(np.abs(np.subtract(p, corner[0][1])).max() for _, p in corner)
        if corner[-1][0] - corner[0][0] < tolerance and spread < 1e-5:
            return np.array(corner[0][1]), True
        centre, worst = np.mean([p for _, p in corner[:-1]], 0), np.array(corner[-1][1])
        at = lambda t: centre + t * (worst - centre)  # noqa: B023, E731
        tried = {t: f(at(t)) for t in (-1.0,)}
        if tried[-1.0] < corner[0][0]:
            tried[-2.0] = f(at(-2.0))
        elif tried[-1.0] >= corner[-2][0]:
            t = -0.5 if tried[-1.0] < corner[-1][0] else 0.5
            tried[t] = f(at(t))
        t = min(tried, key=tried.get)
        if tried[t] < corner[-1][0]:
            corner[-1] = (tried[t], tuple(at(t)))
        else:
            best = np.array(corner[0][1])
            corner = [corner[0], *((f(q), tuple(q)) for q in (best + 0.5 * (np.array(p) - best) for _, p in corner[1:]))]
        corner.sort()
    return np.array(corner[0][1]), False

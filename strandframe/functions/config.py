"""Layered settings and small driver-side tables."""

from __future__ import annotations

import warnings
from pathlib import Path


def layered(defaults: dict, *layers: dict) -> dict:
    """Defaults overridden by each layer in turn; unknown keys are warned of and ignored, None overrides nothing."""
    out = dict(defaults)
    for layer in layers:
        for k, v in layer.items():
            if k not in defaults:
                warnings.warn(f"unknown setting {k}", stacklevel=2)
            elif v is not None:
                out[k] = v
    return out


def read_exchangeabilities(path: str, order: str, wanted: str | None = None) -> list[tuple[str, str, float]]:
    """(letter, letter, rate) of a lower-triangle rate file whose rows follow `order`, permuted to `wanted`; the diagonal is 0."""
    numbers = [float(x) for x in Path(path).read_text().split()]
    n = len(order)
    if len(numbers) < n * (n - 1) // 2:
        raise ValueError("the file is too short for its letters")
    if wanted is not None and set(wanted) - set(order):
        raise ValueError("unknown letters wanted")
    rate = {}
    at = 0
    for i in range(n):
        rate[order[i], order[i]] = 0.0
        for j in range(i):
            rate[order[i], order[j]] = rate[order[j], order[i]] = numbers[at]
            at += 1
    letters = wanted or order
    return [(a, b, rate[a, b]) for a in letters for b in letters]


def read_frequencies(path: str, order: str) -> dict[str, float]:
    """Letter frequencies of the row that follows the rates in such a file, normed to a sum of 1; even ones where the row is missing."""
    n = len(order)
    numbers = [float(x) for x in Path(path).read_text().split()][n * (n - 1) // 2 :]
    if len(numbers) < n:
        return {c: 1 / n for c in order}
    total = sum(numbers[:n])
    return {c: x / total for c, x in zip(order, numbers)}

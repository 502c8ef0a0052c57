"""Population stability of a moving window against a fixed reference, one value at a time."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np


def edges(reference: np.ndarray, bins: int = 10) -> np.ndarray:
    """The distinct quantiles at i / bins, between neighbours lo and hi as lo * (1 - d) + hi * d in one rounding.

    That is how the SQL engine takes them, to the last digit: a value that equals an edge, as values of few decimals do, falls into the same bin there.
    """
    x = np.sort(reference)
    at = [(len(x) - 1) * (i / bins) for i in range(bins + 1)]
    return np.unique([math.fma(x[int(r)], 1 - (r - int(r)), x[min(int(r) + 1, len(x) - 1)] * (r - int(r))) for r in at])


def psi(reference: np.ndarray, current: np.ndarray, bins: int = 10) -> float:
    """Over the reference's quantile bins, the outer ones open; 0 where either is empty or the reference has one value."""
    if not len(reference) or not len(current):
        return 0.0
    cut = edges(reference, bins)
    if len(cut) < 2:
        return 0.0
    r, c = (np.bincount(np.searchsorted(cut[1:-1], x, "right"), minlength=len(cut) - 1) / len(x) for x in (reference, current))
    r, c = np.maximum(r, 1e-6), np.maximum(c, 1e-6)
    return float(((c - r) * np.log(c / r)).sum())


def severity(value: float, threshold: float = 0.25) -> float:
    """0 at the threshold, 1 at twice it."""
    return float(np.clip((value - threshold) / threshold, 0, 1))


def severity_of_score(score: float, floor: float = 0.0, ceil: float = 0.3) -> float:
    """The poorer a detector's score, the nearer to 1."""
    return float(np.clip((ceil - score) / (ceil - floor), 0, 1)) if ceil > floor else float(score < ceil)


def spawn_count(how_bad: float, base: int = 2, extra: int = 10, most: int = 12) -> int:
    return min(most, base + round(extra * float(np.clip(how_bad, 0, 1))))


@dataclass
class Monitor:
    """State of one series: its first values, its last ones, and the index last computed (every ``every`` rows, and while it is 0)."""

    reference_size: int = 300
    window: int = 300
    bins: int = 10
    every: int = 50
    seen: int = 0
    reference: list[float] = field(default_factory=list)
    ring: list[float] = field(default_factory=list)
    value: float = 0.0

    def push(self, x: float) -> float | None:
        """The index after x; None while the windows fill."""
        self.seen += 1
        if len(self.reference) < self.reference_size:
            self.reference.append(x)
            return None
        self.ring = [*self.ring[-(self.window - 1) :], x] if self.window > 1 else [x]
        if len(self.ring) < self.window:
            return None
        if self.value == 0.0 or self.seen % self.every == 0:
            self.value = psi(np.array(self.reference), np.array(self.ring), self.bins)
        return self.value

"""Genetic search over boxes of parameters: a whole generation is scored in one call, so one Spark job can serve it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Gene:
    name: str
    low: float
    high: float
    integer: bool = False


def trader_genes(signals: list[str]) -> list[Gene]:
    """A weight for each signal, the mode (0.5 or more follows), the threshold and the size."""
    return [Gene(n, 0.0, 1.0) for n in signals] + [Gene("mode", 0.0, 1.0), Gene("threshold", 1.0, 8.0), Gene("size", 0.1, 1.0)]


def policy_genes(signals: list[str], weight: float = 3.0) -> list[Gene]:
    return [Gene(f"w_{n}", -weight, weight) for n in signals] + [Gene("bias", -1.0, 1.0)]


def search(genes: list[Gene], score: Callable[[np.ndarray], np.ndarray], size: int = 20, generations: int = 15, seed: int = 0, rate: float = 0.3, spread: float = 0.1, elite: int = 2) -> tuple[dict[str, float], float, list[float]]:
    """(best genome, its score, best so far by generation). ``score`` takes a matrix with a row for each genome.

    The elite stays; each other child mixes two winners of tournaments of three gene by gene, and some of its genes move by a normal step. The first of equal
    scores counts. The same seed gives the same result.
    """
    rng = np.random.default_rng(seed)
    low, high = (np.array([getattr(g, k) for g in genes], float) for k in ("low", "high"))
    whole = np.array([g.integer for g in genes])
    fit = lambda p: np.where(whole, np.rint(np.clip(p, low, high)), np.clip(p, low, high))
    pop = fit(rng.uniform(low, high, (size, len(genes))))
    best, top, history = pop[0], -np.inf, []
    for _ in range(generations):
        got = np.asarray(score(pop), float)
        got = np.where(np.isnan(got), -np.inf, got)
        order = np.argsort(-got, kind="stable")
        if got[order[0]] > top:
            best, top = pop[order[0]].copy(), float(got[order[0]])
        history.append(top)
        n, k = size - min(elite, size), min(3, size)
        duels = np.argsort(rng.random((2 * n, size)), axis=1)[:, :k]
        won = duels[np.arange(2 * n), got[duels].argmax(1)]
        child = np.where(rng.random((n, len(genes))) < 0.5, pop[won[:n]], pop[won[n:]])
        child = child + (rng.random(child.shape) < rate) * rng.normal(0, spread, child.shape) * (high - low)
        pop = np.concatenate((pop[order[: size - n]], fit(child)))
    return {g.name: float(x) for g, x in zip(genes, best, strict=True)}, top, history

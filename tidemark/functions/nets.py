"""Small networks in numpy: a recurrent one over windows, a layered one over states. Gradients are written out; Adam fits them from a fixed seed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def adam(parts: list[np.ndarray], gradient: Callable[[list[np.ndarray]], list[np.ndarray]], steps: int, rate: float) -> None:
    """Moves ``parts`` in place against ``gradient``, ``steps`` times."""
    first, second = ([np.zeros_like(p) for p in parts] for _ in range(2))
    for t in range(1, steps + 1):
        for p, g, a, b in zip(parts, gradient(parts), first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Recurrent:
    """A layer of long short-term memory over the values of a window, and a number from its last state. ``label``: the number is a probability."""

    def __init__(self, hidden: int = 32, seed: int = 0, label: bool = False):
        rng, self.hidden, self.label = np.random.default_rng(seed), hidden, label
        scale = 1 / np.sqrt(hidden)
        # Gates in the order in, forget, out, new; the last part weighs the state for the output.
        self.parts = [rng.uniform(-scale, scale, s) for s in ((1, 4 * hidden), (hidden, 4 * hidden), (4 * hidden,), (hidden,), (1,))]

    def _run(self, x: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, list[tuple]]:
        wx, wh, b, wo, bo = parts
        n, m = len(x), self.hidden
        h, c, seen = np.zeros((n, m)), np.zeros((n, m)), []
        for t in range(x.shape[1]):
            s = x[:, t : t + 1] @ wx + h @ wh + b
            gate, new = _sigmoid(s[:, : 3 * m]), np.tanh(s[:, 3 * m :])
            before, c = c, gate[:, m : 2 * m] * c + gate[:, :m] * new
            seen.append((h, before, gate, new, np.tanh(c)))
            h = gate[:, 2 * m :] * seen[-1][4]
        out = h @ wo + bo[0]
        return (_sigmoid(out) if self.label else out), [*seen, (h,)]

    def predict(self, x: np.ndarray, at_once: int = 4096) -> np.ndarray:
        return np.concatenate([self._run(x[i : i + at_once], self.parts)[0] for i in range(0, len(x), at_once)]) if len(x) else np.zeros(0)

    def gradient(self, x: np.ndarray, y: np.ndarray, parts: list[np.ndarray], weight: np.ndarray | None = None) -> list[np.ndarray]:
        """Of the mean squared error, for labels of the mean cross entropy; ``weight`` by row."""
        wx, wh, b, wo, _ = parts
        got, seen = self._run(x, parts)
        m = self.hidden
        d_out = (got - y) * ((1.0 if self.label else 2.0) / len(x)) * (1.0 if weight is None else weight)
        (last,) = seen.pop()
        out = [np.zeros_like(p) for p in parts]
        out[3], out[4] = last.T @ d_out, np.array([d_out.sum()])
        dh, dc = np.outer(d_out, wo), np.zeros_like(last)
        for t in range(x.shape[1] - 1, -1, -1):
            h, before, gate, new, squashed = seen[t]
            i, f, o = gate[:, :m], gate[:, m : 2 * m], gate[:, 2 * m :]
            dc = dc + dh * o * (1 - squashed * squashed)
            ds = np.concatenate((dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new * new)), 1)
            out[0] += x[:, t : t + 1].T @ ds
            out[1] += h.T @ ds
            out[2] += ds.sum(0)
            dh, dc = ds @ wh.T, dc * f
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 15, rate: float = 0.01, weight: np.ndarray | None = None) -> Recurrent:
        adam(self.parts, lambda parts: self.gradient(x, y, parts, weight), epochs, rate)
        return self


class Layered:
    """Two hidden layers (tanh) and a number for each row."""

    def __init__(self, width: int, hidden: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        sizes = [(width, hidden), (hidden, hidden), (hidden, 1)]
        self.parts = [p for a, b in sizes for p in (rng.uniform(-1, 1, (a, b)) / np.sqrt(a), np.zeros(b))]

    def run(self, x: np.ndarray, parts: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        w1, b1, w2, b2, w3, b3 = parts or self.parts
        h1 = np.tanh(x @ w1 + b1)
        h2 = np.tanh(h1 @ w2 + b2)
        return (h2 @ w3 + b3)[:, 0], [h1, h2]

    def back(self, x: np.ndarray, hidden: list[np.ndarray], d: np.ndarray, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Gradients from ``d``, the derivative by each row's number."""
        (h1, h2), (_, _, w2, _, w3, _) = hidden, parts
        d = d[:, None]
        d2 = (d @ w3.T) * (1 - h2 * h2)
        d1 = (d2 @ w2.T) * (1 - h1 * h1)
        return [x.T @ d1, d1.sum(0), h1.T @ d2, d2.sum(0), h2.T @ d, d.sum(0)]


def policy_gradient(position: np.ndarray, ret: np.ndarray, cost: float, penalty: float, periods: int) -> np.ndarray:
    """Derivative by each position of: minus the Sharpe ratio, plus ``penalty`` times the downside deviation, of the profit over ``ret`` less costs."""
    n, year = len(ret), np.sqrt(periods)
    held = position[:n]
    step = np.sign(np.diff(np.concatenate(([0.0], held))))
    pnl = held * ret - cost * np.abs(np.diff(np.concatenate(([0.0], held))))
    mean, sd = pnl.mean(), pnl.std(ddof=1) if n > 1 else 0.0
    low = np.minimum(pnl, 0)
    down = np.sqrt((low * low).mean() + 1e-12)
    by_pnl = -year * (1 / n / (sd + 1e-8) - mean / (sd + 1e-8) ** 2 * (pnl - mean) / max((n - 1) * sd, 1e-12)) + penalty * year * low / (n * down)
    out = np.zeros(len(position))
    out[:n] = by_pnl * (ret - cost * step)
    out[: n - 1] += by_pnl[1:] * cost * step[1:]
    return out


def train_policy(state: np.ndarray, price: np.ndarray, hidden: int = 16, epochs: int = 400, rate: float = 0.01, penalty: float = 1.0, cost: float = 0.0003, periods: int = 252, seed: int = 0) -> Layered:
    """A policy whose positions are tanh of the network's numbers, fitted on one series."""
    net, ret = Layered(state.shape[1], hidden, seed), price[1:] / price[:-1] - 1

    def gradient(parts: list[np.ndarray]) -> list[np.ndarray]:
        out, hidden_ = net.run(state, parts)
        p = np.tanh(out)
        return net.back(state, hidden_, policy_gradient(p, ret, cost, penalty, periods) * (1 - p * p), parts)

    adam(net.parts, gradient, epochs, rate)
    return net

"""Rolling signals as native window expressions: one shuffle and one sort serve all of them.

A signal is null until its window is full. ``value`` is the input column; windows run along ``seq`` within ``series_id``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a piece of a series.
PIECE = 8192


def along():
    return Window.partitionBy("series_id").orderBy("seq")


def last(n: int):
    return along().rowsBetween(-(n - 1), 0)


def _checked(w: int, least: int = 2) -> int:
    if w < least:
        raise ValueError(f"a window of {w} is below {least}")
    return w


def full(w: int, expr: Column) -> Column:
    return F.when(F.count("value").over(last(w)) == w, expr)


def momentum(w: int) -> Column:
    return full(_checked(w), (F.col("value") - F.lag("value", w - 1).over(along())) / (w - 1))


def volatility(w: int) -> Column:
    return full(_checked(w), F.stddev_samp("value").over(last(w)))


def acceleration(w: int) -> Column:
    lag = lambda k: F.lag("value", k).over(along())
    return full(_checked(w, 3), ((F.col("value") - lag(1)) - (lag(w - 2) - lag(w - 1))) / (w - 2))


def zscore(w: int) -> Column:
    s = F.stddev_samp("value").over(last(w))
    return full(_checked(w), F.when(s == 0, 0.0).otherwise((F.col("value") - F.avg("value").over(last(w))) / s))


def sharpness(w: int) -> Column:
    span = F.max("value").over(last(w)) - F.min("value").over(last(w))
    return full(_checked(w), F.when(span == 0, 0.0).otherwise((F.col("value") - F.avg("value").over(last(w))) / span))


def envelope_weights(n: int) -> list[float]:
    """Weights that give the imaginary part of the analytic signal at the last of n points."""
    out = []
    for i in range(1, n + 1):
        m = n - i
        if m == 0:
            out.append(0.0)
        elif n % 2 == 0:
            out.append(2 / n / math.tan(math.pi * m / n) if m % 2 else 0.0)
        else:
            out.append((math.cos(math.pi * m / n) - (-1) ** m) / (n * math.sin(math.pi * m / n)))
    return out


# Signals of the whole window: rows of x are full windows.
def entropy_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Shannon entropy in bits over even bins between the window's ends.

    Windows with the same counts in other bins have the same entropy but for rounding, which decides on the first of equal peaks: bins are added one by one, as in the SQL.
    """
    low, w = x.min(1, keepdims=True), x.shape[1]
    span = x.max(1, keepdims=True) - low
    place = np.minimum(((x - low) / np.where(span == 0, 1, span) * bins).astype(np.int64), bins - 1)
    count = np.bincount((np.arange(len(x))[:, None] * bins + place).ravel(), minlength=len(x) * bins).reshape(len(x), bins)
    parts = np.array([0.0] + [-(k / w) * math.log2(k / w) for k in range(1, w + 1)])
    total = np.zeros(len(x))
    for k in count.T:
        total += parts[k]
    return total


def autocorrelation_of(x: np.ndarray, lag: int = 1) -> np.ndarray:
    d = x - x.mean(1, keepdims=True)
    below = (d * d).sum(1)
    still = x.max(1) == x.min(1)
    return np.where(still, 0.0, (d[:, :-lag] * d[:, lag:]).sum(1) / np.where(below == 0, 1, below))


def envelope_of(x: np.ndarray) -> np.ndarray:
    """Modulus of the analytic signal of the centred window at its last point, in closed form; equal windows give equal bits wherever they stand in ``x``."""
    other = np.zeros(len(x))
    for values, weight in zip(x.T, envelope_weights(x.shape[1]), strict=True):
        other += values * weight
    return np.hypot(x[:, -1] - x.mean(1), other)


def flatness_of(x: np.ndarray) -> np.ndarray:
    """Geometric over arithmetic mean of the power spectrum without its constant term."""
    w = x.shape[1]
    angle = 2 * np.pi * np.outer(np.arange(w), np.arange(1, w // 2 + 1)) / w
    d = x - x.mean(1, keepdims=True)
    power = (d @ np.cos(angle)) ** 2 + (d @ np.sin(angle)) ** 2
    total = power.sum(1, keepdims=True)
    still = (x.max(1) == x.min(1)) | (total[:, 0] <= 0)
    held = np.maximum(power, np.where(total > 0, total, 1) * 1e-12)
    return np.where(still, 0.0, np.exp(np.log(held).mean(1)) / held.mean(1))


def _fma(a: np.ndarray, b: float, c: np.ndarray) -> np.ndarray:
    """a * b + c, rounded once."""
    split = 134217729.0  # halves a double's digits, so products of halves are exact
    p, high, b_high = a * b, a * split, b * split
    high, b_high = high - (high - a), b_high - (b_high - b)
    low, b_low = a - high, b - b_high
    lost = ((high * b_high - p) + high * b_low + low * b_high) + low * b_low
    total = p + c
    back = total - p
    out = total + ((p - (total - back)) + (c - back) + lost)
    return np.where(np.isfinite(out), out, total)


def sums_of(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and sum of squared distances from the mean of the rows of x, whose windows begin at the places ``first`` of their series, with the SQL engine's rounding.

    Where a signal equals the edge of its band in exact arithmetic, or a value its mean, rounding decides. That engine sums a window by parts (values before the first whole group of ``GROUP``
    places, each whole group, the rest) and combines them from left to right; so do these, digit for digit up to windows of GROUP * GROUP values.
    """
    w = x.shape[1]
    sums, squares = np.empty(len(x)), np.empty(len(x))

    def walk(values: np.ndarray, count: int, total: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple:
        for v in values:
            count += 1
            new = m + (v - m) / count
            total, m, d = total + v, new, d + (v - new) * (v - m)
        return count, total, m, d

    with np.errstate(all="ignore"):
        for k in np.unique(first % GROUP):
            rows = first % GROUP == k
            v = np.ascontiguousarray(x[rows].T)
            none = (0, *np.zeros((3, v.shape[1])))
            count, total, m, d = walk(v[: int(-k) % GROUP], *none)
            while w - count >= GROUP:
                n, t, m2, d2 = walk(v[count : count + GROUP], *none)
                total, both, away = total + t, count + n, m2 - m
                m, d = (_fma(away, n / both, m), d2 + d + away * away * n * count / both) if count else (m2, d2)
                count = both
            _, total, m, d = walk(v[count:], count, total, m, d)
            sums[rows], squares[rows] = total, d
    return sums, squares


def moments_of(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of the rows of x, as :func:`sums_of`."""
    sums, squares = sums_of(x, first)
    with np.errstate(invalid="ignore"):
        return sums / x.shape[1], np.sqrt(squares / (x.shape[1] - 1))


def zscore_of(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    mean, s = moments_of(x, first)
    return np.where(s == 0, 0.0, (x[:, -1] - mean) / np.where(s == 0, 1, s))


#: Places of a group whose aggregates the SQL engine shares among windows.
GROUP = 16
OF_WINDOW = {"entropy": lambda x: entropy_of(x, 8), "entropy_fine": lambda x: entropy_of(x, 16), "entropy_coarse": lambda x: entropy_of(x, 4), "autocorrelation": autocorrelation_of, "hilbert": envelope_of, "spectral_flatness": flatness_of}
#: Of whole windows and the places of their first values; plain window expressions serve where no other signal needs whole windows.
OF_PLACED = {volatility: lambda x, first: moments_of(x, first)[1], zscore: zscore_of}


def of_windows(w: int, names: dict[str, Callable[[np.ndarray], np.ndarray]], placed: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] | None = None) -> Column:
    """A struct of the named signals of the last w values, null until there are w: the windows go to Arrow once and are rows of a matrix there. ``placed`` also get the ``seq`` of each window's first value."""
    placed = placed or {}

    def run(windows: pa.Array, seq: pa.Array) -> pa.Array:
        flat, size = windows.flatten().to_numpy(zero_copy_only=False), np.diff(windows.offsets.to_numpy())
        full = size == w
        start = (windows.offsets.to_numpy()[:-1] - windows.offsets[0].as_py())[full]
        x = flat[start[:, None] + np.arange(w)].astype(float) if full.any() else np.zeros((0, w))
        first = seq.to_numpy(zero_copy_only=False)[full].astype(np.int64) - (w - 1)
        out = []
        for n, f in (names | placed).items():
            col = np.zeros(len(size))
            col[full] = (f(x, first) if n in placed else f(x)) if len(x) else 0
            out.append(pa.array(col, mask=~full))
        return pa.StructArray.from_arrays(out, names=[*names, *placed])

    call = F.arrow_udf(run, T.StructType([T.StructField(n, T.DoubleType()) for n in (*names, *placed)]))
    return call(F.collect_list("value").over(last(_checked(w))), F.col("seq"))


def entropy(w: int, bins: int = 8) -> Column:
    _checked(bins)
    return of_windows(w, {"s": lambda x: entropy_of(x, bins)}).getField("s")


def autocorrelation(w: int, lag: int = 1) -> Column:
    if not 1 <= lag < w:
        raise ValueError("the lag lies between 1 and the window")
    return of_windows(w, {"s": lambda x: autocorrelation_of(x, lag)}).getField("s")


def envelope(w: int) -> Column:
    return of_windows(w, {"s": envelope_of}).getField("s")


def flatness(w: int) -> Column:
    return of_windows(w, {"s": flatness_of}).getField("s")


#: In registration order.
SIGNALS = {
    "momentum": momentum, "volatility": volatility, "entropy": entropy, "entropy_fine": lambda w: entropy(w, 16), "entropy_coarse": lambda w: entropy(w, 4),
    "zscore": zscore, "acceleration": acceleration, "autocorrelation": autocorrelation, "hilbert": envelope, "spectral_flatness": flatness,
}


def state_vector(names: list[str], fill: float = float("nan")) -> Column:
    """The named signals as an array, ``fill`` for missing ones."""
    if not names:
        raise ValueError("names are needed")
    return F.array(*[F.coalesce(n, F.lit(fill)) for n in names])


def is_ready(names: list[str]) -> Column:
    """Whether every named signal is there."""
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])


def standardize(v: Column, centers: Column, scales: Column) -> Column:
    """(v - center) / scale by component; 0 where the scale is 0."""
    pairs = F.zip_with(centers, scales, lambda c, s: F.struct(c.alias("c"), s.alias("s")))
    return F.zip_with(v, pairs, lambda x, p: F.when(p.s == 0, 0.0).otherwise((x - p.c) / p.s))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))


def next_values(w: int) -> Column:
    """The w values before a row as an array, null until there are w: what a forecaster learns the row's value from."""
    before = F.collect_list("value").over(along().rowsBetween(-_checked(w, 1), -1))
    return F.when(F.size(before) == w, before)


def unit_window(w: int) -> Column:
    """The last w values, of mean 0 and population deviation 1 (zeros without spread); null until there are w."""
    over = last(_checked(w))
    a, mean, sd = F.collect_list("value").over(over), F.avg("value").over(over), F.stddev_pop("value").over(over)
    return full(w, F.transform(a, lambda x: F.when(sd > 0, (x - mean) / sd).otherwise(0.0)))


def in_pieces(rows: DataFrame, f: Callable[[DataFrame], DataFrame], before: int, after: int = 0, size: int = PIECE) -> DataFrame:
    """``f`` over pieces of each series: ``size`` rows and what stands up to ``before`` rows before and ``after`` behind them.

    So a long series is many tasks. ``f`` sees pieces as series, must keep ``series_id`` and ``seq`` and may look that far around a row; its rows outside the piece go again.
    """
    piece = F.explode(F.sequence(F.greatest(F.floor((F.col("seq") - after) / size), F.lit(0).cast("long")), F.floor((F.col("seq") + before) / size)))
    cut = rows.withColumn("piece", piece).withColumn("series_id", F.struct("series_id", "piece")).drop("piece")
    out = f(cut).where(F.floor(F.col("seq") / size) == F.col("series_id.piece"))
    return out.withColumn("series_id", F.col("series_id.series_id"))


def with_signals(series: DataFrame, w: int = 30, names: tuple[str, ...] = tuple(SIGNALS)) -> DataFrame:
    """``series`` with a column for each named signal. All signals of whole windows share one pass through Arrow."""
    whole = {n: OF_WINDOW[n] for n in names if n in OF_WINDOW}
    placed = {n: OF_PLACED[SIGNALS[n]] for n in names if whole and n not in whole and SIGNALS[n] in OF_PLACED}

    def add(rows: DataFrame) -> DataFrame:
        out = rows.withColumns({n: SIGNALS[n](w) for n in names if n not in whole and n not in placed})
        if whole:
            out = out.withColumn("of_window", of_windows(w, whole, placed))
        return out.select(*rows.columns, *[F.col(f"of_window.{n}").alias(n) if n in whole or n in placed else n for n in names])

    return in_pieces(series, add, w)

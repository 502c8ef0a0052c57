"""Paper-traded strategies over series: rolling scales, positions, profit, drawdown, scorecards."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.signals import along, in_pieces, last, momentum, sums_of
from tidemark.operators.detection import weighted_detector


def _scale(value: Column, window: int) -> tuple[Column, Column, Column]:
    w = last(window)
    return F.avg(value).over(w), F.stddev_pop(value).over(w), F.count(value).over(w) >= max(5, window // 2)


def rolling_z(value: Column, window: int = 60, clip: float = 5.0) -> Column:
    mean, sd, ok = _scale(value, window)
    return F.when(ok & (sd > 1e-12), F.greatest(F.lit(-clip), F.least(F.lit(clip), (value - mean) / sd))).otherwise(0.0)


def rolling_scale(value: Column, window: int = 60, clip: float = 5.0) -> Column:
    _, sd, ok = _scale(value, window)
    return F.when(ok & (sd > 1e-12), F.greatest(F.lit(-clip), F.least(F.lit(clip), value / sd))).otherwise(0.0)


def moving_moments(x: np.ndarray, there: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, population deviation, number) of those of the last ``window`` values that are there, at each row; means and deviations of none are 0."""
    view = lambda a: np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(window - 1, a.dtype), a)), window)
    own, ok = view(np.where(there, x, 0.0)), view(there)
    count = ok.sum(1)
    n = np.maximum(count, 1)
    mean = own.sum(1) / n
    d = np.where(ok, own - mean[:, None], 0.0)
    return mean, np.sqrt((d * d).sum(1) / n), count


def moving_scale(x: np.ndarray, window: int = 60, clip: float = 5.0, scaled: bool = False) -> np.ndarray:
    """``rolling_z`` (``scaled``: ``rolling_scale``) of a piece of a series at once."""
    mean, sd, count = moving_moments(x, np.ones(len(x), bool), window)
    out = (x if scaled else x - mean) / np.where(sd > 1e-12, sd, 1.0)
    out = np.where(np.isnan(sd), clip, np.clip(out, -clip, clip))
    return np.where((count >= max(5, window // 2)) & ~(sd <= 1e-12), out, 0.0)


def with_returns(prices: DataFrame) -> DataFrame:
    """``ret``: simple return on the row before; null at the first."""
    return prices.withColumn("ret", F.col("value") / F.lag("value").over(along()) - 1)


def realised_volatility(window: int = 20) -> Column:
    w = last(window)
    return F.when(F.count("ret").over(w) >= max(5, window // 2), F.stddev_pop("ret").over(w)).otherwise(0.0)


def volatility_target(vol: Column, target: float = 0.1, periods: int = 252) -> Column:
    """What a position is multiplied with; 0 without volatility."""
    return F.when(vol > 1e-9, F.lit(target / math.sqrt(periods)) / vol).otherwise(0.0)


def sized(raw: Column, scale: Column, most: float = 1.0) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), raw * scale))


def trend_position(z: Column, band: float = 0.5, size: float = 1.0, short: bool = True) -> Column:
    """Long above the band, short (or out) below it, else as before; nothing at first."""
    signal = F.when(z > band, size).when(z < -band, -size if short else 0.0)
    return F.coalesce(F.last(signal, ignorenulls=True).over(along().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))


def momentum_position(score: Column, threshold: float, k: int = 5, follow: bool = True, size: float = 1.0) -> Column:
    past = F.lag("value", k).over(along())
    way = F.signum(F.col("value") / past - 1) * (size if follow else -size)
    return F.when((score >= threshold) & past.isNotNull() & (past > 0), way).otherwise(0.0)


def with_profit(rows: DataFrame, fee: float = 0.0001, slip: float = 0.0002) -> DataFrame:
    """``pnl`` of holding ``position`` over the next step, less costs on its change; null at a series' last row, which changes ``turn`` all the same."""
    w = along()
    turn = F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0)))
    out = rows.withColumns({"turn": turn, "next": F.lead("value").over(w)})
    return out.withColumn("pnl", F.col("position") * (F.col("next") / F.col("value") - 1) - (fee + slip) * F.col("turn")).drop("next")


def scorecard(rows: DataFrame, periods: int = 252) -> DataFrame:
    """(series_id, sharpe, total_return, max_drawdown, exposure, time_in_market, turnover, trades) of rows with pnl, position and turn.

    Profit is that of all rows but the last; exposure (mean size), time in the market (share of positions that are not 0), turnover and trades are of all rows.
    """
    w = along().rowsBetween(Window.unboundedPreceding, 0)
    eq = rows.withColumn("equity", F.product(1 + F.col("pnl")).over(w))
    eq = eq.withColumn("fall", F.when(F.col("pnl").isNotNull(), F.col("equity") / F.max("equity").over(w) - 1))
    sd = F.stddev_pop("pnl")
    return eq.groupBy("series_id").agg(
        F.when(sd > 0, F.avg("pnl") / sd * math.sqrt(periods)).otherwise(0.0).alias("sharpe"), F.coalesce(F.product(1 + F.col("pnl")) - 1, F.lit(0.0)).alias("total_return"), F.coalesce(F.min("fall"), F.lit(0.0)).alias("max_drawdown"),
        F.avg(F.abs("position")).alias("exposure"), F.avg((F.col("position") != 0).cast("int")).alias("time_in_market"), F.avg("turn").alias("turnover"), F.count(F.when(F.col("turn") != 0, 1)).alias("trades"),
    )


def fitness(card: DataFrame, penalty: float = 3.0) -> DataFrame:
    """``fitness``: the Sharpe ratio less a penalty on the largest fall."""
    return card.withColumn("fitness", F.col("sharpe") + penalty * F.col("max_drawdown"))


def active_fitness(card: DataFrame, least: int = 20) -> DataFrame:
    """``fitness``: the Sharpe ratio, 5 less where there are fewer trades than ``least``."""
    return card.withColumn("fitness", F.when(F.col("trades") < least, F.col("sharpe") - 5.0).otherwise(F.col("sharpe")))


def trend_overlay(prices: DataFrame, w: int = 30, band: float = 0.25, short: bool = False, size: float = 1.0, z: int = 60) -> DataFrame:
    """``prices`` with ``z`` of the momentum (0 in its warm-up) and the ``position`` that follows it."""
    rows = in_pieces(prices.select("series_id", "seq", "ts", "value"), lambda x: x.withColumn("signal", F.coalesce(momentum(w), F.lit(0.0))).withColumn("z", rolling_z(F.col("signal"), z)), w + z)
    return rows.withColumn("position", trend_position(F.col("z"), band, size, short))


def backtest(scored: DataFrame, threshold: float = 3.0, size: float = 1.0, follow: bool = True, k: int = 5, fee: float = 0.0001, slip: float = 0.0002) -> DataFrame:
    """``scored`` (value, z) with the ``position`` that acts where z reaches the threshold, and its profit after costs."""
    return with_profit(scored.withColumn("position", momentum_position(F.col("z"), threshold, k, follow, size)), fee, slip)


def trading_agent(prices: DataFrame, weights: dict[str, float], threshold: float, size: float = 1.0, follow: bool = True, k: int = 5, w: int = 30) -> DataFrame:
    """``prices`` with the weighted detector's ``z`` and the ``position`` that follows or fades the last ``k`` steps' move where z reaches the threshold."""
    scored = weighted_detector(prices.select("series_id", "seq", "ts", "value"), weights, w)
    return scored.withColumn("position", momentum_position(F.col("z"), threshold, k, follow, size))


def policy_positions(states: DataFrame, weights: list[float], bias: float = 0.0, leverage: float = 1.0, most: float = 1.0, scaled: bool = True) -> DataFrame:
    """``position`` of a linear policy over ``state`` arrays: tanh of the weighted sum, times ``scale`` if ``scaled``, held within ``most``."""
    raw = F.aggregate(F.zip_with("state", F.array(*[F.lit(float(x)) for x in weights]), lambda a, b: a * b), F.lit(float(bias)), lambda a, x: a + x)
    target = leverage * F.tanh(raw)
    return states.withColumn("position", sized(target, F.col("scale") if scaled else F.lit(1.0), most))


def walk_forward(n: int, folds: int = 3, first: float = 0.5) -> list[tuple[int, int, int, int]]:
    """(train from, train to, test from, test to) of expanding folds; the last takes the remainder; none when too short."""
    start = int(n * first)
    step = (n - start) // folds if folds > 0 else 0
    if step < 1 or start < 1:
        return []
    return [(0, start + i * step, start + i * step, n if i == folds - 1 else start + (i + 1) * step) for i in range(folds)]


def noncausal_residual(series: DataFrame, w: int = 20) -> DataFrame:
    """``robust``: the absolute distance from a centred moving average (missing neighbours count 0), less the series' median distance, in scaled median deviations.

    Signed: most rows are near 0. Without spread the scale is that of a deviation of 1; a series of one row scores 0.
    """
    before = w // 2

    def distances(piece: pa.Table) -> pa.Table:
        piece = piece.sort_by("seq")
        seq, value = piece["seq"].to_numpy(), piece["value"].to_numpy().astype(float)
        none = piece["value"].is_null().to_numpy()
        x, total = np.where(none, 0.0, value), np.empty(len(value))
        whole = slice(before, max(before, len(x) - (w - 1 - before)))
        if len(x) >= w:
            total[whole] = sums_of(np.lib.stride_tricks.sliding_window_view(x, w), seq[whole] - before)[0]
        for i in [*range(min(before, len(x))), *range(whole.stop, len(x))]:
            start = max(0, i - before)
            total[i] = sums_of(x[None, start : i + w - before], seq[start : start + 1])[0][0]
        return piece.append_column("r", pa.array(np.abs(value - total / w), mask=none))

    # Where a value stands often in a row, distances are nothing but rounding: that of the SQL engine.
    rows = in_pieces(series, lambda x: x.groupBy("series_id").applyInArrow(distances, T.StructType([*x.schema.fields, T.StructField("r", T.DoubleType())])), w, w)
    mid = rows.groupBy("series_id").agg(F.median("r").alias("m"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(mid, "series_id")
    mad = rows.groupBy("series_id").agg(F.median(F.abs(F.col("r") - F.col("m"))).alias("mad"))
    scale = 1.4826 * F.when(F.col("mad") == 0, 1.0).otherwise(F.col("mad"))
    return rows.join(mad, "series_id").withColumn("robust", F.when(F.col("n") < 2, 0.0).otherwise((F.col("r") - F.col("m")) / scale)).drop("r", "m", "n", "mad")

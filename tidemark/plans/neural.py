"""Networks over many series: a task fits or applies one to a series; a pooled forecaster is fitted on a bounded sample of windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.nets import Recurrent, train_policy
from tidemark.operators import detection as D
from tidemark.operators import market as M
from tidemark.plans import models

SCORED = "series_id string, seq long, ts timestamp_ntz, value double, residual double"
#: Windows that a pooled network is fitted on, at most.
SAMPLE = 50_000


def _next(z: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of w values and what follows them."""
    if len(z) <= w:
        return np.zeros((0, w)), np.zeros(0)
    return np.lib.stride_tricks.sliding_window_view(z, w)[:-1], z[w:]


def _scaled(x: np.ndarray, prefix: int) -> np.ndarray:
    ref = x[:prefix] if prefix > 0 else x
    return (x - ref.mean()) / (ref.std() or 1.0)


def prefix_of(n: int, share: float = 0.15, most: int = 750) -> int:
    return min(int(n * share), most)


def forecast_residuals(series: DataFrame, w: int = 20, hidden: int = 32, epochs: int = 15, rate: float = 0.01, seed: int = 0, model: Recurrent | None = None) -> DataFrame:
    """``residual``: the absolute distance of each value from a recurrent network's forecast, in units of the series' probation.

    Without ``model`` a network is fitted on the probation of each series (fewer than ten windows there: all residuals 0); with it, that one forecasts all series.
    """
    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        x = g["value"].to_numpy()
        prefix, out, net = prefix_of(len(x)), np.zeros(len(x)), model
        z = _scaled(x, prefix)
        if net is None:
            train = _next(z[:prefix], w)
            net = Recurrent(hidden, seed).fit(*train, epochs, rate) if len(train[0]) >= 10 else None
        seen, follows = _next(z, w)
        if net is not None and len(seen):
            out[w:] = np.abs(follows - net.predict(seen))
        return g.assign(residual=out)

    return series.select("series_id", "seq", "ts", "value").groupBy("series_id").applyInPandas(one, SCORED)


def neural_scores(series: DataFrame, resid_window: int = 200, least: int = 20, **network) -> DataFrame:
    """``forecast_residuals`` with ``z``, the distance of each residual from the ones before it."""
    return D.residual_z(forecast_residuals(series, **network), window=resid_window, least=least)


def pool_forecaster(series: DataFrame, w: int = 20, hidden: int = 32, epochs: int = 15, rate: float = 0.01, seed: int = 0, sample: int = SAMPLE) -> Recurrent | None:
    """One network for a domain: fitted on windows of all series, each scaled by itself; of more than ``sample`` windows on those that come first by hash. None without windows."""
    def windows(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        seen, follows = _next(_scaled(g["value"].to_numpy(), 0), w)
        if not len(seen):
            return pd.DataFrame({"series_id": [], "seq": [], "x": [], "y": []}, dtype=object)
        return pd.DataFrame({"series_id": g["series_id"].iloc[0], "seq": g["seq"].to_numpy()[w:], "x": [*map(list, seen)], "y": follows})

    rows = series.select("series_id", "seq", "value").groupBy("series_id").applyInPandas(windows, "series_id string, seq long, x array<double>, y double")
    some = rows.orderBy(F.xxhash64("series_id", "seq"), "series_id", "seq").limit(sample).toPandas()
    return Recurrent(hidden, seed).fit(np.stack(some["x"].to_list()), some["y"].to_numpy(), epochs, rate) if len(some) else None


def fit_window_classifier(rows: DataFrame, hidden: int = 16, epochs: int = 40, rate: float = 0.02, seed: int = 0, sample: int = SAMPLE) -> Recurrent:
    """A recurrent network that tells the label of ``window_examples`` rows; classes weigh alike. Fitted on ``sample`` rows by hash at most."""
    some = rows.orderBy(F.xxhash64("series_id", "seq"), "series_id", "seq").limit(sample).select("x", "label").toPandas()
    y = some["label"].to_numpy(float)
    if len(set(y)) < 2:
        raise ValueError("both labels are needed")
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    return Recurrent(hidden, seed, label=True).fit(np.stack(some["x"].to_list()), y, epochs, rate, weight)


def window_probabilities(model: Recurrent, rows: DataFrame) -> DataFrame:
    """``rows`` with ``p``, the probability of the label."""
    @F.pandas_udf("double")
    def p(x: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.stack(x.to_list())) if len(x) else [])

    return rows.withColumn("p", p("x"))


def best_threshold(scored: DataFrame, windows: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)) -> tuple[float, float]:
    """(threshold, NAB score) of the best threshold on ``scored`` rows with ``p``, the first of equal ones; one job for all."""
    flags = scored.select("series_id", "seq", "p", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).where("p >= threshold").drop("p")
    got = D.nab_normalized(D.nab_raw(scored, flags, windows, by="threshold", values=list(thresholds)), "threshold").collect()
    best = max(got, key=lambda r: (r["score"], -r["threshold"]))
    return best["threshold"], best["score"]


def cross_validate(rows: DataFrame, windows: DataFrame, k: int = 5, seed: int = 0, **network) -> list[float]:
    """NAB score of each fold's series by a network fitted on the others, at the threshold that is best on those."""
    names = [r["series_id"] for r in rows.select("series_id").distinct().collect()]
    out = []
    for fold in models.fold_series(names, k, seed):
        inside = F.col("series_id").isin(fold)
        model = fit_window_classifier(rows.where(~inside), **network)
        threshold, _ = best_threshold(window_probabilities(model, rows.where(~inside)), windows)
        got = models.nab_of_flags(window_probabilities(model, rows.where(inside)), windows.where(inside), threshold).first()
        out.append(0.0 if got is None else got["score"])
    return out


def neural_positions(states: DataFrame, train: float = 1.0, seed: int = 0, epochs: int = 400, most: float = 1.0) -> DataFrame:
    """``position`` of a layered policy that is fitted on the first ``train`` share of each series of ``states`` rows."""
    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        state, price = np.stack(g["state"].to_list()), g["value"].to_numpy()
        n = max(3, int(len(g) * train))
        if len(g) < 3:
            return g[["series_id", "seq", "value"]].assign(position=0.0)
        net = train_policy(state[:n], price[:n], epochs=epochs, seed=seed)
        return g[["series_id", "seq", "value"]].assign(position=np.clip(np.tanh(net.run(state)[0]), -most, most))

    return states.select("series_id", "seq", "value", "state").groupBy("series_id").applyInPandas(one, "series_id string, seq long, value double, position double")


def neural_card(states: DataFrame, **policy) -> DataFrame:
    """Scorecards of ``neural_positions``."""
    return M.scorecard(M.with_profit(neural_positions(states, **policy)))
